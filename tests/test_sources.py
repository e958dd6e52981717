"""Sources, sinks, connectors and streams on small files."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from marlstone.operators import quality
from marlstone.sources import connectors, readers, sinks
from marlstone.streaming import ingest


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding) if isinstance(text, str) else text)
    return str(path)


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in members.items():
            z.writestr(n, b)
    return out.getvalue()


def test_stock_list(spark, tmp_path):
    p = put(tmp_path / "s.csv", 'h1,h2,h3,h4,h5,h6,h7,h8,h9\n1301,"A, Inc",x,1,s17,10,Sector,Big,\n1301,B,x,1,s17,10,Sector,Big,Prime\n,C,x,1,s,10,Sector,Big,P\n1302,D,x,1,s17,10,,Big,P\n1303,E,x,1,s17,10,Fish,Big,\n')
    got = {r.code: (r.name, r.market) for r in readers.stock_list(spark, p).collect()}
    assert got == {"1301": ("B", "Prime"), "1303": ("E", "不明")}


def test_factor_and_curve(spark, tmp_path):
    p = put(tmp_path / "f.csv", "date,mom_percent\n1994-01-31,1.5\n1994-02-28,-2\n")
    assert [tuple(r) for r in readers.factor_csv(spark, p, "mom_percent").collect()] == [("1994-01", 0.015), ("1994-02", -0.02)]
    for bad in ("date,mom_percent\n1994-02-28,1\n1994-01-31,1\n", "date,mom_percent\n1994-01-31,1\n1994-01-30,1\n"):
        with pytest.raises(quality.QualityError):
            readers.factor_csv(spark, put(tmp_path / f"g{len(bad)}{bad[25]}{hash(bad)}.csv", bad), "mom_percent")
    c = readers.curve_csv(spark, put(tmp_path / "c.csv", "Date,1 Mo,10 Yr\n01/02/2020,N/A,1.9\n01/03/2020,1.5,\n"), "nominal")
    assert [(str(r.date), r["1_mo"], r["10_yr"]) for r in c.collect()] == [("2020-01-02", None, 1.9), ("2020-01-03", 1.5, None)]
    assert [r.value for r in readers.fred_csv(spark, put(tmp_path / "fr.csv", "DATE,X\n2020-01-01,.\n2020-01-02,5\n2020-01-03,-1\n")).collect()] == [5.0]
    with pytest.raises(quality.QualityError):
        readers.exact_columns(c, ["curve"])


def test_zips(spark, tmp_path):
    issuers = "ダウンロード日,2026\n\n証券コード,提出者名,業種\n12340,甲社,水産\n72030,乙社,輸送\n".encode("cp932")
    put(tmp_path / "z/a.zip", zipped(**{"x.csv": issuers}))
    files = spark.read.format("binaryFile").load(str(tmp_path / "z"))
    parse = readers.parse_issuer_zip({"code": ["証券コード"], "name": ["提出者名"], "industry": ["業種"], "english": ["英名"]}, ["証券コード", "提出者名"])
    got = sorted(tuple(r) for r in readers.from_files(files, parse, "code string, name string, industry string, english string").collect())
    assert got == [("12340", "甲社", "水産", None), ("72030", "乙社", "輸送", None)]
    row = "\t".join(["r1", "20260101", "c", "d.com", "http://u", *[""] * 8, "TEST CORP#3;B", "e"])
    put(tmp_path / "n/b.zip", zipped(**{"g.csv": (row + "\nshort\trow\n").encode()}))
    news = readers.from_files(spark.read.format("binaryFile").load(str(tmp_path / "n")), readers.parse_news_zip, readers.NEWS).collect()
    assert [(r.record, r.domain, r.organisations) for r in news] == [("r1", "d.com", "TEST CORP#3;B")]
    table = readers.parse_first_monthly_table("note\n\n,SMB,HML\n199201, 1.0, 2.0\n199202,-1,0\n\n Annual\n,SMB\n1992,3\n")
    assert table == [{"month": "1992-01", "SMB": 1.0, "HML": 2.0}, {"month": "1992-02", "SMB": -1.0, "HML": 0.0}]


def test_xlsx():
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>2004</v></c><c r="C2"><v>5.5</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>2005e</t></is></c><c r="B3"><v>6</v></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Year</t></si></sst>'
    book = readers.parse_xlsx(zipped(**{"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": shared}))
    assert book["sheet1"][0] == ["Year"] and readers.best_year_table(book) == [(2004, 5.5), (2005, 6.0)]


def test_html_and_xml(spark):
    html = "<p>x</p><script>no</script><table><tr><th>Year</th><td>a&amp;b</td></tr><tr><td>2020</td><td> 1 <b>2</b></td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, None)], "id long, h string")
    assert [(r.row_no, r.cells) for r in readers.html_rows(df, "id", "h").orderBy("row_no").collect()] == [(0, ["Year", "a&b"]), (1, ["2020", "1 2"])]
    assert {r.key: r.text for r in readers.html_text(df, "id", "h").collect()}[2] == ""
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>1</id><title>A\n b</title><updated>u</updated><category term="q-fin"/></entry></feed>'
    r = readers.feed_rows(spark.createDataFrame([(feed,)], "x string"), "x").first()
    assert (r.id, r.title, r.summary, r.categories) == ("1", "A b", None, ["q-fin"])
    x = spark.createDataFrame([("<a><b>one</b></a>",)], "x string").select(readers.xml_text(F.col("x"), "/a/c", "/a/b").alias("t")).first()
    assert x.t == "one"


def test_json_logs_cache(spark, tmp_path):
    assert {r.key: r.value for r in readers.json_map(spark, put(tmp_path / "m.json", '{"a":"1","b":"2"}')).collect()} == {"a": "1", "b": "2"}
    assert [r.v for r in readers.json_records(spark, put(tmp_path / "r.json", '{"records":[{"v":1},{"v":2}]}'), "v int").collect()] == [1, 2]
    put(tmp_path / "logs/a.log", "one\nerror two\n")
    put(tmp_path / "logs/b.log", "error three\nfour\n")
    assert [r.value for r in readers.log_tail(spark, str(tmp_path / "logs"), 2, "error").collect()] == ["error two", "error three"]
    cache = spark.createDataFrame([("API/x", '{"data":[{"k":"1"}]}', 1), ("other", '{"data":[]}', 2)], "key string, value string, created_at long")
    assert [r.record for r in readers.cache_pages(cache, "%api%").collect()] == [{"k": "1"}]
    assert readers.list_files(spark, str(tmp_path / "logs"), "a.log").count() == 1
    assert readers.projection_contract(json.dumps({"schema_version": "1", "generated_at": "t", "records": [{"id": 1}], "provenance": {}}), "1")["records"]
    with pytest.raises(quality.QualityError, match="record ids"):
        readers.projection_contract(json.dumps({"schema_version": "1", "generated_at": "t", "records": [{"id": 1}, {"id": 1}], "provenance": {}}), "1")


def test_prices(spark):
    p = spark.createDataFrame([("A", "2020-01-01", "1.5", "3"), ("A", "2020-01-02", "0", "3"), ("B", "2020-01-01", "2", "1")], "code string, date string, AdjustmentClose string, AdjustmentVolume string")
    assert readers.normalize_prices(p).count() == 2
    with pytest.raises(quality.QualityError):
        readers.normalize_prices(p.union(p))
    with pytest.raises(Exception):
        readers.normalize_prices(p.withColumn("AdjustmentClose", F.lit("x"))).collect()
    b = spark.createDataFrame([("2020-01-01", 1.0), ("2020-01-02", 2.0)], "Date string, Close double")
    assert readers.normalize_benchmark(b).count() == 1
    bars = p.select(F.col("code").alias("Code"), F.col("date").alias("Date"), F.col("AdjustmentClose").cast("double").alias("c"))
    assert readers.latest_prices(bars, "Code", "Date", "c").count() == 2 and readers.price_history(bars, "A", "2020-01-01", "2020-01-01").count() == 1


def test_npz(spark, tmp_path):
    import numpy as np

    np.savez(tmp_path / "t.npz", w=np.eye(2), codes=np.array(["a"]))
    rows = readers.npz_long(spark, str(tmp_path / "t.npz")).collect()
    assert len(rows) == 4 and sum(r.value for r in rows) == 2


def test_connectors(spark):
    calls = []

    def fetch(url):
        calls.append(url)
        return (404, "") if "gone" in url else (500, "") if "bad" in url else (200, url.upper())

    assert connectors.fetch_one(fetch, "gone") is None
    with pytest.raises(connectors.FetchError):
        connectors.fetch_one(fetch, "bad")
    wanted = spark.createDataFrame([("a", "ua"), ("b", "ub"), ("c", "gone")], "key string, url string")
    cache = spark.createDataFrame([("a", "old", 10)], "key string, value string, created_at long")
    plain = lambda url: (404, "") if "gone" in url else (200, url.upper())
    assert sorted((r.key, r.value) for r in connectors.read_through(wanted, cache, plain, 100).collect()) == [("a", "old"), ("b", "UB")]
    assert sorted((r.key, r.value) for r in connectors.read_through(wanted, cache, plain, 100, ttl=5).collect()) == [("a", "UA"), ("b", "UB")]
    assert connectors.first_provider([("x", lambda: 1 / 0), ("y", lambda: [1]), ("z", lambda: [1, 2])], 2) == ("z", [1, 2])
    with pytest.raises(connectors.FetchError, match="division.*; y: 1 rows"):
        connectors.first_provider([("x", lambda: 1 / 0), ("y", lambda: [1])], 2)
    data = list(range(25))
    assert list(connectors.offset_pages(lambda at, n: data[at : at + n], 10)) == data
    pages = {None: ([1], "a"), "a": ([2], None)}
    assert list(connectors.keyset_pages(pages.__getitem__)) == [1, 2]
    with pytest.raises(connectors.FetchError):
        list(connectors.keyset_pages(lambda c: ([1], "same")))
    items = [{"id": i} for i in range(7)]
    assert connectors.complete_pages(lambda at: (7, items[at : at + 3])) == items
    with pytest.raises(connectors.FetchError):
        connectors.complete_pages(lambda at: (7 + at, items[at : at + 3]))
    assert connectors.optional_number(lambda: {"mid_price": "0.45"}, "mid", "mid_price") == 0.45
    with pytest.raises(connectors.FetchError):
        connectors.optional_number(lambda: {"mid": 2}, "mid")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    m = sinks.write_with_manifest(df, f"{tmp_path}/m")
    assert m["rows"] == 2 and json.loads(sinks.read_text(spark, f"{tmp_path}/m/manifest.json")) == m
    with pytest.raises(Exception, match="exist"):
        sinks.write_with_manifest(df, f"{tmp_path}/m")
    e = {"snapshot_id": "s1", "reuse_key": "k", "observed_at": "t"}
    schema = "snapshot_id string, reuse_key string, observed_at string"
    sinks.append_entry(spark, f"{tmp_path}/l", e, schema)
    sinks.append_entry(spark, f"{tmp_path}/l", {**e, "snapshot_id": "s2", "observed_at": "t2"}, schema)
    for bad in (e, {**e, "snapshot_id": "s3"}):
        with pytest.raises(quality.QualityError):
            sinks.append_entry(spark, f"{tmp_path}/l", bad, schema)
    a, fresh = sinks.write_snapshot(spark, f"{tmp_path}/s", {"x": 1, "generated_at": "1"})
    b, again = sinks.write_snapshot(spark, f"{tmp_path}/s", {"x": 1, "generated_at": "2"})
    c, other = sinks.write_snapshot(spark, f"{tmp_path}/s", {"x": 2, "generated_at": "2"})
    assert fresh and not again and a == b and other and c != a
    assert sinks.stable_view(df.orderBy(F.desc("k")), ["k"]) == ("k,v\n1,a\n2,b\n", sinks.canonical_json([{"k": 1, "v": "a"}, {"k": 2, "v": "b"}], 2))
    assert sinks.canonical_json({"b": "é", "a": 1}) == '{"a":1,"b":"é"}' and sinks.markdown_view(df, ["k"]).count("\n") == 4


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(i % 6, f"2026-01-01 00:{i:02d}:00", float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id int, t string, v double").withColumn("t", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(str(src))
    known = spark.createDataFrame([(0,)], "doc_id int")
    run = lambda: ingest.ingest(ingest.watch(spark, str(src), df.schema), "doc_id", f"{tmp_path}/out", f"{tmp_path}/cp", known=known).awaitTermination()
    run()
    df.limit(3).coalesce(1).write.mode("append").parquet(str(src))
    run()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 3, 4, 5] and ingest.audit_counts(spark, f"{tmp_path}/out").count() >= 1
    w = ingest.windowed(ingest.watch(spark, str(src), df.schema), "t", "5 minutes", [], F.count("*").alias("n"), late="0 seconds")
    ingest.drain(w.select("window.start", "n"), f"{tmp_path}/cp2", f"{tmp_path}/w").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/w").agg(F.sum("n")).first()[0] >= 10
    ingest.drain(ingest.running_totals(ingest.watch(spark, str(src), df.schema), "doc_id", "v"), f"{tmp_path}/cp3", f"{tmp_path}/r").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/r").groupBy("key").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == 15


def test_lines_keep_their_order_in_split_files(spark, tmp_path):
    """Blocks of a few hundred bytes are read in any order; the last line still wins."""
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.log").write_text("".join(f"a line {i:05d} {'x' * (i % 40)}\n" for i in range(400)))
    (tmp_path / "logs/b.log").write_text("".join(f"b line {i:05d} {'y' * (i % 7)}\n" for i in range(300)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = [r.value[:12] for r in readers.log_tail(spark, str(tmp_path / "logs"), 320).collect()]
        assert got == [f"a line {i:05d}" for i in range(380, 400)] + [f"b line {i:05d}" for i in range(300)]
        text = "code,name,name_en,sector17_code,sector17,sector_code,sector,scale,market\n" + "".join(f"{i % 5},n{i},,,,,s{'z' * (i % 30)},,\n" for i in range(300))
        (tmp_path / "list.csv").write_text(text)
        assert sorted(r.name for r in readers.stock_list(spark, str(tmp_path / "list.csv")).collect()) == [f"n{i}" for i in range(295, 300)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
