"""Sources. Text formats that Spark reads natively stay native; archives and odd encodings are read by mapInPandas over binaryFile rows."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterable, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import quality
from ..operators import relational as R
from ..operators import timeseries as TS
from ..session import shipped
from .textindex import TextIndex

STOCK_LIST = "code string, name string, name_en string, sector17_code string, sector17 string, sector_code string, sector string, scale string, market string"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True, **options) -> DataFrame:
    """Quoted CSV with a given schema: nothing is inferred, no pass is lost."""
    return spark.read.options(header=header, quote='"', escape='"', mode="FAILFAST", **options).schema(schema).csv(path)


def naive_split(line: Column, n: int) -> list[Column]:
    """The first n fields of a line that is cut at every comma, in quotes or not."""
    parts = F.split(line, ",")
    return [F.get(parts, F.lit(i)) for i in range(n)]


def line_order() -> Column:
    """Where a line of text files stands: file, block of the file, and place in the block. Tasks read blocks in any order, but each from front to end."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def stock_list(spark: SparkSession, path: str, schema: str = STOCK_LIST) -> DataFrame:
    """Stocks with code, name and sector; a missing market is '不明'; of equal codes the last line counts, by file name and line."""
    df = spark.read.options(header=True, mode="PERMISSIVE").schema(schema).csv(path).withColumn("__o", line_order())
    ok = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("code", "name", "sector")]
    return R.last_wins(df.filter(ok[0] & ok[1] & ok[2]).withColumn("market", S.first_filled(F.col("market"), F.lit("不明"))), ["code"], "__o").drop("__o")


def statements(df: DataFrame, code: str, date: str, doc_type: str, kind: str = "FYFinancialStatements", order: Column | None = None) -> DataFrame:
    """The latest statement of a kind of each code; of equal dates the first in an order (line_order() for a frame of files), else that of the smallest row."""
    at = F.to_json(F.struct("*")) if order is None else order
    return R.latest_per_key(df.withColumn("__o", at).filter(F.col(doc_type).contains(kind)), [code], date, "__o").drop("__o")


def latest_prices(df: DataFrame, code: str, date: str, close: str) -> DataFrame:
    """The latest positive close of every code, as one aggregate."""
    return df.filter(F.col(close) > 0).groupBy(code).agg(F.max_by(close, date).alias(close), F.max(date).alias(date))


def price_history(df: DataFrame, code: str, low: str, high: str, code_col: str = "Code", date: str = "Date") -> DataFrame:
    """Bars of a four- or five-digit code in a closed range of dates, in order."""
    return df.filter(F.col(code_col).isin(code, f"{code}0") & F.col(date).between(low, high)).orderBy(date)


def json_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """One JSON object as rows (key, value)."""
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return one.select(F.explode("m").alias("key", "value"))


def list_files(spark: SparkSession, path: str, part: str, n: int = 10) -> DataFrame:
    """The first n paths, in order, that contain a text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.filter(F.col("path").contains(part)).orderBy("path").limit(n)


def cache_pages(df: DataFrame | TextIndex, like: str, n: int = 500, element: str = "map<string,string>") -> DataFrame:
    """Records of the newest n cached JSON pages whose key matches, without regard to case. Over a TextIndex of `key` only the blocks that can match are read."""
    found = df.filter(F.col("key").ilike(like)) if isinstance(df, DataFrame) else df.ilike("key", like)
    newest = found.orderBy(F.desc("created_at"), "key").limit(n)
    return newest.select("key", "created_at", F.explode(F.from_json("value", f"data array<{element}>")["data"]).alias("record"))


def factor_csv(spark: SparkSession, path: str, column: str, date: str = "date") -> DataFrame:
    """(month, value) of a percent column; months must be unique and in order, and dates valid."""
    df = read_csv(spark, path, f"{date} string, {', '.join(f'{c} double' for c in _header(spark, path) if c != date)}")
    df = df.select(S.month_key(F.col(date)).alias("month"), (F.col(column) / 100).alias("value"), line_order().alias("ord"))
    bad = quality.violations(spark, quality.unique_key(df, ["month"]), quality.require_columns(df, ["month", "value"]), quality.chronological(df.withColumn("k", F.lit(1)), ["k"], "ord", "month"))
    quality.assert_empty(bad)
    return df.select("month", "value")


def _header(spark: SparkSession, path: str) -> list[str]:
    return next(csv.reader([spark.read.text(path).first().value]))


def exact_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, if it has just these columns."""
    if sorted(df.columns) != sorted(columns):
        raise quality.QualityError(f"columns {sorted(df.columns)} for {sorted(columns)}")
    return df


ALIASES = {"AdjustmentClose": "Close", "AdjustmentVolume": "Volume", "code": "Code", "date": "Date"}


def normalize_prices(df: DataFrame) -> DataFrame:
    """(Date, Code, Close, Volume) of a frame with known aliases; prices must be positive, volumes not negative, keys unique, numbers numbers."""
    for a, b in ALIASES.items():
        if a in df.columns and (b not in df.columns or a == b):
            df = df.withColumnRenamed(a, b)
    if lacking := quality.missing_columns(df, ["Date", "Code", "Close", "Volume"]):
        raise quality.QualityError(f"missing {lacking}")
    df = df.select(F.col("Date").cast("date").alias("Date"), F.col("Code").cast("string").alias("Code"), F.col("Close").cast("double").alias("Close"), F.col("Volume").cast("double").alias("Volume"))
    quality.assert_empty(quality.unique_key(df, ["Date", "Code"]))
    return df.filter((F.col("Close") > 0) & (F.col("Volume") >= 0))


def normalize_benchmark(df: DataFrame) -> DataFrame:
    """(Date, benchmark) of daily closes: the log return."""
    df = df.select(F.col("Date").cast("date").alias("Date"), F.col("Close").cast("double").alias("Close")).filter("Close > 0")
    quality.assert_empty(quality.unique_key(df, ["Date"]))
    return TS.log_return(df, [], "Date", "Close", out="benchmark").filter("benchmark IS NOT NULL").select("Date", "benchmark")


CODECS = ("cp932", "utf-8-sig", "utf-8")


def decode(raw: bytes, codecs: Sequence[str] = CODECS) -> str:
    """The text in the first codec that fits."""
    for c in codecs:
        try:
            return raw.decode(c)
        except UnicodeDecodeError:
            continue
    raise ValueError(f"none of {codecs} decodes the text")


def from_files(files: DataFrame, parse: Callable[[str, bytes], Iterable[dict]], schema: str) -> DataFrame:
    """Rows that parse(path, content) makes of binaryFile rows; each file is one row of one task."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(parse(path, bytes(content)))
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    return shipped(files.select("path", "content")).mapInPandas(run, schema)


def zip_members(content: bytes, suffix: str = "") -> Iterable[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(z.namelist()):
            if name.lower().endswith(suffix):
                yield name, z.read(name)


def parse_issuer_zip(fields: dict[str, Sequence[str]], required: Sequence[str]) -> Callable[[str, bytes], Iterable[dict]]:
    """A parser of zipped CSV tables whose header line, somewhere near the top, has all required headings. fields: name -> headings it goes by."""

    def parse(path, content):
        for _, raw in zip_members(content, ".csv"):
            lines = list(csv.reader(io.StringIO(decode(raw))))
            for i, head in enumerate(lines[:20]):
                if set(required) <= {h.strip() for h in head}:
                    at = {n: next((head.index(h) for h in names if h in head), None) for n, names in fields.items()}
                    for line in lines[i + 1 :]:
                        if any(x.strip() for x in line):
                            yield {n: (line[k].strip() or None) if k is not None and k < len(line) else None for n, k in at.items()}
                    break
            else:
                raise ValueError("no header line")

    return parse


NEWS = "record string, observed string, domain string, url string, organisations string"


def parse_news_zip(path: str, content: bytes) -> Iterable[dict]:
    """Rows of tab-separated news records with at least 15 fields."""
    for _, raw in zip_members(content):
        for line in raw.decode("utf-8", "replace").splitlines():
            x = line.split("\t")
            if len(x) >= 15:
                yield {"record": x[0], "observed": x[1], "domain": x[3], "url": x[4], "organisations": x[13]}


def parse_first_monthly_table(text: str) -> list[dict]:
    """Rows (month, then each heading) of the first table whose lines begin with YYYYMM; it ends where such lines do."""
    rows, head, last = [], None, None
    for line in text.splitlines():
        x = [c.strip() for c in line.split(",")]
        if re.fullmatch(r"\d{6}", x[0]):
            head = head or last
            rows.append({"month": f"{x[0][:4]}-{x[0][4:]}", **{h: float(v) for h, v in zip(head[1:], x[1:], strict=False) if h}})
        elif rows:
            break
        elif len(x) > 1:
            last = x
    return rows


def curve_csv(spark: SparkSession, path: str, curve: str) -> DataFrame:
    """(curve, date, tenors): N/A, NA and blanks are null, headings become column names."""
    head = _header(spark, path)
    df = read_csv(spark, path, ", ".join(f"`{h}` string" for h in head))
    tenors = [F.when(F.col(f"`{h}`").isin("N/A", "NA", ""), None).otherwise(F.col(f"`{h}`")).cast("double").alias(S.column_name(h)) for h in head[1:]]
    return df.select(F.lit(curve).alias("curve"), S.us_date(F.col(f"`{head[0]}`")).alias("date"), *tenors)


def fred_csv(spark: SparkSession, path: str) -> DataFrame:
    """(date, value, integral) of positive values; '.' and blanks go. integral: whether the value is a whole number, which views write as one."""
    df = read_csv(spark, path, "date string, raw string").select("date", S.parse_double(F.nullif(F.col("raw"), F.lit("."))).alias("value"))
    return df.filter("value > 0").withColumn("integral", F.round("value") == F.col("value"))


def parse_xlsx(content: bytes) -> dict[str, list[list[str | None]]]:
    """Cells of each sheet of a workbook, as text."""
    import xml.etree.ElementTree as ET

    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        out = {}
        for name in sorted(n for n in z.namelist() if re.match(r"xl/worksheets/[^/]+\.xml$", n)):
            rows = []
            for row in ET.fromstring(z.read(name)).iter(f"{{{ns['m']}}}row"):
                cells: list[str | None] = []
                for c in row.findall("m:c", ns):
                    col = 0
                    for ch in re.match("[A-Z]+", c.get("r", "A"))[0]:
                        col = col * 26 + ord(ch) - 64
                    v = c.find("m:v", ns)
                    text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                    cells += [None] * (col - 1 - len(cells)) + [text]
                rows.append(cells)
            out[name.rsplit("/", 1)[1][:-4]] = rows
        return out


def best_year_table(sheets: dict[str, list[list[str | None]]]) -> list[tuple[int, float]]:
    """(year, value) of the sheet, upright or turned, that has the most rows, and of equals the latest year."""
    year = re.compile(r"^\s*'?(\d{4})\s*[A-Za-z]?(\.0)?\s*$")

    def number(x):
        try:
            return float(re.sub("[%,]", "", x or ""))
        except ValueError:
            return None

    best: list[tuple[int, float]] = []
    for cells in sheets.values():
        width = max(map(len, cells), default=0)
        square = [r + [None] * (width - len(r)) for r in cells]
        for grid in (square, [list(c) for c in zip(*square, strict=True)]):
            got = [(int(m[1]), v) for r in grid if r and (m := year.match(r[0] or "")) and (v := next((number(x) for x in r[1:] if number(x) is not None), None)) is not None]
            best = max(best, got, key=lambda t: (len(t), max((y for y, _ in t), default=0)))
    return best


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.open, self.cell = [], 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open += 1
        elif tag == "tr" and self.open:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.open and self.tables[-1]:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open -= 1
        elif tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None


def html_tables(html: str) -> list[list[list[str]]]:
    p = _Tables()
    p.feed(html or "")
    return p.tables


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_rows(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, cells) of every HTML table, by Arrow batches."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            rows = [(k, t, r, cells) for k, h in zip(pdf[key], pdf[html], strict=True) for t, table in enumerate(html_tables(h)) for r, cells in enumerate(table)]
            yield pd.DataFrame(rows, columns=["key", "table_no", "row_no", "cells"])

    return shipped(df.select(key, html)).mapInPandas(run, f"key {kind}, table_no int, row_no int, cells array<string>")


def html_text(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text) without tags, scripts and styles."""

    def run(frames):
        for pdf in frames:
            out = []
            for h in pdf[html]:
                p = _Text()
                p.feed(h or "")
                out.append(" ".join("".join(p.parts).split()))
            yield pd.DataFrame({"key": pdf[key], "text": out})

    return shipped(df.select(key, html)).mapInPandas(run, f"key {df.schema[key].dataType.simpleString()}, text string")


def parse_feed(xml: str) -> list[dict]:
    """(id, title, summary, published, updated, categories) of an Atom feed's entries."""
    import xml.etree.ElementTree as ET

    ns = {"a": "http://www.w3.org/2005/Atom"}
    out = []
    for e in ET.fromstring(xml).findall("a:entry", ns):
        text = lambda k, e=e: " ".join((e.findtext(f"a:{k}", None, ns) or "").split()) or None
        out.append({**{k: text(k) for k in ("id", "title", "summary", "published", "updated")}, "categories": [c.get("term") for c in e.findall("a:category", ns)]})
    return out


def feed_rows(df: DataFrame, xml: str) -> DataFrame:
    schema = "id string, title string, summary string, published string, updated string, categories array<string>"

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([r for x in pdf[xml] for r in parse_feed(x)], columns=[f.split()[0] for f in schema.split(", ")])

    return shipped(df.select(xml)).mapInPandas(run, schema)


def xml_text(xml: Column, *paths: str) -> Column:
    """The first of several XPath texts that is not empty, tags taken out."""
    return S.first_filled(*(F.trim(F.regexp_replace(F.xpath_string(xml, F.lit(p)), r"<[^>]+>|\s+", " ")) for p in paths))


def zipped_xml_text(df: DataFrame, key: str, value: str, *paths: str) -> DataFrame:
    """(key, text): xml_text of cached documents that are XML, or the base64 of a ZIP file whose first .xbrl or .xml member is."""
    import base64

    def run(frames):
        for pdf in frames:
            out = []
            for v in pdf[value]:
                if v and v.startswith("UEsD"):
                    members = [raw for name, raw in zip_members(base64.b64decode(v)) if name.lower().endswith((".xbrl", ".xml"))]
                    v = members[0].decode("utf-8", "replace") if members else None
                out.append(v)
            yield pd.DataFrame({"key": pdf[key], "xml": out})

    plain = shipped(df.select(key, value)).mapInPandas(run, f"key {df.schema[key].dataType.simpleString()}, xml string")
    return plain.select("key", xml_text(F.col("xml"), *paths).alias("text"))


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_records(spark: SparkSession, path: str, schema: str, field: str = "records") -> DataFrame:
    """The nested records of a JSON payload."""
    return spark.read.option("multiLine", True).schema(f"{field} array<struct<{schema}>>").json(path).select(F.explode(field).alias("r")).select("r.*")


def npz_long(spark: SparkSession, path: str) -> DataFrame:
    """(t, asset, w-like value) of the two-dimensional arrays of NPZ files, long: (path, name, i, j, value)."""

    def parse(path, content):
        import numpy as np

        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            for name in z.files:
                a = np.atleast_2d(z[name])
                if a.ndim == 2 and a.dtype.kind in "fiu":
                    for (i, j), v in np.ndenumerate(a):
                        yield {"path": path, "name": name, "i": i, "j": j, "value": float(v)}

    return from_files(spark.read.format("binaryFile").load(path), parse, "path string, name string, i int, j int, value double")


def merge_registry(spark: SparkSession, *fragments: DataFrame, key: str = "source_id") -> DataFrame:
    """All fragments as one; schema versions must agree and ids be unique."""
    from functools import reduce

    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fragments)
    if out.select("schema_version").distinct().limit(2).count() > 1:
        raise quality.QualityError("schema versions differ")
    quality.assert_empty(quality.unique_key(out, [key]))
    return out


def log_tail(spark: SparkSession, path: str, n: int = 50, part: str = "") -> DataFrame:
    """The last n lines, by file name and line, that contain a text, in order."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), line_order().alias("line"), "value")
    return lines.filter(F.col("value").contains(part)).orderBy(F.desc("line")).limit(n).orderBy("line")


def projection_contract(payload: str, schema_version: str) -> dict:
    """The payload of a projection file, if its contract holds; all that doesn't is named."""
    p = json.loads(payload)
    bad = [k for k in ("schema_version", "generated_at", "records", "provenance") if k not in p]
    if not bad:
        bad += ["schema_version"] * (p["schema_version"] != schema_version) + ["records"] * (not isinstance(p["records"], list) or not p["records"]) + ["provenance"] * (not isinstance(p["provenance"], dict))
        bad += ["record_count"] * (p.get("record_count", len(p["records"])) != len(p["records"])) + ["record ids"] * (len({r.get("id") for r in p["records"]}) != len(p["records"]))
    if bad:
        raise quality.QualityError(f"projection: {', '.join(bad)}")
    return p
