"""URL filter: rules first, then a ratio of variable-order character Markov models; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

#: (rule, verdict): a host and a path prefix. The longest that fits decides.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Symbols of the models; 0 stands before the start, digits count as one symbol, the last is any other character.
SYMBOLS, SIZE = "abcdefghijklmnopqrstuvwxyz0./-", 32


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without '://'."""
    rx = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, rx, 1), base.UPPER, base.LOWER), F.regexp_extract(url, rx, 2)


def match_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def grams(url: Column) -> Column:
    """A code for each character: itself and the two symbols before it, in base SIZE."""
    text = F.translate(base.ascii_lower(F.coalesce(url, F.lit(""))), "123456789", "0" * 9)
    code = lambda c: F.when(F.instr(F.lit(SYMBOLS), c) > 0, F.instr(F.lit(SYMBOLS), c)).otherwise(SIZE - 1)
    before = lambda a, i, n: F.coalesce(F.get(a, i - n), F.lit(0)) * SIZE**n
    # the symbols are bound to a lambda's variable, so that they are made once and each code looks back at two of them
    one = F.array(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), code))
    return F.flatten(F.transform(one, lambda a: F.transform(a, lambda c, i: c + before(a, i, 1) + before(a, i, 2))))


def log_ratios(labelled: DataFrame) -> DataFrame:
    """One row, one array: ln P(accepted) - ln P(rejected) for each of the SIZE^3 codes.

    labelled: (good boolean, codes array<int>). Witten-Bell: each context of 2, 1 and 0 symbols mixes its own
    counts with the next shorter context, by its number of different followers. The table has a fixed size.
    """
    spark = labelled.sparkSession
    counts = labelled.select("good", F.explode("codes").alias("code")).groupBy("good", "code").agg(F.count("*").alias("n"))
    grid = spark.range(SIZE**3).select(F.col("id").cast("int").alias("code"))
    wide = grid.join(counts.groupBy("code").agg(*(F.sum(F.when(F.col("good") == g, F.col("n"))).alias(f"n{int(g)}") for g in (True, False))), "code", "left").na.fill(0)
    wide = wide.withColumns({"c": F.col("code") % SIZE, "bc": F.col("code") % SIZE**2, "ab": F.floor(F.col("code") / SIZE), "b": F.floor(F.col("code") % SIZE**2 / SIZE)})

    def model(y: int) -> Column:
        n = F.col(f"n{y}").cast("double")
        p, seen = F.lit(1.0 / SIZE), {}
        for own, context in (("c", None), ("bc", "b"), ("code", "ab")):
            here = F.sum(n).over(base_window(own))
            total = F.sum(n).over(base_window(context))
            kinds = F.sum((n > 0).cast("double")).over(base_window(context)) if own == "code" else F.size(F.collect_set(F.when(n > 0, F.col(own))).over(base_window(context))).cast("double")
            p = (here + kinds * p) / F.greatest(total + kinds, F.lit(1e-300)) if own == "c" else F.when(total > 0, (here + kinds * p) / (total + kinds)).otherwise(p)
            p = F.when(total > 0, p).otherwise(F.lit(1.0 / SIZE)) if own == "c" else p
        return p

    def base_window(col):
        from pyspark.sql import Window

        return Window.partitionBy(F.lit(0) if col is None else F.col(col))

    ratio = F.log(model(1)) - F.log(model(0))
    return wide.select("code", ratio.alias("r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "r"))), lambda x: x["r"]).alias("ratios"))


def _mean(codes: Column, ratios: Column) -> Column:
    total = F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + F.get(ratios, c))
    return F.when(F.size(codes) > 0, total / F.size(codes)).otherwise(0.0)


def url_filter(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, score.

    The urls that a rule decides are the accepted and rejected examples; both models count all of them
    but a fifth of the hosts (by crc32), which calibrate: the threshold on the length-normalised
    log-likelihood difference lies between the two means there, in proportion to the deviations.
    Without examples of either kind every score is 0 and the verdict is allow. An empty or null url has
    host and path '' and the score 0, which is held against the threshold as any other. The models take SIZE^3 doubles whatever the input; scores are
    computed row by row, in time linear in the url, so neither a hot host nor a very long url meets a shuffle. Repeated rows are judged each for itself.
    """
    host, path = split_url(F.col(url_col))
    rule, says = match_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), host.alias("host"), path.alias("path")).withColumns({"rule": rule, "says": says})
    labelled = rows.filter("says is not null").select((F.col("says") == "allow").alias("good"), (F.crc32("host") % 5 == 0).alias("calibrates"), grams(F.col("url")).alias("codes"))
    ratios = base.stash(log_ratios(labelled.filter("not calibrates"))).scalar()
    judged = labelled.filter("calibrates").withColumn("ratios", ratios).select("good", _mean(F.col("codes"), F.col("ratios")).alias("s"))
    side = lambda f, g: f(F.when(F.col("good") == g, F.col("s")))
    fit = judged.agg(side(F.avg, True).alias("m1"), side(F.avg, False).alias("m0"), side(F.stddev_pop, True).alias("s1"), side(F.stddev_pop, False).alias("s0"))
    between = (F.col("m1") * (F.col("s0") + 1e-9) + F.col("m0") * (F.col("s1") + 1e-9)) / (F.col("s0") + F.col("s1") + 2e-9)
    threshold = base.stash(fit.select(F.coalesce(between, F.lit(0.0)).alias("t"))).scalar()
    scored = rows.withColumn("ratios", ratios).withColumn("score", _mean(grams(F.col("url")), F.col("ratios")))
    verdict = F.coalesce("says", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")


@base.query("op3_url_filter")
def op3_url_filter(spark, sf_dir):
    return url_filter(base.table(spark, sf_dir, "pages"))
