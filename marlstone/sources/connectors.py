"""Fetching: read-through caches, paged and batched sources, fallback chains. The transport is a parameter, so all of it works without a network."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import storage
from ..operators import quality
from ..session import shipped

#: Answers that mean "nothing there"; others that aren't 2xx are errors.
ABSENT = (400, 403, 404)
#: Requests that run side by side.
AT_ONCE = 3

Fetch = Callable[[str], tuple[int, str]]


class FetchError(RuntimeError):
    """An answer that is neither a result nor "nothing there"."""


def fetch_one(fetch: Fetch, url: str) -> str | None:
    status, body = fetch(url)
    if status in ABSENT:
        return None
    if not 200 <= status < 300:
        raise FetchError(f"{status} for {url}")
    return body


def to_fetch(wanted: DataFrame, cache: DataFrame, now: int, ttl: int | None = None) -> DataFrame:
    """Keys that the cache lacks, or has only older than ttl."""
    fresh = cache.groupBy("key").agg(F.max("created_at").alias("__at"))
    fresh = fresh if ttl is None else fresh.filter(F.col("__at") >= now - ttl)
    return wanted.join(fresh, "key", "left_anti")


def fetch_rows(wanted: DataFrame, fetch: Fetch, now: int, at_once: int = AT_ONCE) -> DataFrame:
    """Cache rows (key, value, created_at) of the wanted (key, url); absent ones give no row. Not more than `at_once` tasks fetch side by side, one request after the other in each."""
    import pandas as pd

    def run(frames):
        for pdf in frames:
            got = [(k, fetch_one(fetch, u)) for k, u in zip(pdf["key"], pdf["url"], strict=True)]
            yield pd.DataFrame([(k, v, now) for k, v in got if v is not None], columns=["key", "value", "created_at"])

    return shipped(wanted.select("key", "url").repartition(at_once)).mapInPandas(run, "key string, value string, created_at long")


def read_through(wanted: DataFrame, cache: DataFrame, fetch: Fetch, now: int, ttl: int | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """The cache with what it lacked of the wanted keys, the newest of each key. What is fetched is stored first, so that each url is asked once; repeated keys are asked for once."""
    new = storage.stash(fetch_rows(to_fetch(wanted.dropDuplicates(["key"]), cache, now, ttl), fetch, now, at_once))
    return cache.join(new.select("key"), "key", "left_anti").unionByName(new)


def first_provider(providers: Sequence[tuple[str, Callable[[], list]]], least: int = 1000) -> tuple[str, list]:
    """Rows of the first provider that gives enough; if none does, all that went wrong is told."""
    errors = []
    for name, get in providers:
        try:
            rows = get()
        except Exception as e:
            errors.append(f"{name}: {e}")
            continue
        if len(rows) >= least:
            return name, rows
        errors.append(f"{name}: {len(rows)} rows")
    raise FetchError("; ".join(errors))


def offset_pages(get: Callable[[int, int], list], size: int = 100) -> Iterator[dict]:
    """Items of pages by offset, until a page is short."""
    at = 0
    while True:
        page = get(at, size)
        yield from page
        if len(page) < size:
            return
        at += size


def keyset_pages(get: Callable[[str | None], tuple[list, str | None]]) -> Iterator[dict]:
    """Items of pages that name the next one; a cursor that comes twice is an error."""
    cursor, seen = None, set()
    while True:
        page, cursor = get(cursor)
        yield from page
        if not cursor:
            return
        if cursor in seen:
            raise FetchError(f"cursor {cursor} came twice")
        seen.add(cursor)


def complete_pages(get: Callable[[int], tuple[int, list]], key: str = "id") -> list[dict]:
    """Distinct items of pages whose stated total may not change and must be reached."""
    total, got = None, {}
    while total is None or len(got) < total:
        said, page = get(len(got))
        if total is not None and said != total:
            raise FetchError(f"total changed from {total} to {said}")
        total = said
        before = len(got)
        got.update((x[key], x) for x in page)
        if len(got) == before and len(got) < total:
            raise FetchError(f"{len(got)} of {total} items")
    return list(got.values())


def optional_number(get: Callable[[], dict], *names: str) -> float | None:
    """The number under the first of several names, between 0 and 1; null if there is no such book."""
    try:
        answer = get()
    except FetchError:
        return None
    value = next((float(answer[n]) for n in names if answer.get(n) is not None), None)
    if value is not None and not 0 <= value <= 1:
        raise FetchError(f"{names[0]} {value} is out of range")
    return value


def request_provenance(df: DataFrame, batch: str, ident: str) -> DataFrame:
    """For each batch of a keyed fetch the digest of its ids, in order, and their number: what a request asked for can be told again."""
    ids = F.array_join(F.array_sort(F.collect_list(ident)), ",")
    return df.groupBy(batch).agg(F.sha2(ids, 256).alias("request_sha256"), F.count("*").alias("n"))


#: Intervals that price histories come in.
INTERVALS = ("1m", "1h", "6h", "1d", "1w", "max")


def price_history_params(token: str, interval: str | None = None, start: int | None = None, end: int | None = None, fidelity: int | None = None) -> dict:
    """Query parameters of a price history: a known interval, or a range of times that doesn't run backwards; a fidelity of minutes must be positive."""
    if not token:
        raise ValueError("a token is needed")
    if (interval is None) == (start is None and end is None):
        raise ValueError("either an interval or a range of times")
    if interval is not None and interval not in INTERVALS:
        raise ValueError(f"interval {interval} isn't one of {INTERVALS}")
    if interval is None and (start is None or end is None or start > end):
        raise ValueError("a range needs a start and an end, in order")
    if fidelity is not None and fidelity <= 0:
        raise ValueError("fidelity must be positive")
    given = {"market": token, "interval": interval, "startTs": start, "endTs": end, "fidelity": fidelity}
    return {k: v for k, v in given.items() if v is not None}


def fetch_validate_write(client, start: str, end: str, path: str) -> tuple[dict, str]:
    """(manifest, folder of the data): bars of a window from a client with bars(start, end) -> DataFrame, normalised, checked to have rows and unique keys, and written with their manifest."""
    from .readers import normalize_prices
    from .sinks import write_with_manifest

    df = normalize_prices(client.bars(start, end))
    quality.assert_empty(quality.require_columns(df, df.columns))
    return write_with_manifest(df, path), f"{path}/data"


class PagedSource(DataSource):
    """spark.read.format("marlstone_pages"): one partition for each page of an API, by options api, pages and schema. api: the name of one in `apis`, or module:function of one that executors can import."""

    apis: dict[str, Callable[[int], list[dict]]] = {}

    @classmethod
    def name(cls) -> str:
        return "marlstone_pages"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        name = self.options["api"]
        module, _, function = name.partition(":")
        get = getattr(importlib.import_module(module), function) if function else self.apis[name]
        return _PagedReader(get, int(self.options.get("pages", "1")), schema.names)


class _PagedReader(DataSourceReader):
    def __init__(self, get, pages, names):
        self.get, self.pages, self.names = get, pages, names

    def partitions(self):
        return [InputPartition(i) for i in range(self.pages)]

    def read(self, partition):
        for item in self.get(partition.value):
            yield tuple(item.get(n) for n in self.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
