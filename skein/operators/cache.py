"""Page cache: conditional requests, freshness, upserts, restored bodies; and keyed tables."""

from __future__ import annotations

import bz2
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from skein.config import CrawlConfig

CACHE = "url string, last_modified double, etag string, updated boolean, location string, checksum string, content_length long, data binary, headers map<string,string>"


@F.pandas_udf(T.BinaryType())
def deflate(data: pd.Series) -> pd.Series:
    return data.map(zlib.compress, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def inflate(data: pd.Series) -> pd.Series:
    return data.map(zlib.decompress, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def bzip(data: pd.Series) -> pd.Series:
    return data.map(bz2.compress, na_action="ignore")


def requests(frontier: DataFrame, cache: DataFrame) -> DataFrame:
    """frontier (url) with request_kind HEAD and conditions where the cache knows the URL, else GET."""
    known = frontier.join(cache.select("url", F.col("last_modified").alias("if_modified_since"), F.col("etag").alias("if_none_match")), "url", "left")
    some = F.col("if_modified_since").isNotNull() | F.col("if_none_match").isNotNull()
    return known.withColumn("request_kind", F.when(some, "HEAD").otherwise("GET"))


def freshness(fetched: DataFrame, cache: DataFrame) -> DataFrame:
    """fetched (url, last_modified, etag, checksum, file_present) with up_to_date: the first of the three that both sides have decides, and the file must be there."""
    old = cache.select("url", *(F.col(c).alias(f"old_{c}") for c in ("last_modified", "etag", "checksum")))
    j = fetched.join(old, "url", "left")
    both = lambda c: F.col(c).isNotNull() & F.col(f"old_{c}").isNotNull()
    same = F.when(both("last_modified"), F.col("last_modified") <= F.col("old_last_modified")).when(both("etag"), F.col("etag") == F.col("old_etag")).when(both("checksum"), F.col("checksum") == F.col("old_checksum")).otherwise(F.lit(False))
    return j.select(*fetched.columns, (same & F.coalesce("file_present", F.lit(False))).alias("up_to_date"))


def download_status(cfg: CrawlConfig) -> Column:
    """What becomes of a fetched URL, over columns status, filter_reason, content_length, is_webpage, word_hit, up_to_date, restored, write_veto."""
    return (
        F.when(F.col("filter_reason").isNotNull(), "FILTERED").when((F.col("status") == 304) | F.col("up_to_date"), F.when(F.col("restored").isNull(), "UPTODATE").when(F.col("restored"), "CACHE_SYNCED").otherwise("CACHE_SYNC_FAILED"))
        .when(F.col("status") != 0, "FAILED").when(F.col("content_length") > cfg.maxfilesize, "FILTERED").when(F.col("word_hit"), "FILTERED")
        .when(F.col("is_webpage") & F.lit(not cfg.html), "FILTERED").when(F.col("write_veto"), "FILTERED").otherwise("SAVED")
    )


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of the same key; other rows stay."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def cache_rows(fetched: DataFrame, with_data: bool) -> DataFrame:
    """Cache rows of fetched pages (url, last_modified, etag, location, body, headers)."""
    body = F.col("body")
    return fetched.select(
        "url", F.col("last_modified").cast("double").alias("last_modified"), "etag", F.lit(True).alias("updated"), "location", F.sha1(body).alias("checksum"), F.octet_length(body).cast("long").alias("content_length"),
        (deflate(body) if with_data else F.lit(None).cast("binary")).alias("data"), "headers",
    )


def with_headers(cache: DataFrame, urls: DataFrame) -> DataFrame:
    """The cache with the headers of urls (url, headers) where they are known."""
    new = urls.select("url", F.col("headers").alias("_h"))
    return cache.join(new, "url", "left").withColumn("headers", F.coalesce("_h", "headers")).drop("_h")


def restored(cache: DataFrame) -> DataFrame:
    """location, body of rows whose body the cache holds."""
    return cache.where("data IS NOT NULL").select("url", "location", inflate("data").alias("body"))


# ---- keyed tables with row ids and versions

def insert(table: DataFrame, rows: DataFrame, next_id: int) -> DataFrame:
    """Appends rows with __id__ from next_id, without gaps, and __version__ 0; missing fields are null.

    Rows are numbered inside their partitions, and partitions by how many rows stand before them, so
    no task gets them all.
    """
    placed = rows.select("*", F.monotonically_increasing_id().alias("_at")).withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1))
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    before, total = {}, next_id
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    base = F.element_at(F.create_map(*(F.lit(x) for p in before for x in (p, before[p]))), F.col("_part")) if before else F.lit(next_id)
    numbered = placed.withColumn("__id__", (base + F.col("_row")).cast("long")).withColumn("__version__", F.lit(0)).drop("_at", "_part", "_row")
    return table.unionByName(numbered, allowMissingColumns=True)


def update(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Sets the fields of changes (__id__, field...) and counts the version up."""
    fields = [c for c in changes.columns if c != "__id__"]
    j = table.join(changes.select("__id__", F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in fields)), "__id__", "left")
    out = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else (F.col(c) + F.when(F.col("_hit"), 1).otherwise(0)).alias(c) if c == "__version__" else F.col(c) for c in table.columns]
    return j.select(*out)


def delete(table: DataFrame, ids: list[int]) -> DataFrame:
    """Without the rows of the ids; ids that repeat or are missing are an error, and nothing goes."""
    if len(set(ids)) != len(ids):
        raise ValueError("an id repeats")
    if table.where(F.col("__id__").isin(ids)).count() != len(ids):
        raise IndexError("no such id")
    return table.where(~F.col("__id__").isin(ids))


def select(table: DataFrame, **values) -> DataFrame:
    for k, v in values.items():
        table = table.where(F.col(k).eqNullSafe(F.lit(v)))
    return table


def add_field(table: DataFrame, name: str, default=None) -> DataFrame:
    return table.withColumn(name, F.lit(default))


def drop_field(table: DataFrame, name: str) -> DataFrame:
    """The table without a field; its ids and versions can't go."""
    if name in ("__id__", "__version__") or name not in table.columns:
        raise ValueError(f"no field {name}")
    return table.drop(name)
