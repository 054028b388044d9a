"""Saving pages with revalidation, retries of failed ones, and downloads in several parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.config import CrawlConfig
from skein.functions import url as U
from skein.operators import cache, filters, graph, reports
from skein.sources import readers


def save_pages(fetched: DataFrame, known: DataFrame, cfg: CrawlConfig) -> DataFrame:
    """fetched (url, kind, status, last_modified, etag, body, file_present, filter_reason) with download_status.

    A page that the cache shows to be up to date is not written again; if its file is gone, its
    body comes from the cache where that holds bodies.
    """
    rows = fetched.withColumn("checksum", F.sha1("body")).withColumn("content_length", F.octet_length("body"))
    fresh = cache.freshness(rows.withColumn("_there", F.col("file_present")).withColumn("file_present", F.lit(True)), known)
    bodies = known.select("url", F.col("data").isNotNull().alias("_body"))
    j = fresh.join(bodies, "url", "left").withColumn("file_present", F.coalesce("_there", F.lit(False)))
    j = j.withColumn("restored", F.when(F.col("up_to_date") & ~F.col("file_present"), F.coalesce("_body", F.lit(False))))
    j = j.withColumn("is_webpage", U.is_webpage(F.col("url"), F.col("kind"))).withColumn("word_hit", filters.word_filtered(F.decode("body", "utf-8"), cfg)).withColumn("write_veto", F.lit(False))
    return j.withColumn("download_status", cache.download_status(cfg)).drop("_there", "_body", "write_veto", "word_hit", "is_webpage")


def retry_failed(fetched: DataFrame, snapshot: DataFrame, cfg: CrawlConfig) -> DataFrame:
    """Fetch results with one more try for each failure that is not fatal; columns retried and fatal are added."""
    if not cfg.retryfailed:
        return fetched.withColumn("retried", F.lit(False)).withColumn("fatal", reports.status_policy(F.col("status"), F.lit(False)) == "fatal")
    again = reports.status_policy(F.col("status"), F.lit(False)) == "retry"
    results = [c for c in ("status", "html", "actual_url", "last_modified", "etag") if c in snapshot.columns]
    second = readers.conditional(fetched.where(again).drop(*results), snapshot).withColumn("retried", F.lit(True))
    first = fetched.where(~again).withColumn("retried", F.lit(False))
    return first.unionByName(second).withColumn("fatal", reports.status_policy(F.col("status"), F.col("retried")) == "fatal")


def split_download(files: DataFrame, cfg: CrawlConfig, ranges: DataFrame | None = None) -> DataFrame:
    """Pieces to fetch of files (url, length), none of them empty: as many as set where the server takes ranges (ranges: host), else one."""
    if ranges is None:
        pieces = graph.byte_ranges(files, cfg.numparts)
    else:
        able = files.join(ranges.select("host").distinct(), U.host(F.col("url")) == F.col("host"), "left").withColumn("able", F.col("host").isNotNull()).drop("host")
        pieces = graph.byte_ranges(able.where("able").drop("able"), cfg.numparts).unionByName(graph.byte_ranges(able.where("NOT able").drop("able"), 1))
    return pieces.where("range_end >= range_start")


def short_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces (url, part, range_start, range_end, data) that came short, to be fetched again from what they lack."""
    got = F.coalesce(F.octet_length("data"), F.lit(0))
    return pieces.where(got < F.col("range_end") - F.col("range_start") + 1).select("url", "part", (F.col("range_start") + got).alias("range_start"), "range_end")


def resume_offset(pieces: DataFrame) -> DataFrame:
    """url, offset: bytes of earlier pieces that are there."""
    return pieces.groupBy("url").agg(F.sum(F.octet_length("data")).cast("long").alias("offset"))


def whole_files(files: DataFrame, pieces: DataFrame) -> DataFrame:
    """url, data, complete: bodies from pieces, and whether they have the length that files (url, length) gives."""
    return files.join(graph.merge_parts(pieces), "url", "left").select("url", "data", (F.coalesce(F.octet_length("data"), F.lit(0)) == F.col("length")).alias("complete"))


def same_address(pairs: DataFrame, hosts: DataFrame) -> DataFrame:
    """pairs (a, b) of host names with same_ip, by a table of hosts (host, ip)."""
    one, two = (hosts.select(F.col("host").alias(n), F.col("ip").alias(f"_{n}")) for n in ("a", "b"))
    return pairs.join(one, "a", "left").join(two, "b", "left").select(*pairs.columns, F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("same_ip"))
