"""Sinks: pages by host, header maps, settings, crawl records, localised pages."""

from __future__ import annotations

import dataclasses
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from skein.config import CrawlConfig
from skein.functions import url as U

PROJECTS = "id long, time double, name string, url string, config string"
STATS = "project_id long, urls long, procurls long, filteredurls long, failedurls long, brokenurls long, cacheurls long, servers long, directories long, files long, data double, duration string"


def write_pages(pages: DataFrame, path: str, overwrite: bool = False) -> None:
    """Pages (url, ...) by host; without overwrite, rows are added."""
    pages.withColumn("host", U.host(F.col("url"))).write.mode("overwrite" if overwrite else "append").partitionBy("host").parquet(path)


def write_headers(links: DataFrame, urls: DataFrame, path: str) -> None:
    """Headers of all children of links, by URL."""
    rows = links.select("child_id").distinct().join(urls, F.col("child_id") == F.col("url_id")).select("url", "headers")
    rows.write.mode("overwrite").parquet(path)


def write_project(spark: SparkSession, cfg: CrawlConfig, path: str) -> None:
    spark.createDataFrame([(json.dumps(dataclasses.asdict(cfg)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_archive(files: DataFrame, path: str, codec: str = "gzip") -> None:
    """A compressed copy of the project's files."""
    files.write.mode("overwrite").option("compression", codec).parquet(path)


def project_row(projects: DataFrame, time: float, name: str, url: str, config: str) -> DataFrame:
    """projects with one more row, of the next id."""
    after = projects.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    return projects.unionByName(after.select("id", F.lit(time).alias("time"), F.lit(name).alias("name"), F.lit(url).alias("url"), F.lit(config).alias("config")))


def stats_row(project_id: int, summary: DataFrame, seconds: float) -> DataFrame:
    """A statistics row from a summary with filtered, uptodate, ext_servers and ext_directories; failedurls holds the fatal count, and servers and directories one more."""
    return summary.select(
        F.lit(project_id).cast("long").alias("project_id"), F.col("links").alias("urls"), F.col("links").alias("procurls"), F.col("filtered").alias("filteredurls"), F.col("fatal").alias("failedurls"), F.col("broken").alias("brokenurls"),
        F.col("uptodate").alias("cacheurls"), (F.col("ext_servers") + 1).alias("servers"), (F.col("ext_directories") + 1).alias("directories"), "files", F.col("bytes").cast("double").alias("data"), F.format_string("%.2f", F.lit(float(seconds))).alias("duration"),
    )


def _localised(html: str, links: list) -> str:
    html = re.sub(r"(?is)<base\s[^>]*>", "", html)
    for link in links:
        old, new = link["link"], link["local"]
        if old and new:
            html = re.sub(r"(?i)((?:href|src|background|action)\s*=\s*[\"']?)" + re.escape(old) + r"(?=[\"'\s>])", lambda m, n=new: m.group(1) + n, html)
    return html


@pandas_udf(T.StringType())
def localise(html: pd.Series, links: pd.Series) -> pd.Series:
    return pd.Series([_localised(h, sorted(x, key=lambda r: -len(r["link"] or ""))) if isinstance(h, str) and x is not None else h for h, x in zip(html, links)])


def localised_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """pages (url, html) whose links (source, link, local) name local files; a link is changed wherever it occurs, and base elements go."""
    own = links.groupBy(F.col("source").alias("url")).agg(F.collect_list(F.struct("link", "local")).alias("links"))
    j = pages.join(own, "url", "left")
    return j.withColumn("html", F.when(F.col("links").isNull(), F.col("html")).otherwise(localise("html", "links"))).drop("links")
