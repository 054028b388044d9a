"""Sources: page snapshots, robots, mirrors, URL lists, caches, projects, settings and feeds."""

from __future__ import annotations

import dataclasses
import json
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from skein.config import CrawlConfig
from skein.functions import html as H
from skein.functions import url as U
from skein.functions.url import resolve_one


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot as fetch results: url_id, url, status, html; it stands in for the network."""
    return table(spark, folder, "pages").select("page_id", U.url_id(F.col("url")).alias("url_id"), "url", F.lit(0).alias("status"), "html")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """One start URL a line; a protocol is added, and the project is the host."""
    lines = spark.read.text(path).select(F.trim("value").alias("u")).where("u <> ''")
    full = F.when(F.col("u").rlike(r"(?i)^(https?|ftp|file):"), F.col("u")).otherwise(F.concat(F.lit("http://"), F.col("u")))
    return lines.select(full.alias("url")).withColumn("project", U.host(F.col("url")))


def download_list(spark: SparkSession, path: str) -> DataFrame:
    """`url[,filename]` lines."""
    return spark.read.schema("url string, filename string").csv(path, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).where("url IS NOT NULL")


def mirrors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").alias("base_url"))


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """Files as url, body."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), F.col("content").alias("body"))


def project(spark: SparkSession, path: str) -> CrawlConfig:
    """A project's settings, written as JSON by sinks.write_project."""
    row = json.loads(spark.read.text(path, wholetext=True).first()[0])
    known = {f.name for f in dataclasses.fields(CrawlConfig)}
    return CrawlConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.items() if k in known})


def xml_config(text: str) -> CrawlConfig:
    """Settings from an XML document whose elements bear option names, their values as text or in `value`."""
    kinds = {f.name: f.type for f in dataclasses.fields(CrawlConfig)}
    found: dict = {}
    for e in ET.fromstring(text).iter():
        name, value = e.tag.lower(), e.get("value", (e.text or "").strip())
        if name in kinds and value != "":
            k = kinds[name]
            found[name] = value.lower() in ("1", "true", "yes") if k == "bool" else int(value) if k == "int" else (*found.get(name, ()), value) if k.startswith("tuple") else value
    return CrawlConfig(**found)


_ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "link", "id", "summary", "published")])
FEED = T.StructType([T.StructField("version", T.StringType()), T.StructField("title", T.StringType()), T.StructField("link", T.StringType()), T.StructField("entries", T.ArrayType(_ENTRY)), T.StructField("bozo", T.BooleanType())])


def _feed(text: str | None, base: str | None = None) -> dict:
    out = {"version": None, "title": None, "link": None, "entries": [], "bozo": False}
    try:
        root = ET.fromstring((text or "").strip().encode())
    except ET.ParseError:
        return out | {"bozo": True}
    plain = lambda e: e.tag.rpartition("}")[2].lower()

    def get(e: ET.Element, *names: str) -> str | None:
        for n in names:
            for c in e:
                if plain(c) == n:
                    value = c.get("href") if n == "link" and c.get("href") else "".join(c.itertext()).strip()
                    if value:
                        return value
        return e.get("href") if "link" in names else None

    kind = plain(root)
    out["version"] = {"feed": "atom", "rss": "rss" + root.get("version", ""), "rdf": "rss1.0", "channel": "cdf"}.get(kind)
    head = next((c for c in root if plain(c) == "channel"), root)
    base = root.get("{http://www.w3.org/XML/1998/namespace}base") or base
    whole = lambda link: (resolve_one(link, base)[0] or link) if link and base else link
    out |= {"title": get(head, "title"), "link": whole(get(head, "link"))}
    for e in root.iter():
        if plain(e) in ("item", "entry"):
            out["entries"].append((get(e, "title"), whole(get(e, "link")), get(e, "guid", "id"), H.with_absolute_links(get(e, "description", "summary", "content", "abstract"), base), get(e, "pubdate", "published", "updated", "date", "issued")))
    return out


@F.pandas_udf(FEED)
def parse_feed(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_feed(x if isinstance(x, str) else None) for x in xml], columns=FEED.names)


@F.pandas_udf(FEED)
def parse_feed_at(xml: pd.Series, url: pd.Series) -> pd.DataFrame:
    """Feeds with the URLs that they came from: links, and those in the markup of entries, are made absolute."""
    return pd.DataFrame([_feed(x if isinstance(x, str) else None, u if isinstance(u, str) else None) for x, u in zip(xml, url)], columns=FEED.names)


def conditional(frontier: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Fetch results of a frontier (url_id, url): rows of the snapshot, 404 where it has none; of several with one key the one of the same URL, else the first.

    actual_url, last_modified and etag come along where the snapshot has them.
    """
    more = [c for c in ("actual_url", "last_modified", "etag") if c in snapshot.columns]
    there = snapshot.select("url_id", F.col("url").alias("_u") if "url" in snapshot.columns else F.lit(None).cast("string").alias("_u"), F.col("status").alias("_s"), "html", *more)
    j = frontier.join(there, "url_id", "left").withColumn("status", F.coalesce("_s", F.lit(404)))
    one = F.row_number().over(W.partitionBy("url_id", "url").orderBy(F.coalesce(F.col("_u") != F.col("url"), F.lit(True)), "_u", "_s", "html"))
    return j.withColumn("_n", one).where("_n = 1").drop("_s", "_u", "_n")


def junk_patterns(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Patterns of junk URLs from a list with one a line, for CrawlConfig.junk_patterns."""
    return tuple(r[0] for r in spark.read.text(path).where("trim(value) <> ''").collect())


def slices(files: DataFrame, body: Column = None) -> DataFrame:
    """The bytes of each range of files (url, body, range_start, range_end)."""
    b = F.col("body") if body is None else body
    return files.withColumn("data", F.substring(b, F.col("range_start").cast("int") + 1, (F.col("range_end") - F.col("range_start") + 1).cast("int")))
