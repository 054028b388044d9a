"""Crawl rules: filters over URLs and pages, as columns that Catalyst can push and combine."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.config import CrawlConfig
from skein.functions import lookup as L
from skein.functions import url as U


# ---- the filter language: "+a-b" includes a and excludes b; * stands for anything

def parse_filter(text: str) -> tuple[list[str], list[str]]:
    include, exclude = [], []
    for sign, item in re.findall(r"([+-])([^+-]+)", text):
        (include if sign == "+" else exclude).append(item.strip())
    return include, exclude


def to_pattern(item: str, extension: bool = False) -> str:
    if extension:
        return r"\." + re.escape(item.lstrip(".")) + "$"
    return re.escape(item).replace(r"\*", ".*")


def flagged(pattern: str, ignore_case: bool = False, flags: str = "") -> str:
    """A pattern with inline flags; only i, m, s and x are known."""
    known = "".join(sorted({f for f in flags if f in "imsx"} | ({"i"} if ignore_case else set())))
    return f"(?{known}){pattern}" if known else pattern


def _any(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def url_filtered(u: Column, cfg: CrawlConfig) -> Column:
    """A path, extension or regular expression excludes the URL and none includes it."""
    include, exclude = [], []
    for items, extension in ((cfg.pathurlfilters, False), (cfg.extnurlfilters, True)):
        for item in items:
            a, b = parse_filter(item)
            include += [to_pattern(x, extension) for x in a]
            exclude += [to_pattern(x, extension) for x in b]
    for item in cfg.regexurlfilters:
        (include if item.startswith("+") else exclude).append(item.lstrip("+-"))
    return ~_any(u, include) & _any(u, exclude)


def text_filter_context(content: Column, title: Column, description: Column, keywords: Column, cfg: CrawlConfig) -> Column:
    """Where a text filter matches (content, title, description, keywords), or null."""
    found = F.when(_any(content, list(cfg.contentfilters)), "content")
    if cfg.metafilters:
        p = list(cfg.metafilters)
        found = found.when(_any(title, p), "title").when(_any(description, p), "description").when(F.exists(keywords, lambda k: _any(k, p)), "keywords")
    return found


def junk_reason(u: Column, cfg: CrawlConfig) -> Column:
    """domain, base_domain or pattern, by the first test that the URL fails; null if none."""
    domains = [d.lower() for d in cfg.junk_domains]
    return F.when(U.host(u).isin(domains), "domain").when(U.base_domain(U.host(u)).isin(domains), "base_domain").when(_any(u, list(cfg.junk_patterns)), "pattern")


def word_filtered(body: Column, cfg: CrawlConfig) -> Column:
    return _any(body, [cfg.wordfilter] if cfg.wordfilter else [])


# ---- servers, depth and fetch levels

def without_tlds(h: Column) -> Column:
    return F.array_join(F.filter(F.split(F.lower(h), r"\."), lambda x: ~x.rlike(U.TLDS_SQL)), ".")


def same_server(a: Column, b: Column, cfg: CrawlConfig) -> Column:
    """Equal but for case and a www prefix; by settings also but for top-level labels, or by base server (label by label)."""
    x, y = (F.regexp_replace(F.lower(c), r"^www\d*\.", "") for c in (a, b))
    same = x == y
    if cfg.ignoretlds:
        same = same | (without_tlds(x) == without_tlds(y))
    if not cfg.subdomain:
        same = same | (U.base_server(x) == U.base_server(y))
    return same


def under_start(u: Column, base: Column, cfg: CrawlConfig) -> Column:
    return F.startswith(U.url_directory(u), U.url_directory(base)) | (same_server(U.host(u), U.host(base), cfg) & F.startswith(U.directory_path(u), U.directory_path(base)))


def too_deep(u: Column, base: Column, cfg: CrawlConfig) -> Column:
    """More directories below the start than cfg.depth; a depth of -1 tests nothing."""
    if cfg.depth == -1:
        return F.lit(False)
    d = U.relative_depth(u, base, 0)
    return (d != -1) & (d > cfg.depth)


def external(u: Column, kind: Column, base: Column, parent: Column, cfg: CrawlConfig) -> Column:
    """The fetch level's table: whether a URL outside the start directory is left out."""
    far = (U.relative_depth(u, base, 2) > cfg.extdepth) if cfg.extdepth > 0 else F.lit(False)
    server = same_server(U.host(u), U.host(base), cfg)
    parent_dir = parent.isNotNull() & (U.url_directory(parent) != U.url_directory(base))
    parent_server = parent.isNotNull() & ~same_server(U.host(parent), U.host(base), cfg)
    near = {0: F.lit(True), 3: parent_dir}.get(cfg.fetchlevel, far)
    other = {0: F.lit(True), 1: F.lit(True), 2: parent_server, 3: parent_server}.get(cfg.fetchlevel, far)
    keep = under_start(u, base, cfg)
    if cfg.getstylesheets:
        keep = keep | U.is_stylesheet(u, kind)
    if cfg.getimagelinks:
        keep = keep | U.is_image(u, kind)
    return F.when(keep, F.lit(False)).when(server, near).otherwise(other)


def media_dropped(u: Column, kind: Column, cfg: CrawlConfig) -> Column:
    off = [(cfg.images, U.is_image(u, kind)), (cfg.movies, U.is_video(u, kind)), (cfg.sounds, U.is_audio(u, kind)), (cfg.flash, U.is_flash(u)), (cfg.documents, U.extension(u).isin(L.DOCUMENT)), (cfg.javascript, kind == "javascript"), (cfg.javaapplet, kind.isin("javaapplet", "appletcodebase"))]
    return reduce(lambda a, b: a | b, [test for on, test in off if not on], F.lit(False))


def page_searched(title: Column, keywords: Column, description: Column, content: Column, pattern: str) -> Column:
    """Whether a page's keywords, description, title or content match: a crawl that goes on from such pages alone."""
    return F.coalesce(F.exists(keywords, lambda k: k.rlike(pattern)) | description.rlike(pattern) | title.rlike(pattern) | content.rlike(pattern), F.lit(False))


def small_image(u: Column, kind: Column, length: Column, least: int) -> Column:
    """An image of fewer bytes than `least`, which is not saved."""
    return U.is_image(u, kind) & (length < least)


# ---- robots

def _decoded(value: Column) -> Column:
    """Percent escapes undone; a plus sign stays, and so does a value with a broken escape."""
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def parse_robots(robots: DataFrame) -> DataFrame:
    """Rules of robots.txt bodies (host, status, body): host, entry, agent, rule, allow, path.

    Lines are numbered and read with windows: agents that follow rules begin an entry, and a
    rule belongs to every agent of its entry. 401 and 403 deny all; other statuses of 400 and
    up allow all, as does a missing row. A default entry (*) stands last.
    """
    lines = robots.where(F.coalesce("status", F.lit(200)) < 400).select("host", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r\n|\n|\r")).alias("line", "text"))
    parts = lines.select("host", "line", F.trim(F.regexp_replace("text", "#.*$", "")).alias("text")).select(
        "host", "line", F.lower(F.trim(F.regexp_extract("text", r"^([^:]+):", 1))).alias("name"), _decoded(F.trim(F.regexp_extract("text", r"^[^:]+:(.*)$", 1))).alias("value"), (F.col("text") == "").alias("blank")
    ).where(F.col("name").isin("user-agent", "allow", "disallow") | F.col("blank"))
    w = W.partitionBy("host").orderBy("line")
    begins = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(w), F.lit("")) != "user-agent")
    entries = parts.withColumn("entry", F.sum(begins.cast("int")).over(w)).where("NOT blank AND entry > 0")
    agents = entries.where("name = 'user-agent'").select("host", "entry", F.lower("value").alias("agent"))
    rules = entries.where("name <> 'user-agent'").select("host", "entry", F.col("line").alias("rule"), (F.col("name").eqNullSafe("allow") | (F.col("value") == "")).alias("allow"), "value")
    listed = agents.join(rules, ["host", "entry"], "left").select("host", F.when(F.col("agent") == "*", F.lit(1 << 30)).otherwise(F.col("entry").cast("int")).alias("entry"), "agent", F.coalesce("rule", F.lit(-1)).alias("rule"), F.coalesce("allow", F.lit(True)).alias("allow"), F.coalesce("value", F.lit("")).alias("path"))
    denied = robots.where(F.col("status").isin(401, 403)).select("host", F.lit(0).alias("entry"), F.lit("*").alias("agent"), F.lit(0).alias("rule"), F.lit(False).alias("allow"), F.lit("*").alias("path"))
    return listed.unionByName(denied)


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str, path: Column | None = None) -> DataFrame:
    """urls (url_id, url) with `allowed`: the first entry whose agent is part of ours decides, by its first rule that fits."""
    token = agent.split("/")[0].lower()
    own = rules.where((F.col("agent") == "*") | F.contains(F.lit(token), F.split_part(F.col("agent"), F.lit("/"), F.lit(1))))
    # the rules of a host are one short list, so its URLs meet one row, however many they are
    entries = own.groupBy("host", "entry").agg(F.array_sort(F.collect_list(F.struct("rule", "allow", F.col("path").alias("prefix")))).alias("rules"))
    first = entries.groupBy("host").agg(F.min_by("rules", "entry").alias("_rules"))
    here = urls.withColumn("_host", U.host(F.col("url"))).withColumn("_path", _decoded(path if path is not None else U.path(F.col("url"))))
    joined = here.join(first.withColumnRenamed("host", "_host"), "_host", "left").withColumn("_path", F.when(F.col("_path") == "", "/").otherwise(F.col("_path")))
    hits = F.filter("_rules", lambda r: (r["prefix"] == "*") | F.startswith(F.col("_path"), r["prefix"]))
    return joined.withColumn("allowed", F.coalesce(F.get(hits, F.lit(0))["allow"], F.lit(True))).select(*urls.columns, "allowed")


# ---- the chain

def filter_reason(cfg: CrawlConfig, u: Column, kind: Column, base: Column, parent: Column, allowed: Column | None = None, include: Column | None = None) -> Column:
    """Why a URL is left out, or null: include hook, skipped types, URL filter, junk, external, robots, depth; the first that says so."""
    chain = F.when(F.lit(False), F.lit(""))
    if include is not None:
        chain = chain.when(include.isNotNull() & ~include, "includelinks").when(include, F.lit(None).cast("string"))
    if cfg.skipruletypes:
        chain = chain.when(kind.isin(*cfg.skipruletypes), F.lit(None).cast("string"))
    chain = chain.when(url_filtered(u, cfg), "urlfilter")
    if cfg.junkfilter:
        chain = chain.when(junk_reason(u, cfg).isNotNull(), "junk")
    chain = chain.when(external(u, kind, base, parent, cfg), "external")
    if cfg.robots and allowed is not None:
        chain = chain.when(~allowed, "robots")
    return chain.when(too_deep(u, base, cfg), "depth")
