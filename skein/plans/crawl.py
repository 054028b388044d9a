"""A breadth-first crawl over a snapshot: each level is one DataFrame plan, written out before the next.

Known URLs and each level's frontier are Parquet tables in the shared folder, so lineage stays
one level long and a lost executor repeats one level's tasks at most. URLs are keyed by hash
and compared by canonical form; within a level the first occurrence by (parent, position) wins.
"""

from __future__ import annotations

import itertools
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.config import CrawlConfig
from skein.functions import html as H
from skein.functions import url as U
from skein.operators import cache, filters, graph
from skein.plans import download
from skein.plans.hooks import Hooks
from skein.sources import readers, sinks


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a session in one process (tests) gets a temporary one, and any other fails."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="skein-")
    return f"{found.rstrip('/')}/crawl-{uuid.uuid4().hex}"


def extracted(fetched: DataFrame, cfg: CrawlConfig, hooks: Hooks | None = None) -> DataFrame:
    """Links of fetched pages and style sheets: parent_id, parent_url, link, kind, pos, in page order; script redirects come first.

    Scripts that write into the page are carried out before its tags are read. Relative links are
    resolved against the page's base element, else the URL that a redirect led to, else its own.
    """
    hooks = hooks or Hooks()
    pages = fetched.where("status = 0 AND html IS NOT NULL")
    if "actual_url" not in pages.columns:
        pages = pages.withColumn("actual_url", F.lit(None).cast("string"))
    kind = F.coalesce("kind", F.lit("generic")) if "kind" in pages.columns else F.lit("generic")
    pages = pages.withColumn("kind", kind).withColumn("own", F.coalesce("actual_url", "url")).withColumn("sheet", U.is_stylesheet(F.col("url"), F.col("kind")))
    sheets = hooks.apply("beforecssparse", pages.where("sheet"))
    named = F.transform(H.css_links(F.col("html")), lambda x: F.struct(x.alias("link"), F.when(F.array_contains(H.css_imports(F.col("html")), x), "stylesheet").otherwise("generic").alias("kind")))
    css = sheets.select("url_id", F.col("own").alias("base"), F.posexplode(named).alias("pos", "l")).select("url_id", "base", "l.link", "l.kind", (F.col("pos") + 1).alias("pos"))
    css = hooks.apply("aftercssparse", css)
    html = pages.where(~F.col("sheet") & U.is_parseable(F.col("url"), F.col("kind")))
    if cfg.javascript:
        html = hooks.apply("beforejsparse", html).withColumn("source", F.col("html"))
        html = html.withColumn("html", F.when(F.contains("html", F.lit("document.write")), H.js_written("html")).otherwise(F.col("html")))
    parsed = html.withColumn("page", H.page_parser(query_links=cfg.getquerylinks)("html"))
    if cfg.robots:
        parsed = parsed.where("page.can_follow")
    base = F.coalesce("page.base_href", "own")
    links = parsed.select("url_id", base.alias("base"), F.explode("page.links").alias("l")).select("url_id", "base", F.col("l.link").alias("link"), F.col("l.kind").alias("kind"), (F.col("l.pos") + 1).alias("pos"))
    if cfg.javascript:
        sent = parsed.select("url_id", base.alias("base"), H.js_redirect("source").alias("link")).where("link IS NOT NULL").select("url_id", "base", "link", F.lit("generic").alias("kind"), F.lit(0).alias("pos"))
        links = links.unionByName(hooks.apply("afterjsparse", sent))
    links = hooks.apply("beforetag", links.unionByName(css))
    cut = graph.offset_links(links.withColumnRenamed("url_id", "source_id"), cfg.linksoffsetstart, cfg.linksoffsetend)
    r = U.resolve_url("link", "base", "kind")
    out = cut.withColumn("r", r).where("r.error IS NULL").select(F.col("source_id").alias("parent_id"), F.col("base").alias("parent_url"), "link", "kind", "pos", F.col("r.full_url").alias("url"))
    return out.withColumn("canonical_url", U.canonical(F.col("url"))).withColumn("url_id", F.xxhash64("canonical_url"))


def fetch(frontier: DataFrame, snapshot: DataFrame, cfg: CrawlConfig, hooks: Hooks) -> DataFrame:
    """Fetch results of a frontier, failures tried again; a page that a text filter or the word filter hits gets that as its filter_reason."""
    got = hooks.run("fetch", readers.conditional, hooks.apply("beforeconnect", frontier), snapshot)
    got = hooks.apply("afterconnect", hooks.run("retry", download.retry_failed, got, snapshot, cfg))
    if cfg.contentfilters or cfg.metafilters:
        page = got.withColumn("page", H.page_parser()("html"))
        hit = filters.text_filter_context(F.col("html"), F.col("page.title"), F.col("page.description"), F.col("page.keywords"), cfg)
        got = page.withColumn("filter_reason", F.when((F.col("status") == 0) & hit.isNotNull(), "textfilter").otherwise(F.col("filter_reason"))).drop("page")
    return got


def saved(fetched: DataFrame, known: DataFrame | None, cfg: CrawlConfig) -> DataFrame:
    """fetched with download_status: what the page cache known (url, last_modified, etag, checksum, data) and the settings make of each page."""
    rows = fetched.withColumn("body", F.col("html").cast("binary"))
    for name, kind in (("last_modified", "double"), ("etag", "string")):
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast(kind))
    if known is None or not cfg.pagecache:
        known = fetched.sparkSession.createDataFrame([], cache.CACHE)
    rows = rows if "file_present" in rows.columns else rows.withColumn("file_present", F.lit(True))
    done = download.save_pages(rows, known, cfg)
    return done.select(*fetched.columns, "download_status")


def crawl(
    spark: SparkSession, snapshot: DataFrame, cfg: CrawlConfig, robots: DataFrame | None = None, hooks: Hooks | None = None, levels: int | None = None, folder: str | None = None,
    known: DataFrame | None = None, out: str | None = None,
) -> DataFrame:
    """All URLs that the crawl meets: url_id, url, canonical_url, kind, parent_id, generation, priority, status, filter_reason, retried, fatal, download_status.

    snapshot: url_id, url, status, html, and if known actual_url, last_modified, etag. Ends when a
    level finds nothing, or at the limits of files, bytes or time, or of levels where one is given.
    A folder of an earlier run resumes after its last whole level. known is the page cache. Saved
    pages go to out, by host and with links to each other made local, unless cfg.dryrun.
    """
    hooks, began = hooks or Hooks(), time.monotonic()
    folder = folder or shared_folder(spark)
    start = spark.createDataFrame([(cfg.start_url,)], "url string").withColumn("canonical_url", U.canonical(F.col("url"))).withColumn("url_id", F.xxhash64("canonical_url"))
    start = hooks.apply("beforestart", start)
    frontier = start.select("url_id", "url", "canonical_url", F.lit("webpage").alias("kind"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("generation"), F.lit(0).alias("priority"), F.lit(None).cast("string").alias("filter_reason"))
    frontier = hooks.apply("afterstart", frontier)
    rules = filters.parse_robots(robots) if robots is not None else None
    done = size = level = 0
    while True:
        path = f"{folder}/level={level}"
        if not _whole(spark, path):
            open_ = hooks.apply("beforefetch", frontier.where("filter_reason IS NULL"))
            fetched = hooks.apply("afterfetch", fetch(open_, snapshot, cfg, hooks))
            kept = hooks.run("save", saved, hooks.run("data", lambda rows: rows, fetched), known, cfg)
            closed = frontier.where("filter_reason IS NOT NULL").withColumns({"status": F.lit(-1), "download_status": F.lit("FILTERED")})
            kept.unionByName(closed, allowMissingColumns=True).write.mode("overwrite").parquet(path)
        here = spark.read.parquet(path)
        fetched = here.where("filter_reason IS NULL")
        n, bytes_ = fetched.where("status = 0").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
        done, size = done + n, size + bytes_
        over = cfg.maxfiles and done >= cfg.maxfiles or cfg.maxbytes and size >= 0.9 * cfg.maxbytes or 0 < cfg.timelimit <= time.monotonic() - began + 1
        if not n or over or level == levels:
            break
        found = hooks.apply("afterparse", hooks.run("crawl", extracted, hooks.apply("beforeparse", fetched), cfg, hooks))
        seen = spark.read.parquet(folder).select("url_id", "canonical_url")
        new = graph.distinct_urls(graph.unseen(found, seen), [F.col("parent_id"), F.col("pos")])
        new = new.where(~filters.media_dropped(F.col("url"), F.col("kind"), cfg))
        allowed = None
        if rules is not None and cfg.robots:
            new, allowed = filters.robots_allowed(new, rules, cfg.useragent), F.col("allowed")
        reason = filters.filter_reason(cfg, F.col("url"), F.col("kind"), F.lit(cfg.start_url), F.col("parent_url"), allowed, hooks.condition("includelinks", new))
        level += 1
        frontier = hooks.apply("beforecrawl", new.select(
            "url_id", "url", "canonical_url", "kind", "parent_id", F.lit(level).alias("generation"),
            graph.url_priority(F.col("url"), F.col("kind"), F.lit(level - 1), cfg).alias("priority"), reason.alias("filter_reason"),
        ))
        frontier = hooks.apply("aftercrawl", frontier)
    whole = spark.read.parquet(folder)
    if out and not cfg.dryrun:
        write_saved(whole.where("download_status IN ('SAVED', 'CACHE_SYNCED')"), cfg, hooks, out)
    return hooks.apply("afterfinish", hooks.apply("postdownload", hooks.apply("beforefinish", whole.drop("html", "level"))))


def write_saved(pages: DataFrame, cfg: CrawlConfig, hooks: Hooks, out: str) -> None:
    """Saved pages (url_id, url, kind, status, html) by host; by cfg.localise, links between them name their local files."""
    pages = hooks.apply("writeurl", pages)
    if cfg.localise:
        local = pages.select(F.col("url_id").alias("child_id"), U.local_path(F.col("url")).alias("child_path"))
        own = pages.select(F.col("url_id").alias("parent_id"), F.col("url").alias("source"), U.local_path(F.col("url")).alias("own_path"))
        links = extracted(pages, cfg).join(local, F.col("url_id") == F.col("child_id")).join(own, "parent_id")
        pages = sinks.localised_pages(pages, links.select("source", "link", U.relative_local_path(F.col("child_path"), F.col("own_path")).alias("local")).distinct())
    sinks.write_pages(pages.drop("level"), out, overwrite=True)


def _whole(spark: SparkSession, path: str) -> bool:
    """Whether a level was written to its end: Spark leaves a marker then."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def levels_of(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Least number of steps from start (node) to each node over edges (source, child); ends when a level is empty."""
    spark = edges.sparkSession
    folder = shared_folder(spark)
    start.select("node").distinct().write.parquet(f"{folder}/level=0")
    for level in itertools.count(1):
        seen = spark.read.parquet(folder)
        new = seen.where(F.col("level") == level - 1).join(edges, F.col("node") == F.col("source")).select(F.col("child").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        new.write.parquet(f"{folder}/level={level}")
        if not spark.read.parquet(f"{folder}/level={level}").head(1):
            break
    return spark.read.parquet(folder).select("node", F.col("level").cast("int").alias("level"))


def link_tree(links: DataFrame, start: DataFrame) -> DataFrame:
    """node, parent, path of the tree that links (source, child, pos) span from start (node): a node hangs on the first parent, by path, of the level before it.

    path holds the positions of the ancestors and of the node; ordered by it, the rows are the tree from the top.
    """
    spark = links.sparkSession
    folder = shared_folder(spark)
    start.select("node", F.lit(None).cast("string").alias("parent"), F.array(F.lit(0)).alias("path")).distinct().write.parquet(f"{folder}/level=0")
    for level in itertools.count(1):
        seen = spark.read.parquet(folder)
        above = seen.where(F.col("level") == level - 1).select(F.col("node").alias("parent"), F.col("path").alias("above"))
        new = above.join(links, F.col("parent") == F.col("source")).select(F.col("child").alias("node"), "parent", F.concat("above", F.array(F.col("pos").cast("int"))).alias("path"))
        new = new.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min(F.struct("path", "parent")).alias("m")).select("node", "m.parent", "m.path")
        new.write.parquet(f"{folder}/level={level}")
        if not spark.read.parquet(f"{folder}/level={level}").head(1):
            break
    return spark.read.parquet(folder).select("node", "parent", "path")
