"""Counts over finished crawls: summary, states, projects, indexes and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.functions import lookup as L
from skein.functions import url as U


def status_policy(status: Column, retried: Column) -> Column:
    """What follows from an HTTP status: ok, unmodified, fatal or retry."""
    return (
        F.when(status == 0, "ok").when(status == L.UNMODIFIED_STATUS, "unmodified").when(status.isin(L.FATAL_STATUS), "fatal")
        .when(status.isin(L.FATAL_AFTER_RETRY) & retried, "fatal").otherwise("retry")
    )


def crawl_summary(urls: DataFrame) -> DataFrame:
    """One row over urls (status, done, retried, fatal, saved, length): links, broken (404), failed (done, and none of 0, 304, 404), retried, fatal, files and bytes."""
    yes = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    s = F.col("status")
    return urls.agg(
        F.count(F.lit(1)).alias("links"), yes(s == 404).alias("broken"), yes(F.col("done") & ~s.isin(0, 304, 404)).alias("failed"),
        yes(F.col("retried")).alias("retried"), yes(F.col("fatal")).alias("fatal"), yes(F.col("saved")).alias("files"),
        F.coalesce(F.sum(F.when(F.col("saved"), F.col("length"))), F.lit(0)).cast("long").alias("bytes"),
    )


def transfer_rate(nbytes: Column, seconds: Column) -> Column:
    """Kilobytes a second, or bytes a second under one."""
    kb = nbytes / seconds / 1024
    return F.when(seconds <= 0, F.lit(None).cast("string")).when(kb >= 1, F.concat(F.format_number(kb, 2), F.lit(" KB/s"))).otherwise(F.concat(F.format_number(nbytes / seconds, 2), F.lit(" bytes/s")))


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """Percent done, bandwidth and seconds to go."""
    return F.struct((100 * done / total).alias("percent"), (done / seconds).alias("bandwidth"), ((total - done) * seconds / done).alias("eta"))


def download_counts(urls: DataFrame) -> DataFrame:
    return urls.groupBy("download_status").agg(F.count(F.lit(1)).alias("n"))


def external_stats(urls: DataFrame, base_host: str) -> DataFrame:
    """Distinct servers and directories outside the start host, and filtered URLs, over urls (url, filter_reason)."""
    u = F.col("url")
    out = U.host(u) != base_host
    return urls.agg(F.countDistinct(F.when(out, U.host(u))).alias("ext_servers"), F.countDistinct(F.when(out, U.url_directory(u))).alias("ext_directories"), F.count("filter_reason").alias("filtered"))


def broken_links(urls: DataFrame) -> DataFrame:
    return urls.where("status = 404").select("url")


def project_report(projects: DataFrame, stats: DataFrame) -> DataFrame:
    """Projects by id with their statistics, if any."""
    return projects.join(stats, projects["id"] == stats["project_id"], "left").drop("project_id")


def url_tree(links: DataFrame) -> DataFrame:
    """source, text: the source's line and its distinct children in order of position, one tab in. links: source, child, pos."""
    first = links.groupBy("source", "child").agg(F.min("pos").alias("pos"))
    grouped = first.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("pos", "child"))).alias("c"))
    lines = F.transform("c", lambda x: F.concat(F.lit("\t"), x["child"]))
    return grouped.select("source", F.concat_ws("\n", F.array("source"), lines).alias("text"))


def url_tree_html(links: DataFrame) -> DataFrame:
    """The tree as nested list items."""
    first = links.groupBy("source", "child").agg(F.min("pos").alias("pos"))
    grouped = first.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("pos", "child"))).alias("c"))
    tag = lambda u: F.concat(F.lit('<a href="'), u, F.lit('">'), u, F.lit("</a>"))
    items = F.array_join(F.transform("c", lambda x: F.concat(F.lit("<li>"), tag(x["child"]), F.lit("</li>"))), "")
    return grouped.select("source", F.concat(F.lit("<li>"), tag(F.col("source")), F.lit("<ul>"), items, F.lit("</ul></li>")).alias("html"))


def inverted_index(docs: DataFrame) -> DataFrame:
    """term, id, tf over docs (id, content); terms are runs of ASCII letters and digits, lower-cased."""
    terms = docs.select("id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))
    return terms.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def index_records(pages: DataFrame) -> DataFrame:
    """Records for an external indexer, of pages that may be indexed: path, length and body."""
    return pages.where("can_index").select(F.concat(F.lit("Path-Name: "), "url", F.lit("\nContent-Length: "), F.octet_length("content").cast("string"), F.lit("\n\n"), "content").alias("record"))


def images_without_alt(parsed: DataFrame) -> DataFrame:
    """url, src of images that have no alt text; parsed: url, page (a parsed page's struct)."""
    return parsed.select("url", F.explode("page.images_without_alt").alias("src"))


def last_posts(pages: DataFrame, word: str) -> DataFrame:
    """The last page of each title that holds a word; pages: seq, title, url, content."""
    return pages.where(F.contains(F.lower("title"), F.lit(word.lower()))).groupBy("title").agg(F.max_by(F.struct("url", "content"), "seq").alias("p")).select("title", "p.url", "p.content")


def duplicates_by_content(docs: DataFrame) -> DataFrame:
    """content_hash, n, first_id of bodies that occur more than once; docs: id, content."""
    return docs.select("id", F.sha1(F.coalesce("content", F.lit("")).cast("binary")).alias("content_hash")).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def links_per_host(pages: DataFrame, anchors: Column) -> DataFrame:
    """host, n_pages, n_links, n_targets over pages (url, html)."""
    found = pages.select(U.host(F.col("url")).alias("host"), anchors.alias("links"))
    totals = found.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.size("links")).cast("long").alias("n_links"))
    targets = found.select("host", F.explode("links").alias("t")).groupBy("host").agg(F.countDistinct("t").alias("n_targets"))
    return totals.join(targets, "host", "left").select("host", "n_pages", "n_links", F.coalesce("n_targets", F.lit(0)).alias("n_targets"))


def pages_by_depth(urls: DataFrame) -> DataFrame:
    return urls.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def running_total(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return rows.withColumn("total", F.sum(value).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def tree_lines(nodes: DataFrame) -> DataFrame:
    """path, line of a tree (node, path: the positions of its ancestors and itself): as many tabs as it has ancestors. Ordered by path, the lines are the tree."""
    return nodes.select("path", F.concat(F.repeat(F.lit("\t"), F.size("path") - 1), "node").alias("line"))
