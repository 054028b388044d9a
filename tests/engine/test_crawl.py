"""The crawl's wiring: sheets, scripts, redirects, filters, cache, limits, saving and events, on a small site."""

import pytest
from pyspark.sql import functions as F

from skein.config import CrawlConfig
from skein.functions import html as H
from skein.functions import url as U
from skein.operators import cache, filters, graph, reports
from skein.plans import crawl
from skein.plans.hooks import EVENTS, Hooks
from skein.sources import readers

SITE = [
    ("http://h/", '<link rel="stylesheet" href="/s/main.css"><a href="/a.html">a</a><a href="/moved">m</a><a href="/bad.html">b</a>', 0, None),
    ("http://h/s/main.css", '@import "more.css"; b { background: url(../img/x.gif) }', 0, None),
    ("http://h/s/more.css", "i { background: url('y.gif') }", 0, None),
    ("http://h/a.html", "<script>document.write('<a href=\"/written.html\">w</a>');</script><a href=\"/\">home</a>", 0, None),
    ("http://h/moved", '<a href="beside.html">x</a>', 0, "http://h/new/place.html"),
    ("http://h/bad.html", '<title>Forbidden words</title><a href="/behind.html">b</a>', 0, None),
    ("http://h/written.html", "done", 500, None), ("http://h/new/beside.html", "done", 0, None), ("http://h/img/x.gif", "gif", 0, None), ("http://h/s/y.gif", "gif", 0, None), ("http://h/behind.html", "done", 0, None),
]


@pytest.fixture(scope="module")
def site(spark):
    df = spark.createDataFrame(SITE, "url string, html string, status int, actual_url string")
    return df.withColumn("url_id", F.xxhash64(U.canonical(F.col("url")))).withColumn("etag", F.when(F.col("url").endswith("a.html"), "e1"))


def config(**more):
    return CrawlConfig(start_url="http://h/", junkfilter=False, **more)


def seen(df):
    return {r["url"].removeprefix("http://h"): r for r in df.collect()}


def test_sheets_scripts_and_redirects_are_followed(spark, site):
    got = seen(crawl.crawl(spark, site, config()))
    assert {u: r["generation"] for u, r in got.items()} == {
        "/": 0, "/s/main.css": 1, "/a.html": 1, "/moved": 1, "/bad.html": 1, "/s/more.css": 2, "/img/x.gif": 2, "/written.html": 2, "/new/beside.html": 2, "/behind.html": 2, "/s/y.gif": 3,
    }
    assert (got["/written.html"]["status"], got["/written.html"]["retried"], got["/written.html"]["download_status"]) == (500, True, "FAILED")
    assert got["/a.html"]["download_status"] == "SAVED" and got["/s/more.css"]["kind"] == "stylesheet"


def test_filters_stop_at_pages(spark, site):
    got = seen(crawl.crawl(spark, site, config(metafilters=("Forbidden",), wordfilter="home", javascript=False), levels=2))
    assert got["/bad.html"]["filter_reason"] == "textfilter" and got["/bad.html"]["download_status"] == "FILTERED" and "/behind.html" not in got
    assert got["/a.html"]["download_status"] == "FILTERED" and got["/a.html"]["filter_reason"] is None and "/written.html" not in got


def test_the_page_cache_knows_what_is_up_to_date(spark, site):
    known = spark.createDataFrame([("http://h/a.html", None, "e1", True, "loc", None, 1, None, None)], cache.CACHE)
    assert seen(crawl.crawl(spark, site, config(), levels=1, known=known))["/a.html"]["download_status"] == "UPTODATE"
    assert seen(crawl.crawl(spark, site, config(pagecache=False), levels=1, known=known))["/a.html"]["download_status"] == "SAVED"


def test_limits(spark, site):
    assert max(r["generation"] for r in seen(crawl.crawl(spark, site, config(maxbytes=100))).values()) == 0
    assert max(r["generation"] for r in seen(crawl.crawl(spark, site, config(), levels=1)).values()) == 1
    assert seen(crawl.crawl(spark, site, config(depth=-1), levels=1))["/s/main.css"]["filter_reason"] is None
    deep = seen(crawl.crawl(spark, site, config(depth=0), levels=1))
    assert deep["/s/main.css"]["filter_reason"] == "depth" and deep["/a.html"]["filter_reason"] is None


def test_saved_pages_link_to_each_other(spark, site, tmp_path):
    crawl.crawl(spark, site, config(), out=str(tmp_path / "out"))
    pages = {r["url"]: r["html"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert 'href="a.html"' in pages["http://h/"] and 'href="s/main.css"' in pages["http://h/"] and "http://h/written.html" not in pages
    crawl.crawl(spark, site, config(localise=0), levels=0, out=str(tmp_path / "raw"))
    assert {r["url"]: r["html"] for r in spark.read.parquet(str(tmp_path / "raw")).collect()}["http://h/"] == SITE[0][1]
    crawl.crawl(spark, site, config(dryrun=True), levels=0, out=str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_every_event_is_raised_and_steps_can_be_replaced(spark, site, tmp_path):
    raised = set()

    def note(event):
        def handler(rows):
            raised.add(event)

        return handler

    hooks = Hooks()
    for event in EVENTS:
        hooks.on(event, note(event))
    steps = []
    for step in ("fetch", "retry", "save", "data", "crawl"):
        hooks.callback(step, lambda *a, s=step: steps.append(s), "pre")
    hooks.plugin("data", lambda rows: rows.withColumn("html", F.replace("html", F.lit("/moved"), F.lit("/a.html"))))
    got = seen(crawl.crawl(spark, site, config(), hooks=hooks, levels=1, out=str(tmp_path / "o")))
    assert raised == set(EVENTS) and set(steps) == {"fetch", "retry", "save", "data", "crawl"} and "/moved" not in got


def test_snapshots_with_two_rows_of_one_key(spark):
    snap = spark.createDataFrame([("http://h/?", "two", 0), ("http://h/", "one", 0)], "url string, html string, status int").withColumn("url_id", F.xxhash64(U.canonical(F.col("url"))))
    got = readers.conditional(snap.select("url_id", "url").where("url = 'http://h/'"), snap).collect()
    assert [r["html"] for r in got] == ["one"]


def test_robots_values_are_decoded(spark):
    robots = spark.createDataFrame([("h", 200, "User-agent: %73kein\nDisallow: /a%20b\nDisallow: /c+d")], "host string, status int, body string")
    urls = spark.createDataFrame([(1, "http://h/a%20b/x"), (2, "http://h/%61%20b"), (3, "http://h/c+d"), (4, "http://h/c%20d"), (5, "http://h")], "url_id long, url string").withColumn("rules", F.lit(1))
    got = {r["url_id"]: r["allowed"] for r in filters.robots_allowed(urls, filters.parse_robots(robots), "skein/1.0").collect()}
    assert got == {1: False, 2: False, 3: False, 4: True, 5: True}


def test_feeds_and_markup_become_absolute(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom" xml:base="http://f/b/"><title>T</title><link href="home.html"/><entry><title>e</title><link href="e1.html"/><summary>&lt;a href="x.html"&gt;x&lt;/a&gt; &lt;img src=y.gif&gt; &lt;a href="mailto:q@q"&gt;</summary></entry></feed>'
    rss = "<rss version='2.0'><channel><title>T</title><item><title>i</title><link>i.html</link></item></channel></rss>"
    one, two = (r["f"] for r in spark.createDataFrame([(atom, None), (rss, "http://g/feed.xml")], "x string, u string").select(readers.parse_feed_at("x", "u").alias("f")).collect())
    assert one["link"] == "http://f/b/home.html" and one["entries"][0]["link"] == "http://f/b/e1.html" and two["entries"][0]["link"] == "http://g/i.html"
    assert one["entries"][0]["summary"] == '<a href="http://f/b/x.html">x</a> <img src=http://f/b/y.gif> <a href="mailto:q@q">'
    assert H.with_absolute_links(None, "http://h/") is None and H.with_absolute_links("<a href='x'>", None) == "<a href='x'>"


def test_mirrors(spark):
    c = spark.createDataFrame([(1, 1, "m1/f"), (1, 2, "m2/f"), (2, 1, "m1/g"), (3, 1, "a"), (3, 2, "b"), (3, 3, "c")], "url_id long, mirror_id long, mirror_url string")
    files = spark.createDataFrame([(1, 11), (2, 9), (3, 7)], "url_id long, length long")
    pieces = graph.mirror_ranges(files, c, 2)
    assert sorted((r["url_id"], r["mirror_id"], r["range_start"], r["range_end"]) for r in pieces.collect()) == [(1, 1, 0, 4), (1, 2, 5, 10), (3, 1, 0, 2), (3, 2, 3, 6)]
    stats = graph.mirror_stats(pieces, spark.createDataFrame([(2,), (9,)], "mirror_id long"))
    assert sorted(map(tuple, stats.collect())) == [(1, 2, 8, 0), (2, 2, 10, 1), (9, 0, 0, 1)]
    u = spark.createDataFrame([("http://Dl.test/x",), ("http://other.test/x",)], "u string")
    assert [r[0] for r in u.select(graph.mirror_capable(F.col("u"), ("dl.test",))).collect()] == [True, False]


def test_fields_ids_and_trees(spark):
    empty = spark.createDataFrame([], "k string, v int, __id__ long, __version__ int")
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(23)], "k string, v int").repartition(5)
    t = cache.insert(cache.insert(empty, rows, 1), rows, 24)
    assert sorted(r["__id__"] for r in t.collect()) == list(range(1, 47)) and cache.insert(empty, rows.limit(0), 1).count() == 0
    assert cache.drop_field(t, "v").columns == ["k", "__id__", "__version__"]
    for bad in ("__id__", "nothing"):
        with pytest.raises(ValueError):
            cache.drop_field(t, bad)
    links = spark.createDataFrame([("r", "a", 0), ("r", "b", 1), ("a", "c", 0), ("b", "c", 0), ("c", "r", 0), ("b", "d", 1)], "source string, child string, pos int")
    tree = reports.tree_lines(crawl.link_tree(links, spark.createDataFrame([("r",)], "node string"))).orderBy("path")
    assert [r["line"] for r in tree.collect()] == ["r", "\ta", "\t\tc", "\tb", "\t\td"]


def test_searches_images_and_tables(spark):
    df = spark.range(1)
    none, words = F.lit(None).cast("string"), F.array(F.lit("cats"), F.lit("dogs"))
    got = df.select(filters.page_searched(none, words, none, none, "dog"), filters.page_searched(F.lit("x"), words, F.lit("y"), F.lit("z"), "bird"), filters.page_searched(none, F.lit(None).cast("array<string>"), none, none, "a")).first()
    assert list(got) == [True, False, False]
    assert list(df.select(filters.small_image(F.lit("http://h/a.png"), F.lit("generic"), F.lit(10), 100), filters.small_image(F.lit("http://h/a.png"), F.lit("generic"), F.lit(200), 100)).first()) == [True, False]
    html = "<table><tr><th>Name</th><th>Get</th></tr><tr><td> one <i>two</i></td><td><a href=\"x.zip\">x</a></td></tr></table>"
    r = df.select(H.table_rows(F.lit(html)).alias("t"), H.labelled_links(F.lit(html)).alias("l")).first()
    assert r["t"] == [["Name", "Get"], ["one two", "x"]] and [tuple(x) for x in r["l"]] == [("one two", "x.zip")]


def test_junk_defaults(spark):
    rows = [("http://doubleclick.net/x", "domain"), ("http://a.b.doubleclick.net/x", "base_domain"), ("http://h/ads/x.gif", "pattern"), ("http://ad.h.test/x", "pattern"), ("http://h/banner12.gif", "pattern"), ("http://h/phpAdserver/x", "pattern"), ("http://h/readme.html", None), ("http://h/shadow/lads.html", None)]
    df = spark.createDataFrame(rows, "u string, want string")
    assert [r[0] for r in df.select(filters.junk_reason(F.col("u"), CrawlConfig())).collect()] == [w for _, w in rows]
