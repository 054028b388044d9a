import pytest
from pyspark.sql import functions as F

from skein.config import CrawlConfig, user_browse
from skein.functions import html as H
from skein.functions import text as X
from skein.operators import cache, filters, graph, reports
from skein.plans import crawl
from skein.plans.hooks import Hooks
from skein.sources import readers, sinks

g = "generic"


def test_filter_language():
    assert filters.parse_filter("+a*b-c+d") == (["a*b", "d"], ["c"])
    assert filters.to_pattern("a*b") == "a.*b" and filters.to_pattern("gif", True) == r"\.gif$"
    assert filters.flagged("x", True, "mq") == "(?im)x"


def test_includes_win_over_excludes(spark):
    cfg = CrawlConfig(pathurlfilters=("-/private/*+/private/ok*",), extnurlfilters=("-gif",))
    df = spark.createDataFrame([("http://h/private/x",), ("http://h/private/ok.html",), ("http://h/a.gif",), ("http://h/a",)], "u string")
    assert [r[0] for r in df.select(filters.url_filtered(F.col("u"), cfg)).collect()] == [True, False, True, False]


@pytest.mark.parametrize(
    "a,b,sub,tld,same",
    [("www.foo.com", "FOO.com", 1, 0, True), ("www2.foo.com", "foo.com", 1, 0, True), ("a.foo.com", "b.foo.com", 1, 0, False), ("a.foo.com", "b.foo.com", 0, 0, True), ("foo.com", "foo.org", 1, 1, True), ("notfoo.com", "foo.com", 0, 0, False)],
)
def test_same_server(spark, a, b, sub, tld, same):
    cfg = CrawlConfig(subdomain=sub, ignoretlds=tld)
    assert spark.range(1).select(filters.same_server(F.lit(a), F.lit(b), cfg)).first()[0] == same


@pytest.mark.parametrize(
    "url,parent,level,out",
    [
        ("http://h/d/x.html", None, 0, False), ("http://h/e/x.html", None, 0, True), ("http://h/e/x.html", None, 1, False), ("http://o/x.html", "http://h/d/p.html", 1, True), ("http://o/x.html", "http://h/d/p.html", 2, False),
        ("http://o/x.html", "http://q/p.html", 2, True), ("http://h/e/x.html", "http://h/d/p.html", 3, False), ("http://h/e/x.html", "http://h/e/p.html", 3, True), ("http://o/x.html", "http://q/p.html", 4, False), ("http://o/i.png", None, 0, False), ("http://o/s.css", None, 0, False),
    ],
)
def test_fetch_levels(spark, url, parent, level, out):
    c = filters.external(F.lit(url), F.lit(g), F.lit("http://h/d/index.html"), F.lit(parent).cast("string"), CrawlConfig(fetchlevel=level))
    assert spark.range(1).select(c).first()[0] == out


def test_robots(spark):
    body = "User-agent: other\nDisallow: /\n\nUser-agent: skein\nUser-agent: friend\nDisallow: /no\nAllow: /\n\nUser-agent: *\nDisallow: /\n# end"
    robots = spark.createDataFrame([("a", 200, body), ("b", 401, None), ("c", 404, None), ("d", 200, "User-agent: *\nDisallow:\n"), ("e", 200, "User-agent: *\nDisallow: /x")], "host string, status int, body string")
    urls = spark.createDataFrame([(1, "http://a/no/x"), (2, "http://a/yes"), (3, "http://b/"), (4, "http://c/"), (5, "http://d/x"), (6, "http://e/xy"), (7, "http://e/y"), (8, "http://z/")], "url_id long, url string")
    rules = filters.parse_robots(robots)
    got = {r["url_id"]: r["allowed"] for r in filters.robots_allowed(urls, rules, "skein/1.0").collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: True, 6: False, 7: True, 8: True}
    assert not {r["url_id"]: r["allowed"] for r in filters.robots_allowed(urls, rules, "else/1").collect()}[2]


def test_page_parsing():
    page = '<html><head><title>A page</title><meta name="robots" content="noindex, nofollow"><meta name="keywords" content="x, y"><meta name="description" content="d"><meta http-equiv="refresh" content="3; URL=/next.html"><base href="http://b/c/"></head><body background="bg.gif">'
    page += '<a href="p.html#q">1</a><a href="p.html">2</a><a href="mailto:x@y">m</a><a href="s?a=b">s</a><img src="i.png"><frame src="f.html"><form action="go.cgi"></form><applet codebase="cb" code="c.class"></applet><area href="ar.html"><embed src="e.swf"><object data="o.swf"></object><select><option value="opt.html"></select><link rel="stylesheet" href="s.css"><script src="j.js"></script>'
    p = H.parse_page(page)
    links = {(k, x) for k, x, *_ in p["links"]}
    assert links == {
        ("generic", "/next.html"), ("base", "http://b/c/"), ("image", "bg.gif"), ("anchor", "p.html#q"), ("generic", "p.html"), ("image", "i.png"), ("frame", "f.html"), ("form", "go.cgi"), ("appletcodebase", "cb"), ("javaapplet", "cb/c.class"),
        ("generic", "ar.html"), ("multimedia", "e.swf"), ("multimedia", "o.swf"), ("generic", "opt.html"), ("stylesheet", "s.css"), ("javascript", "j.js"),
    }
    assert (p["title"], p["keywords"], p["description"], p["can_index"], p["can_follow"], p["base_href"]) == ("A page", ["x", "y"], "d", False, False, "http://b/c/")
    assert ("generic", "s?a=b") in {(k, x) for k, x, *_ in H.parse_page(page, query_links=True)["links"]}
    assert ("generic", "opt.html") not in {(k, x) for k, x, *_ in H.parse_page(page, disabled=frozenset({"option"}))["links"]}
    assert H.parse_page(None)["links"] == [] and H.parse_page("<a href='x'")["title"] == ""


def test_scripts():
    assert H.redirect_of("<script>if (location == 'x') y()</script>") is None
    assert H.written_page("a<script>document.write('<a href=\"x\">');</script>b") == 'a<a href="x">b'


def test_literals_and_headers(spark):
    h = F.create_map(F.lit("content-length"), F.lit("12, 13"), F.lit("content-type"), F.lit("Text/HTML; charset=ISO-8859-2"), F.lit("last-modified"), F.lit("Sun, 06 Nov 1994 08:49:37 GMT"))
    r = spark.range(1).select(X.content_length(h, F.lit(b"x")), X.content_type(h), X.content_encoding(h), X.last_modified(h).cast("string"), X.charset(h, F.lit(b"<a>")), X.bandwidth(F.lit("2kbps")), X.plural(F.lit("directory"), F.lit(2)), X.plural(F.lit("file"), F.lit(1)), X.decode_entities(F.lit("a&amp;b"))).first()
    assert list(r) == [12, "text/html", "plain", "1994-11-06 08:49:37", "iso-8859-2", 2048, "directories", "file", "a&b"]


def test_contexts_offsets_and_names(spark):
    rows = [("webpage", "frame", "FRAME"), ("webpage", "stylesheet", "STYLE"), ("stylesheet", "stylesheet", "CSS2"), ("stylesheet", "image", "CSS"), ("webpage", "image", "PAGE"), ("image", "stylesheet", None)]
    df = spark.createDataFrame(rows, "s string, c string, want string")
    assert all(r[0] == r[1] for r in df.select(graph.link_context(F.col("s"), F.col("c")), "want").collect())
    links = spark.createDataFrame([(1, i) for i in range(6)], "source_id long, pos int")
    assert [sorted(r["pos"] for r in graph.offset_links(links, a, b).collect()) for a, b in ((0, -1), (2, 4), (1, -3))] == [[0, 1, 2, 3, 4, 5], [2, 3], [1, 2, 3, 4, 5]]
    files = spark.createDataFrame([("a/b",), ("a/b/c.html",), ("a/b/c.html",)], "local_path string").withColumn("n", F.monotonically_increasing_id())
    assert sorted(r["local_name"] for r in graph.clash_names(graph.directory_clashes(files), [F.col("n")]).collect()) == ["a/b/c.html", "a/b/c.html.1", "a/b/index.html"]


def test_mirrors_and_limits(spark):
    c = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "url_id long, mirror_id long, mirror_url string")
    f = spark.createDataFrame([(1, 1), (2, 1)], "url_id long, mirror_id long")
    assert [tuple(r) for r in graph.next_mirror(c, f).collect()] == [(1, "y", 2)]
    files = spark.createDataFrame([("p", i, 40) for i in range(5)], "project string, seq int, length int")
    assert graph.within_bytes(files, 100).count() == 3 and graph.within_bytes(files, 0).count() == 5
    assert graph.priority_weights("jpg+5,gif-2,png+9") == {"jpg": 5, "gif": -2, "png": 5}


def test_cache_and_tables(spark):
    body = spark.createDataFrame([("u", 1.0, None, "loc", bytearray(b"hello"), {"a": "b"})], "url string, last_modified double, etag string, location string, body binary, headers map<string,string>")
    rows = cache.cache_rows(body, True)
    assert bytes(cache.restored(rows).first()["body"]) == b"hello"
    assert cache.upsert(rows, rows.withColumn("etag", F.lit("e")), "url").first()["etag"] == "e"
    t = cache.insert(spark.createDataFrame([], "k string, v int, __id__ long, __version__ int"), spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), 5)
    t = cache.update(t, spark.createDataFrame([(6, 9)], "__id__ long, v int"))
    assert sorted((r["k"], r["v"], r["__id__"], r["__version__"]) for r in t.collect()) == [("a", 1, 5, 0), ("b", 9, 6, 1)]
    assert cache.select(cache.delete(t, [5]), k="b").count() == 1
    for bad in ([5, 5], [77]):
        with pytest.raises((ValueError, IndexError)):
            cache.delete(t, bad)


def site(spark):
    rows = [
        ("http://h/", '<a href="/a.html">x</a><a href="/b.html">y</a><a href="http://o/z.html">z</a><img src="i.png">'), ("http://h/a.html", '<a href="/">up</a><a href="/c.html">c</a>'), ("http://h/b.html", '<meta name="robots" content="nofollow"><a href="/hidden.html">h</a>'),
        ("http://h/c.html", "<script>location.href='/d.html'</script>"), ("http://h/d.html", "end"), ("http://h/i.png", ""),
    ]
    return readers.pages(spark, "/root/testdata/sf0.001").limit(0).drop("page_id").unionByName(spark.createDataFrame(rows, "url string, html string").withColumn("status", F.lit(0)).withColumn("url_id", F.xxhash64(crawl.U.canonical(F.col("url")))))


def test_crawl(spark, tmp_path):
    cfg = CrawlConfig(start_url="http://h/", junkfilter=False)
    folder = str(tmp_path / "c")
    got = {r["url"]: (r["generation"], r["status"], r["filter_reason"]) for r in crawl.crawl(spark, site(spark), cfg, folder=folder).collect()}
    assert got == {"http://h/": (0, 0, None), "http://h/a.html": (1, 0, None), "http://h/b.html": (1, 0, None), "http://o/z.html": (1, -1, "external"), "http://h/i.png": (1, 0, None), "http://h/c.html": (2, 0, None), "http://h/d.html": (3, 0, None)}
    again = crawl.crawl(spark, site(spark), cfg, folder=folder)
    assert again.count() == len(got)
    hooks = Hooks().on("includelinks", lambda rows: F.when(F.col("url").endswith("b.html"), F.lit(False)))
    robots = spark.createDataFrame([("h", 200, "User-agent: *\nDisallow: /a")], "host string, status int, body string")
    got = {r["url"]: r["filter_reason"] for r in crawl.crawl(spark, site(spark), cfg, robots, hooks).collect()}
    assert got == {"http://h/": None, "http://h/a.html": "robots", "http://h/b.html": "includelinks", "http://o/z.html": "external", "http://h/i.png": None}
    assert user_browse("x").skipruletypes == ("image", "stylesheet")


def test_hooks():
    h, said = Hooks(), []
    h.callback("step", lambda x: said.append(("pre", x)), "pre")
    h.callback("step", lambda r: said.append(("post", r)))
    h.plugin("step", lambda x: x + 1)
    assert h.run("step", lambda x: x, 1) == 2 and said == [("pre", 1), ("post", 2)]
    with pytest.raises(KeyError):
        h.on("nothing", lambda r: r)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("www.x.org/a\n\nhttp://y.org/\n")
    assert [tuple(r) for r in readers.url_list(spark, str(tmp_path / "urls.txt")).collect()] == [("http://www.x.org/a", "www.x.org"), ("http://y.org/", "y.org")]
    cfg = CrawlConfig(start_url="http://x/", depth=3, skipruletypes=("image",))
    sinks.write_project(spark, cfg, str(tmp_path / "p"))
    assert readers.project(spark, str(tmp_path / "p")) == cfg
    assert readers.xml_config("<c><depth value='4'/><robots>0</robots><pathurlfilters>-a</pathurlfilters></c>") == CrawlConfig(depth=4, robots=False, pathurlfilters=("-a",))
    feed = '<rss version="2.0"><channel><title>T</title><link>http://l/</link><item><title>i</title><link>http://l/1</link><pubDate>Thu, 01 Jan 2004 19:48:21 GMT</pubDate></item></channel></rss>'
    f = spark.createDataFrame([(feed,), ("<broken",)], "x string").select(readers.parse_feed("x").alias("f")).collect()
    assert f[0]["f"]["version"] == "rss2.0" and f[0]["f"]["entries"][0]["link"] == "http://l/1" and f[1]["f"]["bozo"]
    pages = spark.createDataFrame([("p", '<base href="z"><a href="a.html">1</a><a href="a.html">2</a>')], "url string, html string")
    links = spark.createDataFrame([("p", "a.html", "../l/a.html")], "source string, link string, local string")
    assert sinks.localised_pages(pages, links).first()["html"] == '<a href="../l/a.html">1</a><a href="../l/a.html">2</a>'
    projects = spark.createDataFrame([(4, 1.0, "n", "u", "c")], sinks.PROJECTS)
    assert max(r["id"] for r in sinks.project_row(projects, 2.0, "m", "v", "d").collect()) == 5
    assert reports.links_per_host(spark.createDataFrame([("http://h/", '<a href="x">')], "url string, html string"), H.anchors(F.col("html"))).first()["n_targets"] == 1


def test_streams(spark, tmp_path):
    from skein.streaming import streams

    schema = "url string, length long, range_start long, range_end long, data binary"
    rows = [("a", 6, 3, 5, bytearray(b"def")), ("b", 2, 0, 1, bytearray(b"x")), ("a", 6, 0, 2, bytearray(b"abc")), ("b", 2, 0, 1, bytearray(b"xy"))]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.assemble_parts(stream).writeStream.format("memory").queryName("whole").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["url"], bytes(r["data"])) for r in spark.sql("SELECT * FROM whole").collect()} == {("a", b"abcdef"), ("b", b"xy")}


def deep_snapshot(spark, folder, leaves):
    """A chain of 15 pages, the first with so many leaves besides; the levels of its URLs, searched by brute force."""
    links = {f"/c{i:02d}": [f"/c{i + 1:02d}"] for i in range(14)} | {"/c14": []}
    links["/c00"] += [f"/leaf{i}" for i in range(leaves)]
    links |= {f"/leaf{i}": ["/c00"] for i in range(leaves)}
    rows = [(i, f"http://h.example{x}", "".join(f'<a href="{y}">y</a>' for y in ys)) for i, (x, ys) in enumerate(links.items())]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    level, at = {"/c00": 0}, ["/c00"]
    while at:
        at = [y for x in at for y in links[x] if y not in level and level.setdefault(y, level[x] + 1)]
    return level


def test_crawl_snapshot_goes_over_every_level(spark, tmp_path):
    from skein.plans.queries import QUERIES

    level = deep_snapshot(spark, str(tmp_path), 5000)
    got = QUERIES["crawl_snapshot"](spark, str(tmp_path)).collect()
    assert {r["canonical_url"]: r["generation"] for r in got} == {f"http://h.example{x}": k for x, k in level.items()} and len(got) == len(level)
    assert {r["status"] for r in got} == {0}


def test_frontier_levels_goes_on_until_a_level_is_empty(spark, tmp_path):
    from skein.plans.queries import QUERIES

    level = deep_snapshot(spark, str(tmp_path), 2)
    got = QUERIES["frontier_levels"](spark, str(tmp_path)).collect()
    assert {r["node"]: r["level"] for r in got} == {f"h.example{x}": k for x, k in level.items()} and len(got) == len(level)
