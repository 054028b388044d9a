"""URL rules by cases of our own, written from the rules (RFC 3986 and those of skein.functions.url)."""

import pytest
from pyspark.sql import functions as F

from skein.functions import url as U

BASE = "http://site.test/docs/guide/intro.html"
RESOLVED = [
    # link, base, kind, full form, filelike
    ("http://site.test", None, "generic", "http://site.test/", False),
    ("HTTP://Site.Test/A.html", None, "generic", "http://site.test/A.html", True),
    ("http://site.test:80/x", None, "generic", "http://site.test/x", True),
    ("http://site.test:8080/x", None, "generic", "http://site.test:8080/x", True),
    ("https://site.test:443/x", None, "generic", "https://site.test/x", True),
    ("next.html", BASE, "generic", "http://site.test/docs/guide/next.html", True),
    ("./next.html", BASE, "generic", "http://site.test/docs/guide/next.html", True),
    ("../up.html", BASE, "generic", "http://site.test/docs/up.html", True),
    ("../../top.html", BASE, "generic", "http://site.test/top.html", True),
    ("../../../above.html", BASE, "generic", "http://site.test/above.html", True),
    ("a/../b/./c.html", BASE, "generic", "http://site.test/docs/guide/b/c.html", True),
    ("/root.css", BASE, "stylesheet", "http://site.test/root.css", True),
    ("//cdn.test/logo.png", BASE, "image", "http://cdn.test/logo.png", True),
    ("//cdn.test/logo.png", BASE.replace("http", "https"), "image", "https://cdn.test/logo.png", True),
    ("www.other.test/p.html", BASE, "generic", "http://www.other.test/p.html", True),
    ("#part", BASE, "anchor", BASE, True),
    ("next.html#part", BASE, "anchor", "http://site.test/docs/guide/next.html", True),
    ("folder/", BASE, "generic", "http://site.test/docs/guide/folder/", False),
    ("README", BASE, "generic", "http://site.test/docs/guide/README", True),
    ("v1.2", BASE, "generic", "http://site.test/docs/guide/v1.2", True),
    ("find.cgi?q=1&r=2", BASE, "generic", "http://site.test/docs/guide/find.cgi?q=1&r=2", True),
    ("find.cgi?path=../x", BASE, "generic", "http://site.test/docs/guide/find.cgi?path=../x", True),
    ("two words.html", BASE, "generic", "http://site.test/docs/guide/two%20words.html", True),
    ("a%2fb.html", BASE, "generic", "http://site.test/docs/guide/a%2Fb.html", True),
    ("x.html", "http://site.test/list?page=/deep/er", "generic", "http://site.test/x.html", True),
    ("x.html", "http://site.test", "generic", "http://site.test/x.html", True),
    ("file:/tmp/notes.txt", None, "generic", "file:/tmp/notes.txt", True),
]


@pytest.mark.parametrize("link,base,kind,full,filelike", RESOLVED)
def test_resolution(link, base, kind, full, filelike):
    got = U.resolve_one(link, base, kind)
    assert (got[0], got[2], got[4]) == (full, filelike, None)


@pytest.mark.parametrize("link", ["g", "./g", "g/", "/g", "//g", "../g", "../../g", "../../../g", "g/./h", "g/../h", "./../g", "a/b/../../c"])
def test_dot_segments_as_in_the_standard_library(link):
    """RFC 3986 5.2.4; what climbs over the root stays at the root."""
    from urllib.parse import urljoin

    base = "http://a.test/b/c/d"  # d has no dot, so it is a file's name
    want = urljoin(base, link)
    assert U.resolve_one(link, base)[0] == (want + "/" if want.count("/") == 2 else want)


def test_errors_and_anchors():
    for empty in ("", "  ", None):
        assert U.resolve_one(empty, BASE)[4] == U.ZERO
    for scheme in ("http://", "https://", "ftp://", "file://"):
        assert U.resolve_one(scheme, BASE)[4] == U.ONLY_PROTOCOL
    assert U.resolve_one("p.html#a#b", BASE, "anchor")[3] == "#a#b" and U.resolve_one("p.html", None)[4] == U.NO_BASE
    assert U.resolve_one("#a", None, "anchor")[4] == U.NO_BASE


def test_columns(spark):
    u, v, b = (F.lit(x) for x in ("http://www.site.test/p?z=1&b=&a=2&=3&m=4", "https://w1.shop.site.co.uk:8443/x/y/z.html?q=1#top", "https://w1.shop.site.co.uk/x/"))
    got = spark.range(1).select(
        U.canonical(u), U.host(v), U.port(v), U.path(v), U.extension(v), U.directories(v), U.base_domain(U.host(v)), U.base_server(U.host(v)), U.with_port(U.host(v), v),
        U.url_directory(v), U.relative_depth(v, b), U.relative_depth(b, v), U.relative_depth(v, b, 2), U.escape(F.lit("a b%3c(")), U.anchor(v), U.relative_local_path(F.lit("h/a/c/x.gif"), F.lit("h/a/b/p.html")),
        U.local_path(v), U.is_webpage(v, F.lit("generic")), U.is_image(F.lit("http://h/i.PNG"), F.lit("generic")), U.as_directory(F.lit("http://h/a/b?x=1")), U.as_directory(F.lit("http://h/a/")),
        U.without_port(v), U.relative_url(v), U.local_directory(v), U.is_audio(F.lit("http://h/a.mp3"), F.lit("generic")), U.is_video(F.lit("http://h/a.avi"), F.lit("generic")), U.is_multimedia(F.lit("http://h/a"), F.lit("generic")),
        U.is_flash(F.lit("http://h/a.swf")), U.is_parseable(F.lit("http://h/a.css"), F.lit("generic")), U.is_parseable(F.lit("http://h/a.zip"), F.lit("generic")), U.type_of(F.lit("frame")), U.type_of(F.lit("what")),
    ).first()
    assert list(got) == [
        "http://site.test/p?a=2&m=4&z=1", "w1.shop.site.co.uk", 8443, "/x/y/z.html", ".html", ["x", "y"], "co.uk", "site.co.uk", "w1.shop.site.co.uk:8443",
        "https://w1.shop.site.co.uk/x/y/", 1, -1, 2, "a%20b%3C%28", "top", "../c/x.gif",
        "w1.shop.site.co.uk/x/y/z.htmlq=1", True, True, "http://h/a/b/", "http://h/a/",
        "https://w1.shop.site.co.uk/x/y/z.html?q=1#top", "/x/y/z.html?q=1#top", "w1.shop.site.co.uk/x/y", True, True, False, True, True, False, "frame", "generic",
    ]


def test_types_by_content(spark):
    rows = [("text/html; charset=x", "http://h/a.gif", "webpage"), ("image/x-new", "http://h/a", "image"), ("audio/ogg", "http://h/a", "audio"), ("application/pdf", "http://h/a", "document"), (None, "http://h/a.css", "stylesheet"), ("application/zip", "http://h/a.zip", "generic")]
    df = spark.createDataFrame(rows, "c string, u string, want string")
    assert all(r[0] == r[1] for r in df.select(U.type_by_content(F.col("c"), F.col("u")), "want").collect())


def test_the_udf_agrees_with_columns_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    r = U.resolve_url(F.col("url"), F.lit(None).cast("string"), F.lit("generic"))
    diff = pages.select("url", r.alias("r")).where(~(U.host(F.col("r.full_url")) == U.host(F.col("url"))) | F.col("r.error").isNotNull())
    assert diff.count() == 0
