"""Links and metadata of HTML, style sheets and scripts.

Titles, scripts and style links are column expressions. HTML tags go through a tolerant
parser in Arrow batches, one pass a page. Links are (kind, link, line, col, pos) structs in
order of their first occurrence.
"""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skein.functions import lookup as L
from skein.functions.url import resolve_one


#: What SQL's trim() takes off: Unicode's space separators.
_SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def title(html: Column) -> Column:
    return F.btrim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(_SPACES))


def title_text(html: Column) -> Column:
    """The title with its &lt;, &gt; and &amp; decoded, and nothing else: other references stay as written, and those cut short too."""
    return F.replace(F.replace(F.replace(title(html), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def scripts(html: Column) -> Column:
    """Bodies of script elements, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))


def anchors(html: Column) -> Column:
    """The href values of anchor elements, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<a[^>]*href=\"([^\"]*)\""), F.lit(1))


def css_imports(css: Column) -> Column:
    """Sheets that a sheet imports, by string or by url(), in that order."""
    quoted = F.regexp_extract_all(css, F.lit(r"(?i)@import\s+[\"']([^\"']+)[\"']"), F.lit(1))
    called = F.regexp_extract_all(css, F.lit(r"(?i)@import\s+url\(\s*[\"']?([^\"')\s]+)[\"']?\s*\)"), F.lit(1))
    return F.concat(quoted, called)


def css_links(css: Column) -> Column:
    """All that a sheet links to: its imports, and what url() names besides them."""
    named = F.regexp_extract_all(css, F.lit(r"(?i)url\(\s*[\"']?([^\"')\s]+)[\"']?\s*\)"), F.lit(1))
    return F.array_distinct(F.concat(css_imports(css), named))


_STRING = r"(\"[^\"\n]*\"|'[^'\n]*')"
_LOCATION = re.compile(r"(?:^|[\s;{}.])(?:window\.|document\.|self\.|top\.)?location(?:\.href)?\s*(?:=(?!=)\s*|\.(?:replace|assign)\s*\(\s*)" + _STRING)
_WRITE = re.compile(r"document\.write(?:ln)?\s*\(\s*" + _STRING + r"\s*\)")
_SCRIPT = re.compile(r"(?is)<script[^>]*>(.*?)</script>")


def redirect_of(html: str | None) -> str | None:
    """Where the page's scripts send a browser: the last assignment of the first script that has one."""
    for body in _SCRIPT.findall(html or ""):
        found = _LOCATION.findall(body)
        if found:
            return found[-1][1:-1]
    return None


def written_page(html: str | None) -> str | None:
    """The page with each script that writes text replaced by what it writes."""
    if html is None:
        return None

    def put(m: re.Match) -> str:
        said = _WRITE.findall(m.group(1))
        return "".join(s[1:-1] for s in said) if said else m.group()

    return _SCRIPT.sub(put, html)


@F.pandas_udf(T.StringType())
def js_redirect(html: pd.Series) -> pd.Series:
    return html.map(redirect_of, na_action="ignore")


@F.pandas_udf(T.StringType())
def js_written(html: pd.Series) -> pd.Series:
    return html.map(written_page, na_action="ignore")


#: Pages whose parsed forms a worker holds as Python objects.
_PAGES_AT_ONCE = 64


class PageParser(HTMLParser):
    """Collects links, images and metadata of one page."""

    def __init__(self, tags: list[tuple[str, str, str]], query_links: bool, disabled: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.tags = [t for t in tags if t[0] not in disabled]
        self.query_links = query_links
        self.links: dict[tuple[str, str], tuple[int, int]] = {}
        self.title, self.in_title = "", False
        self.keywords: list[str] = []
        self.description = ""
        self.base: str | None = None
        self.can_index = self.can_follow = True
        self.no_alt: list[str] = []
        self.codebase = ""

    def wanted(self, link: str) -> bool:
        low = link.lower()
        if not link or any(low.startswith(p) for p in L.SKIPPED_LINKS):
            return False
        if self.title.strip().lower().startswith("index of") and any(link.endswith(x) for x in L.DIRECTORY_SORTS):
            return False
        return self.query_links or not re.search(r"\?.*=", link)

    def add(self, kind: str, link: str) -> None:
        self.links.setdefault((kind, link), self.getpos())

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {k.lower(): (v or "").strip() for k, v in attrs}
        if tag == "title":
            self.in_title = not self.title
        if tag == "img" and "alt" not in own and own.get("src"):
            self.no_alt.append(own["src"])
        if tag == "meta":
            self.meta(own)
            return
        if tag == "applet":
            self.codebase = own.get("codebase", "")
        for name, attribute, kind in self.tags:
            link = own.get(attribute)
            if name != tag or link is None:
                continue
            if tag == "base":
                self.base = self.base or link or None
            if tag == "link":
                rel = own.get("rel", "").lower()
                kind = "stylesheet" if "stylesheet" in rel else "image" if "icon" in rel else "generic"
            if kind == "javaapplet":
                link = self.codebase.rstrip("/") + "/" + link if self.codebase else link
            if kind == "form" and not self.query_links and "?" in link:
                continue
            if not self.wanted(link):
                continue
            if kind == "anchor":
                page, mark, _ = link.partition("#")
                if mark:
                    self.add("anchor", link)
                    if page:
                        self.add("generic", page)
                else:
                    self.add("generic", link)
            else:
                self.add(kind, link)

    def meta(self, own: dict[str, str]) -> None:
        name, content = own.get("name", "").lower(), own.get("content", "")
        if name == "robots":
            words = {w.strip() for w in content.lower().split(",")}
            self.can_index &= not words & {"noindex", "none"}
            self.can_follow &= not words & {"nofollow", "none"}
        elif name == "keywords":
            self.keywords = [k.strip() for k in content.split(",") if k.strip()]
        elif name == "description":
            self.description = content
        elif own.get("http-equiv", "").lower() == "refresh":
            found = re.search(r"(?i)url\s*=\s*['\"]?([^'\"]+)", content)
            if found and self.wanted(found.group(1).strip()):
                self.add("generic", found.group(1).strip())

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title, self.title = False, self.title.strip()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data


_LINK = T.StructType([T.StructField("kind", T.StringType()), T.StructField("link", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("pos", T.IntegerType())])
PAGE = T.StructType(
    [
        T.StructField("title", T.StringType()), T.StructField("description", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("can_index", T.BooleanType()), T.StructField("can_follow", T.BooleanType()), T.StructField("base_href", T.StringType()),
        T.StructField("links", T.ArrayType(_LINK)), T.StructField("images_without_alt", T.ArrayType(T.StringType())),
    ]
)


def parse_page(html: str | None, tags=tuple(L.LINK_TAGS), query_links: bool = False, disabled: frozenset[str] = frozenset()) -> dict:
    p = PageParser(list(tags), query_links, disabled)
    p.feed(html or "")
    p.close()
    links = [(k, link, at[0], at[1], i) for i, ((k, link), at) in enumerate(p.links.items())]
    return {"title": p.title, "description": p.description, "keywords": p.keywords, "can_index": p.can_index, "can_follow": p.can_follow, "base_href": p.base, "links": links, "images_without_alt": p.no_alt}


def _release() -> None:
    """Gives memory that a task no longer holds back to the system: workers live on beside the tasks of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def page_parser(tags=tuple(L.LINK_TAGS), query_links: bool = False, disabled: frozenset[str] = frozenset({"option"})):
    """A function of an html column that gives a page's struct (`PAGE`); tags can be added, and features disabled by tag.

    Pages stay in the Arrow batch and are read one at a time. It counts as nondeterministic, as
    Spark else runs it again for the filter that it puts below an explode of the page's lists.
    """
    tags, disabled = tuple(tags), frozenset(disabled)

    @F.arrow_udf(PAGE)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = to_arrow_type(PAGE)
        for html in batches:
            rows = (html.slice(i, _PAGES_AT_ONCE) for i in range(0, len(html), _PAGES_AT_ONCE))
            yield pa.concat_arrays([pa.array([], kind), *(pa.array([parse_page(x.as_py(), tags, query_links, disabled) for x in some], kind) for some in rows)])
        _release()

    return parse.asNondeterministic()


def sanitized(html: Column) -> Column:
    """Without scripts, styles, event attributes and tags other than plain markup."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|object|embed|applet|iframe)[^>]*>.*?</\1>", "")
    bare = F.regexp_replace(bare, r"(?i)\s(on\w+|style)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    return F.regexp_replace(bare, r"(?i)</?(?!(a|abbr|b|blockquote|br|code|dd|div|dl|dt|em|h[1-6]|hr|i|img|li|ol|p|pre|q|s|small|span|strong|sub|sup|table|tbody|td|th|thead|tr|u|ul)\b)[a-z][^>]*>", "")


_URI_ATTRIBUTES = re.compile(r"(?i)(\s(?:href|src|action|background|cite|codebase|data|longdesc|usemap)\s*=\s*)(\"[^\"]*\"|'[^']*'|[^\s>\"']+)")


def with_absolute_links(markup: str | None, base: str | None) -> str | None:
    """Markup whose links are resolved against a base; what can't be resolved stays."""
    if not markup or not base:
        return markup

    def put(m: re.Match) -> str:
        value = m.group(2)
        quote = value[0] if value[0] in "\"'" else ""
        link = value.strip("\"'") if quote else value
        if any(link.lower().startswith(p) for p in L.SKIPPED_LINKS):
            return m.group()
        return f"{m.group(1)}{quote}{resolve_one(link, base)[0] or link}{quote}"

    return _URI_ATTRIBUTES.sub(put, markup)


def table_rows(html: Column) -> Column:
    """Texts of the cells of each table row, without markup, in order."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(cells(r), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"\s+", " "))))


def labelled_links(html: Column) -> Column:
    """Structs label, link: each link in a table cell with the text of the cell before it in its row."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"\s+", " "))
    pairs = F.flatten(F.transform(rows, lambda r: F.transform(cells(r), lambda c, i: F.struct(F.when(i > 0, plain(F.get(cells(r), i - 1))).alias("label"), F.regexp_extract(c, r"(?i)<a[^>]*href=\"([^\"]*)\"", 1).alias("link")))))
    return F.filter(pairs, lambda p: p["link"] != "")
