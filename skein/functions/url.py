"""URL algebra as column expressions; only relative resolution needs Python, in Arrow batches."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import lookup as L

TLDS_SQL = r"^([a-z]{2}|" + "|".join(L.GENERIC_TLDS) + r"|xn--[a-z0-9]+)$"


# ---- parts of an absolute URL

def protocol(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def port(u: Column) -> Column:
    given = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/:?#]+:([0-9]+)", 1)
    usual = F.coalesce(*(F.when(protocol(u) == p, F.lit(n)) for p, n in L.PORTS.items()), F.lit(80))
    return F.when(given != "", given.cast("int")).otherwise(usual)


def path(u: Column) -> Column:
    """From the host to a query or fragment."""
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(u: Column) -> Column:
    return F.regexp_extract(u, r"\?([^#]*)", 1)


def last_segment(u: Column) -> Column:
    return F.element_at(F.split(path(u), "/"), -1)


def as_directory(u: Column) -> Column:
    """The URL as one of a directory: its last segment becomes one, and query and fragment go."""
    plain = F.regexp_replace(u, r"[?#].*$", "")
    return F.when(F.endswith(plain, F.lit("/")), plain).otherwise(F.concat(plain, F.lit("/")))


def is_filelike(u: Column) -> Column:
    """The last segment has no dot, or one inside it, and is not of an extension that stands for a directory."""
    s = last_segment(u)
    return (s != "") & (~F.contains(s, F.lit(".")) | s.rlike(r".\..")) & ~F.lower(s).rlike("(" + "|".join(re.escape(x) for x in L.DIRECTORY) + ")$")


def filename(u: Column) -> Column:
    return F.when(is_filelike(u), last_segment(u)).otherwise(F.lit(""))


def extension(u: Column) -> Column:
    return F.lower(F.regexp_extract(last_segment(u), r"(\.[^.]*)$", 1))


def directories(u: Column) -> Column:
    """Path segments that are directories."""
    return F.filter(F.split(F.when(is_filelike(u), F.regexp_replace(path(u), r"[^/]*$", "")).otherwise(path(u)), "/"), lambda s: s != "")


def anchor(u: Column) -> Column:
    return F.regexp_extract(u, r"#+(.*)$", 1)


def without_anchor(u: Column) -> Column:
    return F.element_at(F.split(u, "#+", 2), 1)


def without_port(u: Column) -> Column:
    return F.regexp_replace(u, r"^(\w+://[^/:]+):\d+", "$1")


def relative_url(u: Column) -> Column:
    return F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")


def full_domain(u: Column) -> Column:
    return F.concat(protocol(u), F.lit("://"), host(u))


def with_port(domain: Column, u: Column) -> Column:
    """The domain with the URL's port, unless that is the protocol's own."""
    usual = F.coalesce(*(F.when(protocol(u) == p, F.lit(n)) for p, n in L.PORTS.items()), F.lit(80))
    return F.when(port(u) == usual, domain).otherwise(F.concat(domain, F.lit(":"), port(u).cast("string")))


def base_domain(h: Column) -> Column:
    """The last two labels."""
    return F.substring_index(h, ".", -2)


def base_server(h: Column) -> Column:
    """One label before the trailing top-level labels, and those."""
    labels = F.split(h, r"\.")
    tops = F.aggregate(F.reverse(labels), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, x: F.struct(F.when(a["go"] & x.rlike(TLDS_SQL), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["go"] & x.rlike(TLDS_SQL)).alias("go")))["n"]
    keep = F.least(F.greatest(tops, F.lit(1)) + 1, F.size(labels))
    return F.array_join(F.slice(labels, F.size(labels) - keep + 1, keep), ".")


def url_directory(u: Column) -> Column:
    """Protocol, host and directories, with a slash at the end."""
    dirs = directories(u)
    return F.concat(full_domain(u), F.lit("/"), F.array_join(dirs, "/"), F.when(F.size(dirs) > 0, F.lit("/")).otherwise(F.lit("")))


def directory_path(u: Column) -> Column:
    dirs = directories(u)
    return F.concat(F.lit("/"), F.array_join(dirs, "/"), F.when(F.size(dirs) > 0, F.lit("/")).otherwise(F.lit("")))


def relative_depth(u: Column, base: Column, mode: int = 0) -> Column:
    """Directories below the base URL's (0: under its directory, 1: on its host, 2: from the host's root); -1 where that does not apply."""
    mine, own = F.size(directories(u)), F.size(directories(base))
    if mode == 2:
        return mine
    inside = F.startswith(url_directory(u), url_directory(base)) if mode == 0 else host(u) == host(base)
    return F.when(inside & (mine >= own), mine - own).otherwise(F.lit(-1))


# ---- canonical form, escapes, hashes

def canonical(u: Column, strip_fragment: bool = True) -> Column:
    """Two parameters or more: sorted, without empty ones; none: no question mark at the end; no www prefix anywhere."""
    u = F.regexp_replace(u, r"#.*$", "") if strip_fragment else u
    params = F.regexp_extract_all(u, F.lit(L.PARAMETER), F.lit(1))
    kept = F.array_join(F.array_sort(F.filter(params, lambda p: p.rlike(L.FULL_PARAMETER))), "&")
    several = F.concat(F.regexp_replace(F.regexp_replace(u, L.PARAMETER, ""), r"&+$", ""), kept)
    form = F.when(F.size(params) > 1, several).when(F.size(params) == 0, F.regexp_replace(u, r"\?+$", "")).otherwise(u)
    return F.regexp_replace(form, r"www([0-9]*)\.", "")


def url_id(u: Column) -> Column:
    """The key of the URL table."""
    return F.xxhash64(canonical(u))


def escape(u: Column) -> Column:
    spaced = F.regexp_replace(u, r"\s", "%20")
    dirty = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(f"%{ord(x):02X}")), L.DIRTY_CHARACTERS, spaced)
    parts = F.split(dirty, "%")
    upper = F.transform(parts, lambda p, i: F.when((i > 0) & p.rlike("^[A-Fa-f0-9]{2}"), F.concat(F.upper(F.substring(p, 1, 2)), F.substring(p, F.lit(3), F.length(p)))).otherwise(p))
    return F.array_join(upper, "%")


def local_name(name: Column) -> Column:
    """A file name without characters that file systems refuse."""
    plain = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), L.JUNK_CHARACTERS, plain)


def local_directory(u: Column, root: str = "") -> Column:
    return F.concat_ws("/", *([F.lit(root)] if root else []), host(u), F.array_join(F.transform(directories(u), local_name), "/"))


def local_path(u: Column, root: str = "") -> Column:
    name = F.when(filename(u) == "", F.lit("index.html")).otherwise(local_name(F.concat(filename(u), F.when(query(u) != "", F.concat(F.lit("?"), query(u))).otherwise(F.lit("")))))
    return F.regexp_replace(F.concat_ws("/", local_directory(u, root), name), "/+", "/")


def relative_local_path(child: Column, page: Column) -> Column:
    """The way from a page's file to a child's, climbing with `..`; absolute where the hosts differ."""
    a, b = F.split(page, "/"), F.split(child, "/")
    shared = F.aggregate(
        F.sequence(F.lit(0), F.least(F.size(a), F.size(b)) - 2), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
        lambda s, i: F.struct(F.when(s["go"] & (F.get(a, i) == F.get(b, i)), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["go"] & (F.get(a, i) == F.get(b, i))).alias("go")),
    )["n"]
    up = F.array_repeat(F.lit(".."), F.size(a) - 1 - shared)
    way = F.array_join(F.concat(up, F.slice(b, shared + 1, F.size(b))), "/")
    return F.when(F.get(a, F.lit(0)) != F.get(b, F.lit(0)), child).when((F.size(a) < 2) | (F.size(b) < 2), child).otherwise(way)


# ---- classes

def _typed(kind: Column, name: str) -> Column:
    lineage = [t for t in L.PARENT_TYPE if _is_a(t, name)]
    return kind.isin(lineage)


def _is_a(t: str | None, ancestor: str) -> bool:
    while t is not None:
        if t == ancestor:
            return True
        t = L.PARENT_TYPE[t]
    return False


def type_of(name: Column) -> Column:
    """A known type name, or generic."""
    return F.when(name.isin(list(L.PARENT_TYPE)), name).otherwise(F.lit("generic"))


def is_a(kind: Column, ancestor: str) -> Column:
    return _typed(kind, ancestor)


def is_image(u: Column, kind: Column) -> Column:
    return (kind == "image") | ((kind == "generic") & extension(u).isin(L.IMAGE))


def is_audio(u: Column, kind: Column) -> Column:
    return (kind == "audio") | ((kind == "generic") & extension(u).isin(L.SOUND))


def is_video(u: Column, kind: Column) -> Column:
    return (kind == "video") | ((kind == "generic") & extension(u).isin([x.lower() for x in L.MOVIE]))


def is_multimedia(u: Column, kind: Column) -> Column:
    return is_audio(u, kind) | is_video(u, kind)


def is_webpage(u: Column, kind: Column, query_links: bool = False) -> Column:
    page = _typed(kind, "webpage") | ((kind == "generic") & extension(u).isin(L.WEBPAGE))
    return page | (F.contains(u, F.lit("?")) & F.lit(query_links)) | (_typed(kind, "query") & F.lit(query_links))


def is_stylesheet(u: Column, kind: Column) -> Column:
    return (kind == "stylesheet") | ((kind == "generic") & extension(u).isin(L.STYLESHEET))


def is_flash(u: Column) -> Column:
    return extension(u).isin(L.FLASH)


def is_document(u: Column, kind: Column) -> Column:
    return F.when(is_image(u, kind), F.lit(False)).when(is_webpage(u, kind), F.lit(True)).otherwise(extension(u).isin(L.DOCUMENT))


def is_parseable(u: Column, kind: Column) -> Column:
    no = is_image(u, kind) | is_multimedia(u, kind) | is_flash(u) | extension(u).isin(L.DOCUMENT) | (F.length(extension(u)) >= 3)
    return F.when(is_webpage(u, kind) | is_stylesheet(u, kind), F.lit(True)).when(no, F.lit(False)).otherwise(F.lit(True))


def type_by_content(content_type: Column, u: Column) -> Column:
    """A URL's type from its MIME type, else from its extension."""
    mime = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    known = {"text/html": "webpage", "application/xhtml+xml": "webpage", "text/css": "stylesheet", "text/javascript": "javascript", "application/javascript": "javascript", "application/x-javascript": "javascript", "application/pdf": "document", "application/msword": "document", "application/x-shockwave-flash": "flash"}
    named = F.coalesce(*(F.when(mime == k, F.lit(v)) for k, v in known.items()), F.when(F.startswith(mime, F.lit("image/")), F.lit("image")), F.when(F.startswith(mime, F.lit("audio/")), F.lit("audio")), F.when(F.startswith(mime, F.lit("video/")), F.lit("video")))
    g = F.lit("generic")
    return F.coalesce(named, F.when(is_image(u, g), "image").when(is_stylesheet(u, g), "stylesheet").when(is_audio(u, g), "audio").when(is_video(u, g), "video").when(is_webpage(u, g), "webpage").otherwise("generic"))


# ---- resolution

ZERO = "Error: Zero Length Url"
ONLY_PROTOCOL = "Error: Invalid URL containing only protocol"
NO_BASE = "Error: Relative URL without a base"
_SCHEME = re.compile(r"^(https?|ftp)://", re.I)
_DIRTY = str.maketrans({c: f"%{ord(c):02X}" for c in L.DIRTY_CHARACTERS})


def _escaped(u: str) -> str:
    return re.sub(r"%[a-fA-F0-9]{2}", lambda m: m.group().upper(), re.sub(r"\s", "%20", u).translate(_DIRTY))


def _reduced(segments: list[str]) -> list[str]:
    out: list[str] = []
    for s in segments:
        if s == "..":
            if out:
                out.pop()
        elif s not in (".", ""):
            out.append(s)
    return out


def _filelike(segment: str) -> bool:
    return bool(segment) and ("." not in segment or re.search(r".\..", segment) is not None) and not any(segment.lower().endswith(x) for x in L.DIRECTORY)


def _place(rest: str) -> tuple[list[str], str, str]:
    """Directories, file name and query part (with its question mark) of what stands after a host or before a relative link's end."""
    plain, mark, tail = rest.partition("?")
    segments = plain.split("/")
    name = segments.pop() if segments else ""
    if name in (".", ".."):
        segments, name = [*segments, name], ""
    if name and not _filelike(name) and not mark:
        segments, name = [*segments, name], ""
    return segments, name, mark + tail


def resolve_one(link: str | None, base: str | None = None, kind: str | None = "generic") -> tuple[str | None, bool, bool, str, str | None]:
    """Full URL, whether it was relative, whether it is filelike, its anchor, and an error."""
    link = (link or "").strip()
    if not link:
        return None, False, False, "", ZERO
    if link.lower() in ("http://", "https://", "ftp://", "file://"):
        return None, False, False, "", ONLY_PROTOCOL
    found = ""
    if kind == "anchor" and "#" in link:
        link, found = link[: link.index("#")], link[link.index("#") :]
        link = link or (base or "")
        if not link:
            return None, True, False, found, NO_BASE
    if link.lower().startswith("file:"):
        full = link.rstrip("/") if link.lower() != "file:/" else link
        return _escaped(full), False, _filelike(full.rsplit("/", 1)[-1].rpartition(":")[2]) and not link.endswith("/"), found, None
    relative = False
    scheme = _SCHEME.match(link)
    if scheme:
        protocol_, rest = scheme.group(1).lower(), link[scheme.end() :]
    elif link.startswith("//"):
        own = _SCHEME.match(base or "")
        protocol_, rest = (own.group(1).lower() if own else "http"), link[2:]
    elif re.match(r"(www\d*|ftp)\.", link, re.I):
        protocol_, rest = "http", link
    else:
        relative = True
        own = _SCHEME.match(base or "")
        if not own:
            return None, True, False, found, NO_BASE
        protocol_ = own.group(1).lower()
        server, slash, above = (base or "")[own.end() :].partition("/")
        server = re.split(r"[?#]", server)[0]
        if link.startswith("/"):
            rest = f"{server}{link}"
        else:
            plain, mark, _ = above.partition("?")
            head = plain.split("/") if slash else [""]
            if head and (_filelike(head[-1]) or not head[-1]):
                head = head[:-1]
            rest = "/".join([server, *(s for s in head if s), link])
    m = re.match(r"[^/?#]*", rest)
    server, rest = m.group(), rest[m.end() :]
    name, _, port_ = server.lower().partition(":")
    if port_.isdigit() and int(port_) != L.PORTS[protocol_]:
        name = f"{name}:{port_}"
    dirs, leaf, tail = _place(rest.lstrip("/"))
    dirs = _reduced(dirs)
    folder = "/" + "".join(f"{d}/" for d in dirs)
    return _escaped(f"{protocol_}://{name}{folder}{leaf}{tail}"), relative, bool(leaf), found, None


RESOLVED = T.StructType(
    [T.StructField("full_url", T.StringType()), T.StructField("is_relative", T.BooleanType()), T.StructField("filelike", T.BooleanType()), T.StructField("anchor", T.StringType()), T.StructField("error", T.StringType())]
)


@F.pandas_udf(RESOLVED)
def resolve_url(link: pd.Series, base: pd.Series, kind: pd.Series) -> pd.DataFrame:
    none = lambda s: s.astype(object).where(s.notna(), None)
    rows = [resolve_one(a, b, c) for a, b, c in zip(none(link), none(base), none(kind))]
    return pd.DataFrame(rows, columns=["full_url", "is_relative", "filelike", "anchor", "error"])
