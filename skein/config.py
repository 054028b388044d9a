"""Crawl settings, as one immutable record; names and defaults of the options that change results."""

from __future__ import annotations

from dataclasses import dataclass, field

from skein.functions.junk import JUNK_DOMAINS, junk_patterns


@dataclass(frozen=True)
class CrawlConfig:
    start_url: str = ""
    project: str = "project"
    depth: int = 10
    extdepth: int = 0
    fetchlevel: int = 0
    subdomain: int = 1
    ignoretlds: int = 0
    robots: bool = True
    images: bool = True
    movies: bool = False
    flash: bool = False
    sounds: bool = False
    documents: bool = True
    html: bool = True
    javascript: bool = True
    javaapplet: bool = True
    getquerylinks: bool = False
    getimagelinks: bool = True
    getstylesheets: bool = True
    pagecache: bool = True
    datacache: bool = False
    maxfiles: int = 5000
    maxbytes: int = 0
    maxfilesize: int = 5242880
    timelimit: int = -1
    retryfailed: int = 1
    linksoffsetstart: int = 0
    linksoffsetend: int = -1
    localise: int = 2
    numparts: int = 4
    forcesplit: bool = False
    useragent: str = "skein/1.0"
    skipruletypes: tuple[str, ...] = ()
    urlpriority: str = ""
    serverpriority: str = ""
    pathurlfilters: tuple[str, ...] = ()
    extnurlfilters: tuple[str, ...] = ()
    regexurlfilters: tuple[str, ...] = ()
    contentfilters: tuple[str, ...] = ()
    metafilters: tuple[str, ...] = ()
    wordfilter: str = ""
    junkfilter: bool = True
    dryrun: bool = False
    junk_domains: tuple[str, ...] = field(default=JUNK_DOMAINS)
    junk_patterns: tuple[str, ...] = field(default=junk_patterns())


def user_browse(start_url: str, **more) -> CrawlConfig:
    """Preset: what a browser loads with one page; rules don't apply to its images and stylesheets."""
    return CrawlConfig(start_url=start_url, depth=0, fetchlevel=2, skipruletypes=("image", "stylesheet"), **more)
