from pyspark.sql import functions as F

from skein.config import CrawlConfig
from skein.operators import cache
from skein.plans import download as D


def test_save_statuses(spark):
    body = bytearray(b"text")
    known = spark.createDataFrame([("a", 5.0, None, None, None), ("b", None, "e", None, bytearray(b"z")), ("c", None, "e", None, None)], "url string, last_modified double, etag string, checksum string, data binary")
    rows = [("a", "webpage", 0, 5.0, None, body, True, None), ("b", "webpage", 0, None, "e", body, False, None), ("c", "webpage", 0, None, "e", body, False, None), ("d", "webpage", 0, None, None, body, False, None), ("e", "webpage", 404, None, None, None, False, None), ("f", "webpage", 0, None, None, body, False, "junk"), ("g", "webpage", 0, None, None, bytearray(b"bad word"), False, None)]
    df = spark.createDataFrame(rows, "url string, kind string, status int, last_modified double, etag string, body binary, file_present boolean, filter_reason string")
    got = {r["url"]: r["download_status"] for r in D.save_pages(df, known, CrawlConfig(wordfilter="bad")).collect()}
    assert got == {"a": "UPTODATE", "b": "CACHE_SYNCED", "c": "CACHE_SYNC_FAILED", "d": "SAVED", "e": "FAILED", "f": "FILTERED", "g": "FILTERED"}
    assert {r["url"]: r["request_kind"] for r in cache.requests(df.select("url"), known).collect()}["d"] == "GET"


def test_retries(spark):
    fetched = spark.createDataFrame([(1, "u", 500, None), (2, "v", 404, None), (3, "w", 0, "x"), (4, "z", 400, None)], "url_id long, url string, status int, html string")
    snapshot = spark.createDataFrame([(1, 0, "now"), (4, 400, None)], "url_id long, status int, html string")
    got = {r["url"]: (r["status"], r["retried"], r["fatal"]) for r in D.retry_failed(fetched, snapshot, CrawlConfig()).collect()}
    assert got == {"u": (0, True, False), "v": (404, False, True), "w": (0, False, False), "z": (400, True, True)}


def test_parts(spark):
    files = spark.createDataFrame([("http://h/a", 10), ("http://o/b", 4)], "url string, length long")
    pieces = D.split_download(files, CrawlConfig(numparts=3), spark.createDataFrame([("h",)], "host string"))
    assert sorted((r["url"], r["range_start"], r["range_end"]) for r in pieces.collect()) == [("http://h/a", 0, 2), ("http://h/a", 3, 5), ("http://h/a", 6, 9), ("http://o/b", 0, 3)]
    got = pieces.withColumn("data", F.when(F.col("part") == 1, F.lit(b"x")).otherwise(F.expr("cast(repeat('y', int(range_end - range_start + 1)) as binary)")))
    assert [tuple(r) for r in D.short_pieces(got).collect()] == [("http://h/a", 1, 4, 5)]
    assert {r["url"]: r["complete"] for r in D.whole_files(files, got).collect()} == {"http://h/a": False, "http://o/b": True}
    assert {r["url"]: r["offset"] for r in D.resume_offset(got).collect()} == {"http://h/a": 8, "http://o/b": 4}
    pairs = spark.createDataFrame([("h", "o"), ("h", "q")], "a string, b string")
    hosts = spark.createDataFrame([("h", "1.1.1.1"), ("o", "1.1.1.1")], "host string, ip string")
    assert {r["b"]: r["same_ip"] for r in D.same_address(pairs, hosts).collect()} == {"o": True, "q": False}
