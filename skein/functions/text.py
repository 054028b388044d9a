"""Literals, headers, entities and dates."""

from __future__ import annotations

import html as _html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def byte_size(text: Column) -> Column:
    """Bytes of `10kb`, `5MB`, `1g` or a plain number; null for anything else."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*([kmg]?)b?$", 1)
    unit = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*([kmg]?)b?$", 2)
    scale = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)
    return F.when(n != "", (n.cast("double") * scale).cast("long"))


def bandwidth(text: Column) -> Column:
    """Bytes a second of `10kbps`, `1mb/s` or the like."""
    return byte_size(F.regexp_replace(F.lower(F.trim(text)), r"(ps|/s)$", ""))


def plural(word: Column, n: Column) -> Column:
    many = F.when(word.rlike("[^aeiou]y$"), F.regexp_replace(word, "y$", "ies")).when(word.rlike("(s|x|ch|sh)$"), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))
    return F.when(n == 1, word).otherwise(many)


# ---- headers: a map with lower-case keys

def lower_keys(headers: Column) -> Column:
    return F.map_from_entries(F.array_distinct(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))


def content_length(headers: Column, body: Column) -> Column:
    return F.coalesce(F.trim(F.split_part(headers["content-length"], F.lit(","), F.lit(1))).try_cast("long"), F.octet_length(body).cast("long"))


def content_type(headers: Column) -> Column:
    return F.lower(F.trim(F.split_part(headers["content-type"], F.lit(";"), F.lit(1))))


def content_encoding(headers: Column) -> Column:
    return F.coalesce(headers["content-encoding"], F.lit("plain"))


def etag(headers: Column) -> Column:
    return headers["etag"]


def last_modified(headers: Column) -> Column:
    return rfc822(headers["last-modified"])


# ---- entities

@F.pandas_udf(T.StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    return s.map(_html.unescape, na_action="ignore")


# ---- dates of feeds: each gives a timestamp or null, and feed_date the first that is one

def _try(text: Column, *formats: str) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def _zoned(date: Column, zone: Column) -> Column:
    """A UTC timestamp from a local one and `Z`, `+hh:mm`, `+hhmm` or a name."""
    names = {"": 0, "z": 0, "ut": 0, "utc": 0, "gmt": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420}
    z = F.lower(F.trim(zone))
    named = F.coalesce(*(F.when(z == k, F.lit(v)) for k, v in names.items()))
    digits = F.replace(F.regexp_replace(z, "^[+-]", ""), F.lit(":"))
    offset = F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    minutes = F.coalesce(named, F.when(z.rlike(r"^[+-]\d{2}:?(\d{2})?$"), F.when(F.startswith(z, F.lit("-")), -offset).otherwise(offset)))
    return F.timestamp_add("MINUTE", -minutes, date)


_ISO = r"^(\d{4})-?(\d{2})?-?(\d{2})?(?:[T ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?)?\s*(Z|z|[+-]\d{2}:?\d{2})?$"


def iso8601(text: Column) -> Column:
    t = F.trim(text)
    part = lambda i: F.regexp_extract(t, _ISO, i)
    number = lambda i, d: F.when(part(i) == "", d).otherwise(part(i).try_cast("int"))
    stamp = F.try_make_timestamp(number(1, None), number(2, 1), number(3, 1), number(4, 0), number(5, 0), number(6, 0).cast("decimal(8,6)"))
    return F.when(t.rlike(_ISO), _zoned(stamp, part(7)))


w3dtf = iso8601
_RFC = r"^(?:[A-Za-z]+,?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\.?\s+(\d{2,4})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?\s*([A-Za-z]+|[+-]\d{4})?$"
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _month(name: Column, names: list[str]) -> Column:
    return F.nullif(F.array_position(F.array(*(F.lit(n) for n in names)), F.lower(name)), F.lit(0)).cast("int")


def rfc822(text: Column) -> Column:
    t = F.trim(text)
    part = lambda i: F.regexp_extract(t, _RFC, i)
    year = part(3).try_cast("int")
    year = F.when(F.length(part(3)) > 2, year).when(year < 70, year + 2000).otherwise(year + 1900)
    zero = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(0))
    stamp = F.try_make_timestamp(year, _month(F.substring(part(2), 1, 3), _MONTHS), part(1).try_cast("int"), zero(4), zero(5), zero(6).cast("decimal(8,6)"))
    return F.when(t.rlike(_RFC), _zoned(stamp, part(7)))


def mssql(text: Column) -> Column:
    return _try(F.regexp_replace(F.trim(text), r"(\d{2}:\d{2}:\d{2})\.\d+$", "$1"), "yyyy-MM-dd HH:mm:ss")


def korean(text: Column) -> Column:
    """`2004년 05월 28일 01:31:15`, or `2004-05-25 오후 11:23:17` with morning or afternoon."""
    nine = lambda c: F.timestamp_add("HOUR", F.lit(-9), c)
    one = F.regexp_replace(text, r"^(\d{4})년\s*(\d{2})월\s*(\d{2})일\s+(\d{2}:\d{2}:\d{2})$", "$1-$2-$3 $4")
    two = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})\s+(오전|오후)\s+(\d{1,2}):(\d{2}:\d{2})$", "$1 $3:$4")
    noon = F.when(text.rlike("오후"), F.when(F.regexp_extract(text, r"(\d{1,2}):", 1).try_cast("int") < 12, 12).otherwise(0)).otherwise(0)
    return F.coalesce(F.when(text.rlike("년"), nine(_try(one, "yyyy-MM-dd HH:mm:ss"))), F.when(text.rlike("오전|오후"), F.timestamp_add("HOUR", noon, nine(_try(two, "yyyy-MM-dd H:mm:ss")))))


_GREEK = {"Ιαν": 1, "Φεβ": 2, "Μάώ": 3, "Μαώ": 3, "Μαρ": 3, "Απρ": 4, "Μάι": 5, "Μαϊ": 5, "Μαι": 5, "Ιούν": 6, "Ιον": 6, "Ιουν": 6, "Ιούλ": 7, "Ιολ": 7, "Ιουλ": 7, "Αύγ": 8, "Αυγ": 8, "Σεπ": 9, "Οκτ": 10, "Νοέ": 11, "Νοε": 11, "Δεκ": 12}
_HUNGARIAN = ["január", "februári", "március", "április", "máujus", "június", "július", "augusztus", "szeptember", "október", "november", "december"]


def greek(text: Column) -> Column:
    pattern = r"^\S+,\s+(\d{1,2})\s+(\S+)\s+(\d{4})\s+(\d{2}:\d{2}:\d{2})\s*(\S+)?$"
    name = F.regexp_extract(text, pattern, 2)
    month = F.coalesce(*(F.when(name == k, F.lit(_MONTHS[v - 1])) for k, v in _GREEK.items()))
    return rfc822(F.when(text.rlike(pattern), F.concat_ws(" ", F.regexp_extract(text, pattern, 1), month, F.regexp_extract(text, pattern, 3), F.regexp_extract(text, pattern, 4), F.regexp_extract(text, pattern, 5))))


def hungarian(text: Column) -> Column:
    pattern = r"^(\d{4})-([^-]+)-(\d{1,2})T(\d{1,2}):(\d{2})((?:\+|-)\d{2}:\d{2})$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern), iso8601(F.concat(part(1), F.lit("-"), F.lpad(_month(part(2), _HUNGARIAN).cast("string"), 2, "0"), F.lit("-"), F.lpad(part(3), 2, "0"), F.lit("T"), F.lpad(part(4), 2, "0"), F.lit(":"), part(5), part(6))))


def feed_date(text: Column) -> Column:
    return F.coalesce(iso8601(text), rfc822(text), mssql(text), korean(text), hungarian(text), greek(text))


def charset(headers: Column, body: Column) -> Column:
    """A body's encoding: byte order mark, then the header, then the XML declaration, then UTF-8."""
    start = F.hex(F.substring(body, 1, 3))
    mark = F.when(start == "EFBBBF", "utf-8").when(F.startswith(start, F.lit("FEFF")), "utf-16be").when(F.startswith(start, F.lit("FFFE")), "utf-16le")
    said = F.nullif(F.lower(F.regexp_extract(headers["content-type"], r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)", 1)), F.lit(""))
    declared = F.nullif(F.lower(F.regexp_extract(F.decode(F.substring(body, 1, 200), "iso-8859-1"), r"(?i)^\s*<\?xml[^>]*encoding\s*=\s*[\"']([^\"']+)", 1)), F.lit(""))
    return F.coalesce(mark, said, declared, F.lit("utf-8"))


def without_doctype(xml: Column) -> Column:
    return F.regexp_replace(xml, r"(?is)<!DOCTYPE[^>\[]*(\[.*?\])?[^>]*>", "")


def to_utf8(body: Column, encoding: str) -> Column:
    return F.decode(body, encoding)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
