"""Quality rules as a short-circuit cascade.

Each rule rejects texts by one feature. On a bounded sample the planner measures what a rule
costs and what share of texts it rejects, and sorts the rules by rejection per cost; each
batch then goes through them in that order, and a rule sees only the texts that all earlier
ones let pass. A text is kept if no rule rejects it, so the order changes the work, never the
verdict.

Null and empty texts have no words; they fail the base rule. Repeated rows get equal results.
Other columns of the input are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.shared import Words, chunks, mapped, mix, per_text, raw, shingles, span_hashes, table, text_of

#: Rows that the planner times.
SAMPLE_ROWS = 512
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def keyed(hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
    return mix(hashes + mix(group.astype(np.uint64) + np.uint64(1)))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal one elsewhere."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def seen_before(keys: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:][keys[order][1:] == keys[order][:-1]]] = True
    return out


def base_features(column: pa.Array) -> dict[str, np.ndarray]:
    """Word, symbol, line and repetition counts of each text, as the contract of op1 has them."""
    w = Words(column)
    bytes_, at = w.data, w.at
    n_words = w.counts
    in_words = ((bytes_ & 0xC0) != 0x80) & ~_space(bytes_)
    starts, first = shingles(w.hashes(), w.text, WINDOW)
    twice = first[repeated(keyed(starts, w.text[first]))]
    cover = np.zeros(len(w.starts) + WINDOW + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    covered = np.cumsum(cover)[: len(w.starts)] > 0
    lines, line_text = _lines(bytes_, at, w)
    dup = seen_before(keyed(lines, line_text))
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": per_text(in_words, at),
        "n_symbols": per_text(_SYMBOL[bytes_], at),
        "n_dup_lines": np.bincount(line_text[dup], minlength=w.n_texts).astype(np.int64),
        "n_repeat_words": np.bincount(w.text[covered], minlength=w.n_texts).astype(np.int64),
    }


def _space(b: np.ndarray) -> np.ndarray:
    return (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))


def _lines(data: np.ndarray, at: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines that have a word, and the text of each."""
    cuts = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([at[:-1], cuts + 1]), kind="stable")
    text = np.searchsorted(at[:-1], starts, "right") - 1
    # a line that begins where its text ends belongs to the text before, and has no word in any case
    ends = np.minimum(np.searchsorted(cuts, starts), len(cuts))
    ends = np.minimum(np.where(ends < len(cuts), cuts[np.minimum(ends, max(len(cuts) - 1, 0))] if len(cuts) else len(data), len(data)), at[text + 1])
    full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, keep = np.unique(starts[full], return_index=True)
    return span_hashes(data, starts, ends[full][keep]), text[full][keep]


Base = dict[str, np.ndarray]
Rule = Callable[[pa.Array, Base], np.ndarray]


def symbols(column: pa.Array, base: Base) -> np.ndarray:
    """More than one symbol to four words."""
    return 4 * base["n_symbols"] > base["n_words"]


def duplicate_lines(column: pa.Array, base: Base) -> np.ndarray:
    """More than half of the lines repeat an earlier one, among five lines or more."""
    data, at = raw(text_of(column))
    n = per_text(data == 0x0A, at) + 1
    return (n >= 5) & (2 * base["n_dup_lines"] > n)


def word_length(column: pa.Array, base: Base) -> np.ndarray:
    """Words of under two or over twenty characters on average."""
    n = base["n_words"]
    return (base["word_chars"] < 2 * n) | (base["word_chars"] > 20 * n)


def capitals(column: pa.Array, base: Base) -> np.ndarray:
    """More than half of the ASCII letters are capitals."""
    data, at = raw(text_of(column))
    return 2 * per_text(_UPPER[data], at) > per_text(_LETTER[data], at)


def digits(column: pa.Array, base: Base) -> np.ndarray:
    """More than a third of the characters of words are digits."""
    data, at = raw(text_of(column))
    return 3 * per_text(_DIGIT[data], at) > base["word_chars"]


def distinct_words(column: pa.Array, base: Base) -> np.ndarray:
    """Under one distinct word in twenty, among 200 words or more; long texts repeat words by nature, so 1,000 count at most."""
    w = Words(column)
    new = ~seen_before(keyed(w.hashes(), w.text))
    distinct = np.bincount(w.text[new], minlength=w.n_texts)
    return (w.counts >= 200) & (20 * distinct < np.minimum(w.counts, 1000))


def stutter(column: pa.Array, base: Base) -> np.ndarray:
    """More than one word in five equals the word before it."""
    w = Words(column)
    h = w.hashes()
    again = np.flatnonzero((h[1:] == h[:-1]) & (w.text[1:] == w.text[:-1])) + 1
    return 5 * np.bincount(w.text[again], minlength=w.n_texts) > w.counts


RULES: dict[str, Rule] = {f.__name__: f for f in (symbols, duplicate_lines, word_length, capitals, digits, distinct_words, stutter)}


def base_failed(base: Base) -> np.ndarray:
    return (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > REPEAT_PERCENT * base["n_words"])


def measured(column: pa.Array, rules: dict[str, Rule] = RULES) -> dict[str, tuple[float, int]]:
    """Seconds and rejections of each rule on a sample, among texts that the base rule passes."""
    base = base_features(column)
    alive = ~base_failed(base)
    column, base = column.filter(pa.array(alive)), {k: v[alive] for k, v in base.items()}
    out = {}
    for name, rule in rules.items():
        began = time.perf_counter()
        rejects = int(rule(column, base).sum()) if len(column) else 0
        out[name] = time.perf_counter() - began, rejects
    return out


def plan(cost: dict[str, tuple[float, int]], rules: dict[str, Rule] = RULES) -> list[str]:
    """The rules' names by rejections per second, most first; ties keep the given order."""
    gain = {name: rejects / max(seconds, 1e-6) for name, (seconds, rejects) in cost.items()}
    return sorted(rules, key=lambda name: -gain.get(name, 0.0))


def cascade(column: pa.Array, order: list[str], rules: dict[str, Rule] = RULES) -> tuple[Base, np.ndarray, np.ndarray]:
    """Base features, base verdict, and which texts pass; a rule gets only the texts that are still in."""
    base = base_features(column)
    failed = base_failed(base)
    left = np.flatnonzero(~failed)
    texts, own = column.take(pa.array(left)), {k: v[left] for k, v in base.items()}
    for name in order:
        if not len(left):
            break
        passes = ~rules[name](texts, own)
        if not passes.all():
            left, texts, own = left[passes], texts.filter(pa.array(passes)), {k: v[passes] for k, v in own.items()}
    kept = np.zeros(len(failed), bool)
    kept[left] = True
    return base, failed, kept


def sampled_costs(docs: DataFrame, rows: int, rules: dict[str, Rule] = RULES) -> dict[str, tuple[float, int]]:
    """What `measured` gives on up to `rows` texts, spread over the table by a hash; they set the rules' order only. Executors measure: no text comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {name: (0.0, 0) for name in rules}
        for batch in chunks(batches):
            for name, (seconds, rejects) in measured(text_of(batch.column("text")), rules).items():
                total[name] = total[name][0] + seconds, total[name][1] + rejects
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([t[0] for t in total.values()]), pa.array([t[1] for t in total.values()])], ["rule", "seconds", "rejects"])

    part = docs.where(F.col("doc_id").isNull() | ((F.xxhash64("doc_id") % 16) == 0)).select("text").limit(rows)
    out = {name: (0.0, 0) for name in rules}
    for r in mapped(part, run, "rule string, seconds double, rejects long").collect():  # a row for each rule and task
        out[r["rule"]] = out[r["rule"]][0] + r["seconds"], out[r["rule"]][1] + r["rejects"]
    return out


def score_quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the five base features, base_failed and kept for every row of docs (columns doc_id, text)."""
    order = plan(sampled_costs(docs, sample_rows))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            base, failed, kept = cascade(text_of(batch.column("text")), order)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(base[n], pa.int64()) for n in names), pa.array(failed), pa.array(kept)], ["doc_id", *names, "base_failed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS n_lines
  FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM w, unnest(range(1, len(ws) - 6)) AS u(i)
), h AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1
), r AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM h, unnest(range(0, 8)) AS u(j) GROUP BY doc_id
), b AS (
  SELECT w.doc_id, t, n_lines, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(list_distinct(ws)) AS n_distinct,
         len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_again
  FROM w LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 4 * n_symbols > n_words
            OR (n_lines >= 5 AND 2 * n_dup_lines > n_lines)
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 2 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > length(regexp_replace(t, '[^A-Za-z]', '', 'g'))
            OR 3 * length(regexp_replace(t, '[^0-9]', '', 'g')) > word_chars
            OR (n_words >= 200 AND 20 * n_distinct < least(n_words, 1000))
            OR 5 * n_again > n_words) AS kept
FROM f
"""
