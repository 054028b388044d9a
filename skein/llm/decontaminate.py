r"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A benchmark item is cut into windows of 10 consecutive words (an item of fewer words is one
window). A window counts as a set of positioned word shingles; since containment must be
whole, its prefix is one shingle, and the rarest is taken, by counts over all documents. A
document joins on that shingle; its place in the window gives where the window would begin,
the length bound asks that the window lies inside the document, the positional bound that
the last shingle agrees, and what is left is verified word by word, a word being 64 bits of a hash.

Up to `BROADCAST_WINDOWS` windows are broadcast as an index, which every batch of documents
meets in one pass. More are joined by shuffle: of each document only the places go out whose
shingle passes a filter of the windows' shingles, each with the words around it.

Null and empty texts have no words, hit nothing, and an item without words has no window. The
windows of a null item_id hit, but count as no item. Repeated items count once for each
item_id; repeated documents give a row each. Ids may have any type. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.shared import NOT_ALNUM, Words, chunks, free_names, mapped, shingles, stored, table

WINDOW = 10
SHINGLE = 5
#: Windows in a broadcast index: 17 numbers of 8 bytes each at most, so 70 MB.
BROADCAST_WINDOWS = 1 << 19
#: Bits of the broadcast filter of shingles, within these powers of two: 32 MB at most.
FILTER_BITS = (16, 28)


class Index:
    """Windows of equal length, found by their rarest shingle. items: places in a list of item ids."""

    def __init__(self, words: np.ndarray, items: np.ndarray, width: int):
        self.words, self.items, self.width = words, items, width
        self.k = min(SHINGLE, width)
        self.grams = _grams(words, width)

    def ordered(self, counts: dict[int, int]) -> Index:
        """Picks the rarest shingle of each window; ties take the first place."""
        known, at = np.unique(self.grams, return_inverse=True)
        n = np.array([counts.get(int(g), 0) for g in known.view(np.int64)], np.int64)
        self.place = np.argmin(n[at].reshape(self.grams.shape), axis=1)
        self.key = self.grams[np.arange(len(self.grams)), self.place]
        order = np.argsort(self.key, kind="stable")
        self.words, self.items, self.grams, self.place, self.key = (x[order] for x in (self.words, self.items, self.grams, self.place, self.key))
        return self

    def find(self, hashes: np.ndarray, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of the occurrences in a batch, and the window of each."""
        g, first = shingles(hashes, text, self.k)
        lo = np.searchsorted(self.key, g)
        hit = np.flatnonzero((lo < len(self.key)) & (self.key[np.minimum(lo, len(self.key) - 1)] == g)) if len(self.key) else np.zeros(0, np.int64)
        starts, windows = [], []
        last_place = self.grams.shape[1] - 1
        if len(hit):
            count = np.searchsorted(self.key, g[hit], "right") - lo[hit]
            for part in np.array_split(np.arange(len(hit)), max(1, int(count.sum()) // 200_000 + 1)):
                h, c = hit[part], count[part]
                w = np.repeat(lo[h] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
                start = np.repeat(first[h], c) - self.place[w]
                own = np.repeat(text[first[h]], c)
                fits = (start >= bounds[own]) & (start + self.width <= bounds[own + 1])  # length
                w, start = w[fits], start[fits]
                ends = shingles_at(hashes, start + last_place, self.k) == self.grams[w, last_place]  # position of the last shingle
                w, start = w[ends], start[ends]
                for j in range(self.width):
                    same = hashes[start + j] == self.words[w, j]
                    w, start = w[same], start[same]
                starts.append(start)
                windows.append(w)
        return (np.concatenate(starts), np.concatenate(windows)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _grams(words: np.ndarray, width: int) -> np.ndarray:
    """Shingles of windows (rows of `width` words), in order of place."""
    k = min(SHINGLE, width)
    return shingles(words.reshape(-1), np.repeat(np.arange(len(words)), width), k)[0].reshape(len(words), width - k + 1)


def shingles_at(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Shingle hashes of the k words from each place."""
    flat = hashes[(first[:, None] + np.arange(k)).reshape(-1)]
    return shingles(flat, np.repeat(np.arange(len(first)), k), k)[0]


def windows_of(benchmark: DataFrame) -> DataFrame:
    """item (text of its id), width, words and grams (hashes) of each distinct window of benchmark (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = Words(batch.column("text"), NOT_ALNUM, lower=True)
            h = w.hashes()
            at = np.concatenate([[0], np.cumsum(w.counts)])
            for i, item in enumerate(batch.column("item").to_pylist()):
                own = h[at[i] : at[i + 1]]
                if not len(own):
                    continue
                width = min(WINDOW, len(own))
                rows = np.unique(np.lib.stride_tricks.sliding_window_view(own, width), axis=0)
                grams = _grams(rows, width)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1).view(np.int64))) for x in (rows, grams)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(rows), pa.string()), pa.array(np.full(len(rows), width, np.int32)), *lists], ["item", "width", "words", "grams"])

    return mapped(benchmark.select(F.col("item_id").cast("string").alias("item"), "text"), run, "item string, width int, words array<long>, grams array<long>")


def shingle_counts(docs: DataFrame, grams: dict[int, np.ndarray]) -> DataFrame:
    """gram, n: how often each shingle of `grams` (by its number of words, sorted) occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(v), np.int64) for k, v in shared.value.items()}
        for batch in chunks(batches):
            w = Words(batch.column("text"), NOT_ALNUM, lower=True)
            h = w.hashes()
            for k, keys in shared.value.items():
                g = shingles(h, w.text, k)[0]
                at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                total[k] += np.bincount(at[keys[at] == g], minlength=len(keys))
        for k, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[k][some].view(np.int64)), pa.array(n[some])], ["gram", "n"])

    return mapped(docs.select("text"), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


# ---- few windows: a broadcast index

def index_of(docs: DataFrame, windows: DataFrame) -> tuple[list[Index], list[str | None]]:
    """Indexes of windows, one for each width, ordered by rarity in docs, and the item ids that they refer to."""
    got = windows.toArrow()
    names: dict[str | None, int] = {}
    items = np.array([names.setdefault(x, len(names)) for x in got.column("item").to_pylist()], np.int64)
    width, words = got.column("width").to_numpy(), got.column("words").combine_chunks()
    out = []
    for k in sorted(set(width.tolist())):
        own = np.flatnonzero(width == k)
        flat = words.take(pa.array(own)).flatten().to_numpy().view(np.uint64)
        out.append(Index(flat.reshape(len(own), k), items[own], k))
    wanted = {k: np.unique(np.concatenate([i.grams.reshape(-1) for i in out if i.k == k])) for k in {i.k for i in out}}
    counts = shingle_counts(docs, wanted).toArrow() if wanted else None  # a row for each shingle of the index at most
    known = dict(zip(counts.column("gram").to_pylist(), counts.column("n").to_pylist())) if wanted else {}
    return [i.ordered(known) for i in out], list(names)


def hits(column: pa.Array, indexes: list[Index]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, hit words of each text, and the distinct (text, item) pairs in order."""
    w = Words(column, NOT_ALNUM, lower=True)
    h = w.hashes()
    bounds = np.concatenate([[0], np.cumsum(w.counts)])
    cover = np.zeros(len(h) + 1, np.int64)
    found = [np.zeros((0, 2), np.int64)]
    for index in indexes:
        start, window = index.find(h, w.text, bounds)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + index.width, -1)
        found.append(np.unique(np.stack([w.text[start], index.items[window]], 1), axis=0))
    hit = np.cumsum(cover)[: len(h)] > 0
    return w.counts.astype(np.int64), np.bincount(w.text[hit], minlength=w.n_texts).astype(np.int64), np.unique(np.concatenate(found), axis=0)


# ---- many windows: a shuffle join

def _marks(grams: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A bit set of the shingles in a column, and its size as a power of two."""
    n = grams.count()
    bits = int(np.clip((16 * n).bit_length(), *FILTER_BITS))
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = grams.select(place.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("m")).toArrow()
    marks = np.zeros((1 << bits) // 64, np.int64)
    marks[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return marks, bits


def _marked(g: np.ndarray, marks: np.ndarray, bits: int) -> np.ndarray:
    b = (g >> np.uint64(64 - bits)).astype(np.int64)
    return ((marks[b >> 6] >> (b & 63)) & 1) == 1


_KEY = ("h1", "h2")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with 128 bits of a hash of the text: what a text hits depends on nothing else."""
    return docs.select("text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))


def joined_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """h1, h2, item, start, width of the occurrences of windows in the texts of docs, by a shuffle join on the windows' rarest shingle."""
    spark = docs.sparkSession
    grams = windows.select(F.least("width", F.lit(SHINGLE)).alias("k"), F.explode("grams").alias("gram")).distinct()
    sizes = [r["k"] for r in grams.select("k").distinct().collect()]  # five at most
    marks = {k: _marks(grams.where(F.col("k") == k), "gram") for k in sizes}
    shared = spark.sparkContext.broadcast(marks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = Words(batch.column("text"), NOT_ALNUM, lower=True)
            h = w.hashes()
            for k, (own, bits) in shared.value.items():
                g = shingles(h, w.text, k)[0]
                g, n = np.unique(g[_marked(g, own, bits)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    counts = mapped(docs.select("text"), count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    places = windows.select("item", "width", "words", F.posexplode("grams").alias("place", "gram")).join(counts, "gram", "left")
    rare = places.groupBy("item", "width", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "gram")).alias("r"))
    keys = stored(rare.select("item", "width", "words", F.least("width", F.lit(SHINGLE)).alias("k"), F.col("r.place").alias("place"), F.col("r.gram").alias("gram")), "windows")
    prefix = spark.sparkContext.broadcast({k: _marks(keys.where(F.col("k") == k).select("gram").distinct(), "gram") for k in sizes})

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = Words(batch.column("text"), NOT_ALNUM, lower=True)
            h = w.hashes()
            bounds = np.concatenate([[0], np.cumsum(w.counts)])
            for k, (own, bits) in prefix.value.items():
                g, first = shingles(h, w.text, k)
                some = np.flatnonzero(_marked(g, own, bits))
                text = w.text[first[some]]
                lo = np.maximum(first[some] - (WINDOW - k), bounds[text])
                hi = np.minimum(first[some] + WINDOW, bounds[text + 1])
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(h[at].view(np.int64)))
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("h1").take(rows), batch.column("h2").take(rows), pa.array(np.full(len(some), k, np.int32)), pa.array(g[some].view(np.int64)), pa.array(first[some] - bounds[text]), pa.array((first[some] - lo).astype(np.int32)), near],
                    ["h1", "h2", "k", "gram", "pos", "before", "near"],
                )

    found = mapped(_keyed(docs), emit, "h1 long, h2 long, k int, gram long, pos long, before int, near array<long>")
    met = found.join(keys, ["k", "gram"]).where((F.col("before") >= F.col("place")) & (F.size("near") - F.col("before") + F.col("place") >= F.col("width")))
    same = met.where(F.slice("near", F.col("before") - F.col("place") + 1, F.col("width")) == F.col("words"))
    return same.select(*_KEY, "item", (F.col("pos") - F.col("place")).alias("start"), "width").distinct()


# ---- the operator

def _join(docs: DataFrame, benchmark: DataFrame) -> tuple[list[Index], list[str | None]] | DataFrame:
    """An index of the benchmark's windows, or where they are many the hits."""
    windows = stored(windows_of(benchmark).distinct(), "windows")
    return index_of(docs, windows) if windows.count() <= BROADCAST_WINDOWS else joined_hits(docs, windows)


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = _join(docs, benchmark)
    if isinstance(found, DataFrame):
        return _from_hits(docs, stored(found, "hits"), kind)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = _digest([])
        indexes, names = shared.value
        for batch in chunks(batches):
            n_words, n_hit, pairs = hits(batch.column("text"), indexes)
            at = np.searchsorted(pairs[:, 0], np.arange(batch.num_rows + 1))
            items = [[x for j in pairs[at[i] : at[i + 1], 1] if (x := names[j]) is not None] if at[i] < at[i + 1] else [] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([_digest(x) if x else none for x in items]), pa.array(n_hit > 0)],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return mapped(docs, run, f"doc_id {kind}, {_RESULT}")


def _from_hits(docs: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h1"), batch.column("h2"), pa.array(Words(batch.column("text"), NOT_ALNUM, lower=True).counts.astype(np.int64))], ["doc_id", "h1", "h2", "n_words"])

    keyed = docs.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    rows = mapped(keyed, words, f"doc_id {kind}, h1 long, h2 long, n_words long")
    hit = found.select(*_KEY, F.explode(F.sequence("start", F.col("start") + F.col("width") - 1)).alias("at")).distinct().groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_hit"))
    items = found.groupBy(*_KEY).agg(F.sort_array(F.collect_set("item")).alias("items"))
    joined = rows.join(hit.join(items, list(_KEY)), list(_KEY), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no window of the benchmark."""
    found = _join(docs, benchmark)
    if isinstance(found, DataFrame):
        one, two = free_names(docs.columns, *_KEY)
        texts = stored(found.select(*_KEY).distinct(), "hits").select(F.col("h1").alias(one), F.col("h2").alias(two))
        return docs.join(texts, (F.xxhash64("text") == F.col(one)) & (F.xxhash64(F.lit(1), "text") == F.col(two)), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(found[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield batch.filter(pa.array(hits(batch.column("text"), shared.value)[1] == 0))

    return mapped(docs, run, docs.schema)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), n AS (
  SELECT item_id, ws, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0
), v AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS s FROM n, unnest(range(1, len(ws) - k + 2)) AS u(i)
), g AS (
  SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM v) z, unnest(range(1, len(ws) - k + 2)) AS u(i)
), h AS (
  SELECT doc_id, i, g.k, item_id FROM g JOIN v ON g.k = v.k AND g.s = v.s
), c AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(0, k)) AS u(j) GROUP BY doc_id
), m AS (
  SELECT doc_id, count(item_id) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
