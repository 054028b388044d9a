"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbours and pairs with one word between
them, lower-cased and hashed to 2^22 places. Training keeps a rate for each coordinate, and
the L1 term leaves most weights at zero: only the others are broadcast, as two short arrays.

The model is fitted on the first `TRAIN_ROWS` labelled rows by a hash of doc_id, in their natural
share of classes: a balanced sample, with its bias moved back to the true rate, scored nearly a
third of unseen clean texts at 0.3 or more, as each common word then weighs a little towards
the class that has been made frequent. Features are made by executors, written to the shared
folder, and stream to the driver row by row. Every row is scored over its whole text. Scores
depend on the text alone.

Defined results: null and empty texts score by the bias alone. Rows with a null doc_id or
label train nothing; where no labelled row is left, or only one class, the bias is the smoothed
base rate. held_out is false for a null doc_id. Repeated documents get a row each; repeated
labels or labelled documents train again, within the bound. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.shared import NOT_ALNUM, Words, chunks, mapped, mix, remove, shingles, stored, table

#: Labelled rows that are learnt from at most; they are the only bounded sample here.
TRAIN_ROWS = 16_000
BITS = 22
THRESHOLD = 0.3
EPOCHS = 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.1


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of all features of a batch, in no order, and the text of each; a feature that a text repeats is repeated."""
    w = Words(column, NOT_ALNUM, lower=True)
    h = w.hashes()
    out, text = [mix(h)], [w.text]
    pairs, first = shingles(h, w.text, 2)
    out.append(pairs)
    text.append(w.text[first])
    if len(h) > 2:
        apart = w.text[:-2] == w.text[2:]
        out.append(mix(h[:-2][apart] * np.uint64(0x9E3779B97F4A7C15) + mix(h[2:][apart] + np.uint64(2))))
        text.append(w.text[:-2][apart])
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(text)


def distinct_features(column: pa.Array) -> list[np.ndarray]:
    places, text = features(column)
    keys = np.unique((text.astype(np.int64) << BITS) | places)
    at = np.searchsorted(keys >> BITS, np.arange(len(column) + 1))
    return [(keys[at[i] : at[i + 1]] & ((1 << BITS) - 1)).astype(np.int32) for i in range(len(column))]


class Model:
    """Non-zero weights by place, and the bias."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, bias: float):
        self.places, self.weights, self.bias = places, weights, bias

    def scores(self, column: pa.Array) -> np.ndarray:
        places, text = features(column)
        at = np.minimum(np.searchsorted(self.places, places), max(len(self.places) - 1, 0))
        own = self.places[at] == places if len(self.places) else np.zeros(len(places), bool)
        keys = np.unique(text[own] * (len(self.places) + 1) + at[own])
        sums = np.bincount(keys // (len(self.places) + 1), weights=self.weights[keys % (len(self.places) + 1)] if len(keys) else None, minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -35, 35)))


def fit(rows: Callable[[], Iterable[tuple[np.ndarray, int]]]) -> Model:
    """FTRL-proximal over what each call of rows() gives: distinct feature places and label of each row, in a fixed order; EPOCHS times."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = bias = 0.0
    ones = count = 0
    for epoch in range(EPOCHS):
        for own, label in rows():
            if epoch == 0:
                ones, count = ones + label, count + 1
            zi, root = z[own], np.sqrt(n[own])
            w = np.where(np.abs(zi) > L1, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2), 0.0)
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA + L2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            after = np.sqrt(root * root + g * g)
            z[own] = zi + g - (after - root) / ALPHA * w
            n[own] = after * after
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
        if ones in (0, count):
            rate = (ones + 1) / (count + 2)
            return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(rate / (1 - rate))))
    some = np.flatnonzero(np.abs(z) > L1)
    weights = (np.sign(z[some]) * L1 - z[some]) / ((BETA + np.sqrt(n[some])) / ALPHA + L2)
    return Model(some, weights, float(-bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA + L2)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels may not be learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of labels (doc_id, toxic) over docs (doc_id, text), without the held-out rows."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("turn"))
    # labels of documents that are not there would take room in the sample
    known = usable.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = known.orderBy("turn", "doc_id", "toxic").limit(rows)
    # at most `rows` rows of three numbers, so the bound on what is broadcast is fixed
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("turn", F.xxhash64("doc_id", "toxic", "text").alias("tie"), "toxic", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            own = distinct_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("turn"), batch.column("tie"), batch.column("toxic"), pa.array([x.tobytes() for x in own], pa.binary())], ["turn", "tie", "toxic", "f"])

    made = stored(mapped(texts, run, "turn long, tie long, toxic int, f binary"), "features")
    in_order = made.orderBy("turn", "tie").select("toxic", "f")
    model = fit(lambda: ((np.frombuffer(r["f"], np.int32), r["toxic"]) for r in islice(in_order.toLocalIterator(prefetchPartitions=True), rows)))
    remove(made)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            s = shared.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield batch.filter(pa.array(shared.value.scores(batch.column("text")) < THRESHOLD))

    return mapped(docs, run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
