"""What several operators of this subpackage need: shared storage, byte-level words and batch slicing.

Text is handled as the UTF-8 bytes that Arrow already holds, so that words, shingles and
their hashes are numpy operations over whole batches, without a Python object for each word.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a worker turns into arrays at once; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch on its way to a worker, in place of Spark's default; one longer row makes a batch of its own.
BATCH_BYTES, SPARKS_BATCH = str(8 << 20), "67108864b"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All bytes but ASCII digits, lower-case letters and those of non-ASCII characters (used after lower-casing).
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session in one process (tests) gets a temporary one, and any other fails."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def remove(*tables: DataFrame) -> None:
    """Deletes the files of stored() tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.dirname(df._stored_at))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow, in batches of at most BATCH_BYTES unless the session has set another limit than Spark's."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, SPARKS_BATCH) == SPARKS_BATCH:
        conf.set(_BATCH, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names behind as many underscores as no column begins with."""
    before = "_"
    while any(c.lower().startswith(before) for c in columns):
        before += "_"
    return [before + n for n in names]


def text_of(column: pa.Array) -> pa.Array:
    """The column without nulls (null: empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the n + 1 offsets of its texts in them."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Gives memory that a task no longer holds back to the system: workers live on beside the tasks of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about `most` bytes of text, however many rows Spark put in one; at their end memory is released."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = raw(text_of(batch.column(column)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last
    del batches
    release()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0x2545F4914F6CDD1D
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        for i, step in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            steps = np.full(size, step, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same in every process."""
    up, down = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a batch of texts: byte spans, the text each belongs to, and how many each text has."""

    def __init__(self, column: pa.Array, breaks: np.ndarray = ASCII_SPACE, lower: bool = False):
        data, self.at = raw(text_of(column))
        self.data = LOWER[data] if lower else data
        self.n_texts = len(self.at) - 1
        inside = ~breaks[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.at] = True
        before = np.empty(len(data), bool)
        before[:1], before[1:] = False, inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(data), bool)
        after[-1:], after[:-1] = False, inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.text = np.searchsorted(self.at, self.starts, "right") - 1
        self.counts = np.bincount(self.text, minlength=self.n_texts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


_PLACE = mix(np.arange(1001, 1065, dtype=np.uint64))


def shingles(hashes: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words that lie in one text, and the index of each run's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += mix(hashes[j : j + n] + _PLACE[j % 64]) * (_PLACE[(j + 7) % 64] | np.uint64(1))
    first = np.flatnonzero(text[:n] == text[k - 1 :])
    return mix(out[first]), first


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over [at[i], at[i + 1])."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]
