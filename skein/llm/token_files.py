r"""Token ids in files coded by static range asymmetric numeral systems (rANS).

Documents are dealt to shards by ranges of doc_id and sorted inside them, so that the shards
in order hold ascending ids. A shard is a run of sections; each section is one value of the
binary column `section`, and decodes without any other:

    b"SKRA" | u8 version | u8 bytes an id | u32 lanes | u32 steps a checkpoint | u32 documents | u32 blocks | u32 symbols
    symbols: u32 id * symbols, u32 frequency * symbols     one table, shared by the blocks; sums to 2^20
    blocks:  u32 documents, u64 ids, u64 words, u32 checkpoints, u32 crc32 of the ids
    lengths: u64 ids of each document
    for each block: per checkpoint u64 first word, u32 crc32 of its words, u64 state * lanes; then u32 word * words

Ids of a block are laid out in rows of `lanes`; every lane has its own 64-bit state, kept in
[2^31, 2^63) by moving 32-bit words. A checkpoint is the states before a row and the place of
the next word; each run of rows between two checkpoints can be checked and decoded alone.

Null texts count as empty and give the end id alone; a null doc_id sorts first; ties sort by
text; repeated rows are written each time. An empty table gives no files and no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.shared import chunks, mapped, stored, table, text_of

SCALE_BITS = 20
LANES = 4096
CHECKPOINT_ROWS = 64
BLOCK_IDS = 1 << 19
#: Ids after which a section is closed; a longer document makes a longer section.
SECTION_IDS = 1 << 21
#: Distinct words whose ids a worker remembers.
CACHE_WORDS = 1_800_000
#: The commonest words of the first that a worker meets have a table of their own, looked up first.
HOT_WORDS, MET_WORDS = 20_000, 400_000
END_ID = 2
#: Shards whose bounds are found by sketch and written into the plan; more are dealt by Spark's range partitioning.
MOST_BOUNDS = 2048

_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_HEAD = struct.Struct("<4sBBIIIII")
_BLOCK = struct.Struct("<IQQII")


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, and their frequencies scaled to a sum of 2^20, each 1 at least."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols].astype(np.float64)
    total = 1 << SCALE_BITS
    if len(symbols) > total:
        raise ValueError("more symbols than the scale holds")
    scaled = np.maximum(1, np.floor(counts * ((total - len(symbols)) / counts.sum()))).astype(np.int64)
    spare = total - int(scaled.sum())
    order = np.argsort(-counts, kind="stable")
    if spare >= 0:
        scaled[order[0]] += spare
    for i in order:
        if spare >= 0:
            break
        cut = min(int(scaled[i]) - 1, -spare)
        scaled[i] -= cut
        spare += cut
    return symbols.astype(np.uint32), scaled.astype(np.uint32)


class Coder:
    """Encodes and decodes blocks of one table."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols = symbols
        self.freq = freq.astype(np.uint64)
        self.first = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.most = self.freq << np.uint64(63 - SCALE_BITS)

    def encode(self, ids: np.ndarray, lanes: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """Checkpoints (first word, states), in order of rows, and the words."""
        inverse = np.zeros(int(self.symbols[-1]) + 1 if len(self.symbols) else 1, np.int64)
        inverse[self.symbols] = np.arange(len(self.symbols))
        place = inverse[ids]
        freq, first, most = self.freq[place], self.first[place], self.most[place]
        rows = -(-len(ids) // lanes)
        x = np.full(lanes, _LOW, np.uint64)
        out: list[np.ndarray] = []
        moved, marks = 0, []
        for row in range(rows - 1, -1, -1):
            at = slice(row * lanes, (row + 1) * lanes)
            f = freq[at]
            own = x[: len(f)]
            full = own >= most[at]
            if full.any():
                words = own[full]
                out.append((words & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                moved += len(words)
                own[full] = words >> _WORD
            q = own // f
            x[: len(f)] = (q << np.uint64(SCALE_BITS)) + (own - q * f) + first[at]
            if row % CHECKPOINT_ROWS == 0:
                marks.append((moved, x.copy()))
        words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        return [(moved - m, states) for m, states in reversed(marks)], words

    def table(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freq.astype(np.int64))

    def decode(self, x: np.ndarray, words: np.ndarray, n: int, lookup: np.ndarray) -> np.ndarray:
        """n ids from states and the words that follow."""
        lanes, x = len(x), x.copy()
        out = np.empty(n, np.uint32)
        at = 0
        for i in range(0, n, lanes):
            own = x[: min(lanes, n - i)]
            slot = own & np.uint64((1 << SCALE_BITS) - 1)
            s = lookup[slot]
            out[i : i + len(own)] = s
            own = self.freq[s] * (own >> np.uint64(SCALE_BITS)) + slot - self.first[s]
            low = own < _LOW
            k = int(np.count_nonzero(low))
            if k:
                own[low] = (own[low] << _WORD) | words[at : at + k]
                at += k
            x[: len(own)] = own
        return self.symbols[out]


def encode_section(documents: list[np.ndarray], lanes: int = LANES, block_ids: int = BLOCK_IDS) -> bytes:
    """One section of whole documents (arrays of ids)."""
    lengths = np.array([len(d) for d in documents], np.uint64)
    ids = np.concatenate(documents).astype(np.uint32) if documents else np.zeros(0, np.uint32)
    symbols, freq = frequencies(ids) if len(ids) else (np.zeros(0, np.uint32), np.zeros(0, np.uint32))
    coder = Coder(symbols, freq)
    heads, bodies = [], []
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    first = 0
    while first < len(documents):
        last = min(len(documents), max(first + 1, int(np.searchsorted(at, at[first] + block_ids, "right")) - 1))
        part = ids[at[first] : at[last]]
        marks, words = coder.encode(part, lanes)
        ends = [m[0] for m in marks[1:]] + [len(words)]
        heads.append(_BLOCK.pack(last - first, len(part), len(words), len(marks), zlib.crc32(part.astype("<u4").tobytes())))
        for (word, states), end in zip(marks, ends):
            bodies.append(struct.pack("<QI", word, zlib.crc32(words[word:end].astype("<u4").tobytes())) + states.astype("<u8").tobytes())
        bodies.append(words.astype("<u4").tobytes())
        first = last
    head = _HEAD.pack(b"SKRA", 1, 4, lanes, CHECKPOINT_ROWS, len(documents), len(heads), len(symbols))
    return b"".join([head, symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), *heads, lengths.astype("<u8").tobytes(), *bodies])


class Section:
    """A section's tables and the places of its runs, each of which decodes from its checkpoint alone."""

    def __init__(self, section: bytes):
        magic, version, _, self.lanes, self.every, n_docs, n_blocks, n_symbols = _HEAD.unpack_from(section)
        if magic != b"SKRA" or version != 1:
            raise ValueError("not a section of token ids")
        at = _HEAD.size
        self.coder = Coder(np.frombuffer(section, "<u4", n_symbols, at), np.frombuffer(section, "<u4", n_symbols, at + 4 * n_symbols))
        self.lookup = self.coder.table()
        at += 8 * n_symbols
        heads = [_BLOCK.unpack_from(section, at + i * _BLOCK.size) for i in range(n_blocks)]
        at += n_blocks * _BLOCK.size
        self.lengths = np.frombuffer(section, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        self.blocks = []  # documents, ids, crc32, and of each run the checksum, states, words and number of ids
        for docs, n, n_words, n_marks, crc in heads:
            marks = []
            for _ in range(n_marks):
                word, sum_ = struct.unpack_from("<QI", section, at)
                marks.append((word, sum_, np.frombuffer(section, "<u8", self.lanes, at + 12)))
                at += 12 + 8 * self.lanes
            words = np.frombuffer(section, "<u4", n_words, at)
            at += 4 * n_words
            ends = [m[0] for m in marks[1:]] + [n_words]
            most = self.every * self.lanes
            self.blocks.append((docs, n, crc, [(sum_, states, words[word:end], min(most, n - i * most)) for i, ((word, sum_, states), end) in enumerate(zip(marks, ends))]))

    def run(self, block: int, run: int) -> np.ndarray:
        """The ids of one run; raises ValueError where its words' checksum differs."""
        sum_, states, words, n = self.blocks[block][3][run]
        if zlib.crc32(words.tobytes()) != sum_:
            raise ValueError("a run of words is damaged")
        return self.coder.decode(states, words, n, self.lookup)

    def span(self, first: int, last: int) -> np.ndarray:
        """The ids at places [first, last) of the section, from the runs that hold them alone."""
        out, at = [np.zeros(0, np.uint32)], 0
        for block, (_, n, _, runs) in enumerate(self.blocks):
            for run, (_, _, _, own) in enumerate(runs):
                if first < at + own and at < last:
                    out.append(self.run(block, run)[max(first - at, 0) : last - at])
                at += own
        return np.concatenate(out)


def decode_section(section: bytes) -> list[np.ndarray]:
    """The documents of a section; raises ValueError where a checksum differs."""
    made = Section(section)
    out, doc = [], 0
    for block, (docs, _, crc, runs) in enumerate(made.blocks):
        ids = np.concatenate([made.run(block, i) for i in range(len(runs))]) if runs else np.zeros(0, np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block is damaged")
        out += np.split(ids, np.cumsum(made.lengths[doc : doc + docs])[:-1]) if docs else []
        doc += docs
    return out


#: A space between two characters that no tokenizer pattern takes for white space: no token of the vocabulary's pattern crosses it.
_CUT = re.compile(r"(?<=[^\s\x00-\x1f]) (?=[^\s\x00-\x1f])")
_NEAR = re.compile(r"[\s\x00-\x1f][\s\x00-\x1f]")
_encoders: dict[tuple[str, int], Encoder] = {}


#: Signs that the pattern cuts off a word, where one alone ends it.
_ENDS = ".,;:!?"


def _letters(text: str) -> bool:
    """Whether text is letters alone, of those that every version of Unicode knows as such."""
    return text.isalpha() and (text.isascii() or max(text) < "\u0250")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: printable ones as themselves, the others from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


_LETTERS = _byte_letters()


class Encoder:
    """A byte-level BPE tokenizer that remembers the ids of words, within a bound.

    Texts are cut into words, and words into the pieces of the vocabulary's pattern; the
    library's model encodes each piece it has not met. A word with a special token, or a
    tokenizer of another make, goes through the library's own pipeline whole.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        import json

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[str, bytes] = {}  # pieces of words that have several
        self.spaced: dict[str, bytes] = {}  # words that follow a space
        self.hot: dict[str, bytes] = {}  # the commonest of them, few enough for the processor's own memory
        self.met: Counter[str] | None = Counter()  # the first words met, to find those
        self.n_met = 0
        made = json.loads(self.tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        self.plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre.get("add_prefix_space") and made.get("normalizer") is None and made["model"]["type"] == "BPE"
        self.special = [t["content"] for t in made.get("added_tokens") or []]
        self.model = self.tokenizer.model
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.quick = self.plain and not any(_letters(s.rstrip(_ENDS)) for s in self.special)

    @classmethod
    def of(cls, path: str, most: int) -> Encoder:
        """The worker's encoder; one at a time is kept."""
        if (path, most) not in _encoders:
            _encoders.clear()
            _encoders[path, most] = cls(path, most)
        return _encoders[path, most]

    @staticmethod
    def words(text: str) -> list[str]:
        """The text cut at spaces that no piece crosses; each space belongs to the word after it, and is left out."""
        return _CUT.split(text) if _NEAR.search(text) or text[:1].isspace() or text[-1:].isspace() else text.split(" ")

    def _ids(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_LETTERS))]).tobytes()

    def _piece(self, piece: str) -> bytes:
        got = self.known.get(piece)
        if got is None:
            got = self.spaced.get(piece[1:]) if piece[0] == " " and len(piece) > 1 else None
            got = self._ids(piece) if got is None else got
            if len(self.known) < self.most // 4:
                self.known[piece] = got
        return got

    def _word(self, word: str) -> bytes:
        if self.quick and word[:1] == " ":
            own = word[1:]
            if _letters(own):  # the pattern has one piece for it
                return self._ids(word)
            if own and own[-1] in _ENDS and _letters(own[:-1]):  # and two for this
                head = self.spaced.get(own[:-1])
                return (self._ids(word[:-1]) if head is None else head) + self._piece(own[-1])
        if not self.plain or any(s in word for s in self.special):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        pieces = self.pattern.findall(word)
        return self._ids(word) if len(pieces) == 1 else b"".join(map(self._piece, pieces))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out, spaced = [], self.spaced
        for text in texts:
            words = self.words(text)
            coded = list(map(self.hot.get, words))
            coded[0] = self._word(words[0])
            if None in coded:
                for i, got in enumerate(coded):
                    if got is None:
                        word = words[i]
                        got = spaced.get(word)
                        if got is None:
                            got = self._word(" " + word)
                            if len(spaced) < self.most:
                                spaced[word] = got
                        coded[i] = got
            out.append(np.frombuffer(b"".join(coded), "<u4"))
            if self.met is not None:
                self.met.update(words[1:])
                self.n_met += len(words)
                if self.n_met >= MET_WORDS:
                    self.hot = {w: spaced[w] for w, _ in self.met.most_common(HOT_WORDS) if w in spaced}
                    self.met = None
        return out


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, most_bounds: int = MOST_BOUNDS, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Writes docs (doc_id, text) to the shared folder; the files as a table shard, part, first (ids of the shard before), n_tokens, doc_ids, section."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["shard", F.asc_nulls_first("doc_id"), "text"]
    if n <= most_bounds:
        bounds = sorted({int(b) for b in docs.select("doc_id").where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) or []}) if n > 1 else []
        find = F.when(F.col("doc_id").isNull(), 0).otherwise(_rank(F.col("doc_id"), bounds)) if bounds else F.lit(0)
        dealt = docs.withColumn("shard", find.cast("int")).repartitionById(max(n, len(bounds) + 1), "shard").sortWithinPartitions(*order)
    else:  # Spark's own range partitioning reads the texts once more, but needs no expression over the bounds
        dealt = docs.repartitionByRange(n, F.asc_nulls_first("doc_id")).withColumn("shard", F.spark_partition_id()).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path, cache_words)
        end = np.array([end_id], np.uint32)
        shard, part, first, held, names, size = None, 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([encode_section(held)], pa.binary())],
                ["shard", "part", "first", "n_tokens", "doc_ids", "section"],
            )

        for batch in chunks(batches):
            ids = encoder.encode(text_of(batch.column("text")).to_pylist())
            for at, doc_id, own in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), ids):
                if held and (at != shard or size >= SECTION_IDS):
                    yield close()
                    part, first = (part + 1, first + size) if at == shard else (0, 0)
                    held, names, size = [], [], 0
                elif at != shard:
                    part, first = 0, 0
                shard = at
                held.append(np.concatenate([own, end]))
                names.append(doc_id)
                size += len(own) + 1
        if held:
            yield close()

    return stored(mapped(dealt, run, "shard int, part int, first long, n_tokens long, doc_ids array<long>, section binary"), "tokens")


def _rank(column, bounds: list[int]):
    """How many bounds are at most the value, by binary search in nested conditions."""
    if not bounds:
        return F.lit(0)
    mid = len(bounds) // 2
    return F.when(column < bounds[mid], _rank(column, bounds[:mid])).otherwise(F.lit(mid + 1) + _rank(column, bounds[mid + 1 :]))


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, from the decoded sections."""
    spark = files.sparkSession
    totals = {r["shard"]: r["n"] for r in files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a shard
    base, before = {}, 0
    for shard in sorted(totals):
        base[shard], before = before, before + totals[shard]
    shared = spark.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row] for n in batch.schema.names}
                documents = decode_section(one["section"].as_py())
                lengths = np.array([len(d) for d in documents], np.int64)
                start = shared.value[one["shard"].as_py()] + one["first"].as_py() + np.cumsum(lengths) - lengths
                crc = [zlib.crc32(d.astype("<u4").tobytes()) for d in documents]
                yield pa.RecordBatch.from_arrays([one["doc_ids"].values, pa.array(start), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return mapped(files.select("shard", "first", "doc_ids", "section"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, tokenizer_path: str | None = None, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Writes the files and reads them back; cache_words bounds what a worker's memory of words holds, not what is encoded."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return read_tokens(write_tokens(docs, str(tokenizer_path), cache_words=cache_words))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(table(spark, sf_dir, "documents"))
