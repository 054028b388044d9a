"""Grouped prefix join for n-gram Jaccard similarity.

A document is the set of its distinct k-word shingles. Shingles are totally ordered: first by
how common their bucket is in a corpus-wide count sketch of fixed size (rare first), then by
hash. Two sets whose Jaccard similarity reaches the threshold share a shingle among the first
n - ceil(threshold * n) + 1 of each.

More: of an overlap that two sizes need, all that does not fit behind the prefixes must lie in
them (`_needed`); with longer prefixes and near sizes, that is most of a prefix.

1. Equal sets are one node (least doc_id), and nodes with equal prefix and size one group.
2. The prefixes of groups meet by shingle. In each list, a group meets the one before it by size
   and the list's hub, which has the fewest prefix shingles that no other group has; the one it
   meets most often is proposed, and in groups of several nodes the least node is. Proposals that
   share enough of their prefixes are verified on whole sets, and the links give first components.
3. While lists of over `LONG_LIST` entries lie in several components, the entries outside the
   largest one meet a hub of it in further star rounds, which move those lists alone; the
   components of the other lists are renamed once, after the last round.
4. What lies in different components even then is compared: an entry meets another if theirs can
   be the first common shingle of sets that link, by their sizes and both positions; so a pair
   meets about once, and in long lists only within the bands of size that a position leaves. Pairs
   that share enough of their prefixes are expanded to the groups' nodes and verified. A pair left
   out is either connected already or cannot reach the threshold, so no component is lost, while
   the pairs of a large group of near copies are never written out.

Shingles are compared as 58 bits of a hash, and whole sets by the number of those that both have:
two shingles of one comparison that collide, at one in 10^17 a pair of them, would count as one.

Defined results: null, empty and blank texts have size 0 and their own doc_id as component.
A text of under k words is one shingle. Rows that share a doc_id are one document. A null
doc_id gives a null component, and links nothing. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.llm.components import connected_components
from skein.llm.shared import Words, chunks, mapped, mix, remove, shingles, stored, table

#: The count sketch has about one bucket for 200 bytes of text, within these powers of two; it is broadcast, a byte a bucket.
SKETCH_BITS = (16, 24)
CHUNK_BITS = 16
#: Ids of documents to compare that are broadcast at most (8 bytes each), and bits of the filter that stands for more of them.
BROADCAST_IDS = 1_000_000
FILTER_BITS = 28
#: Entries of one list that a task gets at most, about.
HOT_ENTRIES = 1 << 20
#: A list of more entries is compared by bands of size, each BAND times as wide as the one before, and gets further star rounds first.
LONG_LIST = 128
BAND = 1.04
#: Star rounds after the first, at most; what they leave is compared in any case.
STAR_ROUNDS = 3
#: A prefix is longer than it needs to be for one common shingle, by one in so many of the set.
EXTRA = 20


def _sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a batch in order of text, and the n + 1 offsets of its texts in them; 58 bits each, not yet distinct."""
    w = Words(batch.column("text"), lower=True)
    h = w.hashes()
    full, first = shingles(h, w.text, k)
    text = w.text[first]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        word_at = np.concatenate([[0], np.cumsum(w.counts)])
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = w.counts[short] > j
            whole[has] = mix(whole[has] + h[word_at[short[has]] + j] + np.uint64(j + 1))
        full, text = np.concatenate([full, mix(whole + np.uint64(977))]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        full, text = full[order], text[order]
    return full >> np.uint64(6), np.searchsorted(text, np.arange(w.n_texts + 1))


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h + np.uint64(3)) >> np.uint64(64 - bits)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """32-bit counts, compressed; all lowest bytes stand together, as the others are mostly zero."""
    return zlib.compress(np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def rank_table(docs: DataFrame, k: int) -> tuple[np.ndarray, int, float]:
    """Class of each bucket of the count sketch over all shingles of docs, in half standard deviations from four below the mean, the sketch's bits, and its mean.

    A byte a bucket comes to the driver and is broadcast: 16 MB at most.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(int(size // 200).bit_length(), *SKETCH_BITS))
    n_chunks = 1 << (bits - CHUNK_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(1 << bits, np.uint32), [], 0
        for batch in chunks(batches):
            held.append(_bucket(_sets(batch, k)[0], bits))
            n += len(held[-1])
            if n >= 1 << bits:
                total += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
                held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
        for i, part in enumerate(np.split(total, n_chunks)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_packed(part)], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                total[i] = total.get(i, 0) + _unpacked(packed).astype(np.int64)
        for i, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([int(part.sum())], pa.int64())], ["chunk", "counts", "n"])

    parts = stored(mapped(mapped(docs.select("text"), count, "chunk int, counts binary").repartition("chunk"), add, "chunk int, counts binary, n long"), "sketch")
    mean = max((parts.agg(F.sum("n")).first()[0] or 0) / (1 << bits), 1.0)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, packed in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                c = np.frombuffer(packed, np.int64)
                own = np.clip(np.floor((c - mean) / np.sqrt(mean) * 2) + 8, 0, 48) + np.clip(np.floor(np.log2(np.maximum(c / mean, 1))), 0, 15)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.astype(np.uint8).tobytes()], pa.binary())], ["chunk", "ranks"])

    got = mapped(parts.select("chunk", "counts"), classes, "chunk int, ranks binary").toArrow()
    ranks = np.zeros(1 << bits, np.uint8)
    for i, c in zip(got.column("chunk").to_pylist(), got.column("ranks").to_pylist()):
        ranks[i << CHUNK_BITS : (i + 1) << CHUNK_BITS] = np.frombuffer(c, np.uint8)
    remove(parts)
    return ranks, bits, mean


def _most_entries(tok, mean: float):
    """How many entries a list can have at most, by the class in a key's upper six bits."""
    above = F.greatest(F.shiftrightunsigned(tok, 58).cast("int") - 48, F.lit(0))
    return F.greatest(F.pow(F.lit(2.0), above + 1) * mean, F.lit(mean + 20 * mean**0.5))


def signatures(docs: DataFrame, ranks: np.ndarray, bits: int, k: int, percent: int) -> DataFrame:
    """doc_id, n, set hash (h1, h2), prefix hash (p1, p2) and prefix of every document."""
    kind = docs.schema["doc_id"].dataType
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            h, at = _sets(batch, k)
            keys = (shared.value[_bucket(h, bits)].astype(np.uint64) << np.uint64(58)) | h
            n = np.zeros(batch.num_rows, np.int64)
            sums = np.zeros((4, batch.num_rows), np.uint64)
            prefixes = []
            for i in range(batch.num_rows):
                own = np.unique(keys[at[i] : at[i + 1]])
                n[i] = len(own)
                prefix = own[: len(own) - (percent * len(own) + 99) // 100 + (len(own) + EXTRA - 1) // EXTRA]
                prefixes.append(prefix)
                sums[0, i], sums[1, i] = mix(own).sum(), mix(own ^ _OTHER).sum()
                sums[2, i], sums[3, i] = mix(prefix).sum(), mix(prefix ^ _OTHER).sum()
            lengths = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), *(pa.array(s.view(np.int64)) for s in sums), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))],
                ["doc_id", "n", "h1", "h2", "p1", "p2", "prefix"],
            )

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind.simpleString()}, n long, h1 long, h2 long, p1 long, p2 long, prefix array<long>")


_OTHER = np.uint64(0xA0761D6478BD642F)


def _marked(rows: DataFrame, column: str, wanted: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """Of rows, those whose column has a value that wanted has; or else, where those values are many, marks and a further column b for `_kept`.

    Few wanted values are broadcast, so that other rows never leave the JVM; of more a filter of
    16 bits a value is, so long as it fits FILTER_BITS; of yet more nothing is, and all rows stay.
    """
    n = wanted.count()
    bits = max(16, (16 * n).bit_length())
    if n <= BROADCAST_IDS:
        return rows.join(F.broadcast(wanted), column, "left_semi"), None
    if bits > FILTER_BITS:
        return rows, None
    place = F.pmod(F.xxhash64(column), F.lit(1 << bits)).alias("b")
    words = wanted.select(place).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("m")).toArrow()
    marks = np.zeros((1 << bits) // 64, np.int64)
    marks[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return rows.select("*", place), marks


def _kept(batch: pa.RecordBatch, marks: np.ndarray | None) -> pa.RecordBatch:
    """The rows of a batch that marks let through, without the column b."""
    if marks is None:
        return batch
    b = batch.column("b").to_numpy()
    return batch.filter(pa.array(((marks[b >> 6] >> (b & 63)) & 1) == 1)).select([c for c in batch.schema.names if c != "b"])


def _whole_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node and its set, for the documents in wanted (node), and for few others where those are many."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts, marks = _marked(docs.select(F.col("doc_id").alias("node"), "text").where("node IS NOT NULL"), "node", wanted)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(iter([_kept(batch, shared.value)])):
                h, at = _sets(part, k)
                own = [np.unique(h[at[i] : at[i + 1]]).view(np.int64) for i in range(part.num_rows)]
                lengths = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)))], ["node", "s"])

    return mapped(texts, run, f"node {kind}, s array<long>")


def _rest(n, percent: int):
    """How many shingles of a set of n stand behind its prefix."""
    return F.ceil(n * percent / 100) - F.ceil(n / EXTRA)


def _overlap(x, y, percent: int):
    """The least overlap of sets of x and y shingles that reach the threshold."""
    return F.ceil((x + y) * percent / F.lit(100 + percent))


def _needed(x, y, percent: int):
    """How many shingles the prefixes of sets of x and y shingles share at least, if the sets reach the threshold.

    All shingles of the set whose prefix ends first, up to that end, that the other set has too stand in the
    other's prefix; the others of the overlap stand behind its own.
    """
    return F.greatest(F.lit(1), _overlap(x, y, percent) - F.greatest(_rest(x, percent), _rest(y, percent)))


def _prefixes(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """gid, n and prefix of the groups in wanted (gid), and of few others where those are many."""
    rows = groups.select("gid", "n", "prefix")
    found, marks = _marked(rows, "gid", wanted)
    if marks is None:
        return found
    shared = groups.sparkSession.sparkContext.broadcast(marks)
    return mapped(found, lambda batches: (_kept(batch, shared.value) for batch in batches), rows.schema)


def _alike(pairs: DataFrame, groups: DataFrame, percent: int, *more: str) -> DataFrame:
    """The stored pairs of groups (a, b), and more columns of theirs, whose prefixes share as much as a link needs."""
    pairs = pairs.where("a <> b")
    groups = _prefixes(groups, pairs.select(F.col("a").alias("gid")).union(pairs.select("b")).distinct())
    left = pairs.join(groups.select(F.col("gid").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa")), "a")
    both = left.join(groups.select(F.col("gid").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb")), "b")
    return both.where(F.size(F.array_intersect("pa", "pb")) >= _needed(F.col("na"), F.col("nb"), percent)).select("a", "b", *more)


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the threshold, counted exactly."""
    sets = _whole_sets(docs, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), k)
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * (100 + percent) >= percent * (F.size("sa") + F.size("sb"))).select("a", "b")


def _grouped(signed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of signatures: nodes (equal sets), groups (equal prefix and size) and members (node, gid)."""
    sized = signed.where("n > 0 AND doc_id IS NOT NULL")
    nodes = stored(sized.groupBy("n", "h1", "h2", "p1", "p2").agg(F.min("doc_id").alias("node")), "nodes")
    groups = stored(sized.groupBy("n", "p1", "p2").agg(F.min("doc_id").alias("gid"), F.first("prefix").alias("prefix")), "groups")
    members = stored(nodes.join(groups.select("n", "p1", "p2", "gid"), ["n", "p1", "p2"]).select("node", "gid"), "members")
    return nodes, groups, members


def _fits(small: str, large: str, percent: int):
    return F.col(small) * 100 >= F.col(large) * percent


def prefix_lists(groups: DataFrame, percent: int, mean: float) -> DataFrame:
    """tok, gid, n, pos, and the entry before by size (before, n_before), of lists in which another entry's size fits.

    A list that may be hot is dealt over several tasks by gid; all its entries stay.
    """
    parts = F.ceil(_most_entries(F.col("tok"), mean) / HOT_ENTRIES).cast("int")
    entries = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "tok")).withColumn("parts", parts)
    by_list = W.partitionBy("tok", "part").orderBy("n", "gid")
    near = entries.withColumn("part", F.pmod(F.xxhash64("gid"), F.col("parts"))).select(
        "tok", "gid", "n", "pos", "parts", F.lag("gid").over(by_list).alias("before"), F.lag("n").over(by_list).alias("n_before"), F.lead("n").over(by_list).alias("n_after"),
    )
    return near.where((F.col("parts") > 1) | _fits("n_before", "n", percent) | _fits("n", "n_after", percent)).drop("parts", "n_after")


def _first_proposals(lists: DataFrame, percent: int) -> DataFrame:
    """Each group with the one that stands before it, or at the hub, in most of its lists; a hub that many share makes a star.

    A list's hub has the fewest prefix shingles of its own, and of such groups the largest set.
    """
    size = lists.groupBy("gid").agg((F.first("n") - _rest(F.first("n"), percent) - F.count(F.lit(1))).alias("own"))
    hubs = lists.join(size, "gid").groupBy("tok").agg(F.min(F.struct("own", (-F.col("n")).alias("less"), "gid")).alias("hub"))
    met_hub = lists.select("tok", "gid", "n").join(hubs.select("tok", F.col("hub.gid").alias("b"), (-F.col("hub.less")).alias("nb")), "tok")
    offered = met_hub.select("gid", "n", "b", "nb").union(lists.select("gid", "n", "before", "n_before")).where("b <> gid").where(_fits("n", "nb", percent) & _fits("nb", "n", percent))
    often = offered.groupBy("gid", "b").agg(F.count(F.lit(1)).alias("times"), F.first("n").alias("n"), F.first("nb").alias("nb"))
    often = often.where((F.col("times") > 1) | (_needed(F.col("n"), F.col("nb"), percent) == 1))
    return often.groupBy("gid").agg(F.max_by("b", F.struct("times", (-F.col("b")).alias("least"))).alias("b")).select(F.col("gid").alias("a"), "b")


def _split_lists(lists: DataFrame, labelled: DataFrame) -> DataFrame:
    """Entries of lists that lie in several components: tok, gid, n, pos, c, node (the least of the group in c), big (the list's largest component), m (its entries)."""
    split = labelled.groupBy("gid", "c").agg(F.min("node").alias("node"))
    entries = lists.select("tok", "gid", "n", "pos").join(split, "gid")
    largest = entries.groupBy("tok").agg(F.mode("c").alias("big"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("tok", "big", "m")
    return entries.join(largest, "tok")


def _reach(n, pos, percent: int):
    """The most shingles that a set may have for one of n with `pos` shingles before the first common one to link with it: overlap <= n - pos."""
    return F.floor((n - pos) * F.lit(100 + percent) / F.lit(percent)) - n


def _possible(x: str, y: str, percent: int):
    """Whether the entries x and y can be the first common shingle of sets that link: bounds of length and of both positions."""
    c = lambda name, s: F.col(f"{name}_{s}")
    overlap = _overlap(c("n", x), c("n", y), percent)
    return (
        (F.least(c("n", x), c("n", y)) * 100 >= F.greatest(c("n", x), c("n", y)) * percent)
        & (c("pos", x) <= c("n", x) - overlap) & (c("pos", y) <= c("n", y) - overlap)
    )


def _sides(entries: DataFrame, *columns: str) -> list[DataFrame]:
    return [entries.select(F.col("tok"), *(F.col(c).alias(f"{c}_{s}") for c in ("gid", "n", "pos", "c", *columns))) for s in "xy"]


def _relabelled(table: DataFrame, before: DataFrame, after: DataFrame, *columns: str) -> DataFrame:
    """The table with the components in columns, as `before` (node, component) has them, named as `after` has them.

    A component bears the name of a node of its own, so that node's later component is its later name.
    """
    moved = after.where("node <> component").join(before.where("node <> component"), "node", "left_anti")
    moved = F.broadcast(moved) if moved.count() <= BROADCAST_IDS else moved
    for c in columns:
        table = table.join(moved.select(F.col("node").alias(c), F.col("component").alias("renamed")), c, "left").withColumn(c, F.coalesce("renamed", c)).drop("renamed")
    return table


def _further_proposals(entries: DataFrame, percent: int) -> DataFrame:
    """Of long lists, each group outside the largest component with the hub it could link with in most lists: a (gid), b (gid), node_a, node_b.

    The hub is the group of the largest component with the fewest shingles before the list's.
    """
    long = entries.where(F.col("m") > LONG_LIST)
    hub = long.where("c = big").groupBy("tok").agg(F.min(F.struct("pos", (-F.col("n")).alias("less"), "gid", "n", "node")).alias("h"))
    hub = hub.select("tok", *(F.col(f"h.{c}").alias(f"{c}_y") for c in ("gid", "n", "pos", "node")))
    x = _sides(long.where("c <> big"), "node")[0]
    met = x.join(hub, "tok").where((F.col("gid_x") != F.col("gid_y")) & _possible("x", "y", percent))
    often = met.groupBy("gid_x", "c_x", "gid_y").agg(F.count(F.lit(1)).alias("times"), F.first("node_x").alias("node_x"), F.first("node_y").alias("node_y"))
    best = often.groupBy("gid_x", "c_x").agg(F.max(F.struct("times", (-F.col("gid_y")).alias("least"), "gid_y", "node_x", "node_y")).alias("p"))
    return best.select(F.col("gid_x").alias("a"), F.col("p.gid_y").alias("b"), F.col("p.node_x").alias("node_a"), F.col("p.node_y").alias("node_b"))


def _across(entries: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs of groups (a, b) in different components that have an entry which can be their first common shingle.

    Of two entries in different components, one at least lies outside the list's largest
    component. In long lists those meet only the bands of size that their position leaves.
    """
    band = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(BAND))).cast("int")
    own = F.when(F.col("m") > LONG_LIST, band(F.col("n"))).otherwise(F.lit(-1))
    x, y = _sides(entries.withColumn("band", own), "big", "band")
    most = F.least(_reach(F.col("n_x"), F.col("pos_x"), percent), F.floor(F.col("n_x") * 100 / F.lit(percent)))
    least = F.ceil(F.col("n_x") * percent / F.lit(100))
    bands = F.when(F.col("band_x") < 0, F.array(F.lit(-1))).when(most >= least, F.sequence(band(least), band(F.greatest(most, least)))).otherwise(F.array().cast("array<int>"))
    x = x.where("c_x <> big_x").withColumn("band", F.explode(bands)).drop("band_x")
    y = y.withColumnRenamed("band_y", "band")
    met = x.join(y, ["tok", "band"]).where(
        (F.col("c_x") != F.col("c_y")) & ((F.col("c_x") < F.col("c_y")) | (F.col("c_y") == F.col("big_y"))) & (F.col("gid_x") != F.col("gid_y")) & _possible("x", "y", percent)
    )
    return met.select(F.greatest("gid_x", "gid_y").alias("a"), F.least("gid_x", "gid_y").alias("b")).distinct()


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    ranks, bits, mean = rank_table(docs, k)
    signed = stored(signatures(docs, ranks, bits, k, percent), "signatures")
    nodes, groups, members = _grouped(signed)
    documents = stored(signed.select("doc_id", "n", "h1", "h2"), "documents")
    remove(signed)
    lists = stored(prefix_lists(groups, percent, mean), "lists")

    # first star round: hubs and neighbours of lists, and the nodes of each group with its least one
    offered = [stored(_first_proposals(lists, percent), "offered")]
    proposed = _alike(offered[0], groups, percent).union(members.where("node <> gid").select("node", "gid"))
    pairs = [stored(proposed.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "pairs")]
    links = [stored(_verified(pairs[0], docs, k, percent), "links")]
    tried = lambda: reduce(DataFrame.union, pairs)
    label = lambda: stored(members.join(components.withColumnRenamed("component", "c"), "node", "left").select("node", "gid", F.coalesce("c", "node").alias("c")), "labelled")
    first = components = connected_components(reduce(DataFrame.union, links))
    labelled = label()
    entries = stored(_split_lists(lists, labelled), "entries")
    remove(lists)

    # further star rounds: only long lists are split anew
    short, long = entries.where(F.col("m") <= LONG_LIST), stored(entries.where(F.col("m") > LONG_LIST), "long")
    for _ in range(STAR_ROUNDS):
        if not long.where(F.col("m") > LONG_LIST).head(1):
            break
        offered.append(stored(_further_proposals(long, percent), "offered"))
        further = _alike(offered[-1], groups, percent, "node_a", "node_b")
        pairs.append(stored(further.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct().join(tried(), ["a", "b"], "left_anti"), "pairs"))
        links.append(stored(_verified(pairs[-1], docs, k, percent), "links"))
        if not links[-1].head(1):
            break
        components = connected_components(reduce(DataFrame.union, links))
        remove(labelled)
        labelled = label()
        split = stored(_split_lists(long.select("tok", "gid", "n", "pos").distinct(), labelled), "long")
        remove(long)
        long = split
    if components is not first:
        short = _relabelled(short, first, components, "c", "big")

    # what is left: lists and groups whose nodes lie in different components
    offered.append(stored(_across(short.unionByName(long), percent), "offered"))
    met = _alike(offered[-1], groups, percent)
    torn = labelled.groupBy("gid").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    p, q = (labelled.select(F.col("node").alias(n), F.col("gid").alias(g), F.col("c").alias(f"c_{n}")) for n, g in (("node_a", "a"), ("node_b", "b")))
    rest = met.union(torn).join(p, "a").join(q, "b").where("c_node_a <> c_node_b").select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct()
    pairs.append(stored(rest.join(tried(), ["a", "b"], "left_anti"), "rest"))
    if pairs[-1].head(1):
        links.append(stored(_verified(pairs[-1], docs, k, percent), "links"))
        if links[-1].head(1):
            components = connected_components(reduce(DataFrame.union, links))
    remove(groups, members, labelled, entries, long, *offered, *pairs, *links)

    of_node = nodes.select("n", "h1", "h2", "node").join(components, "node", "left").select("n", "h1", "h2", F.coalesce("component", "node").alias("component"))
    of_document = documents.join(of_node, ["n", "h1", "h2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return of_document.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS ss
  FROM w
), t AS (
  SELECT doc_id, len(ss) AS n, unnest(ss) AS tok FROM s
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS i
  FROM t x JOIN t y ON x.tok = y.tok AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p WHERE 185 * i >= 85 * (na + nb)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a
)
SELECT s.doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, m.component_id
FROM s JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""
