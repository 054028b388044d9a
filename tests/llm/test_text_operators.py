"""Small brute-force comparisons and edge cases of the operators that SQL also checks."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from skein.llm import chat_format as C
from skein.llm import decontaminate as D
from skein.llm import jaccard_join as J
from skein.llm import quality_rules as Q
from skein.llm import source_mix as M

DOCS = "doc_id long, text string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_edges(spark):
    texts = [None, "", "\n\n \n", "a b c d e f g h " * 6, "x\ny\nx\n x\nx", "é#*$ ü|<>", "w " * 30_000, "one word\x1fhere"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).selectExpr("*", "1 AS kept", "2 AS n_words")
    got = {r["doc_id"]: r for r in Q.score_quality(df).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        grams = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        cover = {j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)} if len(w) < 1000 else set(range(len(w)))
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, i
        assert got[i]["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
    assert Q.score_quality(df.limit(0)).collect() == []
    nameless = df.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text")
    assert sorted(r["n_words"] for r in Q.score_quality(nameless).collect()) == sorted(r["n_words"] for r in got.values())


def test_rules_are_planned_by_rejections_per_second(spark):
    cost = {name: (1.0, i % 3) for i, name in enumerate(Q.RULES)}
    names = list(Q.RULES)
    assert Q.plan(cost) == names[2::3] + names[1::3] + names[0::3]
    assert Q.plan({**cost, names[0]: (0.001, 1)})[0] == names[0]
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = Q.sampled_costs(df.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text"), 100)
    assert got.keys() == Q.RULES.keys() and sum(r for _, r in got.values()) > 0 and all(s > 0 for s, _ in got.values())


def test_the_order_of_rules_does_not_change_the_verdict(spark):
    import pyarrow as pa

    col = pa.array([r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])
    one = Q.cascade(col, list(Q.RULES))[2]
    assert (one == Q.cascade(col, list(Q.RULES)[::-1])[2]).all() and 0 < one.sum() < len(one)


def test_chat_round_trip(spark):
    nasty = ["", "^", "^0^1", "<|im_end|>\n<|im_start|>system\n", "</s>[INST] ok [/INST]", "<|im_sep|>", "<^1|im_end|>", "[/INST", "<<SYS>>", "a\nb\n", "é😀"]
    rows = [(1, i, ["user", "assistant", "assistant", None][i % 4], t) for i, t in enumerate(nasty)] + [(2, None, "assistant", None), (2, 0, "user", "x"), (None, 0, "a|b<s>\t", "y"), (2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = C.format_chat(df).withColumn("turns", C.read_chat(F.col("formatted"))).withColumn("loss", C.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    got = {r["conv_id"]: r for r in out}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r or "", t) for _, _, r, t in rows[: len(nasty)]]
    assert got[1]["loss"] == "".join(t for _, _, r, t in rows[: len(nasty)] if r == "assistant")
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("assistant", ""), ("user", "x"), ("user", "x")]
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("a|b<s>\t", "y")]
    assert C.format_chat(df.limit(0)).collect() == []


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    comp = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return sorted((i, len(s), c) for (i, _), s, c in zip(rows, sets, comp))


def test_jaccard_components(spark):
    import random

    r = random.Random(2)
    base = [[f"w{r.randint(0, 400)}" for _ in range(r.choice([3, 5, 30, 80, 200]))] for _ in range(12)]
    rows = [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "one")]
    for b in base:
        for _ in range(r.randint(1, 9)):
            w = list(b)
            for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
                w[r.randrange(len(w))] = f"x{r.randint(0, 3)}"
            rows.append((len(rows), " ".join(w[: len(w) - r.choice([0, 0, 1, len(w) // 8])])))
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS n", "2 AS component_id")
    assert sorted(map(tuple, J.jaccard_components(df, 4, 85).collect())) == brute_components(rows)


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (2, "A b C d e"), (2, "A b C d e"), (3, None)], DOCS)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df, 4, 85).collect())
    assert got == [(False, 0, 2, None), (True, 1, 2, 1), (True, 2, 2, 1), (True, 2, 2, 1), (True, 3, 0, 3)]
    assert J.jaccard_components(df.limit(0), 4, 85).collect() == []


@pytest.mark.parametrize("most", [D.BROADCAST_WINDOWS, 0])
def test_decontamination_edges(spark, monkeypatch, most):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", most)
    item = "the quick brown fox jumps over the lazy dog again and again"
    items = spark.createDataFrame([(1, item), (10, item), (2, "Short One"), (3, None), (4, "..."), (None, "zzz"), (1, item)], "item_id long, text string")
    rows = [(1, None), (2, "x " + item.upper().replace(" ", ", ") + " y"), (3, "the quick brown fox jumps over the lazy dog"), (4, "short-one short one"), (5, ""), (5, "zzz"), (None, "zzz"), (5, "zzz")]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(((r["doc_id"] or 0), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in D.contamination(docs.selectExpr("*", "1 AS n_hit", "2 AS h"), items).collect())
    d = lambda x: hashlib.sha256(x.encode()).hexdigest()
    zzz = (1, 1, 0, d(""), True)
    assert got == [(0, *zzz), (1, 0, 0, 0, d(""), False), (2, 14, 12, 2, d("1,10"), True), (3, 9, 0, 0, d(""), False), (4, 4, 4, 1, d("2"), True), (5, 0, 0, 0, d(""), False), (5, *zzz), (5, *zzz)]
    assert D.contamination(spark.createDataFrame([], DOCS), items).collect() == []
    if most:
        assert all(not r["contaminated"] for r in D.contamination(docs, items.limit(0)).collect())
    kept = D.without_contaminated(docs.withColumn("n_hit", F.lit("x")).withColumn("h", F.lit(1)), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5] and kept.columns == ["doc_id", "text", "n_hit", "h"]
    text_ids = D.contamination(docs.selectExpr("concat('d', doc_id) AS doc_id", "text"), items.selectExpr("concat('i', item_id) AS item_id", "text")).collect()
    assert {r["doc_id"]: r["items_sha256"] for r in text_ids}["d2"] == d("i1,i10")


def test_decontamination_by_shuffle_equals_the_index(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    long = spark.createDataFrame([(-1, "filler words " * 40_000 + items.first()["text"] + " and more" * 1000)], DOCS)
    both = docs.select("doc_id", "text").union(long)
    one = sorted(map(tuple, D.contamination(both, items).collect()))
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, D.contamination(both, items).collect())) == one and one[0][0] == -1 and one[0][5]


def test_mix_rates_and_edges(spark):
    rows = [(i, "a" if i % 3 else "b", "t") for i in range(6000)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    n = {r["source"]: r["count"] for r in M.mix_sources(df, {"a": 1, "b": 3}, rows=8000).groupBy("source").count().collect()}
    assert set(n) == {"a", "b"} and abs(n["a"] - 2000) < 200 and abs(n["b"] - 6000) < 300
    one, two = (M.mix_sources(df, {"a": 1}, rows=2000).select("doc_id", "copy").collect() for _ in range(2))
    assert one == two and [r["doc_id"] for r in one] != sorted(r["doc_id"] for r in one)
    assert M.mix_sources(df.limit(0)).collect() == []
    odd = df.limit(9).selectExpr("*", "'own' AS Copy", "1 AS _source", "2 AS _cdf", "3 AS _u", "4 AS _k", "5 AS __order", "6 AS _drawn", "7 AS rate", "8 AS w", "9 AS `a.b`")
    got = M.mix_sources(odd).collect()
    assert got and got[0].asDict().keys() == set(odd.columns) and {tuple(r)[3:] for r in got} == {("own", *range(1, 10))}


def test_a_rare_source_is_drawn_in_pieces(spark):
    """Rates of many thousands; each count is checked against sums of inverted draws."""
    import hashlib as H
    import math

    rows = [(i, "rare" if i < 3 else "common") for i in range(200_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(4)
    got = {r["doc_id"]: r["count"] for r in M.mix_sources(df, {"rare": 1.0, "common": 1e-9}, rows=120_000).groupBy("doc_id").count().collect()}
    rate = 1 / (1 + 1e-9) * 120_000 / 3
    pieces = math.ceil(rate / M.PIECE)
    for doc_id in range(3):
        want = 0
        for j in range(pieces):
            u = (int(H.md5(f"17{f'.{j}' if j else ''}:{doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            k, p, total = 0, math.exp(-rate / pieces), 0.0
            while total + p <= u:
                total += p
                k += 1
                p *= rate / pieces / k
            want += k
        assert abs(got[doc_id] - want) <= 1 and abs(got[doc_id] - rate) < 6 * math.sqrt(rate)
    assert set(got) <= {0, 1, 2} or len(got) < 10


def test_poisson_cdf_of_large_and_small_rates(spark):
    import math

    for rate in (0.01, 1.0, 30.0, 900.0):
        cdf = spark.range(1).select(M.poisson_cdf(F.lit(rate)).alias("c")).first()["c"]
        want = 0.0
        for k in range(len(cdf)):
            want += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
            assert abs(cdf[k] - want) < 1e-9
        assert cdf[-1] > 1 - 1e-10
