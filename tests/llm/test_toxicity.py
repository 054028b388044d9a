import math
import zlib

import numpy as np
import pyarrow as pa

from skein.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in T.op10_toxicity(spark, SF).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [(got[i]["predicted"], y) for i, y in labels.items() if i in got and got[i]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.93
    assert sum(p and not y for p, y in held) <= 2


def test_held_out_labels_are_not_learnt(spark):
    docs = [(i, "fine words here" if i % 2 else "vile words here") for i in range(60)]
    labels = [(i, 1 - i % 2) for i in range(60)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    one, two = (T.train(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert one.bias == two.bias and (one.weights == two.weights).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (2, "x" * 100_000), (2, "a b"), (3, " , ")], "doc_id long, text string").selectExpr("*", "1 AS score", "0 AS toxic")
    model = T.train(docs, spark.createDataFrame([(None, 1), (1, None), (1, 1)], "doc_id long, toxic int"))
    rows = T.score(docs, model).collect()
    assert len(rows) == 5 and len({r["score"] for r in rows}) == 1
    assert T.score(docs.limit(0), model).collect() == []
    assert T.without_toxic(docs, T.Model(model.places, model.weights, -5.0)).columns == docs.columns


def test_features_are_unigrams_pairs_and_skips():
    a = T.distinct_features(pa.array(["one two three", "One, TWO three!", "one", ""]))
    assert len(a[0]) == 6 and (a[0] == a[1]).all() and len(a[2]) == 1 and len(a[3]) == 0


def dense_ftrl(rows, labels, size):
    """FTRL-proximal as published, one coordinate at a time."""
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)
    l1 = [T.L1] * size + [0.0]

    def weight(i):
        if abs(z[i]) <= l1[i]:
            return 0.0
        return -(z[i] - math.copysign(l1[i], z[i])) / ((T.BETA + math.sqrt(n[i])) / T.ALPHA + T.L2)

    for _ in range(T.EPOCHS):
        for own, y in zip(rows, labels):
            at = [*own, size]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in at:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / T.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return [weight(i) for i in range(size)], weight(size)


def test_training_against_a_dense_version():
    r = np.random.default_rng(4)
    y = (r.random(400) < 0.15).astype(int)
    rows = [np.unique(np.concatenate([r.integers(0, 30, 6), r.integers(30, 36, 2) if label else r.integers(36, 60, 2)])).astype(np.int32) for label in y]
    model = T.fit(lambda: zip(rows, y.tolist()))
    weights, bias = dense_ftrl(rows, y.tolist(), 60)
    assert model.places.tolist() == [i for i, w in enumerate(weights) if w] and 0 < len(model.places) < 60
    assert np.allclose(model.weights, [w for w in weights if w]) and math.isclose(model.bias, bias)


def test_clean_texts_stay_when_the_training_rows_are_many(spark):
    """Common words and rare classes: 9 of 10 rows are clean, and a few words alone mark the others."""
    r = np.random.default_rng(8)
    vocabulary = np.array([f"w{i}" for i in range(800)])
    texts = []
    for i in range(6000):
        w = list(vocabulary[(r.pareto(0.7, 60) * 4).astype(int) % 800])
        toxic = r.random() < 0.1
        if toxic:
            w[10:13] = [f"vile{r.integers(0, 12)}" for _ in range(3)]
        texts.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(texts, "doc_id long, text string, toxic int").repartition(4)
    got = {x["doc_id"]: x for x in T.score(df, T.train(df, df.select("doc_id", "toxic"))).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in texts if got[i]["held_out"]]
    assert sum(p for p, y in held if not y) / sum(not y for _, y in held) < 0.02
    assert sum(p for p, y in held if y) / sum(y for _, y in held) > 0.95


def test_rows_of_the_sample_are_bounded(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i % 3}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, toxic int")
    one, two = (T.train(docs.repartition(n), labels, rows=20) for n in (1, 4))
    assert one.bias == two.bias and (one.weights == two.weights).all()
