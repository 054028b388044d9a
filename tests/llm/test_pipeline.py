"""Each stage of the pipeline against a brute-force version, on its own input."""

import hashlib
import math
import re
from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

from skein.llm import toxicity as T

SF = "/root/testdata/sf0.001"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def kept_of_groups(rows):
    comp = {i: i for i, _ in rows}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    s = {i: sets(t) for i, t in rows}
    ids = sorted(s)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return sorted(i for i in ids if root(i) == i)


def contaminated(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    w = words(text)
    for item in items:
        own = words(item)
        k = min(10, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
        if any(tuple(w[i : i + k]) in windows for i in range(len(w) - k + 1)):
            return True
    return False


def copies(rows):
    n = Counter(s for _, s in rows)
    out = Counter()
    for doc_id, source in rows:
        u = (int(hashlib.md5(f"17:{doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        rate = len(rows) / len(n) / n[source]
        k, total, p = 0, 0.0, math.exp(-rate)
        while total + p <= u:
            total += p
            k += 1
            p *= rate / k
        out[doc_id] = k
    return +out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, functions = docs.columns, dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "source_mix", "token_ids"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    calm = functions["toxicity"](spark, docs, SF).cache()
    scored = {r["doc_id"] for r in T.score(docs, T.train(docs, labels)).where("predicted = 0").collect()}
    assert calm.columns == columns and {r["doc_id"] for r in calm.collect()} == scored and 0 < len(scored) < docs.count()
    single = functions["near_duplicates"](spark, calm, SF).cache()
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == kept_of_groups([(r["doc_id"], r["text"]) for r in calm.collect()])
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = functions["decontamination"](spark, single, SF).cache()
    assert clean.columns == columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in single.collect() if not contaminated(r["text"], items))
    mixed = functions["source_mix"](spark, clean, SF).cache()
    assert mixed.columns == columns and Counter(r["doc_id"] for r in mixed.collect()) == copies([(r["doc_id"], r["source"]) for r in clean.collect()])
    digest = functions["token_ids"](spark, mixed, SF).collect()
    assert Counter(r["doc_id"] for r in digest) == Counter(r["doc_id"] for r in mixed.collect())
    rows = sorted(digest, key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows) and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:]))


def test_stages_pass_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, None, "en", None, 0), (None, "some words here", "en", "a", 15), (3, "some words here", None, "b", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("copy", F.lit("own"))
    for name, stage in P.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert all(f.__module__ == "skein.llm.pipeline" for _, f in P.STAGES)
    assert dict(P.STAGES)["near_duplicates"](spark, docs, SF).count() == len(rows)
