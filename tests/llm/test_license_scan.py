import math
import re
from collections import Counter

from pyspark.sql import functions as F

from skein.llm import license_scan as L

SCHEMA = "id long, path string, text string"


def brute_force(rows, templates=L.TEMPLATES, threshold=L.THRESHOLD):
    """id, licence, score, n_lines, licence file and donor path, with every line, block and whole file compared."""
    lines = [x for _, _, t in rows for x in (t or "").lower().split("\n")]
    known = {t for _, _, x in templates for t in L.terms(x)}
    n = Counter(t for x in lines for t in set(re.findall("[a-z0-9]+", x)) & known)
    value = lambda k: math.log((1 + len(lines)) / (1 + k)) + 1
    idf = {t: value(n[t]) for t in known}
    vectors = []
    for name, must, text in templates:
        w = {t: c * idf[t] for t, c in Counter(L.terms(text)).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        vectors.append((name, set(must.split()), {t: x / norm for t, x in w.items()}))

    def judged(text):
        tf = Counter(L.terms(text))
        x = {t: c * idf.get(t, value(0)) for t, c in tf.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        best = {}
        for name, must, w in vectors:
            if must <= set(tf):
                score = round(sum(v * w.get(t, 0) for t, v in x.items()) / norm, 6)
                if score >= threshold:
                    best[name] = max(best.get(name, 0), score)
        if not best:
            return None
        own = {k: v for k, v in best.items() if k not in L.FAMILIES} or best
        name = max(own, key=lambda k: (own[k], k))
        if any(k != name and own[name] - v < L.MARGIN for k, v in own.items()):
            return None
        return name not in L.FAMILIES, own[name], sum(tf.values()), name

    needed = re.compile("(^|[^a-z0-9])(" + "|".join(L._needed(templates, idf, threshold)) + ")([^a-z0-9]|$)")
    out = {}
    for i, path, text in rows:
        ls = (text or "").lower().split("\n")
        places = {(max(k - before, 0), b) for k, x in enumerate(ls) if needed.search(x) for b in L.BLOCKS for before in (0, b // 2, b - 1)}
        # no line without a needed term matches alone
        assert all(judged(x) is None for k, x in enumerate(ls) if not needed.search(x))
        units = {p: judged(" ".join(ls[p[0] : p[0] + p[1]])) for p in places}
        plain = path is not None and (re.search(L.LICENSE_FILE, path) or re.search(L.PLAIN_FILE, path))
        if places and plain:
            units[0, 0] = judged((text or "").lower())
        won = {k: v for k, v in units.items() if v}
        m = max(won.values()) if won else None
        words = len(L.terms(text or ""))
        cover = max([v[2] for v in won.values()] + [sum(v[2] for k, v in won.items() if k[1] == 1)]) if won else 0
        is_file = bool(m and plain and (re.search(L.LICENSE_FILE, path) or 2 * cover >= words))
        out[i] = [path, m and m[3], m and m[1], sum(k[1] > 0 for k in won), is_file, None]
    donors = {}
    for path, name, _, _, is_file, _ in out.values():
        if is_file:
            d = path.rpartition("/")[0]
            donors[d] = min(donors.get(d, (path, name)), (path, name))
    for r in out.values():
        if r[1] is None and r[0] is not None:
            d = r[0].rpartition("/")[0]
            while True:
                if d in donors:
                    r[1], r[5] = donors[d][1], donors[d][0]
                    break
                if not d:
                    break
                d = d.rpartition("/")[0]
    return {i: tuple(r) for i, r in out.items()}


def found(df):
    return {r["id"]: (r["path"], r["license"], r["score"], r["n_lines"], r["license_file"], r["inherited_from"]) for r in L.scan_licenses(df).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for i, r in want.items():
        assert got[i][:2] + got[i][3:] == r[:2] + r[3:] and math.isclose(got[i][2] or 0, r[2] or 0, abs_tol=2e-6), (i, got[i], r)


BSD3 = f"Copyright (c) 2020, Someone\n\n{L._BSD}\n\n{L._BSD_TWO}\n{L._BSD_NAME}\n\n{L._BSD_END}"
ROWS = [
    (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c/x.py", "code\nmore code"), (3, "a/b/y.py", "text text\nReleased under the MIT License."),
    (4, "z/w.py", "license to nothing at all, they said of the old house"), (5, None, None), (6, "top.py", ""), (7, "a/b/NOTICE.txt", "This work is licensed under the GNU General Public License, version 2."),
    (8, "m/x.c", "Licensed under the Mozilla Public License 2.0"), (9, "m/y.c", "/* it under the terms of the GNU Affero General Public License as published by the Free Software Foundation */"),
    (10, "m/z.c", "// SPDX-License-Identifier: BSD-3-Clause\nint x;"), (11, "u/x.txt", "This is free and unencumbered software released into the public domain."), (12, "v/LICENSE.txt", BSD3),
    (13, "v/w/x.c", "/*\n" + "\n".join(" * " + x for x in re.findall(r".{1,70}(?: |$)", L._GNU_PARAGRAPH.format("Lesser General Public License", 3))) + "\n */\nint main;"),
    (14, "q/y.c", f"# {L._BSD}"), (15, "q/z.c", "\n".join(re.findall(r".{1,60}(?: |$)", L._PERMISSION))), (16, "r/COPYING", BSD3.replace(L._BSD_NAME + "\n", "")),
    (17, "r/s/x.c", "SPDX-License-Identifier: EPL-9.7"), (18, "r/s/y.c", "mit\nder Lizenz"),
]
WANT = {1: "Apache-2.0", 2: "GPL-2.0", 3: "MIT", 4: None, 5: None, 6: None, 7: "GPL-2.0", 8: "MPL-2.0", 9: "AGPL", 10: "BSD-3-Clause", 11: "Unlicense", 12: "BSD-3-Clause", 13: "LGPL-3.0", 14: "BSD", 15: "MIT", 16: "BSD-2-Clause", 17: "BSD-2-Clause", 18: "BSD-2-Clause"}


def test_licences_of_lines_blocks_and_files(spark):
    filler = [(100 + i, f"f{i}.py", "some words of prose that stand on a line of their own\n" * 40) for i in range(5)]
    got = found(spark.createDataFrame(ROWS + filler, SCHEMA))
    assert {i: r[1] for i, r in got.items() if i < 100} == WANT
    assert {i for i, r in got.items() if r[4]} == {1, 7, 11, 12, 16} and got[17][5] == "r/COPYING" and got[2][5] == "a/b/NOTICE.txt"
    same(got, brute_force(ROWS + filler))


def test_documents_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], f"{r['source']}/{r['lang']}/{r['doc_id']}", r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["path"], r["license"], r["score"], r["n_lines"], r["license_file"], r["inherited_from"]) for r in L.op4_license_scan(spark, sf).collect()}
    same(got, brute_force(rows))
    assert sum(r[1] is not None for r in got.values()) > 5


def test_odd_rows(spark):
    text = "Released under the MIT License."
    rows = [(1, "a/x.py", text), (1, "a/x.py", text), (None, "a/y.py", text), (2, None, text), (2, "b/LICENSE", "word " * 100_000 + "\n" + text), (None, None, None), (3, "c/LICENSE", text), (3, "c/COPYING", "Licensed under CC BY 4.0."), (4, "c/z", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("license", F.lit("x")).withColumn("r1", F.lit(1)).withColumn("at", F.lit(1))
    got = sorted((r["id"] or 0, r["path"] or "", r["license"] or "", r["inherited_from"] or "") for r in L.scan_licenses(df).collect())
    assert got == sorted([(1, "a/x.py", "MIT", ""), (1, "a/x.py", "MIT", ""), (0, "a/y.py", "MIT", ""), (2, "", "MIT", ""), (2, "b/LICENSE", "MIT", ""), (0, "", "", ""), (3, "c/LICENSE", "MIT", ""), (3, "c/COPYING", "CC-BY-4.0", ""), (4, "c/z", "CC-BY-4.0", "c/COPYING")])
    assert L.scan_licenses(df.limit(0)).collect() == []
