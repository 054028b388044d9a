"""The join's rounds, bands and dealt lists against brute force."""

import random
import re

import pytest

from skein.llm import jaccard_join as J

DOCS = "doc_id long, text string"


def brute_force(rows, k=4, percent=85):
    sets, comp = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        comp[i] = i

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j >= i:
                break
            shared = len(a & b)
            if shared and 100 * shared >= percent * (len(a) + len(b) - shared):
                x, y = sorted((root(i), root(j)))
                comp[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets.items())


def copies(r, base, n, first, edits):
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.choice(edits)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 10**9)}"
        out.append((first + i, " ".join(w[: len(w) - r.choice([0, 0, 0, 1, 5])])))
    return out


def words(r, n):
    return [f"w{r.randint(0, 10**9)}" for _ in range(n)]


@pytest.mark.parametrize("limits", [{}, {"LONG_LIST": 6, "HOT_ENTRIES": 8}, {"LONG_LIST": 6, "STAR_ROUNDS": 0, "BROADCAST_IDS": 10}])
def test_groups_of_near_copies(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(J, name, value)
    r = random.Random(5)
    rows = copies(r, words(r, 150), 120, 0, [0, 1, 2, 3, 4]) + copies(r, words(r, 40), 60, 200, [0, 1, 2]) + copies(r, words(r, 14), 30, 300, [0, 1])
    passage = words(r, 50)
    rows += [(400 + i, " ".join(passage + words(r, r.choice([3, 6, 9, 12, 60])))) for i in range(60)]
    got = sorted(map(tuple, J.jaccard_components(spark.createDataFrame(rows, DOCS), 4, 85).collect()))
    assert got == brute_force(rows)


def test_a_shingle_that_many_unlike_documents_share(spark):
    r = random.Random(6)
    rows = [(i, " ".join(["one", "two", "three", "four", *words(r, r.choice([0, 1, 4, 8]))])) for i in range(2000)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, J.jaccard_components(df, 4, 85).collect())) == brute_force(rows)
    ranks, bits, mean = J.rank_table(df, 4)
    groups = J._grouped(J.signatures(df, ranks, bits, 4, 85))[1]
    lists = J.prefix_lists(groups, 85, mean)
    alone = groups.selectExpr("gid AS node", "gid", "gid AS c")
    assert J._across(J._split_lists(lists, alone), 85).count() <= 2000


def test_a_very_long_text_and_its_copy(spark):
    r = random.Random(7)
    long = words(r, 60_000)
    rows = [(1, " ".join(long)), (2, " ".join([*long[:-100], *words(r, 100)])), (3, " ".join(long[: len(long) // 2]))]
    assert [(c, n > 29_000) for _, n, c in sorted(map(tuple, J.jaccard_components(spark.createDataFrame(rows, DOCS), 4, 85).collect()))] == [(1, True), (1, True), (3, True)]


def test_further_star_rounds_move_long_lists_alone(spark, monkeypatch):
    monkeypatch.setattr(J, "LONG_LIST", 12)
    r = random.Random(8)
    drifting, rows = words(r, 150), []
    for i in r.sample(range(100), 100):
        drifting[r.randrange(150)] = f"e{r.randint(0, 10**9)}"
        rows.append((i, " ".join(drifting)))
    for i in range(600):
        shared = words(r, 40)
        rows += [(1000 + 2 * i + j, " ".join(words(r, 10) + shared + words(r, 10))) for j in range(2)]
    rows.sort()
    moved, split = [], J._split_lists
    monkeypatch.setattr(J, "_split_lists", lambda lists, labelled: moved.append(lists.count()) or split(lists, labelled))
    got = sorted(map(tuple, J.jaccard_components(spark.createDataFrame(rows, DOCS), 4, 85).collect()))
    assert got == brute_force(rows)
    assert len(moved) > 1 and max(moved[1:]) < moved[0] / 2, moved
