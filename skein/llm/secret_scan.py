r"""Secret scan: candidate strings, judged by a random forest.

Candidates are runs of 16 or more characters of `[A-Za-z0-9+/_=-]` that mix letters with digits
or cases, and values of six or more characters, of any kind but white space and quotes, that
stand after a word such as password or token. The forest's features are length, shares and transitions of characters (changes of class, and how
likely each letter follows the one before in dictionary words), entropy, how much of the value
dictionary words cover, the words before and after it and how near they are, and what kind of
file its path names. It is grown on `labelled_findings`, a small table of true findings and of
false ones (checksums, identifiers, UUIDs, paths, placeholders, fixtures of tests, lock files)
that a seeded rule writes out.

One row for each candidate. Null and empty texts have none; a null path counts as empty;
repeated rows are found again. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.shared import chunks, mapped, table, text_of

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
NAMED = re.compile(r"""(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|auth|bearer|credential|private[_-]?key|access[_-]?key)[a-z_]{0,16}["'`]?(?:\s{0,3}(?:=>|:=|[:=])\s{0,3}|\s)["'`]?([^\s"'`]{6,})""")
TREES, DEPTH, MIN_LEAF = 40, 9, 3
CONTEXT = 48

#: Words that identifiers and placeholders are made of.
DICTIONARY = (
    "access account active address agent api app archive array async auth aws backup base bucket build cache call "
    "change channel char check class client cloud code column commit config connect content context count create current data database date debug default delete "
    "demo deploy device digest dummy element email enable encode entry error event example execute export false field file filter first folder format frame "
    "function global group handle hash header hello host http image import index info init input insert instance integer internal item json key last length level "
    "library line link list load local lock log login long main manager map master max memory message method min mock model module name network next node null number "
    "object offset open option order output page param parse pass password path placeholder point port prefix print private process project public query queue "
    "range read record replace request reset resource response result return role sample schema secret select sequence "
    "server service session setting shared source start state status stop storage store stream string system table "
    "template test text thread time title token total true type unit update uri url user util valid value version view web "
    "write xxxx your changeme"
).split()
_WORDS = re.compile("|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))))
_NEAR_SECRET = re.compile(r"(?i)token|secret|passw|pwd|api.?key|auth|bearer|credential|private|access.?key")
_NEAR_OTHER = re.compile(r"(?i)commit|sha|md5|checksum|digest|hash|uuid|guid|etag|revision|integrity|example|http|path|import")
_NEAR_SAMPLE = re.compile(r"(?i)example|sample|placeholder|dummy|fake|test|your|changeme")
_TEST_PATH = re.compile(r"(?i)tests?/|_test\.|test_|spec|fixture|mock|example|sample|docs?/|demo|readme")
_LOCK_PATH = re.compile(r"(?i)lock|\.sum$|checksums?|manifest|\.min\.js$")
_CONFIG_PATH = re.compile(r"(?i)\.env|credential|secrets?\b|\.pem$|prod|conf|settings|\.ini$|\.ya?ml$")
_KNOWN = re.compile(r"gh[pousr]_|AKIA|ASIA|sk_|sk-|pk_|xox[abprs]-|glpat-|AIza|eyJ|npm_|SG\.")
_HEX = re.compile(r"[0-9a-fA-F-]+")
FEATURES = (
    "length", "digits", "upper", "lower", "other", "class_changes", "case_changes", "likely_pairs", "least_likely", "entropy", "coverage", "hex", "repeats", "distinct",
    "secret_before", "secret_next_to", "other_before", "other_next_to", "sample_near", "secret_after", "assigned", "quoted", "known_prefix", "test_path", "lock_path", "config_path",
)


def _transitions() -> np.ndarray:
    """Log likelihood of each letter after each, in dictionary words, with one more of every pair."""
    n = np.ones((27, 27))
    for word in DICTIONARY:
        own = [26, *(ord(c) - 97 for c in word), 26]
        np.add.at(n, (own[:-1], own[1:]), 1)
    return np.log(n / n.sum(axis=1, keepdims=True))


_PAIRS = _transitions()


def features(value: str, before: str, after: str, path: str) -> list[float]:
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    count, letters, lower = Counter(kinds), Counter(value), value.lower()
    codes = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in lower]
    pairs = _PAIRS[codes[:-1], codes[1:]] if n > 1 else np.zeros(1)
    covered = sum(len(m.group()) for m in _WORDS.finditer(lower))
    tail = before.rstrip()
    near = re.split(r"\s+", tail.rstrip("\"'`=:> "))[-1]
    return [
        float(n), count["d"] / n, count["u"] / n, count["l"] / n, count["o"] / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n, sum({a, b} == {"u", "l"} for a, b in zip(kinds, kinds[1:])) / n,
        float(pairs.mean()), float(np.sort(pairs)[: max(1, len(pairs) // 4)].mean()),
        -sum(k / n * math.log2(k / n) for k in letters.values()), covered / n,
        float(_HEX.fullmatch(value) is not None), sum(a == b for a, b in zip(value, value[1:])) / n, len(letters) / n,
        float(_NEAR_SECRET.search(before) is not None), float(_NEAR_SECRET.search(near) is not None),
        float(_NEAR_OTHER.search(before) is not None), float(_NEAR_OTHER.search(near) is not None),
        float(_NEAR_SAMPLE.search(before + " " + value + " " + after) is not None), float(_NEAR_SECRET.search(after) is not None),
        float(tail.rstrip("\"'`").rstrip().endswith(("=", ":", "=>"))), float(tail.endswith(("\"", "'", "`")) and after[:1] in ("\"", "'", "`")),
        float(_KNOWN.match(value) is not None), float(_TEST_PATH.search(path) is not None), float(_LOCK_PATH.search(path) is not None), float(_CONFIG_PATH.search(path) is not None),
    ]


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans to judge, in order; named values first, and runs that overlap none. What stands before an equals sign inside a run is no part of it."""
    named = [m.span(1) for m in NAMED.finditer(text)]
    named = [(s, e) for s, e in ((s, s + len(text[s:e].rstrip(".,;:!?)]}>"))) for s, e in named) if e - s >= 6]
    out, at = [], 0
    for m in RUN.finditer(text):
        while at < len(named) and named[at][1] <= m.start():
            at += 1
        start, v = m.start(), m.group()
        cut = v.rstrip("=").rfind("=") + 1
        start, v = start + cut, v[cut:]
        if len(v) < 16 or at < len(named) and named[at][0] < m.end():
            continue
        if any(c.isalpha() for c in v) and (any(c.isdigit() for c in v) or (v[1:] != v[1:].lower() and v != v.upper())):
            out.append((start, m.end()))
    return sorted(named + out)


def labelled_findings(n: int = 2400, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """value, before, after, path, label: half of them true but for fixtures of tests, written by rule."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    prose = lambda: " ".join(pick(string.ascii_lowercase, r.randint(2, 9)) for _ in range(r.randint(0, 6)))
    words = lambda k, sep: sep.join(r.choice(DICTIONARY) for _ in range(k))
    plain = ["src/app.py", "lib/client.js", "src3", "src11/en", "web/page", "", "notes.txt"]
    config = ["conf/prod.yml", ".env", "deploy/settings.ini", "config/credentials.json"]
    tests = ["tests/unit.py", "docs/example.md", "spec/fixtures/a.json", "src/client_test.go", "examples/demo.py"]
    locks = ["package-lock.json", "go.sum", "dist/app.min.js", "CHECKSUMS"]
    name = lambda: r.choice(["token", "secret", "password", "api_key", "auth_token", "access_key", "private_key", "bearer", "client_secret", "db_password"])
    known = lambda: r.choice(["ghp_" + pick(alnum, 36), "AKIA" + pick(string.ascii_uppercase + string.digits, 16), "sk_" + pick(alnum, 32), "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24), "glpat-" + pick(alnum, 20), "AIza" + pick(alnum + "_-", 35)])
    random_key = lambda: r.choice([pick(hexes, r.choice([32, 40, 48, 64])), pick(alnum, r.randint(16, 48)), pick(alnum + "+/", r.choice([40, 44])) + "=", pick(string.ascii_uppercase + string.digits, 20), pick(string.ascii_letters, r.randint(16, 32))])
    password = lambda: r.choice([pick(alnum + "!$%&*#@.~", r.randint(8, 16)), r.choice(DICTIONARY).title() + pick(string.digits, 3) + r.choice("!$&#"), pick(string.ascii_letters, 4) + r.choice("!&.~") + pick(alnum, r.randint(4, 9))])
    out = []
    for i in range(n):
        before, after = prose() + " ", " " + prose()
        if i % 2:
            kind = r.randrange(10)
            if kind == 0:  # known make, wherever it stands
                out.append((known(), before, after, r.choice(plain + config + tests), 1))
                continue
            value = known() if kind == 1 else password() if kind < 4 else random_key()
            quote = r.choice(["\"", "\"", "'", ""])
            path = r.choice(plain + config + tests)
            given = f"{prose()} {name()}{r.choice([' = ', '=', ': ', ':', ' => '])}{quote}"
            if kind == 9 and path in config:  # settings name it otherwise
                given = f"{pick(string.ascii_uppercase, 6)}={quote}"
            out.append((value, given, quote + after, path, int(path not in tests or kind == 1)))
            continue
        kind, path = r.randrange(11), r.choice(plain + config + tests + locks)
        if kind == 0:
            value, before = pick(hexes, r.choice([32, 40, 64])), f"{prose()} {r.choice(['commit', 'sha1', 'md5', 'checksum', 'etag', 'digest', 'revision'])}{r.choice([' ', ': ', '='])}"
        elif kind == 1:
            h = pick(hexes, 32)
            value = "-".join([h[:8], h[8:12], h[12:16], h[16:20], h[20:]])
        elif kind == 2:
            value = words(r.randint(3, 5), "_") + str(r.randint(0, 99))
        elif kind == 3:
            value = words(r.randint(3, 5), "/") + f"/v{r.randint(1, 9)}"
        elif kind == 4:
            value, before = r.choice(["x" * 20 + "1", "your_token_here_123", "changeme12345678901", "example_secret_key_1", "0" * 15 + "a", "<password>", "********", "${API_KEY}", "%(password)s", "os.environ"]), f"{prose()} {name()} = \""
            after = "\" " + prose()
        elif kind == 5:
            value = "".join(w.title() for w in words(4, " ").split()) + r.choice(["", str(r.randint(1, 9))])
        elif kind == 6:
            value = pick(string.ascii_lowercase, r.randint(14, 26)) + str(r.randint(0, 9))
        elif kind == 7:
            value = f"{r.randint(2000, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}-{r.randint(10, 59)}"
        elif kind == 8:  # what follows the word in prose or code
            value, before = r.choice([words(1, ""), words(2, "_"), words(2, ".") + "()", pick("aeinorstlcdhmup", r.randint(6, 12))]), f"{prose()} {name()}{r.choice([' ', ' = ', ': '])}"
        elif kind == 9:
            value, path = random_key(), r.choice(locks)
            before = f"{prose()} \"{r.choice(['integrity', 'resolved', 'token', 'hash'])}\": \""
        else:
            value, before, path = random_key(), f"{prose()} {name()} = \"", r.choice(tests)
            after = "\" " + prose()
        out.append((value, before, after, path, 0))
    return out


class Forest:
    """Trees as flat arrays: feature, threshold, left and right child, and at leaves the share of true findings."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 7) -> Forest:
    """Bootstrap trees, each split the best by Gini impurity of a random subset of features."""
    r = np.random.default_rng(seed)
    some = max(1, round(math.sqrt(x.shape[1])))
    out = []
    for _ in range(trees):
        nodes: list[list[float]] = []

        def add(rows: np.ndarray, depth: int) -> int:
            me = len(nodes)
            share = float(y[rows].mean())
            nodes.append([-1, 0.0, 0, 0, share])
            if depth == 0 or len(rows) < 2 * MIN_LEAF or share in (0.0, 1.0):
                return me
            best = (2 * share * (1 - share) - 1e-9, -1, 0.0)
            for f in r.choice(x.shape[1], some, replace=False):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, hits = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(order))
                ok = (v[1:] > v[:-1]) & (n >= MIN_LEAF) & (len(order) - n >= MIN_LEAF)
                if not ok.any():
                    continue
                p, q = hits[:-1] / n, (hits[-1] - hits[:-1]) / (len(order) - n)
                impurity = np.where(ok, (n * 2 * p * (1 - p) + (len(order) - n) * 2 * q * (1 - q)) / len(order), np.inf)
                i = int(np.argmin(impurity))
                if impurity[i] < best[0]:
                    middle = (v[i] + v[i + 1]) / 2
                    best = (float(impurity[i]), int(f), float(middle if middle < v[i + 1] else v[i]))
            if best[1] >= 0:
                goes = x[rows, best[1]] <= best[2]
                nodes[me][:2] = [best[1], best[2]]
                nodes[me][2] = add(rows[goes], depth - 1)
                nodes[me][3] = add(rows[~goes], depth - 1)
            return me

        add(r.integers(0, len(x), len(x)), DEPTH)
        a = np.array(nodes)
        out.append((a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]))
    return Forest(out)


def train(findings: list[tuple[str, str, str, str, int]] | None = None) -> Forest:
    findings = findings or labelled_findings()
    return grow(np.array([features(f[0], f[1][-CONTEXT:], f[2][:CONTEXT], f[3]) for f in findings]), np.array([f[4] for f in findings], float))


@functools.cache
def trained() -> Forest:
    """The forest of `labelled_findings`, grown once in a process."""
    return train()


def scan_secrets(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end (code points, end exclusive), value_sha256, score, secret for every candidate in docs (doc_id, path, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(forest or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows, x = [], []
            for doc_id, path, text in zip(batch.column("doc_id").to_pylist(), batch.column("path").to_pylist(), text_of(batch.column("text")).to_pylist()):
                for start, end in candidates(text):
                    value = text[start:end]
                    rows.append((doc_id, start, end, hashlib.sha256(value.encode()).hexdigest()))
                    x.append(features(value, text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT], path or ""))
            if rows:
                score = np.round(shared.value.predict(np.array(x)), 6)
                ids, starts, ends, digests = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("doc_id").type), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(digests), pa.array(score), pa.array(score >= threshold)], ["doc_id", "start", "end", "value_sha256", "score", "secret"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "path", "text"), run, f"doc_id {kind}, start long, end long, value_sha256 string, score double, secret boolean")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs.select("doc_id", F.concat_ws("/", "source", "lang").alias("path"), "text"))
