r"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

Base spans are the leftmost non-overlapping matches of four patterns, kept if their parts are
valid. The field labels all tokens of every text, over word-shape features, and adds telephone
numbers, cards and addresses in other notations; a span that it finds is added only where no
base span is. It is trained by full-batch gradient steps on `labelled_windows`, a small table
that a seeded rule writes out. Feature weights are looked up in tables of shapes, and Viterbi
runs between the tokens that no other labels around them could make personal data (`Decoder`);
the labels are those of Viterbi over the whole text. A text of over `WINDOW` characters is decoded
in windows that overlap and end where no run of labels can stand, so memory does not grow with it.

Null texts count as empty and have no spans. Positions are code points, ends exclusive.
Repeated rows get equal results; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skein.llm.shared import chunks, mapped, table, text_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits, as one that begins at the run's start is as good.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SEED = re.compile(r"[0-9@]")


def emails(text: str) -> list[Span]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ in time linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[Span]]:
    """The valid matches of each kind."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not _SEED.search(text):
        return out
    out["email"] = emails(text)
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p) < 4 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m.group().split(".")))]
    for m in _CARD.finditer(text):
        own = _digits(m.group())
        if 16 <= len(own) <= 19 and luhn(own):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# ---- the conditional random field

LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")
_KEYWORDS = frozenset("phone tel telephone mobile fax call cell card visa mastercard credit ip host server email mail at dot date version order invoice id page isbn section price total".split())
#: A token and the white space before it.
_SPACE = re.compile(r"\s")
_SPACED = re.compile(r"\s*(?:[0-9]+|[^\W\d_]+|[^\s])")
#: Tokens that a worker remembers, and tokens of padded runs that are decoded at once.
REMEMBERED, AT_ONCE = 200_000, 100_000
#: Characters of a longer text that are decoded at once, and tokens before and after such a window that only lend context.
WINDOW, CONTEXT = 1 << 18, 32


def tokens(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]


def shape(token: str) -> str:
    n = len(token)
    if token[0].isdigit():
        return f"9{n if n < 5 else 5 if n < 8 else 8 if n < 13 else 13}"
    if token[0].isalpha():
        case = "a" if token.islower() else "A" if token.isupper() else "Aa" if token.istitle() else "aA"
        return case + str(min(n, 4))
    return token if token.isascii() else "?"


def token_features(window: list[tuple[str, int, int]]) -> list[list[str]]:
    """Shapes of a token and its neighbours, each with whether white space stands before it, and keywords nearby."""
    shapes = [("_" if i and start > window[i - 1][2] else "") + shape(t) for i, (t, start, _) in enumerate(window)]
    words = [t.lower() for t, _, _ in window]
    at = lambda i: shapes[i] if 0 <= i < len(shapes) else "#"
    out = []
    for i in range(len(window)):
        own = ["bias", *(f"{j}{at(i + j)}" for j in (-3, -2, -1, 0, 1, 2, 3)), f"l{at(i - 1)}|{at(i)}", f"r{at(i)}|{at(i + 1)}", f"m{at(i - 1)}|{at(i)}|{at(i + 1)}", f"f{at(i)}|{at(i + 1)}|{at(i + 2)}", f"p{at(i - 2)}|{at(i - 1)}|{at(i)}"]
        own += [f"k{w}" for w in words[max(0, i - 4) : i] if w in _KEYWORDS]
        out.append(own)
    return out


def labelled_windows(n: int = 500, seed: int = 3) -> list[list[tuple[str, str]]]:
    """Windows of pieces (text, kind or "O"), written by rule."""
    r = random.Random(seed)
    num = lambda k: "".join(str(r.randint(0 if i else 1, 9)) for i in range(k))
    word = lambda: "".join(r.choice("aeinorstlcdhmupg") for _ in range(r.randint(2, 8)))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    seps = ("-", ".", " ")

    def phone() -> str:
        s = r.choice(seps)
        return r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}{s}{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"+{num(2)} {num(3)} {num(7)}", f"+1 ({num(3)}) {num(3)}-{num(4)}", f"1-{num(3)}-{num(3)}-{num(4)}", f"00{num(2)} {num(3)} {num(6)}"])

    positive = {
        "phone": phone,
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": lambda: r.choice([num(16), " ".join(num(4) for _ in range(4)), "-".join(num(4) for _ in range(4))]),
        "email": lambda: r.choice([f"{word()}.{num(2)}@{word()}.example.com", f"{word()}@{word()}{num(1)}.org", f"{num(2)}@{word()}{num(1)}.example.com", f"{word()} (at) {word()} (dot) com"]),
    }
    negative = [
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}", lambda: f"{r.randint(0, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}",
        lambda: f"Version {r.randint(1, 9)}.{r.randint(0, 9)}.", lambda: f"CC BY-NC {r.randint(1, 9)}.0.", lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: f"{r.randint(1, 999)},{num(3)}.{num(2)}", lambda: num(r.randint(1, 9)),
        lambda: f"\"{hexes(40)}\"", lambda: hexes(32), lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"{num(2)}-{num(2)}", lambda: f"{word()}{num(2)}", lambda: f"{num(4)} {num(4)}", lambda: f"@{word()}", lambda: f"${num(3)}.{num(2)}", lambda: f"{num(3)}-{num(3)}",
    ]
    tail = lambda: r.choice(["", "", "", ".", ",", "%%%", "***", "$$$", "###", "&&&", "!!", "\""])
    out = []
    for i in range(n):
        pieces: list[tuple[str, str]] = []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, 4)):
                pieces += [(" ", "O"), (r.choice([word(), word().title(), word().upper()]) + tail(), "O")]
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                if r.random() < 0.3:
                    pieces += [(" ", "O"), (r.choice(["call", "tel:", "phone", "mail", "card", "host"]), "O")]
                pieces += [(" ", "O"), (positive[kind](), kind), (tail(), "O")]
            else:
                pieces += [(" ", "O"), (r.choice(negative)() + tail(), "O")]
        for _ in range(r.randint(0, 4)):
            pieces += [(" ", "O"), (word() + tail(), "O")]
        out.append(pieces)
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """Weights of features by label, and of moves between labels."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        self._decoder: Decoder | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_decoder": None}

    def decoder(self) -> Decoder:
        """Its tables, made once in a process."""
        if self._decoder is None:
            self._decoder = Decoder(self)
        return self._decoder

    def scores(self, windows: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Padded scores (window, place, label), and lengths."""
        lengths = np.array([len(w) for w in windows])
        out = np.zeros((len(windows), int(lengths.max()), len(LABELS)))
        get = self.names.get
        for i, w in enumerate(windows):
            for j, own in enumerate(w):
                out[i, j] = self.weights[[k for k in map(get, own) if k is not None]].sum(axis=0)
        return out, lengths

    def decode(self, windows: list[list[list[str]]]) -> list[np.ndarray]:
        """Best label of each token, by Viterbi over batches of windows of like length."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(windows)
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
        for first in range(0, len(order), 256):
            part = order[first : first + 256]
            score, lengths = self.scores([windows[i] for i in part])
            best, back = score[:, 0], np.zeros(score.shape, np.int64)
            finals = [best]
            for j in range(1, score.shape[1]):
                step = best[:, :, None] + self.moves
                back[:, j] = step.argmax(axis=1)
                best = step.max(axis=1) + score[:, j]
                finals.append(best)
            for row, i in enumerate(part):
                n = int(lengths[row])
                path = np.zeros(n, np.int64)
                path[-1] = finals[n - 1][row].argmax()
                for j in range(n - 1, 0, -1):
                    path[j - 1] = back[row, j, path[j]]
                out[i] = path
        return out


def train(table_: list[list[tuple[str, str]]] | None = None, steps: int = 50, rate: float = 0.2, l2: float = 1e-3) -> Field:
    """Maximum likelihood by Adam steps on all windows at once."""
    windows, labels = [], []
    for pieces in table_ or labelled_windows():
        text = "".join(p for p, _ in pieces)
        kind_at, at, marks = [], 0, []
        for p, k in pieces:
            kind_at += [k] * len(p)
            marks.append(at)
            at += len(p)
        own = tokens(text, 0, len(text))
        begins = set(marks)
        windows.append(token_features(own))
        labels.append([0 if kind_at[s] == "O" else LABELS.index(("B-" if s in begins else "I-") + kind_at[s]) for _, s, _ in own])
    names: dict[str, int] = {}
    for w in windows:
        for f in w:
            for name in f:
                names.setdefault(name, len(names))
    n, longest = len(windows), max(map(len, windows))
    lengths = np.array([len(w) for w in windows])
    place = np.array([i * longest + j for i, w in enumerate(windows) for j, f in enumerate(w) for _ in f])
    feature = np.array([names[x] for w in windows for f in w for x in f])
    order = np.argsort(feature, kind="stable")
    place, feature = place[order], feature[order]
    cuts = np.searchsorted(feature, np.arange(len(names)))
    by_place = np.argsort(place, kind="stable")
    held, first = np.unique(place[by_place], return_index=True)
    k = len(LABELS)
    gold = np.zeros((n, longest, k))
    moves_gold = np.zeros((k, k))
    for i, own in enumerate(labels):
        gold[i, np.arange(len(own)), own] = 1
        np.add.at(moves_gold, (own[:-1], own[1:]), 1)
    inside = np.arange(longest) < lengths[:, None]
    weights, moves = np.zeros((len(names), k)), np.zeros((k, k))
    m = [np.zeros_like(weights), np.zeros_like(moves)]
    v = [np.zeros_like(weights), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        score = np.zeros((n * longest, k))
        score[held] = np.add.reduceat(weights[feature[by_place]], first, axis=0)
        score = score.reshape(n, longest, k)
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[:, 0] = score[:, 0]
        for j in range(1, longest):
            alpha[:, j] = np.where(inside[:, j, None], _log_sum(alpha[:, j - 1, :, None] + moves, 1) + score[:, j], alpha[:, j - 1])
        for j in range(longest - 2, -1, -1):
            beta[:, j] = np.where(inside[:, j + 1, None], _log_sum(moves + (score[:, j + 1] + beta[:, j + 1])[:, None, :], 2), 0.0)
        total = _log_sum(alpha[:, -1], 1)
        share = np.exp(alpha + beta - total[:, None, None]) * inside[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + moves + (score + beta)[:, 1:, None, :] - total[:, None, None, None]) * inside[:, 1:, None, None]
        miss = (gold - share).reshape(n * longest, k)
        gradients = [np.add.reduceat(miss[place], cuts, axis=0) / n - l2 * weights, (moves_gold - pair.sum(axis=(0, 1))) / n - l2 * moves]
        for p, g, mi, vi in zip((weights, moves), gradients, m, v):
            mi += 0.1 * (g - mi)
            vi += 0.01 * (g * g - vi)
            p += rate * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.99**step)) + 1e-8)
    return Field(names, weights.astype(np.float32), moves.astype(np.float32))


@functools.cache
def trained() -> Field:
    """The field of `labelled_windows`, trained once in a process."""
    return train()


class Decoder:
    """A field's labels of whole texts.

    The weights of a token's features are rows of tables, by the shapes of one, two or three
    neighbours; shapes that the field does not know share one number, whose rows are zero.
    """

    #: Rows without a token before each text and after the last, as many as a feature looks back.
    EDGE = 4

    def __init__(self, field: Field):
        weight = lambda name: field.weights[field.names[name]] if name in field.names else np.zeros(len(LABELS), np.float32)
        self.moves = field.moves
        known = ["#", *sorted({n[2:] for n in field.names if n.startswith("-1") and n != "-1#"} | {n[1:] for n in field.names if n[0] in "0123"})]
        self.shapes = {x: i for i, x in enumerate(dict.fromkeys(known))}
        self.other = len(self.shapes)
        self.n = n = self.other + 1
        zero = np.zeros(len(LABELS), np.float32)
        one = {j: np.array([weight(f"{j}{x}") for x in self.shapes] + [zero]) for j in range(-3, 4)}
        two = {k: np.zeros((n, n, len(LABELS)), np.float32) for k in "lr"}
        three = {k: np.zeros((n, n, n, len(LABELS)), np.float32) for k in "mfp"}
        for name in field.names:
            if name[0] in "lrmfp":
                held = two.get(name[0], three.get(name[0]))
                held[self._parts(name[1:], held.ndim - 1)] = weight(name)
        three["m"] += one[-1][:, None, None] + one[0][None, :, None] + one[1][None, None, :] + two["l"][:, :, None] + two["r"][None] + weight("bias")
        three["f"] += one[2][None, None, :]
        three["p"] += one[-2][:, None, None]
        self.single = [(at, one[at]) for at in (-3, 3)]
        self.triples = [(at, three[k].reshape(n**3, -1)) for at, k in ((-1, "m"), (0, "f"), (-2, "p"))]
        words = sorted(_KEYWORDS)
        self.words = {w: i + 1 for i, w in enumerate(words)}
        self.word_rows = np.array([zero] + [weight(f"k{w}") for w in words])
        self.memory: dict[str, int] = {}
        # what the moves before and after a label gain at most over those of O: next to any label, to O, to an end of the text
        before, after = self.moves - self.moves[:, :1], self.moves - self.moves[:1, :]
        self.before = np.array([before.max(axis=0), before[0], zero])
        self.after = np.array([after.T.max(axis=0), after[:, 0], zero])

    def _parts(self, name: str, k: int) -> tuple[int, ...]:
        """Numbers of the shapes in a feature's name; the sign between them is itself a shape."""
        out, at = [], 0
        for i in range(k):
            if i:
                at += 1
            end = at + 1
            while end < len(name) and not (name[end] == "|" and name[at:end] != "_"):
                end += 1
            out.append(self.shapes.get(name[at:end], self.other))
            at = end
        return tuple(out)

    def _token(self, spaced: str) -> int:
        """Number of the keyword, or 0, and of the shape."""
        token = spaced.lstrip()
        found = (self.words.get(token.lower(), 0) << 16) + self.shapes.get(("_" if token != spaced else "") + shape(token), self.other)
        if len(self.memory) < REMEMBERED and len(spaced) < 40:
            self.memory[spaced] = found
        return found

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores (row, label) of the rows of all texts, and where each text's tokens begin and end."""
        flat: list[int] = []
        begins, ends = [], []
        get, new, edge = self.memory.get, self._token, [0] * self.EDGE
        for text in texts:
            flat += edge
            begins.append(len(flat))
            own = _SPACED.findall(text)
            if own:
                own[0] = own[0].lstrip()
            flat += [c if (c := get(t)) is not None else new(t) for t in own]
            ends.append(len(flat))
        flat += edge
        both = np.array(flat, np.int32)
        ids, words = both & 0xFFFF, both >> 16
        size, n, edge_ = len(ids), self.n, self.EDGE
        wide = np.zeros(size + 2 * edge_, np.int32)
        wide[edge_ : edge_ + size] = ids
        triple = (wide[:-2] * n + wide[1:-1]) * n + wide[2:]
        out = np.zeros((size, len(LABELS)), np.float32)
        for at, t in self.triples:
            out += t.take(triple[edge_ + at : edge_ + at + size], axis=0)
        for at, t in self.single:
            out += t.take(wide[edge_ + at : edge_ + at + size], axis=0)
        for i in np.flatnonzero(words):
            out[i + 1 : i + 5] += self.word_rows[words[i]]
        return out, np.array(begins, np.int64), np.array(ends, np.int64)

    def labels(self, texts: list[str]) -> list[np.ndarray]:
        """The best labels of each text's tokens."""
        return self._labels(texts)[0]

    def windows(self, text: str) -> Iterator[tuple[int, int, np.ndarray]]:
        """Start, end and labels of windows that cover a long text, each token in one of them.

        A window ends before a token that is O on every best path, so that runs of other labels
        are whole, and begins with tokens of the one before, whose labels are dropped; one
        without such a token is taken again twice as wide. The labels are those of the whole text.
        """
        lead = start = 0
        size = WINDOW
        while start < len(text):
            end = _SPACE.search(text, start + size) if start + size < len(text) else None
            end = end.start() if end else len(text)
            (path,), (sure,) = self._labels([text[lead:end]])
            places = [m.start() for m in _TOKEN.finditer(text, lead, end)]
            first = bisect.bisect_left(places, start)
            if end == len(text):
                yield start, end, path[first:]
                return
            cuts = np.flatnonzero(sure[: max(len(places) - CONTEXT, 0)])
            cuts = cuts[cuts > first]
            if len(cuts):
                last = int(cuts[-1])
                yield start, places[last], path[first:last]
                start, lead, size = places[last], places[max(last - CONTEXT, 0)], WINDOW
            else:
                size *= 2

    def _labels(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The best labels of each text's tokens, and which tokens are O on every best path."""
        score, begins, ends = self.scores(texts)
        inside = np.zeros(len(score) + 1, np.int64)
        np.add.at(inside, begins, 1)
        np.add.at(inside, ends, -1)
        inside = np.cumsum(inside)[:-1] > 0
        # a token whose O leads by more than moves can make up is O on every best path; its neighbours are then held against O alone
        sure = ~inside
        most = np.maximum(self.before.max(axis=0) + self.after.max(axis=0), 0)[1:] + 1e-3
        open_ = np.flatnonzero(inside)
        for k in range(4):
            if k:
                side = lambda near: np.where(~inside[near], 2, np.where(sure[near], 1, 0))
                most = (self.before[side(open_ - 1)] + self.after[side(open_ + 1)])[:, 1:] + 1e-3
            own = score[open_]
            wins = own[:, 0] > (own[:, 1:] + most).max(axis=1)
            sure[open_[wins]] = True
            open_ = open_[~wins]
        path = np.zeros(len(score), np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], sure, [True]]).astype(np.int8)))
        starts, stops = edges[::2], edges[1::2]
        order = np.argsort(stops - starts, kind="stable")
        first = 0
        while first < len(order):
            last = first + 1
            while last < len(order) and (last + 1 - first) * (stops[order[last]] - starts[order[last]]) <= AT_ONCE:
                last += 1
            part = order[first:last]
            self._runs(score, inside, starts[part], stops[part], path)
            first = last
        return [path[a:b] for a, b in zip(begins, ends)], [sure[a:b] for a, b in zip(begins, ends)]

    def _runs(self, score: np.ndarray, inside: np.ndarray, starts: np.ndarray, stops: np.ndarray, path: np.ndarray) -> None:
        """Viterbi over runs of rows, the shortest first; a token before or after a run is O."""
        lengths = stops - starts
        back = np.zeros((int(lengths[-1]), len(starts), len(LABELS)), np.int8)
        best = score[starts] + np.where(inside[starts - 1, None], self.moves[0], np.float32(0))
        finals = np.empty_like(best)
        alive = 0
        for j in range(len(back)):
            if j:
                step = best[alive:, :, None] + self.moves
                back[j, alive:] = step.argmax(axis=1)
                best[alive:] = step.max(axis=1) + score[starts[alive:] + j]
            over = int(np.searchsorted(lengths, j + 1, side="right"))
            finals[alive:over] = best[alive:over]
            alive = over
        label = (finals + np.where(inside[stops, None], self.moves[:, 0], np.float32(0))).argmax(axis=1)
        for j in range(len(back) - 1, -1, -1):
            has = int(np.searchsorted(lengths, j, side="right"))
            path[starts[has:] + j] = label[has:]
            label[has:] = back[j, np.arange(has, len(starts)), label[has:]]


def _valid(kind: str, value: str) -> bool:
    digits = _digits(value)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", value)
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)
    return re.search(r"(?i)@|\bat\b", value) is not None and re.search(r"(?i)\.|\bdot\b", value) is not None


def _named(text: str, start: int, end: int, path: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of the valid spans that the labels of a window's tokens mark."""
    if not path.any():
        return
    w = tokens(text, start, end)
    j = 0
    while j < len(path):
        if path[j] == 0:
            j += 1
            continue
        kind, first = KINDS[(path[j] - 1) // 2], j
        j += 1
        while j < len(path) and path[j] and path[j] % 2 == 0 and KINDS[(path[j] - 1) // 2] == kind:
            j += 1
        if _valid(kind, text[w[first][1] : w[j - 1][2]]):
            yield kind, w[first][1], w[j - 1][2]


def added_spans(texts: list[str], base: list[dict[str, list[Span]]], field: Field) -> list[dict[str, list[Span]]]:
    """What the field finds beside the base spans; it overlaps none of them."""
    out: list[dict[str, list[Span]]] = [{k: [] for k in KINDS} for _ in texts]
    decoder = field.decoder()
    short = [i for i, t in enumerate(texts) if len(t) <= WINDOW]
    paths = dict(zip(short, decoder.labels([texts[i] for i in short])))
    for i, text in enumerate(texts):
        taken = sorted(s for spans in base[i].values() for s in spans)
        starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        for window in [(0, len(text), paths[i])] if i in paths else decoder.windows(text):
            for kind, start, end in _named(text, *window):
                before = bisect.bisect_left(starts, end)  # of the base spans that begin before its end, one may reach into it
                if not before or ends[before - 1] <= start:
                    out[i][kind].append((start, end))
    return out


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base counts, base_sha256 and spans for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(field or trained())
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = text_of(batch.column("text")).to_pylist()
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, shared.value)
            joined = [_joined(b) for b in base]
            every = [_joined({k: b[k] + m[k] for k in KINDS}) for b, m in zip(base, more)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([len(b[k]) for b in base], pa.int64()) for k in KINDS), pa.array([hashlib.sha256(j.encode()).hexdigest() if j else none for j in joined]), pa.array(every, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
