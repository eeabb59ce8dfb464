"""Personal data by a semi-Markov conditional random field over rule-found base spans.

``base_spans`` finds the four rule-defined kinds exactly.  ``SemiCrf`` scores whole candidate
segments (their digit groups, checksums, separators and neighbours) and picks boundaries and
kinds jointly with a dynamic programme whose entity length is bounded, with weights for labels
that follow each other directly; what it adds never moves or removes a base span.

A candidate must hold a digit, an ``@`` or a written-out at-sign, so text far from those can
only be "outside".  The programme therefore runs over windows around them, which gives the
same best path as running over the whole text: windows are wider than the longest entity.

Nulls count as empty texts, repeated rows give repeated results, an empty table gives an
empty table and columns other than the two named ones are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import documents

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, base string, spans string, n_email long, n_ip long, n_card long, n_phone long"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Every ``@`` with a local part before it and a dotted domain after it, left to right, in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, in order of start and then kind."""
    out = _emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# ---------------------------------------------------------------- segments and their features

MAX_TOKENS, MAX_CHARS, REACH = 24, 96, 112
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.S)
_AT_SIGN = r"@|[\[({]\s?at\s?[\])}]"
_DOT_SIGN = r"\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s"
_TRIGGER = re.compile(rf"[0-9]|{_AT_SIGN}|\sat\s(?=[\w-]{{1,40}}\sdot\s)", re.I)
_AT = re.compile(rf"{_AT_SIGN}|\sat\s(?=[\w-]{{1,40}}\sdot\s)", re.I)
_DOT = re.compile(_DOT_SIGN, re.I)
_ADDRESS = re.compile(rf"\S{{1,40}}(?:\s?(?:{_AT_SIGN})\s?|\sat\s(?=[\w-]{{1,40}}\sdot\s))[\w-]{{1,40}}(?:(?:{_DOT_SIGN})[\w-]{{1,24}}){{1,5}}", re.I)
_OPEN, _INSIDE = frozenset("(+"), frozenset(" ().[]{}@-+/_%")


def _kind_of(c: str) -> str:
    return "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else c if c in "()[]+-.@/:,=\"'#$€%_" else "p"


def segment_features(text: str, a: int, b: int) -> list[str]:
    """What is seen of ``text[a:b]`` as one segment: all of it at once, with one character on either side."""
    s = text[a:b]
    digits = _NOT_DIGIT.sub("", s)
    n = len(digits)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    seps = "".join(sorted(set(re.sub(r"\w", "", s).replace("\n", " "))))[:6]
    left, right = (_kind_of(text[a - 1]) if a else "^"), (_kind_of(text[b]) if b < len(text) else "$")
    f = ["bias", f"left={left}", f"right={right}", f"n={min(n, 22)}"]
    if any(c.isalpha() for c in s):
        f.append("letters")
        if _ADDRESS.fullmatch(s):
            f += ["address", f"address:{left}{right}"]
            if not _AT.search(s).group().isspace() and s.count("@") + s.count("[") + s.count("(") + s.count("{"):
                f.append("address-marked")
            elif re.search(r"\sdot\s", s, re.I):
                f.append("address-spelled")
    else:
        shape = "-".join(map(str, groups)) if len(groups) <= 6 else "many"
        f += [f"shape={shape}", f"shape:{seps}={shape}", f"groups={min(len(groups), 7)}", f"seps={seps}", f"open={s[0] if s[0] in '+(' else 'd'}{min(groups[0], 5)}"]
        if 12 <= n <= 19:
            f += ["card-length", "luhn" if luhn(digits) else "no-luhn"]
            if groups in ([4, 4, 4, 4], [4, 6, 5], [n]):
                f.append("card-groups")
        if len(groups) == 4 and (s.count(".") == 3):
            f.append("quad" if all(g <= 3 for g in groups) and all(int(x) < 256 for x in re.findall(r"[0-9]+", s)) else "quad-large")
        if s[0] == "+" or re.match(r"00[1-9]", s):
            f.append("international")
        if 9 <= n <= 15 and len(groups) >= 3 and max(groups) <= 8:
            f.append("phone-length")
    return f


def _may_be(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] is a candidate segment at all."""
    if b - a > MAX_CHARS or b - a < 7:
        return False
    first, last = text[a], text[b - 1]
    if not (first.isalnum() or first in _OPEN) or not last.isalnum():
        return False
    if a and text[a - 1].isdigit() and first.isdigit():
        return False
    s = text[a:b]
    if any(not (c.isalnum() or c in _INSIDE or c == "\n") for c in s) or "\n" in s:
        return False
    n = sum(c.isdigit() for c in s)
    if any(c.isalpha() for c in s):
        return bool(_AT.search(s) and _DOT.search(s) and _ADDRESS.fullmatch(s))
    return 7 <= n <= 24 or (n >= 4 and (s.count(".") == 3))


class Lattice:
    """Tokens of a text, the candidate segments over them and the features of either."""

    def __init__(self, text: str):
        cuts = [m.end() for m in _TOKEN.finditer(text)]
        self.cuts, self.n = [0, *cuts], len(cuts)
        self.edges: list[list[tuple[int, list[str]]]] = [[] for _ in cuts]  # by start: (stop, features)
        has_at = bool(_AT.search(text))
        for i in range(self.n):
            a, b = self.cuts[i], self.cuts[i + 1]
            c = text[a]
            if not (c.isdigit() or c in _OPEN or (has_at and c.isalnum())):
                continue
            for j in range(i + 1, min(self.n, i + MAX_TOKENS) + 1):
                b = self.cuts[j]
                if b - a > MAX_CHARS or text[b - 1] == "\n":
                    break
                if _may_be(text, a, b):
                    self.edges[i].append((j, segment_features(text, a, b)))


OUTSIDE = len(KINDS)  # the label of a token in no entity; an entity's is its kind


class SemiCrf:
    """Weights of (feature, kind) pairs, and of labels that follow each other directly: ``t[before, after]``; a text begins after an outside token."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, OUTSIDE))
        self.t = np.zeros((OUTSIDE + 1, OUTSIDE + 1))

    def scores(self, features: list[str]) -> np.ndarray:
        rows = [k for f in features if (k := self.index.get(f)) is not None]
        return self.w[rows].sum(axis=0)

    def best(self, lat: Lattice) -> list[tuple[int, int, int]]:
        """The best path's entities as (first token, stop token, kind)."""
        no, labels, t = -math.inf, range(OUTSIDE + 1), self.t.tolist()
        score, back = [[no] * (OUTSIDE + 1) for _ in range(lat.n + 1)], [[None] * (OUTSIDE + 1) for _ in range(lat.n + 1)]
        score[0][OUTSIDE] = 0.0
        for i in range(lat.n):
            here = [x for x in labels if score[i][x] > no]
            came = [max((score[i][x] + t[x][y], -x) for x in here) for y in (labels if lat.edges[i] else (OUTSIDE,))]
            value, x = came[-1]
            if value > score[i + 1][OUTSIDE]:
                score[i + 1][OUTSIDE], back[i + 1][OUTSIDE] = value, (i, -x)
            for j, features in lat.edges[i]:
                for y, s in enumerate(self.scores(features).tolist()):
                    value, x = came[y]
                    if value + s > score[j][y]:
                        score[j][y], back[j][y] = value + s, (i, -x)
        out, j, y = [], lat.n, max(labels, key=lambda y: (score[lat.n][y], y))
        while j:
            i, x = back[j][y]
            if y != OUTSIDE:
                out.append((i, j, y))
            j, y = i, x
        return out[::-1]

    def sums(self, n: int, edges: list[list[tuple[int, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Log sums over all paths to (place, label) and from there, and over what may follow a place, by its label.  ``edges``: by start (stop, scores of the kinds)."""
        to, rest, then = np.full((n + 1, OUTSIDE + 1), -np.inf), np.full((n + 1, OUTSIDE + 1), -np.inf), [np.full(OUTSIDE + 1, -np.inf) for _ in range(n)]
        to[0, OUTSIDE], rest[n] = 0.0, 0.0
        with np.errstate(divide="ignore"):
            for i in range(n):
                came = _logsum(to[i][:, None] + self.t, 0)
                to[i + 1, OUTSIDE] = np.logaddexp(to[i + 1, OUTSIDE], came[OUTSIDE])
                for j, s in edges[i]:
                    to[j, :OUTSIDE] = np.logaddexp(to[j, :OUTSIDE], came[:OUTSIDE] + s)
            for i in range(n - 1, -1, -1):
                then[i][OUTSIDE] = rest[i + 1, OUTSIDE]
                for j, s in edges[i]:
                    then[i][:OUTSIDE] = np.logaddexp(then[i][:OUTSIDE], s + rest[j, :OUTSIDE])
                rest[i] = _logsum(self.t + then[i], 1)
        return to, rest, then

    def gradient(self, n: int, edges: list[list[tuple[int, list[int], int]]]) -> tuple[list[tuple[list[int], np.ndarray]], np.ndarray]:
        """Of one example's log-likelihood: by each edge's features, and by pairs of labels.  ``edges``: by start (stop, features, the gold kind or -1)."""
        scored = [[(j, self.w[rows].sum(axis=0)) for j, rows, _ in es] for es in edges]
        to, rest, then = self.sums(n, scored)
        z = _logsum(to[n], 0)
        by_edge, pairs = [], np.zeros_like(self.t)
        for i in range(n):
            came = _logsum(to[i][:, None] + self.t, 0)
            pairs -= np.exp(to[i][:, None] + self.t + then[i] - z)
            for (j, s), (_, rows, y) in zip(scored[i], edges[i], strict=True):
                grad = -np.exp(came[:OUTSIDE] + s + rest[j, :OUTSIDE] - z)
                if y >= 0:
                    grad[y] += 1
                by_edge.append((rows, grad))
        i, before = 0, OUTSIDE
        while i < n:
            j, y = next(((j, y) for j, _, y in edges[i] if y >= 0), (i + 1, OUTSIDE))
            pairs[before, y] += 1
            i, before = j, y
        return by_edge, pairs

    def fit(self, examples: list[tuple[str, list[Span]]], epochs: int = 12, rate: float = 0.35, decay: float = 1e-3) -> SemiCrf:
        """Maximum conditional likelihood by adaptive gradient steps; forward and backward sums run over segments."""
        prepared = []
        for text, gold in examples:
            lat = Lattice(text)
            want = {(a, b): KINDS.index(k) for k, a, b in gold}
            edges = [[(j, [self.index.setdefault(f, len(self.index)) for f in fs], want.get((lat.cuts[i], lat.cuts[j]), -1)) for j, fs in es] for i, es in enumerate(lat.edges)]
            if any(edges):
                prepared.append((lat.n, edges))
        self.w = np.zeros((len(self.index), OUTSIDE))
        seen, seen_t = np.full((len(self.index), OUTSIDE), 1e-6), np.full(self.t.shape, 1.0)
        order = random.Random(11)
        for _ in range(epochs):
            order.shuffle(prepared)
            for n, edges in prepared:
                by_edge, pairs = self.gradient(n, edges)
                for rows, grad in by_edge:
                    if np.abs(grad).max() > 1e-3:
                        grad = grad - decay * self.w[rows].mean(axis=0)
                        seen[rows] += grad**2
                        self.w[rows] += rate * grad / np.sqrt(seen[rows])
                pairs -= decay * self.t
                seen_t += pairs**2
                self.t += 0.1 * rate * pairs / np.sqrt(seen_t)
        return self

    def spans(self, text: str) -> list[Span]:
        out = []
        for a, b in _windows(text):
            part = text[a:b]
            if sum(c.isdigit() for c in part) < 4 and not _AT.search(part):
                continue
            lat = Lattice(part)
            if any(lat.edges):
                out += [(KINDS[y], a + lat.cuts[i], a + lat.cuts[j]) for i, j, y in self.best(lat)]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(x, axis=axis)


def _windows(text: str):
    """Ranges around triggers that reach further than any entity; those that touch are one."""
    start = stop = None
    for m in _TRIGGER.finditer(text):
        if start is None:
            start = max(0, m.start() - REACH)
        elif m.start() - REACH > stop:
            yield start, stop
            start = m.start() - REACH
        stop = min(len(text), m.end() + REACH)
    if start is not None:
        yield start, stop


# ---------------------------------------------------------------- training examples, made by rule

def training_examples(count: int = 480, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Sentences of invented words around one to three values, half of which only look like personal data."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(["an", "er", "th", "lo", "mi", "sch", "é", "ue", "ñ", "or"]) for _ in range(r.randint(1, 4)))

    def card() -> str:
        d = digits(16)
        if r.random() < 0.6:
            d = next(d[:-1] + c for c in "0123456789" if luhn(d[:-1] + c))
        sep = r.choice(["", "", " ", "-"])
        return sep.join(d[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+{r.randint(1, 99)}-{a}-{b}-{c}", f"00{r.randint(1, 99)} {a} {b}{c}"])

    def email() -> str:
        local, host, top = r.choice([word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}.{digits(2)}", digits(2)]), word(), r.choice(["com", "org", "net", "de", "example.com"])
        at, dot = r.choice([("@", "."), ("@", "."), (" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot "), (" @ ", "."), ("[at]", "[dot]")])
        return f"{local}{at}{host}{dot}{top.replace('.', dot)}"

    def ip() -> str:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def other() -> str:
        return r.choice([
            f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1900, 2099)}", f"{r.randint(0, 23):02}:{digits(2)}:{digits(2)}",
            f"{digits(3)}-{digits(2)}-{digits(4)}", f"97{r.choice('89')}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", " ".join(f"{r.randint(0, 99)}.{digits(1)}" for _ in range(r.randint(3, 6))),
            f"{r.randint(1900, 2099)}{r.randint(1, 12):02}{r.randint(1, 28):02}{digits(6)}", f"{r.randint(1900, 2099)}{r.randint(1, 12):02}{r.randint(1, 28):02}", f"{digits(2)}.{digits(2)} {digits(2)}.{digits(2)} {digits(2)}.{digits(2)}",
            f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", f"{r.randint(1, 999)},{digits(3)}.{digits(2)}", digits(r.choice([7, 8, 9, 10, 11, 20, 22, 24])), f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"',
            f"{r.randint(256, 999)}.{r.randint(256, 999)}.{r.randint(0, 999)}.{r.randint(0, 999)}", f"3.{digits(9)}", f"{digits(4)}-{digits(4)}", f"{r.randint(1900, 2030)} {r.randint(1900, 2030)} {r.randint(1900, 2030)}", f"@{word()}", f"{word()} at {word()}", f"{digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"{digits(5)}-{digits(5)}", f"{digits(1)} {digits(2)} {digits(3)} {digits(1)} {digits(2)}",
        ])

    out = []
    for _ in range(count):
        text, gold = " ".join(word() for _ in range(r.randint(0, 3))), []
        for _ in range(r.randint(1, 3)):
            text += r.choice([" ", " ", "\n", " ", ", "]) if text else ""
            make = r.choice([card, phone, email, ip, other, other, other, other, other])
            value = make()
            if make is not other:
                gold.append((make.__name__, len(text), len(text) + len(value)))
            text += value + r.choice([" ", ", ", ". ", "\n"]) + " ".join(word() for _ in range(r.randint(1, 3)))
        out.append((text, gold))
    return out


@functools.lru_cache(maxsize=1)
def default_model() -> SemiCrf:
    return SemiCrf().fit(training_examples())


def all_spans(text: str, model: SemiCrf) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the model's spans that touch none of them."""
    base = base_spans(text)
    taken, added = sorted((a, b) for _, a, b in base), []
    if _TRIGGER.search(text):
        k, reach = 0, 0
        for kind, a, b in model.spans(text):
            while k < len(taken) and taken[k][0] < b:
                reach = max(reach, taken[k][1])
                k += 1
            if reach <= a:
                added.append((kind, a, b))
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def spell(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SemiCrf | None = None) -> DataFrame:
    """Base and all spans of every text, as ``kind:start:end`` lists over code points, and base counts by kind."""
    model = model or default_model()

    def run(it):
        import pyarrow as pa

        for batch in it:
            base, spans, counts = [], [], [[], [], [], []]
            for text in batch.column("text").to_pylist():
                b, every = all_spans(text or "", model)
                base.append(spell(b))
                spans.append(spell(every))
                for k, c in zip(KINDS, counts, strict=True):
                    c.append(sum(s[0] == k for s in b))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, pa.string()), pa.array(spans, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], ["doc_id", "base", "spans", "n_email", "n_ip", "n_card", "n_phone"])

    return documents(df, id_col, text_col).mapInArrow(run, SCHEMA)


def redact(df: DataFrame, text_col: str = "text", model: SemiCrf | None = None) -> DataFrame:
    """The same rows and columns with each span replaced by its kind in brackets; where spans overlap, the first wins."""
    model = model or default_model()
    schema = df.schema

    def run(it):
        import pyarrow as pa

        for batch in it:
            texts = []
            for text in batch.column(text_col).to_pylist():
                if text is None:
                    texts.append(None)
                    continue
                out, at = [], 0
                for kind, a, b in all_spans(text, model)[1]:
                    if a >= at:
                        out += [text[at:a], f"[{kind.upper()}]"]
                    at = max(at, b)
                texts.append("".join([*out, text[at:]]))
            k = batch.schema.get_field_index(text_col)
            yield batch.set_column(k, pa.field(text_col, pa.string()), pa.array(texts, pa.string()))

    return df.mapInArrow(run, schema)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
