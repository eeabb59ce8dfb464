"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are lower-cased and their runs of white space become one space.
An item is cut into overlapping segments of ``SEGMENT`` characters, one every ``STRIDE`` (one, if it
is shorter), so any passage of ``SEGMENT + STRIDE`` characters holds a whole one.
A text leaks an item if some segment aligns with a stretch of it within ``RATE`` edits a
character (fewer in segments of under 75 characters, where that many could leave no q-gram).  By the q-gram lemma such a stretch shares at least ``length + 1 - q(e + 1)``
q-grams with the segment, on diagonals at most ``e`` apart; so shared q-grams are counted
in overlapping bands of diagonals, and only bands that reach the bound are aligned.  Where texts
and items repeat themselves the shared q-grams are as many as the product of their lengths; they
are counted in overlapping tiles of text and items of at most ``TILE`` at a time, each of which
holds any stretch and segment that fit in it whole.

Benchmark items are dealt into chunks of about ``CHUNK`` characters, and one chunk's index is
broadcast at a time: with more than one, the texts pass them one after the other, each pass
ends in a checkpoint, and the index that it used is destroyed.

Null texts count as empty and leak nothing.  Items with fewer characters than a q-gram
count as leaked where they occur literally between non-letters; empty and null items never.
Ids that are not whole numbers are taken as strings.  Repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, durable, mix

Q, SEGMENT, STRIDE, RATE, CHUNK, SLICE, TILE = 10, 80, 10, 0.08, 4_000_000, 1 << 20, 1 << 20


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes_of(text: str) -> np.ndarray:
    """A text's code points, so q-grams of every script differ where their letters do."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    if len(codes) < q:
        return np.zeros(0, U64)
    n = len(codes) - q + 1
    with np.errstate(over="ignore"):
        acc = codes[:n].astype(U64)
        for k in range(1, q):
            acc *= U64(0x9E3779B97F4A7C15)
            acc += codes[k : n + k]
        return mix(acc)


def budget(length: int, rate: float = RATE, q: int = Q) -> int:
    """Edits allowed in a segment: ``rate`` of its length, but no more than leave a shared q-gram for certain."""
    return max(0, min(int(length * rate), length // q - 1))


def bound(length: int, edits: int, q: int = Q) -> int:
    return length + 1 - q * (edits + 1)


@functools.lru_cache(maxsize=1 << 12)
def letter_rows(segment: str) -> dict[str, int]:
    """For each letter, the rows of a column (as bits) whose segment character it is."""
    rows: dict[str, int] = {}
    for i, c in enumerate(segment):
        rows[c] = rows.get(c, 0) | 1 << i
    return rows


def banded_distance(segment: str, stretch: str, edits: int) -> int | None:
    """Least edits between the segment and any part of the stretch, if within the budget.

    The stretch is what the band's diagonals reach.  A column of the alignment is two bit vectors, of the rows where it rises
    and where it falls (Myers), so the band needs no narrower column; it ends once too few columns are left to come into the budget.
    """
    if segment in stretch:
        return 0
    m, rows = len(segment), letter_rows(segment)
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, min(m, edits + 1)
    left = len(stretch)
    for c in stretch:
        eq = rows.get(c, 0)
        straight = (((eq & up) + up) ^ up) | eq | down
        more, less = down | (full & ~(straight | up)), straight & up
        if more & last:
            score += 1
        elif less & last:
            score -= 1
            best = min(best, score)
        left -= 1
        if score - left >= best:
            break
        more, less = more << 1, less << 1  # the first row costs nothing anywhere
        up, down = full & (less | ~(straight | more)), full & more & straight
    return best if best <= edits else None


class Index:
    """Q-grams of one chunk of items, with their places."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, segment: int = SEGMENT, rate: float = RATE, tile: int = TILE):
        self.q, self.segment, self.rate, self.tile = q, segment, rate, tile
        self.ids = [i for i, _ in items]
        self.starts: dict[int, np.ndarray] = {}
        self.texts = [normal(t) for _, t in items]
        self.short = [(i, re.compile(rf"(?<!\w){re.escape(t)}(?!\w)")) for i, t in zip(self.ids, self.texts, strict=True) if 0 < len(t) < q]
        self.begin = np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64)  # where each item begins in all of them
        keys, place = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for k, t in enumerate(self.texts):
            keys.append(grams(codes_of(t), q))
            place.append(np.arange(len(keys[-1])) + self.begin[k])
        keys, place = np.concatenate(keys), np.concatenate(place)
        order = np.argsort(keys, kind="stable")
        self.place = place[order]  # of each q-gram's occurrences, in rising order
        self.keys, self.start = np.unique(keys[order], return_index=True)
        self.start = np.append(self.start, len(keys)).astype(np.int64)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.keys >> U64(42)] = True
        self.edits = budget(segment, rate, q)
        self.band = max(8, self.edits + 1)
        self.reach = segment + 2 * (self.band + self.edits)  # longer than any segment, or stretch that one can align with

    def segments(self, k: int) -> list[tuple[int, int]]:
        """(start, length) of an item's segments, the last one at its end."""
        n = len(self.texts[k])
        if n <= self.segment:
            return [(0, n)]
        return [(a, self.segment) for a in [*range(0, n - self.segment, STRIDE), n - self.segment]]

    def leaks(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(item id, least distance of a segment) of every leaked item of each text."""
        plain = [normal(t) for t in texts]
        out: list[dict[int, int]] = [{} for _ in texts]
        for i, pattern in self.short:
            for k, t in enumerate(plain):
                if pattern.search(t):
                    out[k][i] = 0
        at = 0
        while at < len(plain) and len(self.keys):
            stop, size = at, 0
            while stop < len(plain) and (stop == at or size + len(plain[stop]) < SLICE):
                size += len(plain[stop]) + 1
                stop += 1
            self._slice(plain[at:stop], out[at:stop])
            at = stop
        return [sorted(x.items()) for x in out]

    def _slice(self, texts: list[str], out: list[dict[int, int]]) -> None:
        codes = codes_of("\0".join(texts) + "\0")
        begin = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
        g = grams(codes, self.q)
        where = np.flatnonzero(self.bits[g >> U64(42)])
        k = np.searchsorted(self.keys, g[where])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == g[where]
        where, k = where[same], k[same]
        if not len(where):
            return
        self._tiles(texts, out, begin, len(codes), where, k, 0, int(self.begin[-1]))

    def _tiles(self, texts, out, begin, size: int, where: np.ndarray, k: np.ndarray, lo: int, hi: int) -> None:
        """Counts the q-grams k at ``where`` of the texts against their occurrences at [lo, hi) of the items, in tiles that hold at most ``tile`` of such pairs."""
        first, last = self.start[k], self.start[k + 1]
        if lo > 0 or hi < self.begin[-1]:
            first, last = (np.array([a + np.searchsorted(self.place[a:b], x) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.int64) for x in (lo, hi))
        times = last - first
        total = int(times.sum())
        if not total:
            return
        owner = np.searchsorted(begin, where[[0, -1]], side="right") - 1
        item = np.searchsorted(self.begin, [lo, hi - 1], side="right") - 1
        if owner[0] == owner[1] and item[0] == item[1] and out[owner[0]].get(self.ids[item[0]]) == 0:
            return
        if total > self.tile:
            half = (lo + hi) // 2
            if owner[0] != owner[1]:  # between two texts, where half the pairs lie on either side
                cut = int(begin[min(max(int(np.searchsorted(begin, where[np.searchsorted(np.cumsum(times), total // 2)], side="right")) - 1, owner[0] + 1), owner[1])])
                for part in (where < cut, where >= cut):
                    self._tiles(texts, out, begin, size, where[part], k[part], lo, hi)
                return
            if where[-1] - where[0] > 4 * self.reach:
                cut = int(where[0] + where[-1]) // 2
                for part in (where < cut + self.reach, where >= cut):
                    self._tiles(texts, out, begin, size, where[part], k[part], lo, hi)
                return
            if hi - lo > 4 * self.reach:
                self._tiles(texts, out, begin, size, where, k, lo, half + self.reach)
                self._tiles(texts, out, begin, size, where, k, half, hi)
                return
        post = np.repeat(first - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(total)
        self._count(texts, out, begin, size, np.repeat(where, times), self.place[post])

    def _count(self, texts, out, begin, size: int, spot: np.ndarray, place: np.ndarray) -> None:
        """Aligns what lies around bands of diagonals with enough shared q-grams."""
        item = np.searchsorted(self.begin, place, side="right") - 1
        place = place - self.begin[item]
        doc = np.searchsorted(begin, spot, side="right") - 1
        offset = size + 1
        low = (spot - place + offset) // self.band
        wide = (size + offset) // self.band + 3
        # each shared q-gram lies in two overlapping bands, [b, b + 2) times the band's width
        key = np.concatenate([item * wide + low, item * wide + low - 1])
        key = key * len(texts) + np.tile(doc, 2)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        edge = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        sizes = np.diff(np.append(edge, len(ranked)))
        enough, done = sizes >= self._least, set()
        for e, n in zip(edge[enough].tolist(), sizes[enough].tolist(), strict=True):
            rows = order[e : e + n] % len(spot)
            i, d = int(item[rows[0]]), int(doc[rows[0]])
            if out[d].get(self.ids[i]) == 0:
                continue
            diagonal, places = spot[rows] - place[rows] - begin[d], np.sort(place[rows])
            told = (d, i, int(diagonal.min()), int(diagonal.max()), places.tobytes())
            if told in done:
                continue  # hits that all lie where two bands overlap
            done.add(told)
            self._align(i, texts[d], out[d], places, told[2], told[3])

    @functools.cached_property
    def _least(self) -> int:
        """The smallest bound of any segment."""
        lengths = {min(len(t), self.segment) for t in self.texts}
        return max(1, min((bound(n, budget(n, self.rate, self.q), self.q) for n in lengths if n >= self.q), default=1))

    def _align(self, i: int, text: str, found: dict[int, int], places: np.ndarray, lo: int, hi: int) -> None:
        """Segments with the most shared q-grams come first; those with too few to be nearer than what is found are left."""
        if i not in self.starts:
            self.starts[i] = np.array([a for a, _ in self.segments(i)])
        starts, n = self.starts[i], min(len(self.texts[i]), self.segment)
        e = budget(n, self.rate, self.q)
        inside = np.searchsorted(places, starts + n - self.q, side="right") - np.searchsorted(places, starts)
        for k in np.argsort(-inside, kind="stable").tolist():
            nearer = min(e, found.get(self.ids[i], e + 1) - 1)
            if nearer < 0 or inside[k] < max(1, bound(n, nearer, self.q)):
                return
            a = int(starts[k])
            x, y = max(0, lo + a - e), min(len(text), hi + a + n + e)
            d = banded_distance(self.texts[i][a : a + n], text[x:y], nearer)
            if d is not None:
                found[self.ids[i]] = d


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = "long" if isinstance(benchmark.schema[id_col].dataType, T.IntegralType) else "string"
    return benchmark.select(F.col(id_col).cast(kind).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null")


def with_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", out_col: str = "leaks", id_col: str = "item_id", item_col: str = "text") -> DataFrame:
    """The rows with a column of leaked items and distances (``out_col`` must be a new name)."""
    if out_col in df.columns:
        raise ValueError(f"{out_col} is taken")
    items = _items(benchmark, id_col, item_col)
    kind = items.schema["item_id"].dataType
    leaks = T.ArrayType(T.StructType([T.StructField("item_id", kind), T.StructField("distance", T.IntegerType())]))
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, leaks)])
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // CHUNK))
    out = df
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()  # about CHUNK characters
        sent = df.sparkSession.sparkContext.broadcast(Index(sorted((r.item_id, r.text) for r in rows)))
        out = out.mapInArrow(functools.partial(_search, sent=sent, text_col=text_col, out_col=out_col, whole=isinstance(kind, T.LongType)), schema)
        if n > 1:
            out = durable(out)
            sent.destroy()
    return out


def _nearest(found: list[dict]) -> list[dict]:
    """One entry for each item, with its least distance, by id."""
    least: dict = {}
    for x in found:
        least[x["item_id"]] = min(x["distance"], least.get(x["item_id"], x["distance"]))
    return [{"item_id": i, "distance": d} for i, d in sorted(least.items())]


def _search(batches, sent, text_col: str, out_col: str, whole: bool):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("item_id", pa.int64() if whole else pa.string()), ("distance", pa.int32())]))
    for batch in batches:
        found = sent.value.leaks([t or "" for t in batch.column(text_col).to_pylist()])
        rows = [[{"item_id": i, "distance": d} for i, d in f] for f in found]
        names, columns = batch.schema.names, batch.columns
        if out_col in names:  # what earlier chunks found
            k = names.index(out_col)
            rows = [_nearest(a + b) for a, b in zip(columns[k].to_pylist(), rows, strict=True)]  # texts of one id may lie in several
            names, columns = names[:k], columns[:k]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], [*names, out_col])


def drop_leaked(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that leak nothing, with the same columns."""
    mark = "leaks"
    while mark in df.columns:
        mark += "_"
    return with_leaks(df, benchmark, text_col, mark).where(F.size(mark) == 0).drop(mark)
