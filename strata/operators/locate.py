"""Where the words of an element stand in the text of its page, and which frame a page shows.

A page meets its elements once, as texts, and words are made where both are: words that both the element and the page have once are
anchors; of those the longest run in order stands; anchors grow over equal neighbours; and where as many words lie between two on both
sides, they are held against each other one by one.  No word is dealt out, and nothing compares an element with the whole page.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions import sequences
from strata.operators import resolve

# How characters of a word are written before words are compared, and how alike two that differ must be.
PLAIN = {"“": '"', "”": '"', "‘": "'", "’": "'", "ﬁ": "fi", "ﬂ": "fl", "…": "...", "−": "-"}
ALIKE = 0.75
WORD = re.compile(r"\S+")
AT_ONCE = 50_000  # words that a task holds and sends on together
SLICE = 1 << 20  # characters of a page's elements that meet it together


PLACED = [("n", pa.int64()), ("word", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]
FOUND = {"n": T.LongType(), "lo": T.LongType(), "hi": T.LongType(), "how": T.StringType()}
_TABLE = str.maketrans(PLAIN)


def _norm(word: str) -> str:
    return word if word.isascii() else unicodedata.normalize("NFC", word.translate(_TABLE))


class _Known(dict):
    """Words as they are written in texts, and as they are compared; each is normalised once."""

    def __missing__(self, word: str) -> str:
        self[word] = made = _norm(word)
        return made


def word_batches(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """``by, n, word, start, stop``: a row for each word of the texts (``by, __text``), normalised, with its place; ``AT_ONCE`` rows at most are held, however long a text is."""

    def made(batch: pa.RecordBatch, owner: list[int], found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, (_, k) in zip(zip(*found, strict=True), PLACED, strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(owner, pa.int64())) for c in by), *columns], [*by, *(c for c, _ in PLACED)])

    for batch in batches:
        owner, found = [], []
        for i, t in enumerate(batch.column("__text")):
            for n, m in enumerate(WORD.finditer(t.as_py() or "")):
                owner.append(i)
                found.append((n, _norm(m[0]), m.start(), m.end()))
                if len(found) == AT_ONCE:
                    yield made(batch, owner, found)
                    owner, found = [], []
        if found:
            yield made(batch, owner, found)


def _listed(text: str | None, known: _Known) -> list[str]:
    return [known[m[0]] for m in WORD.finditer(text or "")]


def _once(words: list[str]) -> dict[str, int]:
    """The numbers of the words that stand once."""
    count = Counter(words)
    return {w: n for n, w in enumerate(words) if count[w] == 1}


def _spans(text: str) -> np.ndarray:
    """Where each word of a text starts and stops."""
    out = array("q")
    for m in WORD.finditer(text):
        out.extend(m.span())
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def _alike(a: str, b: str) -> bool:
    m = SequenceMatcher(None, a.casefold(), b.casefold())
    return m.real_quick_ratio() >= ALIKE and m.quick_ratio() >= ALIKE and m.ratio() >= ALIKE


def placed(a: list[str], b: list[str], once: dict[str, int]) -> tuple[array, set[int]]:
    """For each word of ``a`` its place in ``b`` or -1, and which of them are not equal but alike; ``once`` has what stands once in ``b``."""
    count = Counter(a)
    met = [(n, once[w]) for n, w in enumerate(a) if count[w] == 1 and w in once]
    sure = [met[k] for k in sequences.longest_increasing([v for _, v in met])]
    at, alike = array("q", [-1]) * len(a), set()
    before, reached = -1, -1  # the anchor before, and how far words are found on from it
    for k, (n, v) in enumerate(sure):
        # growing from the left comes first; what grows from the right ends where that did
        i, j = n - 1, v - 1
        while i > before and j > reached and at[i] < 0 and a[i] == b[j]:
            at[i], i, j = j, i - 1, j - 1
        stop, most = sure[k + 1] if k + 1 < len(sure) else (len(a), len(b))
        i, j = n, v
        while i < stop and j < len(b) and j <= most and a[i] == b[j]:
            at[i], i, j = j, i + 1, j + 1
        before, reached = n, j - 1
    # between two that are found, as many words on both sides: one by one
    last = None
    for n, v in enumerate(at):
        if v >= 0:
            if last is not None and 1 < n - last == v - at[last]:
                for i in range(last + 1, n):
                    if _alike(a[i], b[v - n + i]):
                        at[i] = v - n + i
                        alike.add(i)
            last = n
    return at, alike


def place_batches(batches: Iterable[pa.RecordBatch], by: str, key: str) -> Iterator[pa.RecordBatch]:
    """``by, key, n, lo, hi, how`` of pages with some of their elements (``by, __elements, __page``); rows leave ``AT_ONCE`` at a time."""
    told = pa.array(["exact", "alike"])

    def made(owners: dict[str, pa.Array], parts: list[tuple]) -> pa.RecordBatch:
        owner, n, lo, hi, how = (np.concatenate(c) for c in zip(*parts, strict=True))
        columns = [pa.array(n), pa.array(lo, mask=how < 0), pa.array(hi, mask=how < 0), told.take(pa.array(how, mask=how < 0))]
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(owner)) for c in owners.values()), *columns], [*owners, *FOUND])

    page = None
    for batch in batches:
        held, pages = batch.column("__elements"), batch.column("__page")
        each, of = held.flatten(), np.repeat(np.arange(len(held)), held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        owners, texts = {by: batch.column(by).take(pa.array(of)), key: each.field("__key")}, each.field("__text")
        parts, size, row = [], 0, None
        for k, i in enumerate(of):
            if i != row:
                row, text = i, pages[i].as_py() or ""
                if text != page:
                    page, known = text, _Known()
                    words, spans = _listed(text, known), _spans(text)
                    once = _once(words)
            mine = _listed(texts[k].as_py(), known)
            at, alike = placed(mine, words, once)
            for n in range(0, len(mine), AT_ONCE):
                v = np.frombuffer(at, np.int64)[n : n + AT_ONCE]
                how = np.where(v < 0, -1, 0)
                how[[x - n for x in alike if n <= x < n + len(v)]] = 1
                place = spans[v] if len(spans) else np.zeros((len(v), 2), np.int64)
                parts.append((np.full(len(v), k), np.arange(n, n + len(v)), place[:, 0], place[:, 1], how))
                size += len(v)
                if size >= AT_ONCE:
                    yield made(owners, parts)
                    parts, size = [], 0
        if parts:
            yield made(owners, parts)


def located(elements: DataFrame, pages: DataFrame, by: str, key: str, text: str = "text") -> DataFrame:
    """``by, key, n, lo, hi, how``: for the n-th word of each element (``by, key, text``; keys unique on a page) the place of it in the page's text (``by, text``), ``exact``, ``alike`` or null.

    Both are dealt by page; of a page's elements ``SLICE`` characters or so meet it at a time, so a row stays small however many there are.
    """
    chosen = elements.select(by, F.col(key).alias("__key"), F.col(text).alias("__text"))
    earlier = Window.partitionBy(by).orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    sliced = chosen.withColumn("__slice", F.floor(F.coalesce(F.sum(F.length("__text")).over(earlier), F.lit(0)) / SLICE))
    rows = sliced.groupBy(by, "__slice").agg(F.collect_list(F.struct("__key", "__text")).alias("__elements"))
    # pages without elements are let go of later: a left join would ask pages alone for keys, and what both sides are made of would be dealt twice
    met = rows.join(pages.select(by, F.col(text).alias("__page")), by, "full").select(by, "__elements", "__page")
    schema = T.StructType([chosen.schema[by], T.StructField(key, chosen.schema["__key"].dataType), *(T.StructField(c, k) for c, k in FOUND.items())])
    return met.mapInArrow(lambda it: place_batches(it, by, key), schema)


def blocks(found: DataFrame, by: str, key: str) -> DataFrame:
    """``by, key, lo, hi, score``: the stretch of the page over an element's located words; an alike word counts half."""
    worth = F.sum(F.when(F.col("how") == "exact", 1.0).when(F.col("how") == "alike", 0.5).otherwise(0.0))
    return found.groupBy(by, key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (worth / F.count("*")).alias("score"))


def voted_frames(votes: DataFrame, frames: DataFrame, pages: DataFrame, by: str, file: str = "file", bucket: int = 64) -> DataFrame:
    """``by, page, frame, votes``: the frame that most of a page's votes (``by, page, file, line, n``) fall into.

    ``frames``: ``by, frame`` (numbered from 0), ``file, first, last`` (lines, both in it); where frames nest the later one counts.
    Of equal votes the smaller number.  Where no page of a document has votes that count, pages (``by, page, label``) take frames in
    turn, one for each run of equal labels; other pages without votes have none.
    """
    spans = frames.withColumn("stop", F.col("last") + 1)
    keyed = votes.select(by, "page", file, F.col("line"), "n").groupBy(by, "page", file, "line").agg(F.sum("n").alias("n"))
    met = resolve.interval_join(keyed, "line", spans.select(by, file, "frame", "first", "stop"), "first", "stop", [by, file], float(bucket))
    inner = met.groupBy(by, "page", file, "line", "n").agg(F.max("frame").alias("frame"))
    tally = inner.groupBy(by, "page", "frame").agg(F.sum("n").alias("votes"))
    best = tally.groupBy(by, "page").agg(F.max(F.struct(F.col("votes"), -F.col("frame"))).alias("b")).select(by, "page", (-F.col("b.col2")).alias("frame"), "b.votes")
    turn = Window.partitionBy(by).orderBy("page")
    changes = F.when(F.lag("label").over(turn).eqNullSafe(F.col("label")) & (F.row_number().over(turn) > 1), 0).otherwise(1)
    counted = pages.withColumn("new", changes).withColumn("guess", F.sum("new").over(turn.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    told = counted.join(best, [by, "page"], "left").join(best.select(by, F.lit(True).alias("any")).distinct(), by, "left")
    silent = told.join(frames.select(by, F.col("frame").alias("guess"), F.lit(True).alias("there")), [by, "guess"], "left")
    frame = F.when(F.col("any"), F.col("frame")).when(F.col("there"), F.col("guess"))
    return silent.select(by, "page", frame.cast("long").alias("frame"), F.coalesce("votes", F.lit(0)).alias("votes"))
