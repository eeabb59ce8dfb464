"""Three-way merging of styled texts: words merge first, marks follow the words they are on.

A mark is an interval ``start, stop`` (code points, end exclusive) of one property's value on one side's text (``base``, ``ours``,
``theirs``).  Each side's marks are carried to the merged text along the stretches of words that the two share; there they are cut at
each other's ends, and on each cut piece every property is merged by itself.  What a mark was on may be gone: that is told.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import sequences
from strata.plans.lineage import durable

SIDES = ("base", "ours", "theirs")
BUCKET = 256
LINES = re.compile(r"[^\n]*\n|[^\n]+")


def _agree(lists: list[list[str]]) -> tuple[int, int]:
    """How many items all lists share at their heads, and then at their tails."""
    short = min(map(len, lists))
    head = next((k for k in range(short) if any(x[k] != lists[0][k] for x in lists)), short)
    tail = next((k for k in range(short - head) if any(x[-1 - k] != lists[0][-1 - k] for x in lists)), short - head)
    return head, tail


def shared_stretches(a: str, b: str) -> list[tuple[int, int, int]]:
    """Stretches (start, stop, at) of ``a`` that stand in ``b`` at ``at``, in whole words: what both begin and end with, and matching stretches between."""
    x, y = sequences.TOKENS.findall(a), sequences.TOKENS.findall(b)
    head, tail = _agree([x, y])
    x_at, y_at = ([0, *accumulate(map(len, tokens))] for tokens in (x, y))
    blocks = SequenceMatcher(None, x[head : len(x) - tail], y[head : len(y) - tail], autojunk=False).get_matching_blocks()
    found = [(0, 0, head), *((head + m.a, head + m.b, m.size) for m in blocks), (len(x) - tail, len(y) - tail, tail)]
    return [(x_at[i], x_at[i + n], y_at[j]) for i, j, n in found if n]


def merged_text(base: str, ours: str, theirs: str) -> tuple[str, int]:
    """A three-way merge and how many clashes it has; only what lies between the lines, or words of a single line, that all versions begin and end with is merged."""
    if ours == base:
        return theirs, 0
    if theirs == base:
        return ours, 0
    many = any("\n" in t for t in (base, ours, theirs))
    parts = [(LINES if many else sequences.TOKENS).findall(t) for t in (base, ours, theirs)]
    head, tail = _agree(parts)
    middle = ["".join(p[head : len(p) - tail]) for p in parts]
    merged, clashes = sequences.merge_paragraphs(*middle, False)
    return "".join(parts[0][:head]) + merged + "".join(parts[0][len(parts[0]) - tail :]), len(clashes)


MERGED = "merged string, clashes int, stretches array<struct<side:string,start:long,stop:long,at:long>>"


def merged_words(texts: DataFrame, key: str) -> DataFrame:
    """``key, merged, clashes, stretches`` of ``key, base, ours, theirs``; null texts are empty."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        piece = pa.list_(pa.struct([("side", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("at", pa.int64())]))
        for batch in batches:
            out, told, shared = [], [], []
            for row in zip(*(batch.column(s).to_pylist() for s in SIDES), strict=True):
                merged, clashes = merged_text(*row)
                out.append(merged)
                told.append(clashes)
                shared.append([{"side": s, "start": i, "stop": j, "at": k} for s, t in zip(SIDES, row, strict=True) for i, j, k in shared_stretches(t, merged)])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.string()), pa.array(told, pa.int32()), pa.array(shared, piece)], [key, *(c.split()[0] for c in MERGED.split(", ", 2))])

    return texts.select(key, *(F.coalesce(F.col(s), F.lit("")).alias(s) for s in SIDES)).mapInArrow(run, f"{key} {kind}, {MERGED}")


def carried(marks: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """Marks ``key, side, mark, prop, value, start, stop`` with the parts of them that the merged text has: ``at, to`` there and ``words``, whether such a part holds any; null where nothing is left."""
    part = merged.select(key, "merged", F.explode("stretches").alias("s")).select(key, "merged", F.col("s.side").alias("side"), F.col("s.start").alias("s_start"), F.col("s.stop").alias("s_stop"), F.col("s.at").alias("s_at"))
    over = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / BUCKET), F.floor((F.col(hi) - 1) / BUCKET)))
    m = marks.where("stop > start")
    met = m.withColumn("bucket", over("start", "stop")).join(part.withColumn("bucket", over("s_start", "s_stop")), [key, "side", "bucket"])
    lo, hi = F.greatest("start", "s_start"), F.least("stop", "s_stop")
    met = met.where((hi > lo) & (F.floor(lo / BUCKET) == F.col("bucket")))
    at = F.col("s_at") + lo - F.col("s_start")
    words = F.trim(F.substr("merged", (at + 1).cast("int"), (hi - lo).cast("int"))) != ""
    found = met.select(key, "side", "mark", at.alias("at"), (at + hi - lo).alias("to"), words.alias("words"))
    return m.join(found, [key, "side", "mark"], "left")


def lost(parts: DataFrame, key: str) -> DataFrame:
    """Marks of ours and theirs that no word of the merged text carries on, other than those that the base had on a side's same words."""
    return parts.groupBy(key, "side", "mark", "prop", "value", "start", "stop").agg(F.coalesce(F.bool_or("words"), F.lit(False)).alias("stands")).where("side <> 'base' and not stands").drop("stands")


def _pieces(parts: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """Pieces of merged texts between one end and the next, of marks of a property and of stretches: ``key, prop, n, at, to, words``."""
    props = parts.where("at is not null").select(key, "prop").distinct()
    ends = parts.where("at is not null").select(key, "prop", F.explode(F.array("at", "to")).alias("at"))
    shared = merged.select(key, F.explode("stretches").alias("s")).select(key, F.explode(F.array(F.col("s.at"), F.col("s.at") + F.col("s.stop") - F.col("s.start"))).alias("at"))
    cuts = ends.unionByName(shared.join(props, key).select(key, "prop", "at")).distinct()
    w = Window.partitionBy(key, "prop").orderBy("at")
    return cuts.withColumn("n", F.row_number().over(w)).withColumn("to", F.lead("at").over(w))


def merged_marks(parts: DataFrame, merged: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The merged text's marks ``key, prop, value, at, to``, and where both sides changed a piece differently: ``key, prop, at, to, base, ours, theirs``.

    On a piece that the live version (theirs) has, its value stands if the base lacks the piece or has another value there; else
    that of ours where ours has the piece.  A piece that only ours has takes ours.  Null is no mark.
    """
    pieces = durable(_pieces(parts, merged, key))
    at = lambda name, n: pieces.select(key, "prop", F.col("at").alias(name), F.col("n").alias(n))
    on = parts.where("at is not null").select(key, "side", "prop", "value", "at", "to").join(at("at", "n1"), [key, "prop", "at"]).join(at("to", "n2"), [key, "prop", "to"])
    on = on.select(key, "side", "prop", "value", F.explode(F.sequence("n1", F.col("n2") - 1)).alias("n"))
    stretch = merged.select(key, F.explode("stretches").alias("s")).select(key, F.col("s.side").alias("side"), F.col("s.at").alias("at"), (F.col("s.at") + F.col("s.stop") - F.col("s.start")).alias("to"))
    here = stretch.join(at("at", "n1"), [key, "at"]).join(at("to", "n2"), [key, "prop", "to"]).select(key, "side", "prop", F.explode(F.sequence("n1", F.col("n2") - 1)).alias("n"))
    rows = on.withColumn("has", F.lit(False)).unionByName(here.withColumn("value", F.lit(None).cast("string")).withColumn("has", F.lit(True)))
    side = lambda s: (F.max(F.when(F.col("side") == s, F.col("value"))).alias(s), F.coalesce(F.bool_or((F.col("side") == s) & F.col("has")), F.lit(False)).alias(f"has_{s}"))
    table = rows.groupBy(key, "prop", "n").agg(*(c for s in SIDES for c in side(s))).join(pieces.where("to is not null").select(key, "prop", "n", "at", "to"), [key, "prop", "n"])
    b, o, t = (F.col(s) for s in SIDES)
    three: Column = F.col("has_base") & F.col("has_ours") & F.col("has_theirs")
    value = F.when(~F.col("has_theirs"), F.when(F.col("has_ours"), o).otherwise(b)).when(three & t.eqNullSafe(b), o).otherwise(t)
    table = durable(table.withColumn("value", value).withColumn("clash", three & ~t.eqNullSafe(b) & ~o.eqNullSafe(b) & ~o.eqNullSafe(t)))
    w = Window.partitionBy(key, "prop").orderBy("at")
    begins = F.coalesce((F.lag("to").over(w) < F.col("at")) | ~F.lag("value").over(w).eqNullSafe(F.col("value")), F.lit(True))
    runs = table.where("value is not null").withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    told = table.where("clash").select(key, "prop", "at", "to", *SIDES)
    return runs.groupBy(key, "prop", "run").agg(F.first("value").alias("value"), F.min("at").alias("at"), F.max("to").alias("to")).drop("run"), told


def merge_styled(texts: DataFrame, marks: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Styled texts merged three ways.

    ``texts``: ``key`` (unique), ``base, ours, theirs``; ``marks``: ``key, side, mark`` (a number of its own on its side), ``prop,
    value, start, stop``; marks of one property and side don't overlap (of several values the largest counts); empty ones are
    nothing and null values no marks.  Returns the texts (``key, merged, clashes``), their marks (``key, prop, value, at, to``) and
    what is told: ``key, what, prop, at, to, base, ours, theirs``, where ``what`` is ``clash`` (theirs stands; places of the merged
    text) or ``lost_ours``, ``lost_theirs`` (a mark whose words are gone; places of its own text).
    """
    merged = durable(merged_words(texts, key))
    parts = durable(carried(marks.where("value is not null"), merged, key))
    final, clashes = merged_marks(parts, merged, key)
    none = F.lit(None).cast("string")
    gone = lost(parts, key)
    of = lambda s: F.when(F.col("side") == s, F.col("value")).alias(s)
    told = clashes.select(key, F.lit("clash").alias("what"), "prop", "at", "to", *SIDES).unionByName(gone.select(key, F.concat(F.lit("lost_"), "side").alias("what"), "prop", F.col("start").alias("at"), F.col("stop").alias("to"), none.alias("base"), of("ours"), of("theirs")))
    return merged.select(key, "merged", "clashes"), final, told
