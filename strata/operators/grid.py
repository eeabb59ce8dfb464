"""Column grids: the pitch and phase of text whose glyphs stand in columns of one width, from how its tokens are spread.

Everything is windows over lines and aggregations: runs of glyphs one glue apart, the pitch that most of a page's runs agree on, and each
line's phase as a circular mean with its largest residual.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, of a glyph's size or of a pitch: the least and largest glue in a token, how far glues of one token differ, pitches that
# count, how near they agree, tokens that must, an empty column, how far a stretch may be off its line's phase, and stretches that prove a line.
TOUCH, WIDE, GLUE, EM, AGREE, TOKENS, SPACE, FIT, STRETCHES = 0.004, 0.45, 0.012, (0.4, 0.85), 0.012, 3, 0.8, 0.12, 5
FINE = 1_000_000_000  # logarithms of pitches as whole numbers, for windows of ranges


def tokens(glyphs: DataFrame, by: list[str], line: str, pos: str) -> DataFrame:
    """Glyphs (``x, advance, size``) with the ``token`` that each is in, numbered along its line: a new one begins where the gap before a glyph is no glue, or not the glue of the gap before it."""
    w = Window.partitionBy(*by, line).orderBy(pos)
    gap = F.col("x") - F.lag(F.col("x") + F.col("advance")).over(w)
    g = glyphs.withColumn("gap", gap).withColumn("before", F.lag("gap").over(w))
    glue = lambda c: F.coalesce(F.col(c).between(TOUCH * F.col("size"), WIDE * F.col("size")), F.lit(False))
    joins = glue("gap") & (~glue("before") | (F.abs(F.col("gap") - F.col("before")) <= GLUE * F.col("size")))
    return g.withColumn("joins", joins).withColumn("token", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("before")


def spread(marked: DataFrame, by: list[str], line: str) -> DataFrame:
    """Tokens of at least TOKENS glyphs: their ``glue`` (the median gap) and ``pitch`` (their box and a glue at either end, over their glyphs)."""
    inner = F.when(F.col("joins"), F.col("gap"))
    t = marked.groupBy(*by, line, "token").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("advance")).alias("x1"), F.median(inner).alias("glue"), F.max("size").alias("size")).where(F.col("n") >= TOKENS)
    return t.withColumn("pitch", (F.col("x1") - F.col("x0") + 2 * F.col("glue")) / F.col("n"))


def pitches(spread_tokens: DataFrame, by: list[str]) -> DataFrame:
    """``by, size, pitch``: of each page's tokens of a size, the pitch that most agree on within AGREE (the middle one of those, the smallest of equally large sets).

    TOKENS must, and with glues that differ: one glue everywhere is letter-spacing and no grid.
    """
    keyed = spread_tokens.where(F.col("pitch").between(EM[0] * F.col("size"), EM[1] * F.col("size"))).withColumn("size", F.round("size", 1)).withColumn("log", F.round(F.log("pitch") * FINE).cast("long"))
    near = Window.partitionBy(*by, "size").orderBy("log").rangeBetween(0, round(math.log1p(AGREE) * FINE))
    counted = keyed.withColumn("m", F.count("*").over(near)).withColumn("glues", F.max("glue").over(near) - F.min("glue").over(near))
    best = counted.groupBy(*by, "size").agg(F.min(F.struct(-F.col("m"), "pitch", "glues")).alias("b")).select(*by, "size", (-F.col("b.col1")).alias("m"), F.col("b.pitch").alias("least"), F.col("b.glues").alias("glues"))
    best = best.where((F.col("m") >= TOKENS) & (F.col("glues") > GLUE * F.col("size")))
    group = keyed.join(best, [*by, "size"]).where(F.col("pitch").between(F.col("least"), F.col("least") * (1 + AGREE)))
    rank = F.row_number().over(Window.partitionBy(*by, "size").orderBy("pitch"))
    return group.withColumn("rank", rank).where(F.col("rank") == F.floor(F.col("m") / 2) + 1).select(*by, "size", "pitch", F.col("m").alias("n_tokens"))


def column_grid(glyphs: DataFrame, by: list[str], line: str, pos: str) -> DataFrame:
    """``by, line, pitch, edge, n_stretches, worst, on_grid`` of every line of a size that its page has a pitch for.

    A line's stretches end at empty columns.  A stretch's phase, in columns, is read off the token it begins with, a lone glyph is
    centred in its column, others over theirs.  The line's phase is the circular mean, ``edge`` that in points, ``worst`` how far its
    worst stretch is off.  It is on the grid if none is off by more than FIT, and a token of the page's pitch or STRETCHES stretches
    prove it.
    """
    marked = tokens(glyphs, by, line, pos)
    wide = spread(marked, by, line)
    found = pitches(wide, by)
    w = Window.partitionBy(*by, line).orderBy(pos)
    on = marked.withColumn("key", F.round("size", 1)).join(found.withColumnRenamed("size", "key"), [*by, "key"])
    stretch = F.sum(F.when(F.coalesce(F.col("gap") >= SPACE * F.col("pitch"), F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    parts = on.withColumn("stretch", stretch).groupBy(*by, line, "stretch", "pitch").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("advance")).alias("x1"), F.min_by("token", pos).alias("token"))
    parts = parts.join(wide.select(*by, line, "token", "glue", F.col("pitch").alias("own")), [*by, line, "token"], "left")
    middle = (F.col("x0") + F.col("x1")) / 2
    start = F.when((F.col("n") > 1) & F.col("glue").isNotNull(), F.col("x0") - F.col("glue")).otherwise(middle - F.col("n") * F.col("pitch") / 2)
    turn: Column = F.pmod(start / F.col("pitch"), F.lit(1.0))
    parts = parts.withColumn("phase", turn)
    circle = 2 * F.pi()
    mean = parts.groupBy(*by, line).agg(F.pmod(F.atan2(F.sum(F.sin(circle * F.col("phase"))), F.sum(F.cos(circle * F.col("phase")))) / circle, F.lit(1.0)).alias("mean"), F.count("*").alias("n_stretches"), F.bool_or(F.coalesce(F.abs(F.col("own") - F.col("pitch")) <= AGREE * F.col("pitch"), F.lit(False))).alias("proved"))
    off = F.pmod(F.col("phase") - F.col("mean"), F.lit(1.0))
    told = parts.join(mean, [*by, line]).groupBy(*by, line, "pitch", "mean", "n_stretches", "proved").agg(F.max(F.least(off, 1 - off)).alias("worst"))
    good = (F.col("worst") <= FIT) & (F.col("proved") | (F.col("n_stretches") >= STRETCHES))
    return told.select(*by, line, "pitch", (F.col("mean") * F.col("pitch")).alias("edge"), "n_stretches", "worst", good.alias("on_grid"))
