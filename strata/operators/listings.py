"""Rows of dots, columns of line numbers, and pictures over the holes that were left for them."""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How wide a dot is (of the size), numbers of a column ending this near each other (points), how far a picture may be
# off its hole across (points) and down (lines of so many times the size), and up to how many are assigned at least cost.
DOT, ALIGNED, ACROSS, LINES, LINE, PICTURES, HOLES = 0.278, 1.0, 12.0, 1.0, 1.2, 6, 8


def leader_pitch(text: Column, x0: Column, x1: Column, size: Column, mono: Column) -> Column:
    """The distance between dots, in sizes, of a line that is nothing but four dots or more; null for any other line and for monospaced ones."""
    leader = F.trim(text).rlike(r"^\.(\s*\.){3,}$")
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    pitch = (x1 - x0 - DOT * size) / (dots - 1) / size
    return F.when(leader & ~F.coalesce(mono, F.lit(False)) & (size > 0) & (pitch > 0), F.round(pitch, 4))


def line_numbers(lines: DataFrame, page: str, key: str) -> DataFrame:
    """Lines that begin with a number, with the ``column`` that it stands in and whether that column numbers a listing: ``page, key, column, numbers_code``.

    ``lines``: ``first`` (the line's first word), its ``right`` edge, ``baseline``, ``size``, and ``code`` (whether code stands beside it).
    Columns are taken from the left: a number whose edge is more than ALIGNED right of a column's first begins the next.  A column
    numbers a listing if it has three numbers or more, of one size, that only grow downwards, and code beside half of them, two at least.
    """
    numbers = lines.where(F.trim("first").rlike(r"^\d{1,4}$")).select(page, key, F.trim("first").cast("int").alias("n"), F.col("right").cast("double").alias("right"), "baseline", F.round("size", 1).alias("size"), F.coalesce("code", F.lit(False)).alias("code"))
    row = F.struct("right", F.col(key).alias("key"))
    # the first edge of each row's column, going on from the row before
    edges = F.aggregate("rows", F.array().cast("array<double>"), lambda seen, r: F.concat(seen, F.array(F.when((F.size(seen) > 0) & (r.right - F.element_at(seen, -1) <= ALIGNED), F.element_at(seen, -1)).otherwise(r.right))))
    placed = numbers.groupBy(page).agg(F.array_sort(F.collect_list(row)).alias("rows")).withColumn("edges", edges)
    placed = placed.select(page, F.explode(F.arrays_zip("rows", "edges")).alias("z")).select(page, F.col("z.rows.key").alias(key), F.col("z.edges").alias("edge"))
    w = Window.partitionBy(page, "edge").orderBy("baseline", key)
    ranked = numbers.join(placed, [page, key]).withColumn("grows", F.coalesce(F.col("n") > F.lag("n").over(w), F.lit(True)))
    column = ranked.groupBy(page, "edge").agg((F.count("*") >= 3).alias("enough"), F.bool_and("grows").alias("grow"), (F.count_distinct("size") == 1).alias("one_size"), (F.count(F.when(F.col("code"), 1)) >= F.greatest(F.lit(2), F.count("*") / 2)).alias("beside"))
    good = column.select(page, "edge", (F.col("enough") & F.col("grow") & F.col("one_size") & F.col("beside")).alias("numbers_code"), F.row_number().over(Window.partitionBy(page).orderBy("edge")).cast("long").alias("column"))
    return ranked.select(page, key, "edge").join(good, [page, "edge"]).select(page, key, "column", "numbers_code")


def _assigned(pairs: list[dict]) -> list[dict]:
    """One hole for each picture: as many pairs as can be, and of those the cheapest; of many pictures or holes the cheapest pair first."""
    cost = {(p["picture"], p["hole"]): p["cost"] for p in pairs}
    pictures, holes = sorted({p for p, _ in cost}), sorted({h for _, h in cost})
    if len(pictures) <= PICTURES and len(holes) <= HOLES:
        few, many, turned = (pictures, holes, False) if len(pictures) <= len(holes) else (holes, pictures, True)
        best = None
        for chosen in permutations(many, len(few)):
            got = [(b, a) if turned else (a, b) for a, b in zip(few, chosen, strict=True)]
            got = sorted(x for x in got if x in cost)
            told = (-len(got), round(sum(cost[x] for x in got), 9), got)
            best = told if best is None or told < best else best
        found = best[2] if best else []
    else:
        found, taken = [], set()
        for _, p, h in sorted((c, p, h) for (p, h), c in cost.items()):
            if ("p", p) not in taken and ("h", h) not in taken:
                taken |= {("p", p), ("h", h)}
                found.append((p, h))
    return [{"picture": p, "hole": h, "cost": cost[p, h]} for p, h in found]


def over_holes(pictures: DataFrame, holes: DataFrame, page: str, picture: str, hole: str) -> DataFrame:
    """``page, picture, hole, cost``: pictures (``x0, y0, x1, y1``) with the hole each stands over (boxes and ``size``, that of the hole's line), one to one.

    A page's candidates, near enough on both axes, are joined by cells of a grid and assigned together.
    """
    centre = lambda lo, hi: (F.col(lo) + F.col(hi)) / 2
    cell = ACROSS * 2
    p = pictures.select(page, F.col(picture).alias("picture"), centre("x0", "x1").alias("px"), centre("y0", "y1").alias("py")).withColumn("cx", F.floor(F.col("px") / cell))
    h = holes.select(page, F.col(hole).alias("hole"), centre("x0", "x1").alias("hx"), centre("y0", "y1").alias("hy"), (LINES * LINE * F.col("size")).alias("down"))
    h = h.withColumn("cx", F.explode(F.sequence(F.floor((F.col("hx") - ACROSS) / cell), F.floor((F.col("hx") + ACROSS) / cell))))
    dx, dy = F.abs(F.col("px") - F.col("hx")), F.abs(F.col("py") - F.col("hy"))
    met = p.join(h, [page, "cx"]).where((dx <= ACROSS) & (dy <= F.col("down"))).select(page, F.struct(F.col("picture").cast("long").alias("picture"), F.col("hole").cast("long").alias("hole"), (dx + dy).alias("cost")).alias("pair"))

    def run(arrays: pa.Array) -> pa.Array:
        return pa.array([_assigned(x) for x in arrays.to_pylist()], pa.list_(pa.struct([("picture", pa.int64()), ("hole", pa.int64()), ("cost", pa.float64())])))

    got = met.groupBy(page).agg(F.collect_list("pair").alias("pairs")).select(page, F.explode(F.arrow_udf(run, "array<struct<picture:long,hole:long,cost:double>>")("pairs")).alias("x"))
    return got.select(page, F.col("x.picture").alias(picture), F.col("x.hole").alias(hole), "x.cost")
