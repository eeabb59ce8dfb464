"""Diagrams from drawings: which boxes the ends of lines stand at, and least-squares fits that leave outliers out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.resolve import numbered
from strata.plans.lineage import durable


def nearest_nodes(points: DataFrame, nodes: DataFrame, by: list[str], point: list[str], node: str, reach: float, cell: float) -> DataFrame:
    """``by, point, node, gap, tied``: the box nearest to each point (``x, y``) within ``reach`` of it, by cells of a grid.

    Nodes lie in all cells that they come within ``reach`` of, so a point looks in its own only.  The gap is 0 inside a box; of boxes
    around a point the smallest counts (so of one in another the inner), then the smaller key.  ``tied``: the point is in no box, and
    another is as near.  A point without a box in reach has none.
    """
    span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - reach) / cell), F.floor((F.col(hi) + reach) / cell)))
    n = nodes.select(*by, F.col(node).alias("__node"), "x0", "y0", "x1", "y1").withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
    p = points.select(*by, *point, "x", "y").withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    off = lambda at, lo, hi: F.greatest(F.col(lo) - F.col(at), F.col(at) - F.col(hi), F.lit(0.0))
    met = p.join(n, [*by, "cx", "cy"]).withColumn("gap", F.round(F.hypot(off("x", "x0", "x1"), off("y", "y0", "y1")), 6)).where(F.col("gap") <= reach)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    best = met.groupBy(*by, *point).agg(F.min(F.struct(F.col("gap"), F.when(F.col("gap") == 0, area).otherwise(0.0).alias("area"), F.col("__node").alias("node"))).alias("b"), F.min("gap").alias("gap"))
    same = met.join(best.select(*by, *point, F.col("gap").alias("least")), [*by, *point]).where((F.col("gap") == F.col("least")) & (F.col("gap") > 0)).groupBy(*by, *point).agg((F.count("*") > 1).alias("tied"))
    return best.join(same, [*by, *point], "left").select(*by, *point, F.col("b.node").alias(node), "gap", F.coalesce("tied", F.lit(False)).alias("tied"))


def edges(lines: DataFrame, nodes: DataFrame, by: list[str], line: str, node: str, reach: float, cell: float) -> DataFrame:
    """``by, line, src, dst, verdict`` of lines (``fx, fy, tx, ty``): ``edge``, or why it is none.

    ``open``: no end stands at a node; ``dangling``: one does; ``tied``: an end is as near to another node; ``loop``: both ends stand at
    one node, which a line inside it does as well.  ``src`` and ``dst`` are told wherever an end has its node.
    """
    an_end = lambda end, x, y: F.struct(F.lit(end).alias("end"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ends = lines.select(*by, line, F.explode(F.array(an_end("src", "fx", "fy"), an_end("dst", "tx", "ty"))).alias("e")).select(*by, line, "e.*")
    at = nearest_nodes(ends, nodes, by, [line, "end"], node, reach, cell)
    pick = lambda end, c: F.max(F.when(F.col("end") == end, F.col(c)))
    both = at.groupBy(*by, line).agg(pick("src", node).alias("src"), pick("dst", node).alias("dst"), F.bool_or("tied").alias("tied"))
    out = lines.select(*by, line).join(both, [*by, line], "left")
    src, dst = F.col("src"), F.col("dst")
    verdict = F.when(src.isNull() & dst.isNull(), "open").when(src.isNull() | dst.isNull(), "dangling").when(F.col("tied"), "tied").when(src == dst, "loop").otherwise("edge")
    return out.select(*by, line, "src", "dst", verdict.alias("verdict"))


# ---------------------------------------------------------------- fits

def _solved(p: int, q: int):
    """Coefficients, q lists of p, from the upper half of X'X row by row and then X'Y."""

    def run(arrays: pa.Array) -> pa.Array:
        out = []
        rows, cols = np.triu_indices(p)
        for sums in arrays.to_pylist():
            both = np.zeros((p, p))
            both[rows, cols] = both[cols, rows] = sums[: len(rows)]
            out.append(np.linalg.lstsq(both, np.reshape(sums[len(rows) :], (p, q)), rcond=None)[0].T.tolist())
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    return F.arrow_udf(run, "array<array<double>>")


def least_squares(rows: DataFrame, by: str, x: list[str], y: list[str]) -> DataFrame:
    """``by, coef`` (a list for each of ``y``) of each group: sums of products, added up where the rows are, and one small solve a group."""
    p = len(x)
    products = [F.sum(F.col(x[i]) * F.col(x[j])) for i in range(p) for j in range(i, p)] + [F.sum(F.col(a) * F.col(b)) for a in x for b in y]
    return rows.groupBy(by).agg(F.array(*products).alias("sums")).select(by, _solved(p, len(y))("sums").alias("coef"))


def _missed(rows: DataFrame, coef: DataFrame, by: str, x: list[str], y: list[str]) -> DataFrame:
    """Rows with what the fit says of each target (``said``) and the largest miss (``err``)."""
    one = lambda k: sum((F.col("coef")[k][i] * F.col(c) for i, c in enumerate(x)), F.lit(0.0))
    said = F.array(*(one(k) for k in range(len(y))))
    return rows.join(coef, by).withColumn("said", said).withColumn("err", F.greatest(*(F.abs(F.col("said")[k] - F.col(c)) for k, c in enumerate(y)), F.lit(0.0)))


def quantiles(rows: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """``by, cut``: each group's q-quantile, exactly and between neighbours in proportion, by ranks; no group is held in one task."""
    ranked = numbered(rows.select(by, value), [by], [value], "rank")
    n = rows.groupBy(by).agg(F.count("*").alias("n")).withColumn("spot", (F.col("n") - 1) * F.lit(q))
    wanted = n.select(by, "spot", F.explode(F.array_distinct(F.array(F.floor("spot") + 1, F.ceil("spot") + 1))).alias("rank"))
    met = ranked.join(wanted, [by, "rank"]).groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.first("spot").alias("spot"))
    return met.select(by, (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("spot") - F.floor("spot"))).alias("cut"))


def trimmed_fit(rows: DataFrame, by: str, x: list[str], y: list[str], tol: float, enough: float = 0.9, trim: float = 0.1) -> DataFrame:
    """A fit of several targets on several variables for each group: ``by, coef, share, span, refitted``.

    ``share``: how many of all rows the fit misses by at most ``tol`` in every target.  Where that is under ``enough``, the ``trim``
    worst rows are left out and the rest fitted anew; that fit counts if its share, of all rows again, is larger.  ``span``: by how
    much the fit itself ranges, over its targets.  A null in a row leaves the row out; a group without rows has none.
    """
    rows = rows.select(by, *x, *y).dropna()
    first = durable(least_squares(rows, by, x, y))
    k = len(y)

    def scored(coef: DataFrame) -> DataFrame:
        ranges = [F.max(F.col("said")[i]) - F.min(F.col("said")[i]) for i in range(k)]
        told = _missed(rows, coef, by, x, y).groupBy(by).agg(F.avg((F.col("err") <= tol).cast("double")).alias("share"), F.greatest(*ranges, F.lit(0.0)).alias("span"))
        return coef.join(told, by)

    plain = durable(scored(first))
    poor = durable(_missed(rows, plain.where(F.col("share") < enough).select(by, "coef"), by, x, y).drop("coef", "said"))
    kept = poor.join(quantiles(poor, by, "err", 1 - trim), by).where(F.col("err") <= F.col("cut"))
    again = scored(durable(least_squares(kept, by, x, y))).select(by, F.col("coef").alias("coef2"), F.col("share").alias("share2"), F.col("span").alias("span2"))
    out = plain.join(again, by, "left").withColumn("refitted", F.coalesce(F.col("share2") > F.col("share"), F.lit(False)))
    pick: dict[str, Column] = {c: F.when(F.col("refitted"), F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in ("coef", "share", "span")}
    return out.select(by, *pick.values(), "refitted")
