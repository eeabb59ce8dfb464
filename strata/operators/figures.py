"""Drawings, curves and pixels: what shows, what bounds a curve, how two pages' ink compares.

Pixels are rows (page, x, y and a packed colour or a mark).  What looks at neighbours takes a page's pixels as two arrays, which is
what a page is bounded by, and works on them with numpy; no pixel's neighbours are shuffled.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators import graph

#: What the stroke alone, or the fill alone, says of a drawing.
OF_STROKE, OF_FILL = ("color", "stroke_opacity", "width", "dash", "dash_phase"), ("fill", "fill_opacity", "even_odd")
#: Steps to the eight neighbours of a pixel, and to the four that share a side with it.
EIGHT = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]
FOUR = [(dx, dy) for dx, dy in EIGHT if dx == 0 or dy == 0]


def visible_drawings(df: DataFrame, kind: str = "type") -> DataFrame:
    """Drawings that show (``kind``: f, s or fs), as what shows of them: a fill or stroke at opacity 0 and all that it alone says are left out; no opacity is 1."""
    shows = lambda which, c: F.col(kind).isin(which, "fs") & (F.coalesce(F.col(c), F.lit(1.0)) > 0)
    fill, stroke = shows("f", "fill_opacity"), shows("s", "stroke_opacity")
    shown = F.when(fill & stroke, "fs").when(fill, "f").when(stroke, "s")
    part = lambda c, gone: F.when(F.col("__shown") == F.col(kind), F.col(c)).when(F.col("__shown") != gone, F.col(c))
    cols = [F.col("__shown").alias(c) if c == kind else part(c, "f").alias(c) if c in OF_STROKE else part(c, "s").alias(c) if c in OF_FILL else F.col(c) for c in df.columns]
    return df.withColumn("__shown", shown).where("__shown is not null").select(*cols)


def _turns(p: list[Column]) -> list[Column]:
    """The values at a cubic curve's ends and where it turns on one axis (null where it doesn't)."""
    a, b, c = -p[0] + 3 * p[1] - 3 * p[2] + p[3], 2 * (p[0] - 2 * p[1] + p[2]), p[1] - p[0]
    tiny, disc = 1e-9, b * b - 4 * a * c
    straight = F.abs(a) < tiny
    roots = [F.when(straight, F.when(F.abs(b) > tiny, -c / b))]
    roots += [F.when(~straight & (disc >= 0), (-b + s * F.sqrt(F.greatest(disc, F.lit(0.0)))) / (2 * a)) for s in (1, -1)]
    at = lambda t: (1 - t) * (1 - t) * (1 - t) * p[0] + 3 * (1 - t) * (1 - t) * t * p[1] + 3 * (1 - t) * t * t * p[2] + t * t * t * p[3]
    return [p[0], p[3], *(F.when((t > 0) & (t < 1), at(t)) for t in roots)]


def curve_box(x: list[Column], y: list[Column]) -> Column:
    """The box of a cubic curve of four points: its ends and its turns on either axis."""
    across, down = _turns(x), _turns(y)
    return F.struct(F.least(*across).alias("x0"), F.least(*down).alias("y0"), F.greatest(*across).alias("x1"), F.greatest(*down).alias("y1"))


def page_ground(pixels: DataFrame, by: list[str], colour: str = "rgb") -> DataFrame:
    """The colour that each page mostly is (of equally frequent ones the smallest) and its share."""
    n = pixels.groupBy(*by, colour).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.max_by(colour, F.struct(F.col("n"), -F.col(colour))).alias("ground"), (F.max("n") / F.sum("n")).alias("share"))


def _by_page(mask: DataFrame, by: list[str], xs: str = "xs", ys: str = "ys") -> DataFrame:
    return mask.where("x is not null and y is not null").groupBy(*by).agg(F.collect_list(F.col("x").cast("long")).alias(xs), F.collect_list(F.col("y").cast("long")).alias(ys))


def _packed(x: np.ndarray, y: np.ndarray, frame: tuple[int, int, int]) -> np.ndarray:
    """Places as numbers in the order of y and then x, in a frame (least x, least y, width with a margin), so steps to neighbours never wrap."""
    return (y - frame[1]) * frame[2] + (x - frame[0])


def _frame(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    return (int(x.min()) - 1, int(y.min()) - 1, int(x.max()) - int(x.min()) + 3) if len(x) else (0, 0, 3)


def _has(cells: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are among sorted ``cells``, and where."""
    at = np.minimum(np.searchsorted(cells, wanted), max(len(cells) - 1, 0))
    return (cells[at] == wanted) if len(cells) else np.zeros(len(wanted), bool), at


def _arrays(f, kind: str, *columns: str) -> Column:
    """A column of lists: ``f`` of each page's arrays."""

    def run(*arrays: pa.Array) -> pa.Array:
        return pa.array([f(*(np.array(v or (), np.int64) for v in row)) for row in zip(*(a.to_pylist() for a in arrays), strict=True)])

    return F.arrow_udf(run, kind)(*columns)


CELL = "array<struct<x:long,y:long,label_x:long,label_y:long>>"


def text_mask(ink: DataFrame, by: list[str], least: int = 4) -> DataFrame:
    """Pixels of a mask with at least ``least`` set in the three by three around them, themselves included."""

    def kept(x, y):
        frame = _frame(x, y)
        cells = np.unique(_packed(x, y, frame))
        n = 1 + sum(_has(cells, cells + dy * frame[2] + dx)[0].astype(np.int64) for dx, dy in EIGHT)
        some = cells[n >= least]
        return [{"x": int(c % frame[2]) + frame[0], "y": int(c // frame[2]) + frame[1]} for c in some]

    cell = _arrays(kept, "array<struct<x:long,y:long>>", "xs", "ys")
    return _by_page(ink, by).select(*by, F.explode(cell).alias("p")).select(*by, "p.x", "p.y")


def ink_overlap(ref: DataFrame, got: DataFrame, by: list[str]) -> DataFrame:
    """How far each page's ink agrees on both sides: pixels of either that lie on the other's, grown by one to its four sides, of all pixels (1 where there are none on a page named by either)."""

    def share(ax, ay, bx, by_):
        frame = _frame(np.concatenate([ax, bx]), np.concatenate([ay, by_]))
        a, b = np.unique(_packed(ax, ay, frame)), np.unique(_packed(bx, by_, frame))
        on = lambda m, other: int(np.logical_or.reduce([_has(other, m + dy * frame[2] + dx)[0] for dx, dy in [(0, 0), *FOUR]]).sum())
        return (on(a, b) + on(b, a)) / (len(a) + len(b)) if len(a) + len(b) else 1.0

    pages = _by_page(ref, by, "ax", "ay").join(_by_page(got, by, "bx", "by_"), by, "full_outer")
    return pages.select(*by, _arrays(share, "double", "ax", "ay", "bx", "by_").alias("overlap"))


def labels(cells: DataFrame, page: str) -> DataFrame:
    """``page, x, y, label_x, label_y``: cells that touch, also at corners, are told by their first (by y, then x)."""

    def shapes(x, y):
        frame = _frame(x, y)
        at = np.unique(_packed(x, y, frame))
        pairs = [(np.flatnonzero(hit), where[hit]) for hit, where in (_has(at, at + dy * frame[2] + dx) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1)))]
        first = np.arange(len(at))
        nodes, to = graph.solve(*(np.concatenate(c) for c in zip(*pairs, strict=True)))
        first[nodes] = to
        place = lambda c: (int(c % frame[2]) + frame[0], int(c // frame[2]) + frame[1])
        return [dict(zip(("x", "y", "label_x", "label_y"), (*place(c), *place(at[f])), strict=True)) for c, f in zip(at, first, strict=True)]

    return _by_page(cells, [page]).select(page, F.explode(_arrays(shapes, CELL, "xs", "ys")).alias("p")).select(page, "p.*")


#: Sides of a cell in turn, from its upper left corner on: where the side begins, its step, and the cell beyond it.
SIDES = ((0, 0, 1, 0, 0, -1), (1, 0, 0, 1, 1, 0), (1, 1, -1, 0, 0, 1), (0, 1, 0, -1, -1, 0))


def _rings(cells: np.ndarray, width: int) -> list[list[tuple[int, int]]]:
    """Boundary rings of a mask (sorted packed cells), as corners in turn with the ink to the right.

    Every side without a cell beyond it is an edge; the edge behind it begins where it ends, and where two do, at cells that only touch
    at a corner, the one that stays at the same cell.
    """
    begins, turns = [], []
    for k, (x, y, _, _, bx, by) in enumerate(SIDES):
        edge = cells[~_has(cells, cells + by * width + bx)[0]]
        begins.append(edge + y * width + x)
        turns.append(np.full(len(edge), k))
    begin, turn = np.concatenate(begins), np.concatenate(turns)
    order = np.lexsort((turn, begin))
    begin, turn = begin[order], turn[order]
    step = np.array([dy * width + dx for _, _, dx, dy, _, _ in SIDES])
    end = begin + step[turn]
    lo, hi = np.searchsorted(begin, end), np.searchsorted(begin, end, side="right")
    after = lo.copy()
    two = np.flatnonzero(hi - lo == 2)
    after[two] += turn[lo[two]] != (turn[two] + 1) % 4
    rings, seen = [], np.zeros(len(begin), bool)
    for first in range(len(begin)):
        if seen[first]:
            continue
        ring, at = [], first
        while not seen[at]:
            seen[at] = True
            ring.append(at)
            at = int(after[at])
        corners = [k for k, prev in zip(ring, ring[-1:] + ring[:-1], strict=True) if turn[k] != turn[prev]]
        rings.append([(int(begin[k] % width), int(begin[k] // width)) for k in corners])
    return rings


def _farthest(p: np.ndarray, a: int, b: int, tol: float) -> list[int]:
    """The point between two that is farthest from the line through them, if by more than ``tol``; points are complex numbers."""
    off, way = p[a + 1 : b] - p[a], p[b] - p[a]
    far = np.abs((off * np.conj(way)).imag) / abs(way) if abs(way) > 1e-9 else np.abs(off)
    return [a + 1 + int(far.argmax())] if len(far) and far.max() > tol else []


def simplified(ring: list[tuple[float, float]], tol: float) -> list[tuple[float, float]]:
    """A ring's corners without those nearer than ``tol`` to the line between two that stay; a ring that would have fewer than three stays as it is.

    It begins with the first corner and the one farthest from it; in rounds every stretch is split at its farthest corner until none is too far.
    """
    p = np.array([complex(*c) for c in [*ring, ring[0]]])
    kept = sorted({0, int(np.abs(p - p[0]).argmax()), len(ring)})
    while more := [k for a, b in pairwise(kept) for k in _farthest(p, a, b, tol)]:
        kept = sorted([*kept, *more])
    return [ring[k] for k in kept[:-1]] if len(kept) > 3 else ring


RING = "array<struct<area:long,n_edges:long,points:array<struct<x:double,y:double>>>>"


def contours(cells: DataFrame, page: str, tol: float = 0.0) -> DataFrame:
    """``page, ring, area, n_edges, points``: the outlines of a page's ink along its cells' sides, each shape's outer one and, with a negative area, one for each hole.

    Shapes are cells that share sides.  ``points`` are the corners, simplified with ``tol``; area and the number of cell sides are those
    of the whole outline, so the areas of a page add up to its cells.
    """

    def traced(x, y):
        frame = _frame(x, y)
        out = []
        for ring in _rings(np.unique(_packed(x, y, frame)), frame[2]) if len(x) else []:
            p = np.asarray(ring, np.int64)
            q = np.roll(p, -1, axis=0)
            area = int((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()) // 2
            points = simplified([(float(a + frame[0]), float(b + frame[1])) for a, b in ring], tol) if tol else [(float(a + frame[0]), float(b + frame[1])) for a, b in ring]
            out.append({"area": area, "n_edges": int(np.abs(q - p).sum()), "points": [{"x": a, "y": b} for a, b in points]})
        return out

    return _by_page(cells, [page]).select(page, F.posexplode(_arrays(traced, RING, "xs", "ys")).alias("ring", "r")).select(page, F.col("ring").cast("long").alias("ring"), "r.*")


def uncovered(cells: DataFrame, rectangles: DataFrame, by: list[str], cell: float) -> DataFrame:
    """Ink cells (x, y) of a page that none of its rectangles holds, edges included; by cells of a grid."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    at = cells.select(*by, "x", "y").distinct().withColumn("__cx", F.floor(F.col("x") / cell)).withColumn("__cy", F.floor(F.col("y") / cell))
    boxes = rectangles.select(*by, "x0", "y0", "x1", "y1").withColumn("__cx", span("x0", "x1")).withColumn("__cy", span("y0", "y1"))
    met = [at[c] == boxes[c] for c in [*by, "__cx", "__cy"]]
    inside = [at["x"].between(boxes["x0"], boxes["x1"]), at["y"].between(boxes["y0"], boxes["y1"])]
    on = met[0]
    for m in [*met[1:], *inside]:
        on = on & m
    return at.join(boxes, on, "left_anti").select(*by, "x", "y")
