"""Rectangles as struct columns of x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def width(r: Column) -> Column:
    return r.x1 - r.x0


def height(r: Column) -> Column:
    return r.y1 - r.y0


def area(r: Column) -> Column:
    return F.greatest(width(r), F.lit(0.0)) * F.greatest(height(r), F.lit(0.0))


def intersects(a: Column, b: Column) -> Column:
    """Strictly: rectangles that only touch don't."""
    return (a.x0 < b.x1) & (b.x0 < a.x1) & (a.y0 < b.y1) & (b.y0 < a.y1)


def overlap(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.lit(0.0))
    return w * F.greatest(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def centre_distance(a: Column, b: Column) -> Column:
    return F.hypot((a.x0 + a.x1 - b.x0 - b.x1) / 2, (a.y0 + a.y1 - b.y0 - b.y1) / 2)


def likeness(a: Column, b: Column, reach: float = 60.0) -> Column:
    """Overlap or nearness, whichever says more."""
    return F.greatest(iou(a, b), 1 - centre_distance(a, b) / reach, F.lit(0.0))


def union(r: Column) -> Column:
    """Aggregate: the bounding box of a group."""
    return F.struct(F.min(r.x0).alias("x0"), F.min(r.y0).alias("y0"), F.max(r.x1).alias("x1"), F.max(r.y1).alias("y1"))


def compose(p: Column, c: Column) -> Column:
    """Six-number transforms (a, b, c, d, e, f) as struct columns: first ``c``, then ``p``."""
    return F.struct(
        (p.a * c.a + p.c * c.b).alias("a"), (p.b * c.a + p.d * c.b).alias("b"), (p.a * c.c + p.c * c.d).alias("c"),
        (p.b * c.c + p.d * c.d).alias("d"), (p.a * c.e + p.c * c.f + p.e).alias("e"), (p.b * c.e + p.d * c.f + p.f).alias("f"),
    )


def transformed_box(m: Column, w: Column, h: Column) -> Column:
    """The box of a w by h rectangle at the origin under a transform."""
    xs = [m.e, m.e + m.a * w, m.e + m.c * h, m.e + m.a * w + m.c * h]
    ys = [m.f, m.f + m.b * w, m.f + m.d * h, m.f + m.b * w + m.d * h]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def colour_distance(a: Column, b: Column) -> Column:
    """Summed channel difference of two ``#rrggbb`` colours."""
    channel = lambda c, k: F.conv(F.substring(c, 2 + 2 * k, 2), 16, 10).cast("long")
    return sum((F.abs(channel(a, k) - channel(b, k)) for k in range(1, 3)), F.abs(channel(a, 0) - channel(b, 0)))


def winding(px: Column, py: Column, polygon: Column) -> Column:
    """Even-odd rule: whether a point lies in a polygon, an array of structs x, y."""
    n = F.size(polygon)
    crossing = lambda i: (lambda p, q: ((p.y > py) != (q.y > py)) & (px < (q.x - p.x) * (py - p.y) / (q.y - p.y) + p.x))(polygon[i], polygon[(i + 1) % n])
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), lambda inside, i: F.when(crossing(i), ~inside).otherwise(inside))


def placement(x: Column, y: Column) -> tuple[Column, Column]:
    """Aggregate: scale and shift of the least-squares line y = scale * x + shift."""
    return F.regr_slope(y, x), F.regr_intercept(y, x)


def common_shift(dx: Column, tolerance: float = 0.05) -> Column:
    """Aggregate: the shift that all members share within a tolerance, else null."""
    return F.when(F.max(dx) - F.min(dx) <= tolerance, F.avg(dx))


def circular_mean(phase: Column, period: float) -> Column:
    """Aggregate: mean of values on a circle of the given length."""
    turn = 2 * 3.141592653589793 / period
    return F.pmod(F.atan2(F.avg(F.sin(phase * turn)), F.avg(F.cos(phase * turn))) / turn, F.lit(period))


def off_page(r: Column, w: Column, h: Column) -> Column:
    """Whether a box lies wholly outside a page of w by h."""
    return (r.x1 <= 0) | (r.y1 <= 0) | (r.x0 >= w) | (r.y0 >= h)


def is_band(r: Column, w: Column, h: Column, share: float = 0.12) -> Column:
    """Whether a box is a band of decoration: nearly the page's width, low, and at its top or foot."""
    return (width(r) >= 0.95 * w) & (height(r) <= share * h) & ((r.y0 <= 0.02 * h) | (r.y1 >= 0.98 * h))


def turned(x: Column, y: Column, px: Column, py: Column, degrees: Column) -> Column:
    """A point turned about a pivot."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.struct((px + (x - px) * c - (y - py) * s).alias("x"), (py + (x - px) * s + (y - py) * c).alias("y"))
