"""Line ends at boxes, fits without outliers, and the ledger of losses, against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from strata.operators import audit, diagrams
from strata.plans import figure_queries as fq


def fitted(x, y, tol, enough=0.9, trim=0.1):
    """With numpy, over all rows at once."""
    coef = np.linalg.lstsq(x, y, rcond=None)[0]
    err = np.abs(x @ coef - y).max(axis=1)
    share, again = (err <= tol).mean(), False
    if share < enough:
        keep = err <= np.quantile(err, 1 - trim)
        other = np.linalg.lstsq(x[keep], y[keep], rcond=None)[0]
        better = (np.abs(x @ other - y).max(axis=1) <= tol).mean()
        if better > share:
            coef, share, again = other, better, True
    said = x @ coef
    return coef, share, np.abs(said.max(axis=0) - said.min(axis=0)).max(), again


def check_fits(rows, got, x, y, tol):
    groups = defaultdict(list)
    for r in rows:
        groups[r["label"]].append(r)
    assert {r["label"] for r in got} == set(groups)
    refitted = 0
    for r in got:
        a = np.array([[v[c] for c in x] for v in groups[r["label"]]])
        b = np.array([[v[c] for c in y] for v in groups[r["label"]]])
        coef, share, span, again = fitted(a, b, tol)
        assert np.array(r["coef"]).T == pytest.approx(coef, abs=1e-6) and r["share"] == pytest.approx(share) and r["span"] == pytest.approx(span, abs=1e-6) and r["refitted"] == again
        refitted += again
    return refitted


def test_fits_equal_numpy(spark):
    rows = fq.coloured_pixels(spark, "/root/testdata/sf0.01")
    got = fq.a27_trimmed_fit(spark, "/root/testdata/sf0.01").collect()
    n = check_fits(rows.collect(), got, ["one", "px", "py"], ["c0", "c1", "c2"], 1.5)
    assert 0 < n


def test_fits_of_odd_groups(spark):
    r = random.Random(2)
    rows = [(1, 1.0, float(k), 3.0 * k + 1) for k in range(5)] + [(2, 1.0, 2.0, 7.0)] * 4 + [(3, 1.0, 5.0, 1.0)] + [(4, 1.0, r.random(), r.random() * 9) for _ in range(40)] + [(5, 1.0, None, 2.0)]
    df = spark.createDataFrame(rows, "label long, one double, px double, c0 double")
    got = diagrams.trimmed_fit(df, "label", ["one", "px"], ["c0"], 1.0).collect()
    check_fits([x.asDict() for x in df.where("px is not null").collect()], got, ["one", "px"], ["c0"], 1.0)
    assert diagrams.trimmed_fit(df.limit(0), "label", ["one", "px"], ["c0"], 1.0).count() == 0


def test_quantiles_equal_numpy(spark):
    r = random.Random(6)
    rows = [(g, round(r.random() * 9, r.choice([0, 3]))) for g in range(5) for _ in range(g * 37 + 1)]
    df = spark.createDataFrame(rows, "g long, v double")
    for q in (0.0, 0.37, 0.9, 1.0):
        got = {x.g: x.cut for x in diagrams.quantiles(df, "g", "v", q).collect()}
        assert got == pytest.approx({g: float(np.quantile([v for h, v in rows if h == g], q)) for g in range(5)})


def test_line_ends_at_random_boxes(spark):
    r = random.Random(9)
    nodes, lines = [], []
    for p in range(30):
        for k in range(r.randint(0, 6)):
            x, y = r.randrange(0, 90, 10), r.randrange(-20, 40, 10)
            nodes.append((p, k, float(x), float(y), float(x + r.choice([10, 40])), float(y + r.choice([0, 20]))))
        lines += [(p, k, *(float(r.randrange(-20, 110, 5)) for _ in range(4))) for k in range(6)]
    got = diagrams.edges(spark.createDataFrame(lines, "p long, line long, fx double, fy double, tx double, ty double"), spark.createDataFrame(nodes, "p long, node long, x0 double, y0 double, x1 double, y1 double"), ["p"], "line", "node", 12.0, 30.0)
    want = {}
    for p, k, *ends in lines:
        at = []
        for x, y in (ends[:2], ends[2:]):
            near = sorted((round(math.hypot(max(x0 - x, x - x1, 0), max(y0 - y, y - y1, 0)), 6), n, (x1 - x0) * (y1 - y0)) for q, n, x0, y0, x1, y1 in nodes if q == p)
            near = [(g, a if g == 0 else 0, n) for g, n, a in near if g <= 12]
            at.append((min(near)[2], min(near)[0] > 0 and sum(g == min(near)[0] for g, *_ in near) > 1) if near else (None, False))
        (s, a), (d, b) = at
        want[p, k] = (s, d, "open" if s is d is None else "dangling" if s is None or d is None else "tied" if a or b else "loop" if s == d else "edge")
    assert {(x.p, x.line): (x.src, x.dst, x.verdict) for x in got.collect()} == want
    assert {v[2] for v in want.values()} == {"open", "dangling", "tied", "loop", "edge"}


def test_losses_are_told_or_lost(spark):
    r = random.Random(12)
    make = lambda: [(d, r.choice(["word", "mark"]), r.choice("abcd")) for d in range(6) for _ in range(r.randint(0, 9))]
    base, before, after, told = make(), make(), make(), [(*x, r.randint(1, 2)) for x in make()[:20]]
    df = lambda rows, more="": spark.createDataFrame(rows, "doc long, kind string, unit string" + more)
    got = audit.untold_losses(df(base), df(before), df(after), df(told, ", n long"), ["doc"])
    b, t, a, said = Counter(base), Counter(before), Counter(after), Counter()
    for *x, n in told:
        said[tuple(x)] += n
    want = {}
    for u in t:
        own = max(t[u] - b[u], 0)
        gone = min(own, max(t[u] - a[u], 0))
        if gone > said[u]:
            want[u] = (own, gone, said[u], gone - said[u])
    assert {(x.doc, x.kind, x.unit): (x.own, x.gone, x.told, x.lost) for x in got.collect()} == want and want
    assert audit.untold_losses(df(before), df(before), df([]), df([], ", n long"), ["doc"]).count() == 0
