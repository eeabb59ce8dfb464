"""Line numbers and pictures over holes, with loops."""

import itertools
import random
from collections import defaultdict

import pytest

from strata.operators import listings as ls
from strata.plans import layout_queries as lq


def columns(rows):
    """{(page, line): (column, numbers code)}."""
    out, pages = {}, defaultdict(list)
    for r in rows:
        if (r["first"] or "").strip().isdigit() and len(r["first"].strip()) <= 4:
            pages[r["page"]].append(r)
    for page, own in pages.items():
        found = []
        for r in sorted(own, key=lambda r: (r["right"], r["line"])):
            if found and r["right"] - found[-1][0]["right"] <= 1.0:
                found[-1].append(r)
            else:
                found.append([r])
        for k, col in enumerate(found, 1):
            col.sort(key=lambda r: (r["baseline"], r["line"]))
            n = [int(r["first"]) for r in col]
            good = len(col) >= 3 and all(a < b for a, b in zip(n, n[1:], strict=False)) and len({round(r["size"], 1) for r in col}) == 1 and sum(bool(r["code"]) for r in col) >= max(2, len(col) / 2)
            out |= {(page, r["line"]): (k, good) for r in col}
    return out


def test_number_columns_are_taken_from_the_left(spark):
    r = random.Random(4)
    rows = [(p, p * 100 + k, r.choice(["1", " 22", "333", "4444", "55555", "x", None]) if r.random() < 0.3 else str(k + 1), r.choice([10.0, 10.6, 11.0, 11.2, 12.1, 40.0]), float(k), r.choice([9.0, 9.0, 9.0, 8.0]) if p % 3 == 0 else 9.0, r.choice([True, True, False, None])) for p in range(30) for k in range(r.randint(1, 9))]
    df = spark.createDataFrame(rows, "page long, line long, first string, right double, baseline double, size double, code boolean")
    got = {(x.page, x.line): (x.column, x.numbers_code) for x in ls.line_numbers(df, "page", "line").collect()}
    assert got == columns([x.asDict() for x in df.collect()]) and {v[1] for v in got.values()} == {True, False}
    assert ls.line_numbers(df.limit(0), "page", "line").count() == 0


def assigned(pictures, holes):
    """Every way to pair, as many pairs and then as cheap as can be."""
    cost = {}
    for p, h in itertools.product(pictures, holes):
        dx, dy = (abs((p[a] + p[b] - h[a] - h[b]) / 2) for a, b in (("x0", "x1"), ("y0", "y1")))
        if dx <= 12 and dy <= 1.2 * h["size"]:
            cost[p["picture"], h["hole"]] = dx + dy
    best = (0, 0.0)
    todo = [([], sorted(cost))]
    while todo:
        chosen, rest = todo.pop()
        best = min(best, (-len(chosen), round(sum(cost[c] for c in chosen), 6)))
        for k, (p, h) in enumerate(rest):
            todo.append((chosen + [(p, h)], [x for x in rest[k + 1 :] if x[0] != p and x[1] != h]))
    return cost, best


def test_pictures_are_assigned_at_least_cost(spark):
    r = random.Random(6)
    box = lambda n: [(p, k, x := r.uniform(0, 50), y := r.uniform(0, 20), x + 5, y + 5) for p in range(40) for k in range(r.randint(0, n))]
    pics = spark.createDataFrame(box(4), "page long, picture long, x0 double, y0 double, x1 double, y1 double")
    holes = spark.createDataFrame([(*b, 10.0) for b in box(5)], "page long, hole long, x0 double, y0 double, x1 double, y1 double, size double")
    got = defaultdict(list)
    for x in ls.over_holes(pics, holes, "page", "picture", "hole").collect():
        got[x.page].append(x)
    p, h = defaultdict(list), defaultdict(list)
    for rows, out in ((pics, p), (holes, h)):
        for x in rows.collect():
            out[x.page].append(x)
    for page in p:
        cost, best = assigned(p[page], h[page])
        mine = got[page]
        assert len({x.picture for x in mine}) == len({x.hole for x in mine}) == len(mine)
        assert all(x.cost == pytest.approx(cost[x.picture, x.hole]) for x in mine)
        assert (-len(mine), round(sum(x.cost for x in mine), 6)) == best


def test_many_pictures_take_the_cheapest_first(spark):
    pics, holes = lq.measured_pictures(spark, "/root/testdata/sf0.001")
    many = pics.where("page < 20").selectExpr("0L as page", "page * 1000 + picture as picture", "x0 + page * 3 as x0", "y0", "x1 + page * 3 as x1", "y1")
    there = holes.where("page < 20").selectExpr("0L as page", "page * 1000 + hole as hole", "x0 + page * 3 as x0", "y0", "x1 + page * 3 as x1", "y1", "size")
    cost, _ = assigned([], [])
    p, h = many.collect(), there.collect()
    for a, b in itertools.product(p, h):
        dx, dy = abs((a.x0 + a.x1 - b.x0 - b.x1) / 2), abs((a.y0 + a.y1 - b.y0 - b.y1) / 2)
        if dx <= 12 and dy <= 12:
            cost[a.picture, b.hole] = dx + dy
    want, used = set(), set()
    for _, a, b in sorted((c, a, b) for (a, b), c in cost.items()):
        if ("p", a) not in used and ("h", b) not in used:
            used |= {("p", a), ("h", b)}
            want.add((a, b))
    assert {(x.picture, x.hole) for x in ls.over_holes(many, there, "page", "picture", "hole").collect()} == want and len(want) > 20


def test_query_pages(spark):
    pics, holes = (df.collect() for df in lq.measured_pictures(spark, "/root/testdata/sf0.001"))
    got = defaultdict(list)
    for x in lq.j32_over_holes(spark, "/root/testdata/sf0.001").collect():
        got[x.page].append(x)
    for page in {x.page for x in pics}:
        p, h = [x for x in pics if x.page == page], [x for x in holes if x.page == page]
        if len(p) <= 6 and len(h) <= 8:
            assert (-len(got[page]), round(sum(x.cost for x in got[page]), 6)) == assigned(p, h)[1]
