"""Pictures of one signature, all against all."""

import random

from strata.operators import pictures as pic


def alike(a, b):
    (wa, ha, la), (wb, hb, lb) = a, b
    ra, rb = wa / max(1, ha), wb / max(1, hb)
    ink = max(sum(255 - x for x in la), sum(255 - x for x in lb), 510)
    return abs(ra - rb) <= 0.05 * max(ra, rb) and sum(abs(x - y) for x, y in zip(la, lb, strict=True)) < 0.3 * ink


def test_no_pair_under_the_limit_is_lost(spark):
    r = random.Random(1)
    rows = []
    for k in range(260):
        if rows and r.random() < 0.6:
            _, w, h, levels = r.choice(rows)
            levels = [min(255, max(0, x + r.choice([-30, 0, 0, 25]))) if r.random() < r.choice([0, 0.1, 0.5]) else x for x in levels]
        else:
            w, h, levels = r.choice([100, 103, 106, 200]), r.choice([100, 0]), [255 - r.choice([0, 0, 0, 40, 200]) if r.random() < r.choice([0.02, 0.4, 1]) else 255 for _ in range(36)]
        rows.append((k, w, h, levels))
    df = spark.createDataFrame([*rows, (900, None, 1, [1] * 36), (901, 1, 1, None)], "k long, width long, height long, levels array<long>")
    first = {}
    for k, *s in rows:
        first.setdefault(repr(s), k)
    links = {k: sum(alike(s, t) for j, *t in rows if first[repr(t)] == j and j != first[repr(s)]) for k, *s in rows}
    got = {x.k: (x.class_id, x.n_links) for x in pic.linked_pictures(df, "k").collect()}
    assert got == {k: (first[repr(s)], links[k]) for k, *s in rows} and sum(links.values()) > 200
    assert pic.linked_pictures(df.limit(0), "k").count() == 0


def test_no_row_is_made_for_pictures_that_only_share_a_cell(spark):
    df = spark.createDataFrame([(k, 100, 100, [255 - k % 250, 255 - 3 * k % 250, 0 if k % 2 else 200, 100 + k % 3]) for k in range(400)], "class_id long, width long, height long, levels array<long>")
    rows = df.collect()
    want = sorted((a.class_id, b.class_id) for a in rows for b in rows if a.class_id < b.class_id and alike(a[1:], b[1:]))
    for block in (90, 10_000):
        got = pic.same_pictures(df, block)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == want and len(want) > 100
