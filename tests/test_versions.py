"""Versions against each other, held by brute force."""

import itertools
import random
from collections import defaultdict

import pytest

from strata.functions import chains
from strata.functions import sequences as seq
from strata.operators import alignment, ordering, pairing
from strata.plans import version_queries as vq

SF = "/root/testdata/sf0.001"


def by_group(df, key):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


# ---------------------------------------------------------------- foreign pairing

def likeness(a, b):
    w = max(0.0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]))
    h = max(0.0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))
    size = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    whole = size(a) + size(b) - w * h
    off = ((a["x0"] + a["x1"] - b["x0"] - b["x1"]) ** 2 + (a["y0"] + a["y1"] - b["y0"] - b["y1"]) ** 2) ** 0.5 / 2
    return max(w * h / whole if whole > 0 else 0.0, 1 - off / 60, 0.0)


def score(a, b):
    place = likeness(a, b)
    x, y = (" ".join((r["text"] or "").split()) for r in (a, b))
    fit = 1.0 if a["kind"] == b["kind"] else 0.7 if {"image", "diagram"} & {a["kind"], b["kind"]} else 0.5
    return 0.0 if place <= 0 else round(fit * (0.55 * seq.ratio(x, y) + 0.45 * place if x or y else place), 4)


def held(inner, outer):
    w = min(inner["x1"], outer["x1"]) - max(inner["x0"], outer["x0"])
    h = min(inner["y1"], outer["y1"]) - max(inner["y0"], outer["y0"])
    size = (inner["x1"] - inner["x0"]) * (inner["y1"] - inner["y0"])
    return w > 0 and h > 0 and size > 0 and w * h / size >= 0.85


def one_drawing(a, b):
    x, y = (" ".join((r["text"] or "").split()) for r in (a, b))
    if x and x == y and a["x0"] >= b["x0"] - 2 and a["y0"] >= b["y0"] - 2 and a["x1"] <= b["x1"] + 2 and a["y1"] <= b["y1"] + 2:
        return True
    return all(abs((a[q] - a[p]) - (b[q] - b[p])) <= 8 + 0.25 * max(a[q] - a[p], b[q] - b[p]) for p, q in (("x0", "x1"), ("y0", "y1")))


def explained(ours, theirs):
    """One page, all pairs."""
    own, layout = [b for b in theirs if not b["inherited"]], [b for b in theirs if b["inherited"]]
    ours, own = sorted(ours, key=lambda r: r["a"]), sorted(own, key=lambda r: r["b"])
    table = [[score(a, b) for b in own] for a in ours]
    why, pairs = {}, {}
    for i, row in enumerate(table):
        if max(row, default=0) < 0.45:
            why[i] = "no_candidate"
            continue
        j = row.index(max(row))
        second = max((s for k, s in enumerate(row) if k != j), default=0.0)
        rival = max((r[j] for k, r in enumerate(table) if k != i), default=0.0)
        if rival > row[j]:
            why[i] = "not_best"
        elif round(row[j] - second, 4) < 0.08 or round(row[j] - rival, 4) < 0.08:
            why[i] = "ambiguous"
        else:
            pairs[i] = j
    out = {}
    for i, a in enumerate(ours):
        if i in pairs:
            out[a["a"]] = ("paired", own[pairs[i]]["b"], None)
        elif any(score(a, b) >= 0.45 and one_drawing(a, b) for b in layout):
            out[a["a"]] = ("layout", None, None)
        elif any(b["kind"] == "table" and held(a, b) for b in own):
            out[a["a"]] = ("table", None, None)
        else:
            owners = [ours[k]["a"] for k, j in pairs.items() if held(a, own[j])]
            out[a["a"]] = ("drawn_from", None, min(owners)) if owners else (why[i], None, None)
    return out


def test_every_foreign_element_is_paired_or_explained(spark):
    ours, theirs = (by_group(df, "page") for df in vq.foreign_page(spark, SF))
    want = {(p, k): v for p in ours for k, v in explained(ours[p], theirs[p]).items()}
    rows = vq.j29_foreign_pairs(spark, SF).collect()
    assert len(rows) == len(want) and {(r.page, r.a): (r.verdict, r.b, r.owner) for r in rows} == want
    assert {v[0] for v in want.values()} >= {"paired", "layout", "table", "drawn_from", "ambiguous", "no_candidate"}


SEEN = "page long, {} long, kind string, x0 double, y0 double, x1 double, y1 double, text string"


@pytest.mark.parametrize("seed", range(3))
def test_random_pages_are_paired_as_all_pairs_say(spark, seed):
    r = random.Random(seed)

    def element(k):
        x, y = r.uniform(-50, 700), r.uniform(-50, 500)
        w, h = r.choice([(20, 20), (200, 30), (700, 500), (0, 0), (120, 60)])
        return k, r.choice(["text", "table", "image", "shape", "diagram"]), x, y, x + w, y + h, r.choice([None, "", "a b", "one two three", "one  two four", "zzz"])

    ours = [(p, *element(k)) for p in range(12) for k in range(r.randint(0, 8))]
    near = [(p, k + 1, kind, x0 + r.uniform(-9, 9), y0 + r.uniform(-9, 9), x1 + r.uniform(-3, 9), y1 + r.uniform(-3, 9), text, r.random() < 0.2) for p, k, kind, x0, y0, x1, y1, text in ours if r.random() < 0.8]
    theirs = near + [(p, *element(100 + k), r.random() < 0.3) for p in range(12) for k in range(r.randint(0, 4))]
    a, b = spark.createDataFrame(ours, SEEN.format("a")), spark.createDataFrame(theirs, SEEN.format("b") + ", inherited boolean")
    ga, gb = by_group(a, "page"), by_group(b, "page")
    want = {(p, k): v for p in ga for k, v in explained(ga[p], gb[p]).items()}
    assert {(x.page, x.a): (x.verdict, x.b, x.owner) for x in pairing.explain(a, b, ["page"], "a", "b").collect()} == want


def test_empty_pages(spark):
    a, b = spark.createDataFrame([], SEEN.format("a")), spark.createDataFrame([], SEEN.format("b") + ", inherited boolean")
    assert pairing.explain(a, b, ["page"], "a", "b").count() == 0
    one = spark.createDataFrame([(None, 1, "text", 0.0, 0.0, 9.0, 9.0, "x"), (2, 1, "text", 0.0, 0.0, 9.0, 9.0, "x")], SEEN.format("a"))
    assert [r.verdict for r in pairing.explain(one, b, ["page"], "a", "b").collect()] == ["no_candidate"] * 2


# ---------------------------------------------------------------- alignment

def all_chains(pairs):
    """Every order-keeping set of pairs."""
    pairs = sorted(pairs)
    out = [[]]
    for p in pairs:
        out += [c + [p] for c in out if not c or (c[-1][0] < p[0] and c[-1][1] < p[1])]
    return out


@pytest.mark.parametrize("seed", range(40))
def test_chains_equal_enumeration(seed):
    r = random.Random(seed)
    pairs = [(i, j, r.choice([60, 60, 80, 100])) for i in range(5) for j in range(5) if r.random() < 0.45][:12]
    every = all_chains(pairs)
    best = max(sum(s for *_, s in c) for c in every)
    got = chains.aligned(pairs, 2)
    assert [(i, j, s) for i, j, s, _ in got] in every and sum(s for _, _, s, _ in got) == best
    for i, j, s, tie in got:
        rivals = {p[0] for c in every if sum(x[2] for x in c) >= best - 2 for p in c if p[1] == j} | {p[0] for p in pairs if p[1] == j and p[2] >= s - 2}
        assert tie == bool(rivals - {i})


def walked(pairs):
    """The chain that a walk over the full score table takes."""
    s = {(i, j): w for i, j, w in pairs}
    n, m = max((i for i, _ in s), default=-1) + 1, max((j for _, j in s), default=-1) + 1
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i, j in itertools.product(range(n - 1, -1, -1), range(m - 1, -1, -1)):
        best[i][j] = max(best[i + 1][j], best[i][j + 1], s.get((i, j), 0) + best[i + 1][j + 1] if (i, j) in s else 0)
    i = j = 0
    out = []
    while i < n and j < m:
        if (i, j) in s and best[i][j] == s[i, j] + best[i + 1][j + 1]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


@pytest.mark.parametrize("seed", range(60))
def test_of_equal_chains_the_walk_decides(seed):
    r = random.Random(seed)
    pairs = [(i, j, r.choice([1, 1, 2])) for i in range(9) for j in range(9) if r.random() < 0.3]
    assert [(i, j) for i, j, *_ in chains.aligned(pairs, 0)] == walked(pairs)


def may_pair(a, b, base, ours):
    x, y = a["label"], b["label"]
    return not (x and y) or x == y or (x not in {o["label"] for o in ours} and y not in {o["label"] for o in base})


def test_weak_alignment_equals_all_pairs(spark):
    base, ours = (by_group(df, "conv_id") for df in vq.twin_versions(spark, SF))
    want = {}
    for c in base:
        pairs = []
        for a, b in itertools.product(base[c], ours[c]):
            title = a["title"] != "" and a["title"] == b["title"]
            s = round((seq.ratio((a["text"] or "").split(), (b["text"] or "").split()) + 0.5 * title - 1e-4 * a["removed"]) * 1_000_000)
            if s >= 600_000 and may_pair(a, b, base[c], ours[c]):
                pairs.append((a["pos"], b["pos"], s))
        label = {b["pos"]: b["label"] for b in ours[c]}
        want[c] = {(i, j): (s, "twins" if tie and not label[j] else None) for i, j, s, tie in chains.aligned(pairs, 20_000)}
    got = defaultdict(dict)
    for r in vq.j26_weak_alignment(spark, SF).collect():
        got[r.conv_id][r.a, r.b] = (round(r.similarity * 1_000_000), r.weak)
    assert dict(got) == {c: v for c, v in want.items() if v}
    assert sum(w == "twins" for v in want.values() for _, w in v.values()) > 3


def test_no_pair_over_the_threshold_is_missed(spark):
    r = random.Random(5)
    make = lambda k: [(g, i, "", "", " ".join(r.choices("abcdefgh", [9, 5, 3, 2, 1, 1, 1, 1], k=r.randint(0, 9))), False) for g in range(3) for i in range(k)]
    schema = "g long, pos long, title string, label string, text string, removed boolean"
    a, b = make(25), make(25)
    got = {(x.g, x.a, x.b): x.worth for x in alignment.scores(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "g").collect()}
    want = {(x[0], x[1], y[1]): round(seq.ratio(x[4].split(), y[4].split()) * 1_000_000) for x in a for y in b if x[0] == y[0]}
    assert got == {k: v for k, v in want.items() if v >= 600_000 and k in got or v >= 600_000 and any(x[0] == k[0] and x[1] == k[1] and x[4] for x in a)}


# ---------------------------------------------------------------- orders

def folded(base, ours, live, kept):
    """Three-way order merge, one insertion after another."""
    moved_of = lambda was, now: [x for k, x in enumerate(now) if k not in set(seq.longest_increasing([was.index(y) for y in now]))]
    ours_set, live_set, base_set = set(ours), set(live), set(base)
    kept = {k for k in kept if k in base_set and k not in ours_set}
    deleted = {k for k in base if k not in ours_set and k not in kept}
    existing = [k for k in live if k in base_set and k not in deleted]
    order = [k for k in ours if k in live_set or k not in base_set]
    source_moved = set(moved_of([k for k in base if k in ours_set and k in live_set], [k for k in order if k in base_set]))

    def behind(key, row):
        at = row.index(key)
        before = next((k for k in reversed(row[:at]) if k in order), None)
        order.insert(order.index(before) + 1 if before is not None else 0, key)

    for k in [k for k in base if k in kept and k in live_set]:
        behind(k, base)
    deck = moved_of([k for k in base if k in set(existing)], existing)
    for k in deck:
        order.remove(k)
        behind(k, live)
    added = [k for k in live if k not in order and k not in deleted]
    for k in added:
        behind(k, live)
    how = {k: "moved" if k in deck else "added" if k in added else "kept" if k in kept else "source" for k in order}
    return [(k, how[k], k in deck and k in source_moved) for k in order]


def check_merge(got, base, ours, live):
    for g in set(base) | set(ours) | set(live):
        rows = {n: sorted(v[g], key=lambda r: r["pos"]) for n, v in (("b", base), ("o", ours), ("t", live))}
        want = folded(*([r["key"] for r in rows[n]] for n in "bot"), {r["key"] for r in rows["t"] if r["kept"]})
        assert [(r["key"], r["how"], r["both_moved"]) for r in sorted(got[g], key=lambda r: r["position"])] == want
        assert [r["position"] for r in sorted(got[g], key=lambda r: r["position"])] == list(range(1, len(want) + 1))


def test_order_merge_equals_insertions_one_by_one(spark):
    versions = vq.moved_versions(spark, SF)
    got = by_group(vq.o8_order_merge(spark, SF), "conv_id")
    check_merge(got, *(by_group(df, "conv_id") for df in versions))
    assert {r["how"] for v in got.values() for r in v} == {"source", "kept", "moved", "added"}


def test_random_orders_merge(spark):
    r = random.Random(11)
    base, ours, live = [], [], []
    for g in range(40):
        keys = list(range(r.randint(0, 9)))
        base += [(g, k, p) for p, k in enumerate(keys)]
        mine = [k for k in keys if r.random() < 0.8] + [100 + k for k in range(r.randint(0, 2))]
        theirs = [k for k in keys if r.random() < 0.8] + [200 + k for k in range(r.randint(0, 3))]
        for row in (mine, theirs):
            for _ in range(r.randint(0, 2)):
                if row:
                    row.insert(r.randrange(len(row)), row.pop(r.randrange(len(row))))
        ours += [(g, k, p) for p, k in enumerate(mine)]
        live += [(g, k, p, r.random() < 0.5) for p, k in enumerate(theirs)]
    tables = [spark.createDataFrame(x, "g long, key long, pos long" + ", kept boolean" * (x is live)) for x in (base, ours, live)]
    got = by_group(ordering.merged_order(*tables, "g", "key", "pos"), "g")
    check_merge(got, *(by_group(df, "g") for df in tables))


def test_carried_values_cross_parts(spark):
    data = [(g, k, k if k % 97 == 5 else None) for g in (1, 2) for k in range(1000)]
    got = ordering.carried(spark.createDataFrame(data, "g long, k long, v long"), ["g"], ["k"], "v", "last")
    assert {(r.g, r.k): r["last"] for r in got.collect()} == {(g, k): (k - 5) // 97 * 97 + 5 if k >= 5 else None for g, k, _ in data}


# ---------------------------------------------------------------- stacking

def held_constraints(rows, edges, got):
    place = {r["key"]: r["position"] for r in got}
    told = {r["key"]: r["told"] for r in got}
    pos = {k: p for _, k, p, _ in rows}
    broken = [(a, b) for a, b in edges if a in pos and b in pos and not (pos[a] is not None and pos[b] is not None) and place[a] >= place[b]]
    stays = [k for _, k, p, _ in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0], r[2]))]
    assert [k for k in sorted(stays, key=lambda k: (k // 1000, place[k]))] == stays
    return broken, told


def test_stacking_holds_all_it_can(spark):
    r = random.Random(3)
    rows, edges = [], []
    for g in range(60):
        n = r.randint(1, 9)
        rows += [(g, g * 1000 + k, float(k) if r.random() < 0.5 else None, r.randint(0, 3)) for k in range(n)]
        for _ in range(r.randint(0, 6)):
            a, b = r.sample(range(n), 2) if n > 1 else (0, 0)
            if a != b:
                edges.append((g * 1000 + min(a, b), g * 1000 + max(a, b)) if g % 3 else (g * 1000 + a, g * 1000 + b))
    got = ordering.stacked(spark.createDataFrame(rows, "g long, key long, pos double, rank int"), spark.createDataFrame(edges, "below long, above long"), "g", "key", "pos", "rank").collect()
    broken, told = held_constraints(rows, edges, got)
    pos = {k: p for _, k, p, _ in rows}
    # what is broken: what a squeezed row should have been above, or a ring's own
    for a, b in broken:
        assert told[b] == "squeezed" and pos[a] is not None or {told[a], told[b]} == {"cycle"}
    assert not [b for b in broken if b[0] // 1000 % 3 and told[b[1]] != "squeezed"]
    assert {x for x in told.values()} == {"stays", "placed", "squeezed", "cycle"}
    assert sorted(r.position for r in got if r.g == 7) == list(range(1, sum(x[0] == 7 for x in rows) + 1))
    # every row told to be on a ring reaches itself or lies between two that do
    new = {(a, b) for a, b in edges if a in pos and b in pos and pos[a] is None and pos[b] is None}
    reach = {a: {b for x, b in new if x == a} for a, _ in new}
    for _ in range(10):
        reach = {a: v | {c for b in v for c in reach.get(b, ())} for a, v in reach.items()}
    rings = {a for a, v in reach.items() if a in v}
    assert {k for k, t in told.items() if t == "cycle"} == {k for k in told if k in rings or (any(k in reach.get(x, ()) for x in rings) and rings & reach.get(k, set()))}
