import random

import numpy as np
import pytest
from edge import ROWS, awkward, empty

from strata.llm import near_dedup as N
from strata.llm import queries
from strata.llm.common import table


def brute(rows, size, percent):
    sets, at = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        for g in sets[i]:
            at.setdefault(g, []).append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in sets.items():
        shared = {}
        for g in s:
            for j in at[g]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("sf", "size", "percent", "block"), [("sf0.01", 3, 85, 1000), ("sf0.01", 3, 85, 2), ("sf0.001", 5, 80, 3)])
def test_components_equal_brute_force(spark, sf, size, percent, block):
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], size, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs, size=size, percent=percent, block=block).collect()}
    assert got == want and any(c != i for i, (_, c) in want.items())


def test_a_large_family_of_chained_copies(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(80)], []
    for i in range(150):
        base[r.randrange(80)] = word()
        other = list(base)
        for _ in range(r.randint(0, 3)):
            other[r.randrange(80)] = word()
        rows.append((i, " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 85)
    for block in (10, 1000):
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in N.near_duplicates(docs, size=3, percent=85, block=block).collect()} == want


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    bands = N.bands_for(0.8)
    for similarity in (0.7, 0.8, 0.9, 0.97):
        errors = []
        for _ in range(20):
            n = 400
            both = int(similarity * n)
            x = rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64)
            sets = [np.sort(x[:n]), np.sort(np.concatenate([x[:both], x[n:]]))]
            true = both / (2 * n - both)
            _, sketch = N.signatures(sets, bands)
            differing = np.bitwise_count(sketch[0] ^ sketch[1]).sum()
            errors.append(N.estimate(np.array([differing]), bands * N.ROWS)[0] - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_query_and_awkward_rows(spark):
    got = queries.op5_near_dedup(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.where("kept is null").count() == 0
    rows = N.near_duplicates(awkward(spark), size=3, percent=85).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[6].component_id == 1 and by_id[2].component_id == 2 and by_id[2].n_shingles == 0 and by_id[5].n_shingles == 1
    assert N.near_duplicates(empty(spark)).count() == 0


NEAR = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
OTHER = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def test_null_and_repeated_ids_lose_no_link(spark):
    rows = [(None, NEAR), (3, NEAR), (4, NEAR), (5, NEAR + " plus"), (5, OTHER), (9, OTHER.upper()), (-(1 << 63), "quite alone in here"), (None, "")]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=80).collect())
    assert got == sorted([("None", 22, 3), ("3", 22, 3), ("4", 22, 3), ("5", 23, 3), ("5", 13, 5), ("9", 13, 5), (str(-(1 << 63)), 2, -(1 << 63)), ("None", 0, None)])
    only_null = N.near_duplicates(spark.createDataFrame([(None, NEAR), (None, NEAR)], "doc_id long, text string")).collect()
    assert [r.component_id for r in only_null] == [None, None]


def test_keep_one_judges_by_text(spark):
    rows = [(1, NEAR, "x"), (5, NEAR + " plus", "y"), (5, OTHER, "z"), (None, OTHER, "n"), (5, OTHER, "a"), (7, None, "p"), (7, None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string")
    kept = N.keep_one(docs, size=3, percent=80)
    assert kept.dtypes == docs.dtypes
    assert sorted(map(str, kept.collect())) == sorted(f"Row(doc_id={i}, text={t!r}, __id={x!r})" for i, t, x in [(1, NEAR, "x"), (5, OTHER, "a"), (7, None, "p"), (7, None, "q")])
    none_but_null = spark.createDataFrame([(None, OTHER, "b"), (None, OTHER + " and", "c")], "doc_id long, text string, __id string")
    assert N.keep_one(none_but_null, size=3, percent=80).count() == 1
