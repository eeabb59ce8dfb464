import hashlib
import random

import pytest
from edge import ROWS, awkward, empty

from strata.llm import queries, substring_dedup
from strata.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(rows, window=20):
    docs = [(i, t.encode().split()) for i, t in sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0], r[1].encode()))]
    first, out = {}, []
    for k, (_, w) in enumerate(docs):
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (k, s))
    for k, (i, w) in enumerate(docs):
        off = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (k, s):
                off[s : s + window] = [True] * window
        out.append((i, len(w), sum(off), hashlib.sha256(b" ".join(x for x, o in zip(w, off) if not o)).hexdigest()))
    return sorted(out)


def results(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_query_equals_brute_force(spark):
    got = results(queries.op2_substring_dedup(spark, SF))
    assert got == brute([(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()])
    assert sum(x[2] for x in got) > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_shifted_and_nested_repeats(spark, seed):
    r = random.Random(seed)
    base = [" ".join(r.choice("abcdefg") for _ in range(r.randint(0, 90))) for _ in range(12)]
    rows = [(i, " ".join(r.choice(base) for _ in range(r.randint(0, 3))) if r.random() < 0.7 else " ".join(r.choice("ab") for _ in range(60))) for i in range(60)] + [(100, None), (101, "a " * 300)]
    got = results(substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), n_groups=7, n_shards=5))
    assert got == brute(rows)


def test_awkward_rows(spark):
    rows = [r for r in ROWS if r[0] is not None]
    assert results(substring_dedup.repeats(awkward(spark, rows))) == brute([(r[0], r[1]) for r in rows])
    assert substring_dedup.repeats(awkward(spark)).count() == len(ROWS)
    assert substring_dedup.repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.repeats(empty(spark), window=18, block=10)


def test_the_smallest_id_is_an_id(spark):
    text = " ".join(f"w{k}" for k in range(30))
    least = -(1 << 63)
    rows = {r.doc_id: r.n_removed for r in substring_dedup.repeats(spark.createDataFrame([(least, text), (0, text), (None, text)], "doc_id long, text string")).collect()}
    assert rows == {None: 0, least: 30, 0: 30}
