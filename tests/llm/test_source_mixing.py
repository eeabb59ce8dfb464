import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from edge import awkward, empty

from strata.llm import source_mixing as sm
from strata.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, source string, size long, place long, start long, target double, h long, g long, copy int"


def plain_targets(sizes, weights=sm.WEIGHTS, share=1.5, most=2.0):
    """By source, null last: shares by weight, the excess dealt anew until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > most * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def made_up(seed=1, docs=400):
    r = random.Random(seed)
    sources = ["b", "a", None, "ü", "", "c" * 3]
    out = [(i if r.random() < 0.9 else None, " ".join(["w"] * r.choice([0, 1, 3, 50, 400])), r.choices(sources, [9, 1, 2, 2, 1, 3])[0]) for i in range(docs)]
    return out + [(7, "same text here", "a")] * 5 + [(None, "same text here", None)] * 5 + [(5, None, "d"), (6, " \n", "d")]


def frame(spark, data):
    return spark.createDataFrame([(*row, 1, 2, 3, 0.5, 4, 5, 6) for row in data], SCHEMA)


def check(data, got, **settings):
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += n_words(t)
    target = plain_targets(sizes, **settings)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, n_words(t)) for i, t, _ in data)
    known = defaultdict(set)
    for i, t, s in data:
        known[i, n_words(t)].add((sizes[s], round(target[s], 6)))
    for r in got:
        assert (r.source_size, round(r.target, 6)) in known[r.doc_id, r.size] and 0 <= r.taken <= 2 * r.size
    by_target = defaultdict(int)
    for r in got:
        by_target[r.source_size, round(r.target, 6)] += r.taken
    want = defaultdict(int)
    for s in sizes:
        want[sizes[s], round(target[s], 6)] += round(target[s])
    assert all(abs(by_target[k] - want[k]) <= 1 for k in want)


@pytest.mark.parametrize("settings", [{}, {"block": 7, "shard_words": 500, "weights": (1.0, 1.0, 5.0, 1.0)}, {"block": 1, "shard_words": 100_000, "share": 0.3}])
def test_targets_and_pieces(spark, monkeypatch, settings):
    monkeypatch.setattr(sm, "GROUP", 40)
    monkeypatch.setattr(sm, "UPPER", 4)
    data = made_up()
    mix = sm.Mix(frame(spark, data), **settings)
    check(data, mix.taken().collect(), **{k: v for k, v in settings.items() if k in ("weights", "share")})
    pieces = [r for r in mix.pieces().collect() if r.n_words]
    spots = Counter((r.place, r["pass"], r.start + r.first_word + k) for r in pieces for k in range(r.n_words))
    assert max(spots.values()) == 1  # no word twice in a pass
    assert all(0 <= r.first_word and r.first_word + r.n_words <= r.size for r in pieces)
    wanted = {r.place: r for r in mix.sources.collect()}
    taken, passes = Counter(), defaultdict(Counter)
    for r in pieces:
        taken[r.place] += r.n_words
        passes[r.place][r["pass"]] += r.n_words
    for p, r in wanted.items():
        assert taken[p] == r.wanted and all(n == r.source_size for k, n in passes[p].items() if k < r.wanted // r.source_size)
    again = sm.Mix(frame(spark, random.Random(3).sample(data, len(data))), **settings)
    assert sorted(map(tuple, again.shuffled().collect()), key=repr) == sorted(map(tuple, mix.shuffled().collect()), key=repr)


def test_shards_are_even_and_mixed(spark):
    data = [(i, "w " * 100, "abc"[i % 3]) for i in range(600)]
    mix = sm.Mix(frame(spark, data), block=10, shard_words=3000)
    rows = mix.shuffled().collect()
    words, by = Counter(), defaultdict(Counter)
    for r in rows:
        words[r.shard] += r.n_words
        by[r.shard][r.place] += r.n_words
    assert mix.shards == 30 and len(words) == 30 and max(words.values()) - min(words.values()) <= 20
    whole = Counter({r.place: r.wanted for r in mix.sources.collect()})
    for shard in by:
        for p, n in whole.items():
            assert abs(by[shard][p] / words[shard] - n / sum(whole.values())) < 0.15
    in_order = [r.place for r in sorted(rows, key=lambda r: (r.shard, r.position)) if r.shard == 0]
    assert sum(a != b for a, b in zip(in_order, in_order[1:], strict=False)) > len(in_order) / 10
    assert sorted(r.position for r in rows if r.shard == 0) == list(range(len(in_order)))


def test_tree_deals_every_draw_once():
    node = {"place": np.array([1, 2, 3]), "n_blocks": np.array([50, 1, 900]), "source_size": np.array([495, 3, 9000]), "wanted": np.array([990, 2, 4321]), "n_draws": np.array([100, 1, 433])}
    node |= {"first": np.zeros(3, np.int64), "quota": node["n_draws"]}
    leaves = list(sm._subtree(0, 13, node, 5, 1))
    assert sum(int(n["quota"].sum()) for _, _, n in leaves) == 534 and max(int(n["quota"].sum()) for _, _, n in leaves) <= 42
    got = [tuple(x) for lo, _, n in leaves for cols in sm._blocks(lo, n, 10, 5, 17) for x in zip(*cols, strict=True)]
    assert len({(p, b, t) for _, p, b, t, _ in got}) == 534
    upper = [(a, b, part) for lo, hi, n in sm._subtree(0, 13, node, 5, 4) for a, b, part in sm._subtree(lo, hi, n, 5, 1)]
    assert [(a, b, p["quota"].tolist()) for a, b, p in upper] == [(a, b, p["quota"].tolist()) for a, b, p in leaves]


def test_quotas_are_hypergeometric():
    quota = np.array([60, 40])
    left = np.array([sm.split(0, 4, quota, s)[1][0] for s in range(3000)])
    assert abs(left.mean() - 30) < 0.3 and abs(left.var() - 50 * 0.6 * 0.4 * 50 / 99) < 0.6  # n K/N (1-K/N) (N-n)/(N-1)


def test_words_are_counted_by_the_pattern(spark):
    r = random.Random(9)
    texts = ["".join(r.choices("ab\u00a0\u2003é\x1c\x85 \t\n\x0b\x0c\r", k=r.randint(0, 12))) for _ in range(300)] + [None, "", "w " * 200_000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sm.words(sm.F.col("t")).alias("n")).collect()
    assert [x.n for x in got] == [n_words(t) for t in texts]


def test_permutation():
    for n in (1, 2, 3, 5, 64, 65, 1000):
        out = sm.permuted(np.arange(n), np.full(n, n), np.full(n, 77, np.uint64))
        assert sorted(out) == list(range(n)) and (n < 64 or (out != np.arange(n)).mean() > 0.9)


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], sm.Mix(docs).taken().collect())
    assert sm.Mix(empty(spark)).taken().count() == 0
    blank = frame(spark, [(1, "", "a"), (2, None, None)])
    assert sorted(map(tuple, sm.Mix(blank).taken().collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_query(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "source").collect()
    got = QUERIES["op11_source_mixing"](spark, path)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and [k for _, k in got.dtypes] == ["bigint", "bigint", "bigint", "double", "bigint"]
    check([tuple(d) for d in docs], got.collect())
