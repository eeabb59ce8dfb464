import collections
import math
import zlib

import numpy as np
from edge import ROWS, awkward, empty

from strata.llm import lm_scoring as L
from strata.llm import queries
from strata.llm.common import dealt, table

SF = "/root/testdata/sf0.001"


def test_query_base_scores_equal_brute_force(spark):
    rows = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in table(spark, SF, "documents").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in rows}
    counts = collections.Counter(w for i, t in rows.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    got = queries.op9_lm_scoring(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        t = rows[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert -400 * r.n_tokens < r.score < 0
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 32, 50_000).astype(np.uint64)
    keys = np.unique(keys)
    counts = np.minimum(rng.zipf(1.8, len(keys)), 5000)
    for shape, most in ((L.Shape(), 5e-4), (L.Shape(10, 4), 0.03), (L.Shape(10, 4, 9), 0.03)):
        made = L.segment(keys, L.level(counts), shape)
        field = L.LogFrequencyFilter({0: made}, 1, shape)
        read = field.levels(keys)
        assert (read >= L.level(counts)).all() and (read > L.level(counts)).mean() < most
        fresh = np.setdiff1d(rng.integers(0, 1 << 32, 200_000).astype(np.uint64), keys)
        rate = L.false_rate(made, shape.probes)
        assert (field.levels(fresh) > 0).mean() < most and 0.5 * rate - 1e-4 < (field.levels(fresh) > 0).mean() < 2 * rate + 1e-4
    assert (L.VALUES[L.level(counts)] <= counts).all() and (L.VALUES[L.level(counts)] > counts / 1.5).all()


def model(rows):
    """Exact counts of training tokens and of pairs; ``None`` is the end, and also what stands before a text."""
    fit = [t for i, t in rows.items() if zlib.crc32(str(i).encode()) % 10]
    return collections.Counter(w for t in fit for w in t), collections.Counter(p for t in fit for p in zip([None, *t], t, strict=False))


def probability(word, pair, v, w, false=0.0, raised=0):
    """The model's probability of w after v, from exact counts, their levels raised by so many."""
    n, types = sum(word.values()), len(word)
    seen = min(int(L.VALUES[L.level(np.array([pair[v, w]]))[0] + raised]), word[v], word[w])
    return (seen + L.MU * (word[w] + 0.1) / (n + 0.1 * (types + 1))) / ((1 + false) * word[v] + L.MU + false * types)


TEXTS = {i: b"a b a c " * (i % 4) + [b"d a b", b"c c c c a", b"e", b"b d"][i % 4] for i in range(1, 41)}


def test_scores_equal_brute_force_where_no_probe_is_false(spark):
    token = {i: [*t.split(), None] for i, t in TEXTS.items()}
    word, pair = model(token)
    for v in word:
        assert 0.5 < sum(probability(word, pair, v, w) for w in [*word, "unknown"]) <= 1 + 1e-12
    df = spark.createDataFrame([(i, t.decode()) for i, t in TEXTS.items()], "doc_id long, text string")
    for n_groups, n_shards, most in ((0, 0, 1 << 20), (3, 5, 1 << 20), (3, 5, 0)):
        for r in L.score_texts(df, n_groups=n_groups, n_shards=n_shards, shape=L.Shape(200, 20), broadcast_bytes=most).collect():
            t = token[r.doc_id]
            want = sum(math.log10(probability(word, pair, v, w)) for v, w in zip([None, *t], t, strict=False))
            assert math.isclose(r.score, want, rel_tol=1e-9)


def scored(spark, shape, most=1 << 30):
    return {r.doc_id: r for r in L.score_texts(table(spark, SF, "documents"), shape=shape, broadcast_bytes=most, n_groups=16, n_shards=8).collect()}


def test_scores_come_from_probes(spark):
    """Another seed sets other bits, so other levels are raised; every score stays between no level raised and all raised by far."""
    token = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in table(spark, SF, "documents").collect()}
    word, pair = model(token)
    one, other, wide = scored(spark, L.Shape(8, 3)), scored(spark, L.Shape(8, 3, 7)), scored(spark, L.Shape(200, 20))
    assert sum(one[i].score != other[i].score for i in token) > len(token) / 2
    rate = (1 - math.exp(-3 / 8)) ** 3
    for i, t in token.items():
        p = list(zip([None, *t], t, strict=False))
        exact = sum(math.log10(probability(word, pair, v, w)) for v, w in p)
        assert math.isclose(wide[i].score, exact, rel_tol=1e-6)
        least, most = (sum(math.log10(probability(word, pair, v, w, 1.2 * rate if not raised else 0.8 * rate, raised)) for v, w in p) for raised in (0, 6))
        assert least <= one[i].score <= most and least <= other[i].score <= most


def test_a_broadcast_filter_and_its_shards_answer_alike(spark):
    for shape in (L.Shape(), L.Shape(8, 3)):
        sent, kept = scored(spark, shape), scored(spark, shape, 0)
        assert sent == kept


def test_expected_probabilities_sum_to_one_at_most():
    """Over all next tokens of each context, with levels as a narrow filter finds them."""
    rng = np.random.default_rng(4)
    n_types, shape = 400, L.Shape(10, 4)
    counts = np.where(rng.random((n_types, n_types)) < 0.05, rng.zipf(1.6, (n_types, n_types)).clip(max=300), 0)
    context, word = counts.sum(1), counts.sum(0)
    keys = np.arange(n_types * n_types, dtype=np.uint64)
    flat = counts.reshape(-1)
    made = L.segment(keys[flat > 0], L.level(flat[flat > 0]), shape)
    seen = L.VALUES[L.LogFrequencyFilter({0: made}, 1, shape).levels(keys)].reshape(n_types, n_types)
    false = L.false_rate(made, shape.probes)
    p = (np.minimum(seen, np.minimum(context[:, None], word[None, :])) + L.MU * word[None, :] / word.sum()) / ((1 + false) * context + L.MU + false * n_types)[:, None]
    assert (seen > counts).any() and p.sum(1).mean() <= 1 and p.sum(1).max() < 1.1


def test_query_scores_are_near_brute_force(spark):
    token = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in table(spark, SF, "documents").collect()}
    word, pair = model(token)
    for r in queries.op9_lm_scoring(spark, SF).collect():
        t = token[r.doc_id]
        want = sum(math.log10(probability(word, pair, v, w, (1 - math.exp(-0.5)) ** 10)) for v, w in zip([None, *t], t, strict=False))
        assert math.isclose(r.score, want, rel_tol=0.002, abs_tol=0.1)


def test_messages_grow_as_the_input():
    for groups, shards in ((512, 128), (1024, 128)):
        size = 1 << 27
        for _ in range(3):
            (a, b), (c, d) = dealt(size, groups, shards), dealt(4 * size, groups, shards)
            assert 3.9 < c * d / (a * b) < 4.1
            size *= 4
        a, b = dealt(1 << 47, groups, shards)
        assert (1 << 47) / a <= 1 << 23 and (1 << 47) / b <= 1 << 26


def test_awkward_rows_and_shards(spark):
    got = L.score_texts(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 1 and by[None].held_out is False
    other = L.score_texts(awkward(spark), n_groups=2, n_shards=3).collect()
    close = lambda a, b: (a.doc_id, a.n_tokens, a.n_known, a.train_tokens) == (b.doc_id, b.n_tokens, b.n_known, b.train_tokens) and math.isclose(a.base_score, b.base_score, rel_tol=1e-9)
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens)
    assert all(close(a, b) for a, b in zip(sorted(got, key=key), sorted(other, key=key), strict=True))
    assert L.score_texts(empty(spark)).count() == 0
