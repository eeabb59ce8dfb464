import collections
import math
import zlib

import numpy as np
from edge import ROWS, awkward, empty

from strata.llm import quality_ngram as Q
from strata.llm import queries
from strata.llm.common import table


def brute(texts):
    """Interpolated modified Kneser-Ney over word trigrams with dictionaries."""
    c3 = collections.Counter()
    for t in texts:
        w = ["<s>", "<s>", *t.split(), "</s>"]
        c3.update(zip(w, w[1:], w[2:]))
    c2, c1 = collections.Counter(), collections.Counter()
    for (_, v, w), c in c3.items():
        c2[v, w] += c if v == "<s>" else 1
    for _, w in c2:
        c1[w] += 1

    def discount(counts):
        n1, n2, n3, n4 = (max(1, sum(c == k for c in counts.values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        return [min(k - 1e-3, max(0.05, d)) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]

    def level(counts, lower):
        d = discount(counts)
        cut = lambda c: d[min(c, 3) - 1]
        total, mass = collections.Counter(), collections.Counter()
        for k, c in counts.items():
            total[k[:-1]] += c
            mass[k[:-1]] += cut(c)

        def p(*k):
            context = k[:-1]
            if not total[context]:
                return lower(*k[1:])
            c = counts.get(k, 0)
            return (c - cut(c) if c else 0) / total[context] + mass[context] / total[context] * lower(*k[1:])

        return p

    p1 = level({(w,): c for w, c in c1.items()}, lambda *_: 1 / (len(c1) + 1))
    return level(c3, level(c2, p1))


def test_probabilities_equal_brute_force(spark):
    texts = ["a b a c", "a b b", "c a b a b", "", "b b b c a"]
    model = Q.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), list(range(len(texts))))
    p = brute(texts)
    for t in [*texts, "a c c z", "z z", "b a b c"]:
        w = ["<s>", "<s>", *t.split(), "</s>"]
        want = [math.log(p(*k)) for k in zip(w, w[1:], w[2:])]
        two, one, token, _ = Q.sequences([t.encode()])
        assert np.allclose(model.log_probabilities(two, one, token), want, atol=1e-6)


def test_junk_is_told_from_trusted_text(spark):
    got = {r.doc_id: r for r in queries.op6_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    assert len(got) == 1000
    assert np.mean([got[i].kept for i, q in labels.items() if q == 1]) > 0.95
    assert np.mean([got[i].kept for i, q in labels.items() if q == 0]) < 0.3


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (7, 1), (6, 1), (None, 1), (5, 0), (9, None)], "doc_id long, quality int")
    got = Q.classify(awkward(spark), labels).collect()
    assert len(got) == len(ROWS) and all(r.n_tokens >= 1 and r.perplexity > 0 and r.kept is not None for r in got)
    assert all(r.kept for r in Q.classify(awkward(spark), labels.limit(0)).collect())
    assert Q.classify(empty(spark), labels).count() == 0


def test_a_long_trusted_document_is_trained_on(spark):
    long, held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5), next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 0)
    rows = [(long, "en", "alpha beta gamma " * 430_000), (held, "en", "alpha beta gamma " * 50), (100, "en", "delta epsilon zeta eta")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in Q.classify(df, spark.createDataFrame([(long, 1), (held, 1)], "doc_id long, quality int")).collect()}
    assert got[long].n_tokens == 1_290_001 and got[long].perplexity < 1.1
    assert got[held].threshold == got[held].perplexity and got[held].kept and not got[100].kept


def test_scores_by_shards_equal_the_local_model(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "lang", "text")
    ids = [r.doc_id for r in docs.where("doc_id % 3 = 0").select("doc_id").collect()]
    model = Q.train(docs.select("doc_id", "text"), ids)
    entries, unknown = Q.fit(docs.where("doc_id % 3 = 0"))
    for n in (0, 3):
        got = {r.doc_id: r for r in Q.score(docs, entries, unknown, n, n).collect()}
        for r in docs.collect():
            n_tokens, want = model.perplexities([(r.text or "").encode()])
            assert got[r.doc_id].n_tokens == n_tokens[0] and math.isclose(got[r.doc_id].perplexity, want[0], rel_tol=1e-9)


def test_all_trusted_text_is_trained_on(spark):
    ids = [i for i in range(8000) if zlib.crc32(str(i).encode()) % 5]
    df = spark.createDataFrame([(i, "en", " ".join([f"w{i}"] * 260)) for i in ids], "doc_id long, lang string, text string")
    got = Q.classify(df, df.selectExpr("doc_id", "1 quality")).collect()
    assert len(got) == len(ids) > 6000 and max(r.perplexity for r in got) < 2


def test_the_model_takes_little_room(spark, tmp_path):
    """At rest its entries take less than the hashes of each triple's words would."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("text")
    Q.fit(docs, str(tmp_path / "quality-room"))
    u, v, w, _ = Q.sequences([(r.text or "").encode() for r in docs.collect()])
    room = sum(p.stat().st_size for p in (tmp_path / "quality-room").rglob("*.parquet"))
    assert room < 24 * len(np.unique(Q.key_of(3, u, v, w)))
