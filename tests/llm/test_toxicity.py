import math
import zlib

import numpy as np
from edge import ROWS, awkward, empty

from strata.llm import queries, toxicity
from strata.llm.common import table

SF = "/root/testdata/sf0.1"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        weight, active = rng.normal(size=n), rng.random(n) < 0.6
        chain = toxicity.Chain(np.zeros(0, np.uint64), np.zeros(0), *rng.normal(size=3))
        got, logz = chain.marginals(np.flatnonzero(active), weight[active], np.array([0, 0, n, n]))
        total, mass = 0.0, np.zeros(n)
        for bits in range(2**n):
            y, s, before = [bits >> k & 1 for k in range(n)], 0.0, 0
            for k in range(n):
                if y[k]:
                    s += (chain.stay if before else chain.start1) + chain.bias + (weight[k] if active[k] else 0)
                before = y[k]
            total += math.exp(s)
            mass += math.exp(s) * np.array(y)
        assert np.allclose(got, (mass / total)[active]) and np.isclose(logz[1], math.log(total))


def test_held_out_documents_are_told_apart(spark):
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, SF).collect()}
    labels = [(r.doc_id, r.toxic) for r in table(spark, SF, "labels").collect()]
    held = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(r.held_out for r, _ in held) and all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    order = np.argsort(np.argsort([r.score for r, _ in held]))
    y = np.array([y for _, y in held])
    auc = (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.93
    flagged = [y for r, y in held if r.predicted]
    assert np.mean(flagged) > 0.8 and sum(flagged) / y.sum() > 0.7


def test_held_out_labels_are_not_read(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    from pyspark.sql import functions as F

    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda lab: sorted(map(tuple, toxicity.score_documents(docs, toxicity.train(docs, lab)).collect()))
    assert score(labels) == score(other)


def test_awkward_rows_spans_and_missing_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    chain = toxicity.train(docs, labels)
    got = toxicity.score_documents(awkward(spark), chain).collect()
    told = {r.doc_id: ",".join(f"{x.start}:{x.end}" for x in r.spans) for r in toxicity.toxic_spans(awkward(spark), chain).collect()}
    assert all(r.spans == (told[r.doc_id] if r.score >= toxicity.THRESHOLD else "") for r in got)
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(empty(spark), chain).count() == 0
    text = "é you idiot é"
    assert [text[a:b] for a, b, _ in chain.spans(text)] == ["idiot"]
    assert toxicity.keep_clean(awkward(spark), chain).columns == awkward(spark).columns
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    flat = toxicity.train(docs, nothing)
    assert len({r.score for r in toxicity.score_documents(awkward(spark), flat).collect()}) == 1
    odd = spark.createDataFrame([(1, None), (None, 1), (5, 1), (5, 1), (6, 0)], "doc_id long, toxic int")
    toxicity.score_documents(awkward(spark), toxicity.train(awkward(spark), odd)).collect()
