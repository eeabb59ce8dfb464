import corpus_pipeline
from edge import awkward, empty
from test_near_dedup import brute as components

from strata.llm import decontamination, pii, sentencepiece_codec, toxicity
from strata.llm.common import table

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in table(spark, SF, "documents").collect())
    chain = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    docs = [(i, t) for i, t in docs if chain.scores([t.encode()])[0] < toxicity.THRESHOLD]
    groups = components(docs, 5, 80)
    docs = [(i, t) for i, t in docs if groups[i][1] == i]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    docs = [(i, t) for i, t in docs if not any(decontamination.normal(x) in decontamination.normal(t) for _, x in items)]
    v, model = sentencepiece_codec.load(), pii.default_model()
    want = {}
    for i, t in docs:
        for kind, a, b in reversed(pii.all_spans(t, model)[1]):
            t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
        want[i] = v.encode(t)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(got) < 200


def test_stages_keep_columns_and_take_awkward_rows(spark):
    for docs in (awkward(spark), empty(spark)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            rows = out.collect()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.dtypes == docs.dtypes
            assert len(rows) <= docs.count()
    near = corpus_pipeline.drop_near_duplicates(spark, awkward(spark), SF).collect()
    assert sorted(str(r.doc_id) for r in near) == sorted(map(str, [1, 2, 3, 4, 5, 7, 8, 9, None]))
