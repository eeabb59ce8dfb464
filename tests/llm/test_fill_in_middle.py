import hashlib
import re

import pytest
from edge import awkward, empty

from strata.llm import fill_in_middle as fim
from strata.llm.queries import QUERIES

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def plain_python(doc_id, text, rate=100, spm=50, unit=fim.LINES, seed=7):
    text = text or ""
    units = re.findall(unit, text)
    h = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = ["a\nb\nc\n", "\n\n", "one line", "x<S>y\nz\n", "a<\nS>b\n<P", "<S\n>M>\nq", "é\U0001f600\n日本\nz", "", None, "\r\n\tq\x00\n", "l\n" * 40_000]


def rows(spark, texts=TEXTS, copies=6):
    return [(None if i == 3 else i - 5, t) for i, t in enumerate(texts * copies)]


@pytest.mark.parametrize("settings", [{}, {"rate": 50}, {"spm": 0}, {"unit": "[^ ]* |[^ ]+", "seed": 9}])
def test_equals_plain_python_and_comes_back(spark, settings):
    data = rows(spark)
    cut = fim.fill_in_middle(spark.createDataFrame(data, "doc_id long, text string"), **settings)
    got = sorted((tuple(r) for r in cut.collect()), key=repr)
    assert got == sorted(((i, *plain_python(i, t, **settings)) for i, t in data), key=repr)
    assert {r[2] for r in got} >= {"plain", "psm"}
    back = sorted(((r.id, r.text) for r in fim.restore(cut).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t in data), key=repr)


def test_slices_of_a_batch(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fim, "SLICE_BYTES", 10)
    data = rows(spark, TEXTS[:8], 3)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in data], pa.int64()), pa.array([t for _, t in data])], ["id", "text"])
    sql = fim.CUT.format(unit=fim.LINES, seed=7, rate=100, spm=50, P="<P>", S="<S>", M="<M>")
    got = [tuple(r.values()) for made in fim._by_batch(iter([batch, batch.slice(0, 0)]), sql, "text") for r in made.to_pylist()]
    assert got == [(i, *plain_python(i, t)) for i, t in data]


def test_a_text_of_many_megabytes():
    import pyarrow as pa

    sql = fim.CUT.format(unit=fim.LINES, seed=7, rate=100, spm=50, P="<P>", S="<S>", M="<M>")
    for text in ("l\n" * (9 << 20), "a line of some length that is said again\n" * (1 << 20)):
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([text, "short\n"])], ["id", "text"])
        got = [r for made in fim._by_batch(iter([batch]), sql, "text") for r in made.to_pylist()]
        assert [tuple(r.values()) for r in got] == [(1, *plain_python(1, text)), (2, *plain_python(2, "short\n"))]


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    cut = fim.fill_in_middle(docs)
    assert sorted((r.id is None, r.id, r.output) for r in cut.collect()) == sorted((r.doc_id is None, r.doc_id, plain_python(r.doc_id, r.text)[4]) for r in docs.collect())
    assert fim.restore(fim.fill_in_middle(empty(spark))).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, marks=("<PRE>", "<S>", "<M>"))


def test_query(spark):
    got = QUERIES["op12_fill_in_middle"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    made = [(d.doc_id, *plain_python(d.doc_id, d.text), d.text or "") for d in docs]
    assert sorted(tuple(r) for r in got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()) == sorted((*m[:5], sha(m[5]), sha(m[6])) for m in made)
