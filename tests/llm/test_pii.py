import hashlib
import random
import re

import numpy as np
import pytest
from edge import ROWS, awkward, empty

from strata.llm import pii, queries
from strata.llm.common import table

SF = "/root/testdata/sf0.001"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    r = random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choice("0123456789.@+-( )ab%é\n") for _ in range(r.randint(0, 50)))
        assert pii.base_spans(t) == brute(t)


def test_base_spans_take_long_runs():
    for t in ("9" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1(" * 50_000, "a@" * 100_000):
        pii.base_spans(t)


def test_query_equals_brute_force(spark):
    want = {r.doc_id: brute(r.text or "") for r in table(spark, SF, "documents").collect()}
    got = queries.op1_pii(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        spans = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(pii.spell(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert set(pii.spell(spans).split(",")) <= set(r.spans.split(",")) or not spans


def test_model_generalises_and_adds():
    model = pii.default_model()
    fresh = pii.training_examples(300, seed=77)
    wrong = sum(sorted(model.spans(t)) != sorted(g) for t, g in fresh)
    assert wrong / len(fresh) < 0.05
    text = "call (234) 555-7890 or write jo [at] mail [dot] example [dot] org"
    base, every = pii.all_spans(text, model)
    assert base == [] and [s[0] for s in every] == ["phone", "email"]


def test_what_only_looks_like_personal_data_is_left_alone():
    model = pii.default_model()
    for text in ("number 123-45-6789 on file", "see ISBN 978-3-16-148410-0 there", "rose to 12.5 14.7 88.2 91.3 today", "made at 20240101123456 by hand", "of 2019-03-04 and 04.03.2019", "version 1.12.3 of 3.141592653"):
        assert pii.all_spans(text, model)[1] == []


def paths(model, lat, i=0, before=pii.OUTSIDE):
    """Every path from a token on, as (its weight, its entities)."""
    if i == lat.n:
        yield 0.0, ()
        return
    for worth, rest in paths(model, lat, i + 1, pii.OUTSIDE):
        yield worth + model.t[before, pii.OUTSIDE], rest
    for j, features in lat.edges[i]:
        for y, s in enumerate(model.scores(features)):
            for worth, rest in paths(model, lat, j, y):
                yield worth + s + model.t[before, y], ((i, j, y), *rest)


def test_best_path_and_sums_equal_enumeration():
    model = pii.default_model()
    old, rng = model.t.copy(), np.random.default_rng(4)
    try:
        for text in ("1 234 567 8901", "(12)345-6789 a", "x@y.org 1.2.3.4", "+1 23 456 789", "12345678"):
            model.t = rng.normal(size=old.shape) * 2
            lat = pii.Lattice(text)
            every = list(paths(model, lat))
            assert len(every) > 1
            found = tuple(model.best(lat))
            assert max(w for w, _ in every) == pytest.approx(next(w for w, p in every if p == found))
            edges = [[(j, model.scores(f)) for j, f in es] for es in lat.edges]
            to, rest, _ = model.sums(lat.n, edges)
            z = np.logaddexp.reduce([w for w, _ in every])
            assert np.logaddexp.reduce(to[lat.n]) == pytest.approx(z) and rest[0, pii.OUTSIDE] == pytest.approx(z)
    finally:
        model.t = old


def test_gradient_equals_differences():
    model = pii.SemiCrf()
    text, gold = "a 1.2.3.4 b", (2, 9)
    lat = pii.Lattice(text)
    edges = [[(j, [model.index.setdefault(f, len(model.index)) for f in fs], 1 if (lat.cuts[i], lat.cuts[j]) == gold else -1) for j, fs in es] for i, es in enumerate(lat.edges)]
    rng = np.random.default_rng(5)
    model.w, model.t = rng.normal(size=(len(model.index), 4)), rng.normal(size=model.t.shape)

    def likelihood():
        every = list(paths(model, lat))
        want = next(w for w, p in every if [(lat.cuts[i], lat.cuts[j], y) for i, j, y in p] == [(*gold, 1)])
        return want - np.logaddexp.reduce([w for w, _ in every])

    by_edge, pairs = model.gradient(lat.n, edges)
    whole = np.zeros_like(model.w)
    for rows, grad in by_edge:
        np.add.at(whole, rows, grad)
    for field, got in ((model.t, pairs), (model.w, whole)):
        for at in zip(*(rng.integers(0, n, 12) for n in field.shape), strict=True):
            was, here = field[at], likelihood()
            field[at] += 1e-6
            assert (likelihood() - here) / 1e-6 == pytest.approx(got[at], abs=1e-4)
            field[at] = was


def test_windows_do_not_change_the_best_path():
    model, r = pii.default_model(), random.Random(3)
    for _ in range(40):
        text = (" filler" * r.randint(0, 60)).join(t for t, _ in r.sample(pii.training_examples(30, seed=9), 3))
        lat = pii.Lattice(text)
        whole = [(pii.KINDS[y], lat.cuts[i], lat.cuts[j]) for i, j, y in model.best(lat)]
        assert model.spans(text) == whole


def test_awkward_rows_and_redaction(spark):
    got = pii.find_pii(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    assert next(r for r in got if r.doc_id == 7).n_phone == 6000
    assert pii.find_pii(empty(spark)).count() == 0
    clean = pii.redact(awkward(spark))
    assert clean.columns == awkward(spark).columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[2] is None and texts[3] == "" and "@" not in texts[9] and "[EMAIL] [IP] [CARD]" in texts[9]
