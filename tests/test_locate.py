"""Located words against a sequential version."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa

from strata.functions import sequences
from strata.operators import locate
from strata.plans import version_queries as vq

SF = "/root/testdata/sf0.001"


def one_by_one(element, page):
    """Places of an element's words on its page: unique words in order, grown to the right and then to the left, then equal gaps."""
    norm = lambda t: [(m[0].replace("’", "'").replace("ﬁ", "fi"), m.start(), m.end()) for m in re.finditer(r"\S+", t)]
    a, b = norm(element), norm(page)
    na, nb = Counter(w for w, *_ in a), Counter(w for w, *_ in b)
    where = {w: k for k, (w, *_) in enumerate(b)}
    met = [(n, where[w]) for n, (w, *_) in enumerate(a) if na[w] == nb[w] == 1]
    kept = [met[k] for k in sequences.longest_increasing([v for _, v in met])]
    found = dict(kept)
    for k, (n, v) in enumerate(kept):
        stop = kept[k + 1] if k + 1 < len(kept) else (len(a), len(b))
        while n + 1 < stop[0] and v + 1 <= stop[1] and v + 1 < len(b) and a[n + 1][0] == b[v + 1][0]:
            n, v = n + 1, v + 1
            found[n] = v
    for k, (n, v) in enumerate(kept):
        low = max((found[x] for x in found if x < n and (k == 0 or x >= kept[k - 1][0])), default=-1) if k else -1
        stop = kept[k - 1][0] if k else -1
        while n - 1 > stop and n - 1 not in found and v - 1 > low and a[n - 1][0] == b[v - 1][0]:
            n, v = n - 1, v - 1
            found[n] = v
    how = {n: "exact" for n in found}
    sure = sorted(found.items())
    for (n, v), (m, w) in zip(sure, sure[1:], strict=False):
        if m - n == w - v:
            for d in range(1, m - n):
                if SequenceMatcher(None, a[n + d][0].casefold(), b[v + d][0].casefold()).ratio() >= 0.75:
                    found[n + d], how[n + d] = v + d, "alike"
    return [(n, *(b[found[n]][1:] if n in found else (None, None)), how.get(n)) for n in range(len(a))]


def test_words_are_located_as_one_by_one(spark):
    elements, pages = vq.written_pages(spark, SF)
    text = {r.conv_id: r.text for r in pages.collect()}
    got = {}
    for r in locate.located(elements, pages, "conv_id", "turn").collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.n, r.lo, r.hi, r.how))
    want = {(r.conv_id, r.turn): one_by_one(r.text, text[r.conv_id]) for r in elements.collect()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    told = Counter(x[3] for v in want.values() for x in v)
    assert told["exact"] > 0.6 * sum(told.values()) and told["alike"] > 50


def test_odd_elements(spark):
    rows = [(1, 1, "x y z a b c"), (1, 2, None), (1, 3, "p q r"), (1, 4, "a b b a"), (2, 1, "alone"), (1, 5, "it’s ﬁne Here")]
    pages = spark.createDataFrame([(1, "a b c x y z\n it's fine here"), (3, "")], "g long, text string")
    got = {}
    for r in locate.located(spark.createDataFrame(rows, "g long, k long, text string"), pages, "g", "k").collect():
        got.setdefault((r.g, r.k), []).append((r.n, r.lo, r.hi, r.how))
    page = {1: "a b c x y z\n it's fine here"}
    assert {k: sorted(v) for k, v in got.items()} == {(g, k): one_by_one(t or "", page.get(g, "")) for g, k, t in rows if t}
    assert locate.blocks(locate.located(spark.createDataFrame([], "g long, k long, text string"), pages, "g", "k"), "g", "k").count() == 0


def test_few_words_are_held_at_once(monkeypatch):
    """Words leave in bounded batches, within a text as well."""
    monkeypatch.setattr(locate, "AT_ONCE", 40)
    counts = (0, 130, 40, 3, 0)
    texts = [" ".join(f"w{k}’" for k in range(n)) for n in counts[:-1]] + [None]
    batch = pa.RecordBatch.from_pydict({"g": range(len(texts)), "__text": texts})
    made = list(locate.word_batches(iter([batch]), ["g"]))
    rows = [tuple(r.values()) for x in made for r in x.to_pylist()]
    assert [r[:3] for r in rows] == [(g, k, f"w{k}'") for g, n in enumerate(counts) for k in range(n)]
    assert all(texts[g][a:b] == f"w{k}’" for g, k, _, a, b in rows)
    assert max(x.num_rows for x in made) == 40


def test_query(spark):
    got = {(r.conv_id, r.turn): (r.lo, r.hi, round(r.score, 6)) for r in vq.j30_located_words(spark, SF).collect()}
    elements, pages = vq.written_pages(spark, SF)
    text = {r.conv_id: r.text for r in pages.collect()}
    for r in elements.collect():
        found = one_by_one(r.text, text[r.conv_id])
        if found:
            some = [x for x in found if x[3]]
            worth = sum(1.0 if x[3] == "exact" else 0.5 for x in some) / len(found)
            assert got[r.conv_id, r.turn] == (min((x[1] for x in some), default=None), max((x[2] for x in some), default=None), round(worth, 6))


def test_no_word_is_dealt_out(spark):
    """Elements and pages are dealt by page as texts, each once; what has a row for each word comes after all that is dealt."""
    df = locate.located(*vq.written_pages(spark, SF), "conv_id", "turn")
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("- Exchange ") == plan.count("- Exchange hashpartitioning(conv_id") == 2
    assert plan.count("MapInArrow") == 1 and plan.index("MapInArrow") < plan.index("Exchange ")


def test_few_places_are_held_at_once(monkeypatch):
    monkeypatch.setattr(locate, "AT_ONCE", 40)
    page = " ".join(f"w{k}" for k in range(130))
    texts = [page, None, " ".join(page.split()[30:]), "", "w5"]
    rows = {"g": [1, 2], "__elements": [[{"__key": k, "__text": t} for k, t in enumerate(texts)], [{"__key": 9, "__text": "w7 alone"}]], "__page": [page, None]}
    made = list(locate.place_batches(iter([pa.RecordBatch.from_pydict(rows)]), "g", "k"))
    got = [tuple(r.values()) for x in made for r in x.to_pylist()]
    assert got == [(1, k, *x) for k, t in enumerate(texts) for x in one_by_one(t or "", page)] + [(2, 9, n, None, None, None) for n in range(2)]
    assert max(x.num_rows for x in made) < 80


def test_slices_of_a_page_find_the_same(spark, monkeypatch):
    """However many slices a page's elements are dealt in."""
    r = random.Random(7)
    pages = [(g, " ".join(r.choice("abcdefghijklmnopqrstuvwxyzéﬁ’") * r.choice((1, 1, 2)) for _ in range(r.choice((0, 1, 30, 60))))) for g in range(12)]
    rows = []
    for g, text in pages:
        for k in range(12):
            words = [w for w in text.split() if r.random() > 0.2]
            words = [w + r.choice("xyz") if r.random() < 0.2 else w for w in words]
            r.random() < 0.3 and r.shuffle(words)
            rows.append((g, k, r.choice((" ", "\n ")).join(words)))
    found = []
    for size in (1 << 20, 40, 1):
        monkeypatch.setattr(locate, "SLICE", size)
        df = locate.located(spark.createDataFrame(rows, "g long, k long, text string"), spark.createDataFrame(pages, "g long, text string"), "g", "k")
        got = {}
        for x in df.collect():
            got.setdefault((x.g, x.k), []).append((x.n, x.lo, x.hi, x.how))
        found.append({k: sorted(v) for k, v in got.items()})
    text = dict(pages)
    assert found[0] == {(g, k): w for g, k, t in rows if (w := one_by_one(t, text[g]))}
    assert found[1:] == found[:1] * 2


def test_turns_are_dealt_once(spark):
    df = vq.j30_located_words(spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("- Exchange hashpartitioning(conv_id") == 2 and plan.count("ReusedExchange") == 1  # the other deals the rows returned
