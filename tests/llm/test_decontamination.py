import random

import pytest
from edge import ROWS, awkward, empty

from strata.llm import decontamination as D
from strata.llm import queries
from strata.llm.common import table

SF = "/root/testdata/sf0.001"


def distance(s, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(s, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(r, text, edits, letters="abcdefgh "):
    t = list(text)
    for _ in range(edits):
        k, op = r.randint(0, len(t)), r.choice("isd")
        if op == "i":
            t.insert(k, r.choice(letters))
        elif k < len(t):
            t[k : k + 1] = [r.choice(letters)] if op == "s" else []
    return "".join(t)


def test_banded_distance_equals_the_full_table():
    r = random.Random(4)
    for _ in range(1500):
        s = "".join(r.choice("abc") for _ in range(r.randint(1, 30)))
        t = "z" * r.randint(0, 3) + edited(r, s, r.randint(0, 4), "abcx") + "z" * r.randint(0, 3)
        e = r.randint(0, 4)
        want, got = distance(s, t), D.banded_distance(s, t, e)
        assert (got is None and want > e) or got == want


def brute(items, texts):
    out = []
    for t in texts:
        t, found = D.normal(t), {}
        for k, item in enumerate(items.texts):
            best = [distance(item[a : a + n], t) for a, n in items.segments(k)]
            fit = [d for d, (_, n) in zip(best, items.segments(k), strict=True) if d <= D.budget(n)]
            if fit:
                found[items.ids[k]] = min(fit)
        out.append(sorted(found.items()))
    return out


def test_leaks_equal_brute_force_with_edits():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(r.choice([3, 8, 14, 30])))) for i in range(12)]
    index = D.Index(items)
    texts = []
    for _ in range(60):
        _, item = r.choice(items)
        cut = r.choice([item, item[: len(item) // 2]])
        texts.append(" ".join(word() for _ in range(20)) + "\n " + edited(r, cut, int(len(cut) * r.choice([0, 0.03, 0.07, 0.15]))) + " " + " ".join(word() for _ in range(20)))
    want = brute(index, texts)
    assert index.leaks(texts) == want and any(want) and not all(want)


def test_query_finds_every_planted_item(spark):
    items = {r.item_id: D.normal(r.text) for r in table(spark, SF, "benchmark").collect()}
    got = {r.doc_id: r for r in queries.op7_decontamination(spark, SF).collect()}
    for r in table(spark, SF, "documents").collect():
        whole = {i for i, x in items.items() if x in D.normal(r.text)}
        assert whole <= set(got[r.doc_id].item_ids)
        assert got[r.doc_id].leaked == bool(got[r.doc_id].item_ids)
    assert any(r.leaked for r in got.values())


def test_chunks_awkward_rows_and_names(spark):
    items = spark.createDataFrame([(1, ROWS[0][1]), (2, None), (3, ""), (4, "one"), (None, "x"), (1, ROWS[0][1]), (5, "lorem " * 40)], "item_id long, text string")
    plain = D.with_leaks(awkward(spark).drop("leaks"), items)
    found = [(r.doc_id, [x.item_id for x in r.leaks]) for r in plain.collect()]
    assert sorted(x for i, x in found if i == 6) == [[1], [1]] and (2, []) in found and (3, []) in found and (5, [4]) in found
    old, D.CHUNK = D.CHUNK, 50
    try:
        assert sorted(map(str, D.with_leaks(awkward(spark).drop("leaks"), items).collect())) == sorted(map(str, plain.collect()))
    finally:
        D.CHUNK = old
    kept = D.drop_leaked(awkward(spark), items)
    assert kept.columns == awkward(spark).columns and {r.doc_id for r in kept.collect()} >= {2, 3, None} and 1 not in {r.doc_id for r in kept.collect()}
    assert D.drop_leaked(empty(spark), items).count() == 0
    assert D.drop_leaked(awkward(spark), items.limit(0)).count() == len(ROWS)


def test_partial_passages_at_every_offset():
    r = random.Random(5)
    item = " ".join("".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 9))) for _ in range(60))
    index = D.Index([(1, item)])
    need = D.SEGMENT + D.STRIDE
    for at in range(len(item) - need):
        assert index.leaks(["qqq " * 5 + "|" + item[at : at + need] + "| " + "rrr " * 5])[0] == [(1, 0)]


def test_tiles_change_nothing():
    r = random.Random(9)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(r.choice([8, 40, 300])))) for i in range(8)]
    texts = []
    for _ in range(12):
        _, item = r.choice(items)
        at = r.randrange(len(item))
        texts.append(" ".join(word() for _ in range(200)) + " " + edited(r, item[at : at + 120], r.randint(0, 9), "ab ") + " " + " ".join(word() for _ in range(100)))
    whole, tiled = D.Index(items), D.Index(items, tile=3000)
    assert whole.leaks(texts) == tiled.leaks(texts) and any(whole.leaks(texts))


def test_one_letter_texts_stay_within_a_tile():
    import tracemalloc

    index = D.Index([(1, "a" * 4000), (2, "ab" * 2000), (3, "x" * 300)])
    tracemalloc.start()
    got = index.leaks(["a" * 20_000, "ba" * 9000 + "c", "a" * 79 + "b" * 500])
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert got == [[(1, 0)], [(2, 0)], [(1, 1)]]


def test_ids_of_other_kinds_and_chunks(spark):
    items = spark.createDataFrame([("x-1", ROWS[0][1]), ("y", "lorem ipsum dolor +1 (234) 555-7890 " * 4)], "item_id string, text string")
    docs = awkward(spark).drop("leaks")
    old = D.CHUNK
    for D.CHUNK in (old, 60):
        got = {r.doc_id: [x.item_id for x in r.leaks] for r in D.with_leaks(docs, items).collect()}
        assert got[1] == ["x-1"] and got[7] == ["y"] and got[5] == []
    D.CHUNK = old


@pytest.mark.parametrize(("first", "last"), [(0x4E00, 0x9FFF), (0x410, 0x44F), (0xAC00, 0xD7A3), (0x1F300, 0x1F5FF)])
def test_every_script_has_its_own_grams(first, last):
    """Unrelated texts of a script share hardly a q-gram, so nothing of them is aligned; a planted passage is found."""
    r = random.Random(first)
    script = lambda n: "".join(chr(r.randint(first, last)) for _ in range(n))
    item, text = script(2000), script(10_000)
    index = D.Index([(1, item)])
    aligned = []
    index._align = lambda *a: aligned.append(a)
    assert index.leaks([text]) == [[]] and not aligned
    planted = item[500:590][:40] + chr(first) + item[500:590][41:]
    assert D.Index([(1, item)]).leaks([text[:3000] + planted + text[3000:], text]) == [[(1, 1 if planted != item[500:590] else 0)], []]


def test_texts_of_one_id_in_several_chunks(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "pack my box with five dozen liquor jugs now", "how vexingly quick daft zebras jump in there"]
    bench = spark.createDataFrame([(7, t) for t in texts] + [(8, texts[0])], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {texts[0]} b {texts[1][:-1]}x"), (2, "nothing of it")], "doc_id long, text string")
    old, D.CHUNK = D.CHUNK, 30
    try:
        got = {x.doc_id: [tuple(y) for y in x.leaks] for x in D.with_leaks(docs, bench).collect()}
    finally:
        D.CHUNK = old
    assert got == {1: [(7, 0), (8, 0)], 2: []}
