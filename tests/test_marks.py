"""Styled texts merged three ways, held letter by letter."""

import random
from collections import defaultdict

from strata.functions import sequences
from strata.operators import marks
from strata.plans import version_queries as vq

SF = "/root/testdata/sf0.001"
TEXTS, MARKS = "k long, base string, ours string, theirs string", "k long, side string, mark long, prop string, value string, start long, stop long"


def by_letter(texts, found):
    """For each text its merged letters' values by property, and what is told."""
    of = defaultdict(lambda: defaultdict(list))
    for k, side, _, prop, value, start, stop in found:
        if value is not None and stop > start:
            of[k][side].append((prop, value, start, stop))
    final, told = {}, set()
    for k, *sides in texts:
        sides = dict(zip(marks.SIDES, (t or "" for t in sides), strict=True))
        merged = marks.merged_text(*sides.values())[0]
        origin = {s: {} for s in sides}  # letter of the merged text: the side's letter
        for s, t in sides.items():
            for i, j, at in marks.shared_stretches(t, merged):
                assert t[i:j] == merged[at : at + j - i]
                origin[s].update({at + x: i + x for x in range(j - i)})
        for prop in {p for m in of[k].values() for p, *_ in m}:
            style = {s: {x: max(v for p, v, a, b in of[k][s] if p == prop and a <= i < b) for x, i in origin[s].items() if any(p == prop and a <= i < b for p, _, a, b in of[k][s])} for s in sides}
            for x in range(len(merged)):
                b, o, t = (style[s].get(x) for s in marks.SIDES)
                has = {s: x in origin[s] for s in sides}
                if has["theirs"]:
                    value = o if all(has.values()) and t == b else t
                    if all(has.values()) and len({b, o, t}) == 3:
                        told.add((k, "clash", prop, x))
                else:
                    value = o if has["ours"] else b
                if value is not None:
                    final[k, prop, x] = value
        for s in ("ours", "theirs"):
            letters = {i for x, i in origin[s].items() if not merged[x].isspace()}
            told |= {(k, f"lost_{s}", p, a, b, v) for p, v, a, b in of[k][s] if not letters & set(range(a, b))}
    return final, told


def check(texts, found, final, told):
    want, want_told = by_letter(texts, found)
    got = {}
    for r in final:
        assert r.at < r.to
        for x in range(r.at, r.to):
            assert (r[0], r.prop, x) not in got
            got[r[0], r.prop, x] = r.value
    assert got == want
    assert {(r[0], r.what, r.prop, x) for r in told if r.what == "clash" for x in range(r.at, r.to)} == {w for w in want_told if w[1] == "clash"}
    assert {(r[0], r.what, r.prop, r.at, r.to, r.ours or r.theirs) for r in told if r.what != "clash"} == {w for w in want_told if w[1] != "clash"}
    # neighbours of one value are one mark
    ends = {(r[0], r.prop, r.to): r.value for r in final}
    assert not [r for r in final if ends.get((r[0], r.prop, r.at)) == r.value]


def test_merges_of_what_differs_equal_whole_merges():
    """Where no word occurs twice, nothing depends on what is left out."""
    r = random.Random(1)
    same = 0
    for k in range(400):
        lines = [[f"w{i}x{j}" for j in range(r.randint(1, 6))] for i in range(r.choice([1, 1, 4]))]
        versions = []
        for v in range(3):
            mine = [list(x) for x in lines]
            for _ in range(r.randint(0, 2) if v else 0):
                row = r.choice(mine)
                i = r.randrange(len(row) + 1)
                row[i : i + r.randint(0, 1)] = r.choice([[], [f"new{v}"]])
            versions.append("\n".join(" ".join(x) for x in mine))
        merged, clashes = marks.merged_text(*versions)
        whole, told = sequences.merge_paragraphs(*versions, False)
        same += merged == whole and clashes == len(told)
        assert merged == whole or clashes or told
    assert same > 380
    assert marks.merged_text("", "", "a") == ("a", 0) and marks.merged_text("a\nb\nc", "a\nc", "a\nb\nb2\nc")[1] <= 1


def test_random_styled_texts(spark):
    r = random.Random(8)
    texts, found = [], []
    for k in range(60):
        words = [r.choice(["a", "bb", "ccc", "dd é", "\U0001f600x"]) for _ in range(r.randint(0, 12))]
        versions = []
        for _ in range(3):
            mine = list(words)
            for _ in range(r.randint(0, 2)):
                if mine:
                    i = r.randrange(len(mine))
                    mine[i : i + r.randint(0, 1)] = r.choice([[], ["new"], ["one", "more"]])
            versions.append(" ".join(mine))
        texts.append((k, *versions))
        for side, t in zip(marks.SIDES, versions, strict=True):
            n = 0
            for prop in ("bold", "size"):
                at = 0
                while len(t) - at > 1 and r.random() < 0.8:
                    a = r.randint(at, len(t) - 1)
                    b = r.randint(a, min(len(t), a + 9))
                    found.append((k, side, n, prop, r.choice(["1", "2", None]), a, b))
                    at, n = b, n + 1
    texts.append((99, None, None, None))
    got = marks.merge_styled(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(found, MARKS), "k")
    check(texts, found, got[1].collect(), got[2].collect())
    assert {x.k for x in got[0].collect()} == {t[0] for t in texts}


def test_marks_of_both_sides_survive(spark):
    text = "the quick brown fox jumps"
    texts = [(1, text, "the quick red brown fox jumps", "the quick brown fox leaps")]
    found = [(1, "ours", 1, "bold", "yes", 4, 9), (1, "theirs", 1, "italic", "yes", 16, 19), (1, "theirs", 2, "bold", "yes", 20, 25), (1, "base", 1, "size", "9", 20, 25), (1, "ours", 2, "size", "9", 24, 29)]
    merged, final, told = marks.merge_styled(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(found, MARKS), "k")
    assert [r.merged for r in merged.collect()] == ["the quick red brown fox leaps"]
    assert {(r.prop, r.value, r.at, r.to) for r in final.collect()} == {("bold", "yes", 4, 9), ("italic", "yes", 20, 23), ("bold", "yes", 24, 29)}
    assert {(r.what, r.prop, r.at, r.to) for r in told.collect()} == {("lost_ours", "size", 24, 29)}


def test_nothing_to_merge(spark):
    none = marks.merge_styled(spark.createDataFrame([], TEXTS), spark.createDataFrame([], MARKS), "k")
    assert [x.count() for x in none] == [0, 0, 0]
    plain = marks.merge_styled(spark.createDataFrame([(1, "a b", "a b", "a c")], TEXTS), spark.createDataFrame([], MARKS), "k")
    assert plain[0].collect()[0].merged == "a c" and plain[1].count() == plain[2].count() == 0


def test_queries_equal_letters(spark):
    texts, found = (df.collect() for df in vq.styled_versions(spark, SF))
    rows = [(r.block, r.side, r.mark, r.prop, r.value, r.start, r.stop) for r in found]
    final, told = vq.m10_block_marks(spark, SF).collect(), vq.m21_styling_told(spark, SF).collect()
    check([(r.block, r.base, r.ours, r.theirs) for r in texts], rows, final, told)
    assert {r.what for r in told} >= {"clash", "lost_theirs"} and {r.prop for r in final} == {"bold", "colour"}
