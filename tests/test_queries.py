import hashlib

import pytest

from strata import catalog
from strata.functions import sequences as seq
from strata.plans import resolve_queries
from strata.sources.tables import table

from oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], SF) > 0


def rows_of(spark, name):
    got = [r.asDict() for r in catalog.QUERIES[name](spark, SF).collect()]
    assert got
    return got


def turns(spark):
    return {(r.conv_id, r.turn): r.text for r in table(spark, SF, "conversations").collect()}


def test_every_query_without_sql_has_a_value_test():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"j5_paragraph_pairs", "q11_greedy_match", "q18_alignment", "j27_filled_alignment", "c10_edit_scripts", "q19_text_merge", "s11_html_round_trip", "h1_html_blocks", "h2_stray_words", "w9_paragraphs", "j29_foreign_pairs", "j26_weak_alignment", "o8_order_merge", "m10_block_marks", "m21_styling_told", "j30_located_words", "a27_trimmed_fit", "w3_column_grid", "j32_over_holes"}


def test_paragraph_pairs_equal_sequential_greedy(spark):
    text = {c * 1000 + t: (c, x) for (c, t), x in turns(spark).items()}
    scored = [(seq.word_ratio(x, y + " indeed"), a, b) for a, (c, x) in text.items() for b, (d, y) in text.items() if c == d and b % 5]
    want = {(a, b): round(s, 6) for a, b, s in seq.greedy_pairs(scored, 0.34)}
    assert {(r["a"], r["b"]): r["score"] for r in rows_of(spark, "j5_paragraph_pairs")} == pytest.approx(want)


def test_part_names_equal_sequential_greedy(spark):
    scored = [(r.score, r.a, r.b) for r in resolve_queries._part_names(spark, SF).collect()]
    assert {(r["a"], r["b"], r["score"]) for r in rows_of(spark, "q11_greedy_match")} == set(seq.greedy_pairs(scored, 0.35))


@pytest.mark.parametrize(("name", "fill"), [("q18_alignment", False), ("j27_filled_alignment", True)])
def test_alignments_keep_order_and_have_the_largest_sum(spark, name, fill):
    every, got = turns(spark), {}
    for r in rows_of(spark, name):
        got.setdefault(r["conv_id"], []).append((r["a_pos"], r["b_pos"], r["similarity"]))
    for conv in {c for c, _ in every}:
        a = {t: x for (c, t), x in sorted(every.items()) if c == conv}
        b = {t: ("said anew throughout" if fill and t % 4 == 1 else x + " and more of it" if not fill and t % 4 == 0 else x) for t, x in a.items() if (conv + t) % 6}
        assert sorted(p[0] for p in got[conv] if p[0] is not None) == list(a) and sorted(p[1] for p in got[conv] if p[1] is not None) == list(b)
        both = sorted(p for p in got[conv] if p[0] is not None and p[1] is not None)
        assert [p[1] for p in both] == sorted(p[1] for p in both)
        assert all(s == pytest.approx(seq.word_ratio(a[i], b[j]), abs=1e-6) for i, j, s in both)
        worth = {}
        for i, x in reversed(a.items()):
            for j, y in reversed(b.items()):
                after = max((v for (p, q), v in worth.items() if p > i and q > j), default=0.0)
                s = seq.word_ratio(x, y)
                worth[i, j] = s + after if s >= 0.5 else 0.0
        assert sum(s for _, _, s in both if s >= 0.5) == pytest.approx(max(worth.values(), default=0.0), abs=1e-4)


def test_edit_scripts_and_merged_texts(spark):
    assert all(r["round_trip"] and r["n_ops"] > 0 for r in rows_of(spark, "c10_edit_scripts"))
    docs = {r.doc_id: r.text.split("\n") for r in table(spark, SF, "documents").collect()}
    checked = 0
    for r in rows_of(spark, "q19_text_merge"):
        base = docs[r["doc_id"]]
        n = len(base) - 1 if len(base) > 3 else len(base)
        if n > 1 and r["conflicts"] == 0 and not any(k % 35 == 1 for k in range(len(base))):
            # each line was touched by one side at most
            want = [x.upper() if k % 7 == 1 else x + " (ours)" if k % 5 == 1 else x for k, x in enumerate(base[:n])]
            assert r["merged_sha256"] == hashlib.sha256("\n".join(want).encode()).hexdigest()
        if len(base) == 1:
            assert r["merged_sha256"] == hashlib.sha256(base[0].encode()).hexdigest() and r["conflicts"] == 0
            checked += 1
    assert checked


def test_html_queries(spark):
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    blocks = {}
    for r in rows_of(spark, "h1_html_blocks"):
        blocks.setdefault(r["page_id"], []).append(r["pos"])
    assert set(blocks) <= set(pages) and all(len(set(p)) == len(p) for p in blocks.values())
    assert all(r["n_same"] == r["n_blocks"] for r in rows_of(spark, "s11_html_round_trip"))
    for r in catalog.QUERIES["h2_stray_words"](spark, SF).collect():
        assert r.page_id in pages


def test_paragraphs_hold_lines(spark):
    assert rows_of(spark, "w9_paragraphs")
