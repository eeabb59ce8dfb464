import hashlib
import itertools
import random

import pytest
from edge import ROWS, awkward, empty

from strata.llm import queries
from strata.llm import sentencepiece_codec as S
from strata.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return S.load()


@pytest.fixture(scope="module")
def summed():
    """The same pieces with their scores taken as log-probabilities."""
    return S.load(merges=False)


def brute(v, text, reach=16):
    """Viterbi over the whole text at once, with the pieces of the file before any are left out."""
    n = len(text)
    best, back = [0.0] + [float("-inf")] * n, [None] * (n + 1)
    for i in range(n):
        for j in range(i + 1, min(n, i + reach) + 1):
            p = v.get(text[i:j]) or ((S.UNKNOWN, -1) if j == i + 1 else None)
            if p and best[i] + p[0] > best[j]:
                best[j], back[j] = best[i] + p[0], i
    cuts = [n]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]



def texts_for(r):
    return ["".join(r.choice("aaabther \n▁é梦\U0001f600") for _ in range(r.randint(0, 120))) for _ in range(150)] + ["", " ", "  ", "▁", " ▁ ", "a" * 3000, "ab" * 1500, "    x    ", "-" * 777]


def test_ids_are_the_librarys(spark, vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    texts = [t for t in texts_for(random.Random(3)) if S.SPACE not in t] + [r.text for r in table(spark, SF, "documents").collect() if S.SPACE not in r.text]
    for t in texts:
        ids = vocabulary.encode(t)
        assert ids == sp.encode(t) and vocabulary.decode(ids) == t
        if t:
            assert vocabulary.search(S.SPACE + t.replace(" ", S.SPACE)) == ids


def test_summed_scores_equal_another_unigram_encoder():
    import tokenizers

    r = random.Random(7)
    pieces = {"".join(r.choice("abcd") for _ in range(r.randint(2, 5))) for _ in range(120)}
    rows = [("<unk>", -30.0), *((c, -6.0 - r.random()) for c in "abcd"), *((p, -4.0 - 6 * r.random()) for p in sorted(pieces))]
    other = tokenizers.Tokenizer(tokenizers.models.Unigram(rows, unk_id=0))
    mine = S.Vocabulary([(p, v, "normal" if k else "other") for k, (p, v) in enumerate(rows)], merges=False)
    for _ in range(300):
        t = "".join(r.choice("abcd") for _ in range(r.choice([3, 20, 300])))
        worth = lambda ids: sum(rows[i][1] for i in ids)  # noqa: E731  (of paths of one worth either may be taken)
        assert abs(worth(mine.search(t)) - worth(other.encode(t).ids)) < 1e-6


def test_ids_have_the_best_score_and_round_trip(summed):
    import sentencepiece

    vocabulary = summed

    sp = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    every = {sp.id_to_piece(i): (sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    for t in texts_for(random.Random(3)):
        ids = vocabulary.encode(t)
        assert vocabulary.decode(ids) == t
        if t and S.SPACE not in t:
            whole = S.SPACE + t.replace(" ", S.SPACE)
            cuts = brute(every, whole)
            want = sum(every.get(whole[a:b], (S.UNKNOWN,))[0] for a, b in zip(cuts, cuts[1:]))
            streamed = vocabulary.search(whole)
            assert streamed == ids
            at, total = 0, 0.0
            k = 0
            while k < len(ids):
                raw = vocabulary.by_id[ids[k]]
                if ids[k] in vocabulary.byte_ids:
                    c = whole[at]
                    k += len(c.encode())
                    total += S.UNKNOWN
                    at += 1
                else:
                    total += sp.get_score(ids[k])
                    at += len(raw.decode())
                    k += 1
            assert at == len(whole) and abs(total - want) < 1e-3 * max(1, abs(want) * 1e-9)


def test_window_stays_bounded(vocabulary, summed):
    for v in (vocabulary, summed):
        seen = []
        v.search("ab" * 20_000, lambda at, shared: seen.append(at))  # noqa: B023
        assert seen and max(seen) <= 8 * v.longest


def test_query_and_data_frames(spark, vocabulary):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op10_sentencepiece(spark, SF).collect():
        assert r.round_trip and r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_ids > 0
    back = S.decode_documents(S.encode_documents(docs, vocabulary), vocabulary)
    assert {r.doc_id: r.text for r in back.collect()} == texts


def test_awkward_rows(spark, vocabulary):
    got = S.encode_digest(awkward(spark), vocabulary).collect()
    assert len(got) == len(ROWS)
    assert all(r.n_ids == 0 for r in got if r.doc_id in (2, 3))
    assert all(r.round_trip for r in got)
    assert S.encode_documents(empty(spark), vocabulary).count() == 0


def test_pieces_side_by_side_are_judged_once(monkeypatch):
    v, calls = S.Vocabulary([("a", 0.0, "normal"), ("b", 0.0, "normal"), ("ab", -1.0, "normal"), ("aab", -2.0, "normal"), (S.SPACE, 0.0, "normal")]), []
    fits = v.fits
    monkeypatch.setattr(v, "fits", lambda a, b: calls.append((a, b)) or fits(a, b))
    words = ["".join(w) for w in itertools.product("ab", repeat=6)]
    got = [v._short_merged(S.SPACE + w) for w in words]
    assert len(calls) == len(set(calls))
    monkeypatch.setattr(S, "PAIRS", 2)
    v.beside.clear()
    assert [v._short_merged(S.SPACE + w) for w in words] == got == [v.search(S.SPACE + w) for w in words]


def test_remembered_words_are_few():
    """What a worker remembers stays beside an executor's other memory while later stages run."""
    memo = S.Memo(lambda key: (1, 2))
    for k in range(700_000):
        memo.find(f"word{k}")
    assert memo.find("word699999") == (1, 2) and len(memo.young) + len(memo.old) <= 400_000


def test_a_word_is_searched_in_few_steps(spark):
    v, asked = S.Vocabulary.__new__(S.Vocabulary), []
    v.__setstate__(S.load().__getstate__())

    class Counted(dict):
        def get(self, *key):
            asked.append(key)
            return super().get(*key)

    v.starts = Counted(v.starts)
    words = sorted({w for r in table(spark, SF, "documents").collect() for w in r.text.split() if S.SPACE not in w and len(w) < S.SHORT})
    for w in words:
        assert v._short_merged(S.SPACE + w) == v.search(S.SPACE + w)
    asked.clear()
    for w in words:
        v._short_merged(S.SPACE + w)
    assert len(asked) < 3 * sum(len(w) + 1 for w in words)
