"""SentencePiece encoding and decoding with a streaming Viterbi search.

The search reads characters from left to right and keeps back pointers only for the part
of the text that is still undecided.  Ids are committed up to a boundary as soon as every
surviving path runs through it: at once where no piece can cross a position, else by
following the live positions (at most the longest piece's length of them) back to the
boundary they share.  What is kept beside the ids so follows the undecided part, not the text.

For a file of the unigram kind a path's worth is its pieces' summed scores, which are
log-probabilities.  Pieces that can never lie on a best path, because their own characters
split into pieces of a higher total score, are left out beforehand.

A file of the BPE kind has ranks for scores, whose sums mean nothing: there a piece may follow
another only if merging the two's characters in the order of the ranks would leave them side by
side (``fits``), and pieces that merging their own characters doesn't give are left out.  Merges
are local, so such paths are the merge order's own result: every position keeps one way back, and
the ids are the library's.

The file at hand is of the BPE kind.  Tokenizers are never trained here.

Spaces become U+2581 with one in front of the text; a U+2581 in the text itself is spelled
in bytes, as is any character without a piece, so that decoding gives back every text
exactly.  Null counts as empty and has no ids.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import documents

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE, SHORT = 200_000, 48  # texts in each of two generations, and the longest kept
PAIRS = 1 << 19  # pairs of pieces of which it is known whether they may stand side by side
UNKNOWN = -1e10
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Memo:
    """Ids by text in two generations: what is found in the old one moves to the young one, and the old is dropped when the young is full."""

    def __init__(self, make):
        self.make, self.young, self.old = make, {}, {}

    def find(self, key: str) -> tuple[int, ...]:
        ids = self.young.get(key)
        if ids is None:
            ids = self.old.get(key)
            if ids is None:
                ids = self.make(key)
            if len(key) <= SHORT:
                if len(self.young) >= CACHE:
                    self.old, self.young = self.young, {}
                self.young[key] = ids
        return ids


class Vocabulary:
    """Pieces with ids and scores, ready for the search; small, so that it can be sent to every worker."""

    def __init__(self, pieces: list[tuple[str, float, str]], merges: bool = True):
        """``pieces``: by id (text, score, kind), where kind is normal, byte or other.  ``merges``: the scores are negated ranks of merges (BPE), not log-probabilities."""
        self.merges = merges
        self.by_id: list[bytes] = []
        self.byte_ids = [0] * 256
        scored: dict[str, tuple[float, int]] = {}
        for k, (text, score, kind) in enumerate(pieces):
            if kind == "byte":
                self.byte_ids[int(text[3:5], 16)] = k
                self.by_id.append(bytes([int(text[3:5], 16)]))
            elif kind == "normal":
                scored.setdefault(text, (score, k))
                self.by_id.append(text.replace(SPACE, " ").encode())
            else:
                self.by_id.append(b"")
        self.pieces = scored
        if merges:
            self.rank = {p: -v for p, (v, _) in scored.items() if len(p) > 1}
            made = {p: self._merged(p) for p in self.rank}
            self.born = {p: (self.rank[p], *m) for p, m in made.items() if m}  # rank, left and right half of the last merge
            self.pieces = {p: v for p, v in scored.items() if len(p) == 1 or p in self.born}
        else:
            self._index()
            self.pieces = {p: v for p, v in scored.items() if len(p) == 1 or self._needed(p, v[0])}
        self._index()
        self._memos()

    def _merged(self, piece: str) -> tuple[str, str] | None:
        """The halves that merging a piece's characters in the order of the ranks joins last; None if it doesn't end in the piece."""
        parts = list(piece)
        while len(parts) > 2:
            found = [(r, k) for k in range(len(parts) - 1) if (r := self.rank.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                return None
            _, k = min(found)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def fits(self, a: str, b: str) -> bool:
        """Whether two pieces side by side stay so: no two of their parts that met while they grew would have merged first.

        Merges are undone one at a time, the latest first (of equal ranks the right one, as merging goes from the left); the
        parts that touch at each time must not make a piece of a lower rank than the merge that ended them.
        """
        rank, born, until = self.rank, self.born, math.inf
        while True:
            together = rank.get(a + b)
            if together is not None and together < until:
                return False
            x, y = born.get(a), born.get(b)
            if x and (not y or x[0] > y[0]):
                until, a = x[0], x[2]
            elif y:
                until, b = y[0] + 0.5, y[1]
            else:
                return True

    def _index(self) -> None:
        """By each beginning of a piece: its score and id if it is one itself (else None and -1), and whether longer ones go on from it."""
        self.longest = max(map(len, self.pieces), default=1)
        self.inside = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.crosses = any(c[1] == SPACE != c[0] for c in self.inside)
        longer = {p[:n] for p in self.pieces for n in range(1, len(p))}
        self.starts = {p: (*self.pieces.get(p, (None, -1)), p in longer) for p in longer | set(self.pieces)}

    def _needed(self, piece: str, score: float) -> bool:
        best = [0.0] + [-float("inf")] * len(piece)
        for i in range(len(piece)):
            for j in range(i + 1, len(piece) + 1):
                if (i or j < len(piece)) and (v := self.pieces.get(piece[i:j])):
                    best[j] = max(best[j], best[i] + v[0])
        return score >= best[-1]

    def _memos(self) -> None:
        self.stretches = Memo(self._cut)
        self.words = Memo(self._word)
        self.beside: dict[int, bool] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("stretches", "words", "beside")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._memos()

    # -------------------------------------------------------------- encoding

    def search(self, text: str, watch=None) -> list[int]:
        """Ids of a text in which spaces are already U+2581.  ``watch`` is told the window's length at each commit attempt."""
        starts, n = self.starts.get, len(text)
        ids: list[int] = []
        done, before = 0, ""  # committed up to here, and the piece that ends here; the lists below begin here
        score, back, piece = [0.0], [0], [-1]
        furthest = 0
        look = 4 * self.longest
        for i in range(n):
            at = i - done
            if i and furthest <= i:
                ids += self._path(text, done, back, piece, at)
                before = text[done + back[at] : i] if at else before
                done, at, score, back, piece = i, 0, [0.0], [0], [-1]
                look = 4 * self.longest
            elif at >= look:
                shared = self._shared(back, at, furthest - done)
                if watch:
                    watch(at, shared)
                if shared:
                    ids += self._path(text, done, back, piece, shared)
                    before = text[done + back[shared] : done + shared]
                    done += shared
                    at -= shared
                    score, back, piece = score[shared:], [b - shared for b in back[shared:]], piece[shared:]
                look = at + 4 * self.longest
            base = score[at]
            last = text[done + back[at] : i] if at else before
            for j in range(i + 1, n + 1):
                found = starts(text[i:j])
                value, which = (found[0], found[1]) if found else (None, -1)
                if value is None and j == i + 1:
                    value, which = UNKNOWN, -1
                if value is not None and self.merges:
                    value = 0.0 if not i or self.fits(last, text[i:j]) else None
                if value is not None:
                    if j > furthest:
                        furthest = j
                    k = j - done
                    while len(score) <= k:
                        score.append(-float("inf"))
                        back.append(0)
                        piece.append(-1)
                    if base + value > score[k]:
                        score[k], back[k], piece[k] = base + value, at, which
                if not found or not found[2]:
                    break
        if n > done:
            ids += self._path(text, done, back, piece, n - done)
        return ids

    def _short(self, text: str) -> list[int]:
        """``search`` for a text no longer than the window, where nothing can be committed early."""
        if self.merges:
            return self._short_merged(text)
        starts, n = self.starts.get, len(text)
        score, back, piece = [-1e300] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        for i in range(n):
            base = score[i]
            for j in range(i + 1, n + 1):
                found = starts(text[i:j])
                value, which = (found[0], found[1]) if found else (None, -1)
                if value is None and j == i + 1:
                    value = UNKNOWN
                if value is not None and base + value > score[j]:
                    score[j], back[j], piece[j] = base + value, i, which
                if not found or not found[2]:
                    break
        return self._path(text, 0, back, piece, n)

    def _short_merged(self, text: str) -> list[int]:
        """Longest pieces first, going back where none fits: as only one path of fitting pieces leads to the end, it is the one found."""
        starts, known, n = self.starts.get, self.beside.get, len(text)
        path: list[tuple[int, int, list[tuple[int, int]]]] = []  # where each piece begins, its id, and the shorter ones not tried
        dead: set[int] = set()  # positions that lead nowhere
        at, left = 0, None
        while at < n:
            if left is None:
                left, j = [], at
                while j < n:
                    j += 1
                    found = starts(text[at:j])
                    if not found:
                        if j == at + 1:
                            left.append((j, -1))
                        break
                    if found[1] >= 0 or j == at + 1:
                        left.append((j, found[1]))
                    if not found[2]:
                        break
            while left:
                j, which = left.pop()
                if j in dead:
                    continue
                if path:
                    begin, before, _ = path[-1]
                    pair = before << 32 | which if before >= 0 and which >= 0 else -1
                    fits = known(pair) if pair >= 0 else self.fits(text[begin:at], text[at:j])
                    if fits is None:
                        if len(self.beside) >= PAIRS:
                            self.beside.clear()
                        fits = self.beside[pair] = self.fits(text[begin:at], text[at:j])
                    if not fits:
                        continue
                path.append((at, which, left))
                at, left = j, None
                break
            else:
                dead.add(at)
                at, _, left = path.pop()
        out: list[int] = []
        for begin, which, _ in path:
            if which >= 0:
                out.append(which)
            else:
                out += [self.byte_ids[b] for b in text[begin].encode()]
        return out

    @staticmethod
    def _shared(back: list[int], at: int, furthest: int) -> int:
        """The last boundary on all paths to the live positions: ``at`` and those a piece from before it reaches."""
        live = {at} | {j for j in range(at + 1, min(furthest + 1, len(back))) if back[j] < at}
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(back[last])
        return min(live.pop(), at)

    def _path(self, text: str, done: int, back: list[int], piece: list[int], stop: int) -> list[int]:
        out: list[int] = []
        while stop:
            k, which = back[stop], piece[stop]
            if which >= 0:
                out.append(which)
            else:
                out += [self.byte_ids[b] for b in reversed(text[done + k : done + stop].encode())]
            stop = k
        out.reverse()
        return out

    def _cut(self, stretch: str) -> tuple[int, ...]:
        """A stretch is cut where no piece crosses, which is where the search would commit."""
        inside, ids, at, n = self.inside, [], 0, len(stretch)
        for i in range(1, n + 1):
            if i < n and stretch[i - 1 : i + 1] in inside:
                continue
            if i - at == n:
                return tuple(self._short(stretch) if n <= SHORT else self.search(stretch))
            ids += self.stretches.find(stretch[at:i])
            at = i
        return tuple(ids)

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a space and a word; a last character that no piece joins to the others is taken off, so that punctuation shares the word's ids."""
        if 1 < len(word) <= SHORT and word[-2:] not in self.inside:
            return self.words.find(word[:-1]) + self.stretches.find(word[-1])
        return tuple(self._short(SPACE + word)) if len(word) < SHORT else self._cut(SPACE + word)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if SPACE in text:
            mark = [self.byte_ids[b] for b in SPACE.encode()]
            parts = text.split(SPACE)
            out = self._plain(SPACE + parts[0].replace(" ", SPACE))
            for p in parts[1:]:
                out += mark
                out += self._plain(p.replace(" ", SPACE)) if p else []
            return out
        if self.crosses or "  " in text or text[0] == " " or text[-1] == " ":
            return self._plain(SPACE + text.replace(" ", SPACE))
        # the common case: every word has one space before it and is kept without it
        out: list[int] = []
        find, young = self.words.find, self.words.young
        for w in text.split(" "):
            out += young.get(w) or find(w)
        return out

    def _plain(self, text: str) -> list[int]:
        if self.crosses:
            return self.search(text)
        out: list[int] = []
        for w in _RUNS.findall(text):
            out += self.stretches.find(w)
        return out

    # -------------------------------------------------------------- decoding

    def decode(self, ids) -> str:
        by_id = self.by_id
        raw = b"".join([by_id[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def load(path: str = MODEL, merges: bool | None = None) -> Vocabulary:
    """Reads a model file on the driver; workers get its pieces (a vocabulary's size, not the data's).

    ``merges`` is told from the scores where it isn't given: those of a BPE file are whole numbers.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
    pieces = [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]
    return Vocabulary(pieces, all(float(s).is_integer() for _, s, k in pieces if k == "normal") if merges is None else merges)


def encode_documents(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` for every row."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(it):
        import pyarrow as pa

        v = sent.value
        for batch in it:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([v.encode(t or "") for t in part.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents(df, id_col, text_col).mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_documents(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from ids; null ids give an empty text."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(it):
        import pyarrow as pa

        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([sent.value.decode(i or ()) for i in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{ids_col}` ids").mapInArrow(run, "doc_id long, text string")


def encode_digest(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and compare each text in one pass: ``doc_id, n_ids, n_byte_ids, ids_sha256, text_sha256, round_trip``.

    ``ids_sha256`` is over the ids as little-endian 32-bit integers.
    """
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(it):
        import numpy as np
        import pyarrow as pa

        v = sent.value
        is_byte = np.zeros(len(v.by_id), bool)
        is_byte[v.byte_ids] = True
        for batch in it:
            rows = []
            for x in batch.column("text"):
                t = x.as_py() or ""
                ids = np.array(v.encode(t), "<i4")
                back = v.decode(ids.tolist())
                rows.append((len(ids), int(is_byte[ids].sum()), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == t))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.bool_())], ["doc_id", "n_ids", "n_byte_ids", "ids_sha256", "text_sha256", "round_trip"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, n_ids long, n_byte_ids long, ids_sha256 string, text_sha256 string, round_trip boolean")
