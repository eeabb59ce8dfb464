"""Language-model scores from a log-frequency Bloom filter of bigram counts, over exact unigram counts.

Tokens are the words of the text, A-Z lower-cased, and one end per document.  Unigram counts
are exact.  Bigram counts are quantised to the next smaller of ``VALUES`` and held in a Bloom
filter only: a bigram of level q is entered q times, as (bigram, 1) ... (bigram, q), and its
level is what probes find, counting up until one fails.  No bigram's true count is looked up:
false probes raise some levels, and scores have that error.

The probability of w after v is (seen + MU * p(w)) / ((1 + f) * c(v) + MU + f * V): seen is the
count that the found level stands for, at most c(v) and c(w); c(v) is v's exact count, V the
number of types, p the base's unigram probability and f the filter's rate of false probes, told by
its fill.  Quantising only lowers counts, and of the V possible next tokens a share f at most is
expected to be raised, by a level: so the expected sum of all probabilities after v is at most 1.

Documents are dealt into groups by id and text.  A group sends each shard of the hash space its
distinct words and bigrams there with their training counts (0 for those of held-out texts
only), so a word that every document holds costs one entry a group.  A shard sums them and builds
its own segment of the filter at ``BITS_A_KEY`` from all its bigrams, so the filter grows with
the input.  A filter of at most ``BROADCAST_BYTES`` is broadcast and probed where texts are
scored; a larger one stays in its shards, each of which has probed its segment for all groups
that asked.  Both probe the same bits, so scores don't depend on which way it was.

Null texts count as empty (one token, the end).  A null id is never held out.  Rows with
equal ids each count and each get a row.  Without training tokens all counts are 0.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, dealt, documents, durable, input_bytes, mix, pieces, texts_of
from .substring_dedup import _by_shard, address

END = U64(0x5851F42D4C957F2D)
BITS_A_KEY, PROBES, MU = 20, 10, 40.0
BROADCAST_BYTES = 32 << 20
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 10 == 0, F.lit(False))


class Tokens:
    """Distinct tokens and bigrams of a group of texts."""

    def __init__(self, table):
        texts = texts_of(table)
        flat, counts = [], []
        for a, b in pieces(texts):
            w = Words([t.lower() for t in texts[a:b]])
            flat.append(np.insert(w.hashes, w.first[1:], END))
            counts.append(np.diff(w.first) + 1)
        self.flat, self.count = np.concatenate(flat), np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.train = ~np.array(table.column("held_out").to_pylist(), bool)
        self.words, self.word = np.unique(self.flat, return_inverse=True)
        before = np.empty_like(self.flat)
        before[1:] = self.flat[:-1]
        before[self.first[:-1]] = END
        self.before = before
        with np.errstate(over="ignore"):
            self.pairs = mix(before * U64(0xC2B2AE3D27D4EB4F) + self.flat)

    def in_training(self) -> np.ndarray:
        return np.repeat(self.train, self.count)


#: The count that each level stands for: 0, 1, 2, 3, 4, 6, 8, 12, 16, 24 and so on.
VALUES = np.array([0, 1, *(v << k for k in range(60) for v in (2, 3))], np.int64)


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(VALUES, counts, side="right") - 1


class Shape(NamedTuple):
    """How a filter is laid out; another seed sets other bits."""

    bits: int = BITS_A_KEY
    probes: int = PROBES
    seed: int = 0


def _spots(keys: np.ndarray, q: np.ndarray | int, probe: int, bits, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys + (np.asarray(q).astype(U64) * U64(64) + U64(probe) + U64(seed << 20)) * U64(0x9E3779B97F4A7C15)) % np.asarray(bits).astype(U64)


def segment(keys: np.ndarray, levels: np.ndarray, shape: Shape = Shape()) -> bytes:
    """A shard's part of the filter: every bigram, at so many bits a level."""
    bits = max(64, -(-int(levels.sum()) * shape.bits // 64) * 64)
    field = np.zeros(bits, bool)
    for step in range(1, int(levels.max(initial=0)) + 1):
        at = keys[levels >= step]
        for p in range(shape.probes):
            field[_spots(at, step, p, bits, shape.seed)] = True
    return np.packbits(field).tobytes()


class LogFrequencyFilter:
    """Segments by shard, probed by address (shard above, value below)."""

    def __init__(self, segments: dict[int, bytes], n_shards: int, shape: Shape = Shape()):
        self.shape = shape
        self.start, self.bits = np.zeros(n_shards, np.int64), np.full(n_shards, 1, np.int64)
        at, parts = 0, []
        for s in sorted(segments):
            self.start[s], self.bits[s] = at * 8, len(segments[s]) * 8
            parts.append(segments[s])
            at += len(segments[s])
        self.has = np.zeros(n_shards, bool)
        self.has[list(segments)] = True
        self.field = np.frombuffer(b"".join(parts) or b"\0", np.uint8)

    def levels(self, addresses: np.ndarray) -> np.ndarray:
        """Levels of bigrams, as probes find them; 0 for unseen ones."""
        shard = (addresses >> U64(32)).astype(np.int64)
        out = np.zeros(len(addresses), np.int64)
        live = np.flatnonzero(self.has[shard])
        step = 0
        while len(live):
            step += 1
            for p in range(self.shape.probes):
                s = shard[live]
                bit = self.start[s] + _spots(addresses[live] & U64(0xFFFFFFFF), step, p, self.bits[s], self.shape.seed).astype(np.int64)
                live = live[(self.field[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0]
            out[live] = step
            if step == len(VALUES) - 1:
                break
        return out


def false_rate(segment_bytes: bytes, probes: int) -> float:
    """How often all probes of a bigram that isn't in a segment hit."""
    field = np.frombuffer(segment_bytes, np.uint8)
    return float(np.unpackbits(field).mean() ** probes) if len(field) else 0.0


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_groups: int = 0, n_shards: int = 0, shape: Shape = Shape(), broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Base (unigram) and smoothed bigram log10 scores of every row; see ``OUT``."""
    many = dealt(input_bytes(df, text_col), 512, 128)
    n_groups, n_shards = n_groups or many[0], n_shards or many[1]
    docs = documents(df, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id"))).withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)).cast("int"))

    def ask(group):
        import pyarrow as pa

        g, t = group.column("g")[0].as_py(), Tokens(group)
        train = t.in_training()
        counts = np.bincount(t.word[train], minlength=len(t.words)).astype(np.uint32)
        pairs, pair = np.unique(address(t.pairs, n_shards), return_inverse=True)
        pair_counts = np.bincount(pair[train], minlength=len(pairs)).astype(np.uint32)
        rows: dict[int, list[bytes]] = {}
        for s, a, b in _by_shard((t.words >> U64(32)) * U64(n_shards) >> U64(32), n_shards):
            rows[int(s)] = [t.words[a:b].tobytes(), counts[a:b].tobytes(), b"", b""]
        for s, a, b in _by_shard(pairs >> U64(32), n_shards):
            rows.setdefault(int(s), [b"", b"", b"", b""])[2:] = [pairs[a:b].astype(np.uint32).tobytes(), pair_counts[a:b].tobytes()]
        cols = list(zip(*rows.values(), strict=True))
        return pa.table([pa.array(list(rows), pa.int32()), pa.array([g] * len(rows), pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=["shard", "g", "words", "counts", "pairs", "pair_counts"])

    def count(group):
        import pyarrow as pa

        shard, gs = group.column("shard")[0].as_py(), group.column("g").to_pylist()
        part = lambda c, kind: [np.frombuffer(x, kind) for x in group.column(c).to_pylist()]
        words = part("words", U64)
        keys, which = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(which, weights=np.concatenate(part("counts", np.uint32)), minlength=len(keys)).astype(np.int64)
        kind = np.uint32 if total.max(initial=0) < 1 << 32 else U64
        told = [x.tobytes() for x in np.split(total[which].astype(kind), np.cumsum([len(w) for w in words])[:-1])]
        asked = part("pairs", np.uint32)
        pairs, which = np.unique(np.concatenate(asked), return_inverse=True)
        times = np.bincount(which, weights=np.concatenate(part("pair_counts", np.uint32)), minlength=len(pairs)).astype(np.int64)
        part_of_filter = segment(pairs.astype(U64), level(times), shape)
        found = LogFrequencyFilter({0: part_of_filter}, 1, shape).levels(pairs.astype(U64)).astype(np.uint8)
        levels = [x.tobytes() for x in np.split(found[which], np.cumsum([len(p) for p in asked])[:-1])]
        n = len(gs)
        return pa.table({
            "g": pa.array([*gs, -1], pa.int32()), "shard": pa.array([shard] * (n + 1), pa.int32()), "data": pa.array([*told, part_of_filter], pa.binary()), "levels": pa.array([*levels, b""], pa.binary()),
            "wide": pa.array([kind is U64] * (n + 1)), "tokens": pa.array([0] * n + [int(total.sum())], pa.int64()), "types": pa.array([0] * n + [int((total > 0).sum())], pa.int64()),
            "false": pa.array([0.0] * n + [false_rate(part_of_filter, shape.probes)], pa.float64()),
        })

    told = durable(docs.groupBy("g").applyInArrow(ask, "shard int, g int, words binary, counts binary, pairs binary, pair_counts binary").groupBy("shard").applyInArrow(count, "g int, shard int, data binary, levels binary, wide boolean, tokens long, types long, false double"))
    made = told.where("g = -1").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"), F.avg("false").alias("false"), F.sum(F.octet_length("data")).alias("size")).first()
    n_tokens, n_types, false = made.tokens or 0, made.types or 0, made.false or 0.0
    sent = None
    if (made.size or 0) <= broadcast_bytes:
        parts = {r.shard: bytes(r.data) for r in told.where("g = -1").select("shard", "data").collect()}
        sent = df.sparkSession.sparkContext.broadcast(LogFrequencyFilter(parts, n_shards, shape))

    def score(group, answers):
        import pyarrow as pa

        t = Tokens(group)
        got = {s: row for s, *row in zip(*(answers.column(x).to_pylist() for x in ("shard", "data", "wide", "levels")), strict=True)}
        c = np.zeros(len(t.words))
        for s, a, b in _by_shard((t.words >> U64(32)) * U64(n_shards) >> U64(32), n_shards):
            d, wide, _ = got[s]
            c[a:b] = np.frombuffer(d, U64 if wide else np.uint32)
        share = (c + 0.1) / (n_tokens + 0.1 * (n_types + 1))
        base = np.add.reduceat(np.log10(share)[t.word], t.first[:-1])
        known = np.add.reduceat((c > 0)[t.word].astype(np.int64), t.first[:-1])
        pairs, which = np.unique(address(t.pairs, n_shards), return_inverse=True)
        if sent:
            levels = sent.value.levels(pairs)
        else:
            levels = np.zeros(len(pairs), np.int64)
            for s, a, b in _by_shard(pairs >> U64(32), n_shards):
                levels[a:b] = np.frombuffer(got[s][2], np.uint8)
        context = c[np.searchsorted(t.words, t.before)]
        seen = np.minimum(VALUES[levels][which], np.minimum(context, c[t.word]))
        score = np.add.reduceat(np.log10((seen + MU * share[t.word]) / ((1 + false) * context + MU + false * n_types)), t.first[:-1])
        n = len(t.count)
        return pa.table([group.column("doc_id"), group.column("held_out"), pa.array(t.count, pa.int64()), pa.array(known, pa.int64()), pa.array([n_tokens] * n, pa.int64()), pa.array(base), pa.array(score)], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.groupBy("g").cogroup(told.where("g >= 0").groupBy("g")).applyInArrow(score, OUT)
