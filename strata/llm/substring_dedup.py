"""Exact substring deduplication with fixed-block anchors.

Reference blocks are the non-overlapping runs of ``BLOCK`` words of each text, from its first
word on.  A repeat of ``WINDOW`` words holds a whole block of its other occurrence whatever
the two alignments are, so each text probes the block index with every rolling window of
``BLOCK`` words; only words near a hit can lie in a repeat.  Around the hits, windows of
``WINDOW`` words are compared exactly across texts (96-bit hashes within a shard, over 100
bits in all), which extends each hit to the maximal run of repeated words.

Documents are dealt into groups by id, and every group sends each shard of the hash space
one message: its distinct values there, four bytes each, whatever their number of
occurrences.  A shard answers each group with the values that hit; a second exchange asks
which group holds a window's first occurrence.  So a passage that every document holds costs
one value a group, not one a document, and no pair is listed.

Windows are judged on the input: a window is removed if the same words start earlier, in a
smaller id or earlier in the same text.  Of rows with equal ids, the smaller text (by bytes)
comes first; a null id comes before all others.  A null text counts as empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, dealt, documents, input_bytes, pieces, rolling, texts_of

WINDOW, BLOCK = 20, 10
OUT = "doc_id long, n_words long, n_removed long, n_repeats long, kept_sha256 string, kept string"


class Group:
    """The texts of one group in order of id, with block-length window values."""

    def __init__(self, table, window: int, block: int):
        ids = table.column("doc_id").to_pylist()
        texts = texts_of(table)
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, texts[k]))
        self.has_id = np.array([ids[k] is not None for k in order], bool)
        self.ids = np.array([ids[k] or 0 for k in order], np.int64)
        self.texts = [texts[k] for k in order]
        hashes, counts = [], []
        for a, b in pieces(self.texts):
            w = Words(self.texts[a:b])
            hashes.append(w.hashes)
            counts.append(np.diff(w.first))
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.window, self.block = window, block
        self.owner = np.repeat(np.arange(len(self.ids)), self.count)
        self.place = np.arange(len(self.words)) - self.first[self.owner] if len(self.words) else np.zeros(0, np.int64)
        self.room = self.count[self.owner] - self.place if len(self.words) else np.zeros(0, np.int64)  # words from here to the text's end

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Values of all windows of ``block`` words, with the positions they start at."""
        values = rolling(self.words, self.block)
        at = np.flatnonzero(self.room[: len(values)] >= self.block)
        return values[at], at

    def candidates(self, hot: np.ndarray, n_shards: int):
        """Starts of windows with a hit inside; their distinct values; which is each start's, and each value's first start."""
        values, at = self.anchors()
        hit = np.zeros(len(self.words) + 1, np.int64)
        if len(hot) and len(values):
            key = address(values, n_shards)
            k = np.searchsorted(hot, key)
            k[k == len(hot)] = 0
            hit[at[hot[k] == key]] = 1
        seen = np.concatenate([[0], np.cumsum(hit)])
        starts = np.flatnonzero(self.room >= self.window)
        starts = starts[seen[starts + self.window - self.block] > seen[starts]]
        one, two = rolling(self.words, self.window), rolling(self.words ^ U64(0xA24BAED4963EE407), self.window, 0x9FB21C651E98DF25)
        pair = np.empty(len(starts), [("one", U64), ("two", np.uint32)])
        pair["one"], pair["two"] = one[starts], two[starts] >> U64(32)
        order = np.lexsort((starts, pair["two"], pair["one"]))
        ranked = pair[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return starts, ranked[new], which, starts[order[new]]


def address(values: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard in the upper and 32 further hash bits in the lower half."""
    return ((values >> U64(32)) * U64(n_shards) & U64(0xFFFFFFFF00000000)) | (values & U64(0xFFFFFFFF))


def _by_shard(key_shard: np.ndarray, n_shards: int):
    """Slices of a shard-sorted array."""
    edges = np.searchsorted(key_shard, np.arange(n_shards + 1))
    return ((s, int(edges[s]), int(edges[s + 1])) for s in np.flatnonzero(np.diff(edges)))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK, n_groups: int = 0, n_shards: int = 0, keep_text: bool = True) -> DataFrame:
    """Each row's words, without those in windows that start earlier elsewhere: ``doc_id, n_words, n_removed, n_repeats, kept_sha256, kept``.

    ``kept`` (null unless ``keep_text``) joins the kept words by one space; ``n_repeats`` counts maximal removed runs.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block at any alignment")
    many = dealt(input_bytes(df, text_col), 1024, 128)
    n_groups, n_shards = n_groups or many[0], n_shards or many[1]
    docs = documents(df, id_col, text_col).withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(n_groups)).cast("int"))

    def ask_anchors(group):
        import pyarrow as pa

        g = group.column("g")[0].as_py()
        texts = Group(group, window, block)
        values, at = texts.anchors()
        key, where, times = np.unique(address(values, n_shards), return_index=True, return_counts=True)
        aligned = np.zeros(len(key), bool)
        aligned[np.searchsorted(key, address(values[texts.place[at] % block == 0], n_shards))] = True
        rows = []
        for s, a, b in _by_shard((key >> U64(32)).astype(np.int64), n_shards):
            low = key[a:b].astype(np.uint32)
            kind = aligned[a:b] * 2 + (times[a:b] > 1)
            rows.append((int(s), g, *(low[kind == k].tobytes() for k in range(4))))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["shard", "g", "p1", "p2", "b1", "b2"])

    def find_hits(group):
        import pyarrow as pa

        shard = group.column("shard")[0].as_py()
        parts = {c: [np.frombuffer(x, np.uint32) for x in group.column(c).to_pylist()] for c in ("p1", "p2", "b1", "b2")}
        index = np.unique(np.concatenate(parts["b1"] + parts["b2"]))
        hits = []
        if len(index):
            total = np.zeros(len(index), np.int64)

            def look(x):
                k = np.searchsorted(index, x)
                k[k == len(index)] = 0
                return k, index[k] == x

            for c, weight in (("p1", 1), ("b1", 1), ("p2", 2), ("b2", 2)):
                k, same = look(np.concatenate(parts[c]))
                total += weight * np.bincount(k[same], minlength=len(index))
            for row in zip(*parts.values(), strict=True):
                mine = np.concatenate(row)
                k, same = look(mine)
                hits.append(mine[same & (total[k] > 1)].tobytes())
        keep = [k for k, h in enumerate(hits) if h]
        g = group.column("g").to_pylist()
        return pa.table({"g": pa.array([g[k] for k in keep], pa.int32()), "kind": pa.array([0] * len(keep), pa.int32()), "shard": pa.array([shard] * len(keep), pa.int32()), "data": pa.array([hits[k] for k in keep], pa.binary())})

    def hot_of(answers) -> np.ndarray:
        rows = [(s, d) for k, s, d in zip(answers.column("kind").to_pylist(), answers.column("shard").to_pylist(), answers.column("data").to_pylist(), strict=True) if k == 0]
        found = [np.frombuffer(d, np.uint32).astype(U64) | U64(s << 32) for s, d in rows]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, U64)

    def ask_first(group, answers):
        import pyarrow as pa

        rows = []
        if group.num_rows and answers.num_rows:
            g = group.column("g")[0].as_py()
            texts = Group(group, window, block)
            _, values, _, first = texts.candidates(hot_of(answers), n_shards)
            shard = ((values["one"] >> U64(32)) * U64(n_shards) >> U64(32)).astype(np.int64)  # values are sorted, so shards are
            owner = texts.owner[first]
            ids, has = texts.ids[owner], texts.has_id[owner]
            rows = [(int(s), g, values[a:b].tobytes(), ids[a:b].tobytes(), has[a:b].tobytes()) for s, a, b in _by_shard(shard, n_shards)]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table({"shard": pa.array(cols[0], pa.int32()), "g": pa.array(cols[1], pa.int32()), "windows": pa.array(cols[2], pa.binary()), "ids": pa.array(cols[3], pa.binary()), "has_id": pa.array(cols[4], pa.binary())})

    def find_first(group):
        import pyarrow as pa

        kind = np.dtype([("one", U64), ("two", np.uint32)])
        shard, gs = group.column("shard")[0].as_py(), group.column("g").to_pylist()
        values = [np.frombuffer(x, kind) for x in group.column("windows").to_pylist()]
        sizes = [len(v) for v in values]
        ids, has = (np.concatenate([np.frombuffer(x, kind) for x in group.column(c).to_pylist()]) for c, kind in (("ids", np.int64), ("has_id", bool)))
        flat, g = np.concatenate(values), np.repeat(gs, sizes)
        order = np.lexsort((g, ids, has, flat["two"], flat["one"]))
        ranked = flat[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        mine = np.empty(len(order), bool)
        mine[order] = new
        bits = [np.packbits(x).tobytes() for x in np.split(mine, np.cumsum(sizes)[:-1])]
        return pa.table({"g": pa.array(gs, pa.int32()), "kind": pa.array([1] * len(gs), pa.int32()), "shard": pa.array([shard] * len(gs), pa.int32()), "data": pa.array(bits, pa.binary())})

    def strip(group, answers):
        import pyarrow as pa

        texts = Group(group, window, block)
        hot = hot_of(answers)
        removed = np.zeros(len(texts.words) + 1, np.int64)
        if len(hot):
            starts, values, which, first = texts.candidates(hot, n_shards)
            shard = ((values["one"] >> U64(32)) * U64(n_shards) >> U64(32)).astype(np.int64)
            bits = {s: d for k, s, d in zip(answers.column("kind").to_pylist(), answers.column("shard").to_pylist(), answers.column("data").to_pylist(), strict=True) if k == 1}
            mine = np.zeros(len(values), bool)
            for s, a, b in _by_shard(shard, n_shards):
                mine[a:b] = np.unpackbits(np.frombuffer(bits[s], np.uint8), count=b - a)
            gone = starts[~(mine[which] & (first[which] == starts))]
            np.add.at(removed, gone, 1)
            np.subtract.at(removed, gone + window, 1)
        gone = np.cumsum(removed)[:-1] > 0
        rows = []
        for k, text in enumerate(texts.texts):
            a, b = texts.first[k], texts.first[k + 1]
            words, off = text.split(), gone[a:b]
            n = int(off.sum())
            if n:
                words = [w for w, x in zip(words, off.tolist(), strict=True) if not x]
            kept = b" ".join(words)
            rows.append((int(texts.ids[k]) if texts.has_id[k] else None, int(b - a), n, int((np.diff(off.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.table([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "n_repeats", "kept_sha256", "kept"])

    answer = "g int, kind int, shard int, data binary"
    hits = docs.groupBy("g").applyInArrow(ask_anchors, "shard int, g int, p1 binary, p2 binary, b1 binary, b2 binary").groupBy("shard").applyInArrow(find_hits, answer)
    firsts = docs.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(ask_first, "shard int, g int, windows binary, ids binary, has_id binary").groupBy("shard").applyInArrow(find_first, answer)
    return docs.groupBy("g").cogroup(hits.unionByName(firsts).groupBy("g")).applyInArrow(strip, OUT)
