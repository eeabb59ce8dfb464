"""Prefix trie of conversations as succinct level-order tries (LOUDS).

Turns are numbered and hashed; a prefix's key is the xor of its turns' place-bound 128-bit hashes, so prefixes of however long a
conversation are running xors over pieces of it, and texts never leave the first scan.  Prefixes with more than ``per``
conversations are the heavy upper levels: at most ``MOST_HEAVY`` by count, so they may be broadcast.  What hangs below them are
subtrees of at most ``per`` conversations, dealt to shards.  In a shard numpy sorts the nodes by level into a LOUDS bitvector and
label arrays (``louds_shards`` is that table); a second pass reads the bits back and adds up subtrees by ``np.add.at`` in reverse
breadth-first order.  The heavy levels are merged with the shards' totals in a trie of their own, in one task of bounded size.
Below a prefix that one conversation has for itself nothing branches: such tails are kept out of the bitvectors.

Null roles and texts are empty; turns are in the order of ``turn``, nulls first, ties by a hash of role and text, so a repeated row
is a repeated turn.  Rows without a conversation id belong to none and are left out.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.resolve import numbered
from strata.plans.lineage import durable

PIECE = 1024  # turns of a conversation that are put in order together
LEAST_PER, MOST_HEAVY = 1024, 100_000
SHARD_NODES = 50_000
KEY = ["depth", "ka", "kb"]


def hashed_turns(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, k`` (from 1 on), two hashes of role and text, and the text's code points."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    slim = convs.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.xxhash64(r, t).alias("a"), F.xxhash64(F.lit("b"), t, r).alias("b"), F.length(t).cast("long").alias("chars"))
    return numbered(slim, ["conv_id"], ["turn", "a", "b"], "k").select("conv_id", "k", "a", "b", "chars")


def _pieces(turns: DataFrame) -> DataFrame:
    return turns.withColumn("piece", F.shiftright(F.col("k") - 1, 10))


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with their turns as they stand: ``conv_id, piece, place, a, b, chars, length`` and ``conv_id, length``."""
    by_piece = _pieces(turns).groupBy("conv_id", "piece").agg(F.count("*").alias("m"))
    convs = by_piece.groupBy("conv_id").agg(F.sum("m").alias("length"))
    return _pieces(turns).join(by_piece.join(convs, "conv_id").select("conv_id", "piece", "length"), ["conv_id", "piece"]).select("conv_id", "piece", F.col("k").alias("place"), "a", "b", "chars", "length"), convs


def rebuilt(turns: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of their family's first one, h = crc32(id) % ``most``, and go on with their own after the first h.

    Returns what ``as_they_are`` does; a conversation may come out without turns.
    """
    by_piece = _pieces(turns).groupBy("conv_id", "piece").agg(F.count("*").alias("m"))
    convs = by_piece.groupBy("conv_id").agg(F.sum("m").alias("n")).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % most).withColumn("from", F.col("conv_id") - F.col("conv_id") % family)
    first = convs.select(F.col("conv_id").alias("from"), F.col("n").alias("there"))
    plan = convs.join(first, "from", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0)))).select("conv_id", "from", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    own = _pieces(turns).join(by_piece.select("conv_id", "piece").join(plan, "conv_id"), ["conv_id", "piece"]).where("k > h").select("conv_id", "piece", (F.col("m") + F.col("k") - F.col("h")).alias("place"), "a", "b", "chars", "length")
    asked = plan.where("m > 0").select("conv_id", "length", "from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m").cast("long"))).alias("place"))
    heads = turns.where(F.col("k") < most).select(F.col("conv_id").alias("from"), F.col("k").alias("place"), "a", "b", "chars")
    lent = asked.join(heads, ["from", "place"]).select("conv_id", F.lit(-1).cast("long").alias("piece"), "place", "a", "b", "chars", "length")
    return own.unionByName(lent), plan.select("conv_id", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """Each turn with the key of the prefix that it ends (``ka, kb``) and of the one before it (``qa, qb``)."""
    bound = lambda s: F.xxhash64(F.lit(s), "place", "a", "b")
    put = rows.select("conv_id", "piece", "place", "chars", "length", bound(1).alias("sa"), bound(2).alias("sb"))
    inside = Window.partitionBy("conv_id", "piece").orderBy("place")
    so_far = put.withColumn("xa", F.bit_xor("sa").over(inside)).withColumn("xb", F.bit_xor("sb").over(inside))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = put.groupBy("conv_id", "piece").agg(F.bit_xor("sa").alias("ta"), F.bit_xor("sb").alias("tb"))
    before = totals.select("conv_id", "piece", F.coalesce(F.bit_xor("ta").over(earlier), F.lit(0)).alias("ba"), F.coalesce(F.bit_xor("tb").over(earlier), F.lit(0)).alias("bb"))
    key = lambda p: F.col(f"x{p}").bitwiseXOR(F.col(f"b{p}"))
    out = so_far.join(before, ["conv_id", "piece"])
    return out.select("conv_id", F.col("place").alias("depth"), key("a").alias("ka"), key("b").alias("kb"), key("a").bitwiseXOR(F.col("sa")).alias("qa"), key("b").bitwiseXOR(F.col("sb")).alias("qb"), "chars", "length")


# ---------------------------------------------------------------- LOUDS

def encode(depth, level, ka, kb, qa, qb) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A forest's nodes in level order and its bits: a one for each child and a zero behind each node's, first those of a root above all."""
    kind = [("d", np.int64), ("a", np.int64), ("b", np.int64)]
    n = len(depth)
    keys = np.empty(2 * n, kind)
    for f, own, up in (("d", depth, depth - 1), ("a", ka, qa), ("b", kb, qb)):
        keys[f][:n], keys[f][n:] = own, up
    _, code = np.unique(keys, return_inverse=True)
    row = np.full(code.max() + 1 if n else 1, -1)
    row[code[:n]] = np.arange(n)
    parent = np.where(level == 0, -1, row[code[n:]])
    place = np.full(n + 1, -1)  # the last stands for the root above all
    order = []
    at = 0
    for rows in np.split(np.argsort(level, kind="stable"), np.flatnonzero(np.diff(np.sort(level))) + 1):
        rows = rows[np.lexsort((code[rows], place[parent[rows]]))]
        place[rows] = np.arange(at, at + len(rows))
        at += len(rows)
        order.append(rows)
    order = np.concatenate(order)
    degree = np.bincount(np.where(parent[order] < 0, 0, place[parent[order]] + 1), minlength=n + 1)
    bits = np.ones(2 * n + 1, np.uint8)
    bits[np.cumsum(degree + 1) - 1] = 0
    return order, bits, degree


def parents(bits: np.ndarray) -> np.ndarray:
    """For each node in level order the place of its parent, from the bits: as many as zeros before its one; -1 for roots."""
    return np.cumsum(bits == 0)[bits == 1] - 1


def add_up(parent: np.ndarray, *values: np.ndarray) -> None:
    """Adds to each node's values those of all nodes below it, level by level from the lowest."""
    edges = [0, int(np.searchsorted(parent, 0))]
    while edges[-1] < len(parent):
        edges.append(int(np.searchsorted(parent, edges[-1])))
    for lo, hi in reversed(list(zip(edges[1:-1], edges[2:], strict=True))):
        for v in values:
            np.add.at(v, parent[lo:hi], v[lo:hi].copy())


ARRAYS = ("depth", "ka", "kb", "qa", "qb", "conv_id", "n_convs", "chars", "more")
SHARD = "shard int, n_nodes long, louds binary, " + ", ".join(f"{c} binary" for c in ARRAYS)


def _encoded(shard: int, t) -> dict:
    col = {c: t.column(c).to_numpy() for c in (*ARRAYS, "top")}
    order, bits, _ = encode(col["depth"], col["depth"] - col["top"], col["ka"], col["kb"], col["qa"], col["qb"])
    return {"shard": shard, "n_nodes": len(order), "louds": np.packbits(bits).tobytes(), **{c: np.ascontiguousarray(col[c][order], np.int64).tobytes() for c in ARRAYS}}


def _decoded(row: dict) -> tuple[dict[str, np.ndarray], np.ndarray]:
    bits = np.unpackbits(np.frombuffer(row["louds"], np.uint8), count=2 * row["n_nodes"] + 1)
    return {c: np.frombuffer(row[c], np.int64) for c in ARRAYS}, parents(bits)


def _shards(nodes: DataFrame, shards: int) -> DataFrame:
    """A row for each shard: ``nodes`` has ARRAYS, ``top`` (the depth at which its subtree begins) and ``ta, tb`` (that node's key)."""
    import pyarrow as pa

    kinds = pa.schema([("shard", pa.int32()), ("n_nodes", pa.int64()), *((c, pa.binary()) for c in ("louds", *ARRAYS))])

    def run(key, t):
        return pa.Table.from_pylist([_encoded(key[0].as_py(), t)], schema=kinds)

    dealt = nodes.select(F.pmod(F.xxhash64("ta", "tb"), F.lit(shards)).cast("int").alias("shard"), "top", *(F.col(c).cast("long").alias(c) for c in ARRAYS))
    return dealt.groupBy("shard").applyInArrow(run, SHARD)


ROLLED = "depth long, ka long, kb long, qa long, qb long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, is_top boolean"


def _rolled(encoded: DataFrame) -> DataFrame:
    """The nodes of each shard with what lies below them, from its bits."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                col, up = _decoded(batch.slice(k, 1).to_pylist()[0])
                degree = np.bincount(up[up >= 0], minlength=len(up))
                leaves, saved = (degree == 0).astype(np.int64), (col["n_convs"] - 1) * col["chars"]
                add_up(up, leaves, saved)
                top = up < 0
                above = pa.array(col["conv_id"][up], mask=top)
                yield pa.RecordBatch.from_arrays([*(pa.array(col[c]) for c in ("depth", "ka", "kb", "qa", "qb", "conv_id")), above, *(pa.array(x) for x in (col["n_convs"], degree + col["more"], leaves, saved, top))], [c.split()[0] for c in ROLLED.split(", ")])

    return encoded.mapInArrow(run, ROLLED)


def _merged(heavy: DataFrame) -> DataFrame:
    """The heavy levels' rollups: ``heavy`` has their nodes and, summed by parent, the shards' totals (``kids, leaves_below, saved_below``); at most MOST_HEAVY rows and the root."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        c = {n: t.column(n).to_numpy() for n in t.column_names}
        order, bits, degree = encode(c["depth"], c["depth"], c["ka"], c["kb"], c["qa"], c["qb"])
        c, up, own = {n: v[order] for n, v in c.items()}, parents(bits), degree[1:]
        leaves, saved = c["leaves_below"] + ((own == 0) & (c["kids"] == 0)), c["saved_below"] + (c["n_convs"] - 1) * c["chars"]
        add_up(up, leaves, saved)
        above = pa.array(c["conv_id"][up], mask=up < 0)
        yield pa.RecordBatch.from_arrays([*(pa.array(c[n]) for n in ("depth", "ka", "kb", "qa", "qb", "conv_id")), above, *(pa.array(x) for x in (c["n_convs"], own + c["kids"], leaves, saved, up < 0))], [x.split()[0] for x in ROLLED.split(", ")])

    return heavy.coalesce(1).mapInArrow(run, ROLLED)


def _ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """SHA-256 of each prefix's own conversations, ids ascending and joined by commas.

    Ids are written out in pieces of at most 65,536 on all cores; the hash, which can only go through them in order, then reads a
    few texts for however large a group, never all at once.
    """
    zero = F.lit(0).cast("long")
    last = rows.where("depth = length").select(*KEY, "conv_id").unionByName(convs.where("length = 0").select(zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), "conv_id"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    texts = last.groupBy(*KEY, F.shiftright("conv_id", 16).alias("part")).agg(ids.alias("ids"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("depth", pa.int64()), ("ka", pa.int64()), ("kb", pa.int64()), ("ends_sha256", pa.string())])
        now, state = None, None
        for batch in batches:
            done = []
            for d, a, b, text in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if (d, a, b) == now:
                    state.update(b",")
                else:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = (d, a, b), hashlib.sha256()
                state.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*now, state.hexdigest()), schema, strict=True)], schema=schema)

    return texts.repartition(*KEY).sortWithinPartitions(*KEY, "part").mapInArrow(run, "depth long, ka long, kb long, ends_sha256 string")


# ---------------------------------------------------------------- the whole

class Trie:
    """The nodes of all prefixes and how they are divided: ``nodes`` (one each), ``heavy`` (bounded), ``inner`` (in shards) and tails.

    ``rows, convs``: as ``as_they_are`` or ``rebuilt`` return them.  ``per``: the most conversations of a shard's subtree;
    it grows with the input so that no more than MOST_HEAVY prefixes are heavy.
    """

    def __init__(self, rows: DataFrame, convs: DataFrame, per: int = LEAST_PER, shard_nodes: int = SHARD_NODES):
        self.convs, self.rows = convs, durable(prefixes(rows))
        self.nodes = durable(self.rows.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.max("length").alias("length"), F.min("qa").alias("qa"), F.min("qb").alias("qb")))
        self.per = max(per, self.rows.count() // MOST_HEAVY)
        self.shards = max(1, self.nodes.count() // shard_nodes)
        zero = F.lit(0).cast("long")
        root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), "n_convs", "conv_id", zero.alias("chars"), zero.alias("length"), zero.alias("qa"), zero.alias("qb"))
        self.heavy = durable(self.nodes.where(F.col("n_convs") > self.per).unionByName(root))
        self._divide()

    def _divide(self) -> None:
        hot = F.broadcast(self.heavy.select(*KEY, F.lit(True).alias("is_heavy")))
        light = self.nodes.where(F.col("n_convs") <= self.per)
        above = F.broadcast(self.heavy.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("qa"), F.col("kb").alias("qb"), F.lit(True).alias("under_heavy")))
        alone = light.where("n_convs = 1").join(above, ["depth", "qa", "qb"], "left")
        shared = light.where("n_convs > 1").select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("qa"), F.col("kb").alias("qb"), F.lit(True).alias("under_shared"))
        alone = alone.where("under_heavy is null").join(shared, ["depth", "qa", "qb"], "left").select(*self.nodes.columns, F.col("under_shared").isNotNull().alias("begins")).unionByName(alone.where("under_heavy").select(*self.nodes.columns, F.lit(True).alias("begins")))
        alone = durable(alone)
        more = ((F.col("n_convs") == 1) & (F.col("depth") < F.col("length"))).cast("long")
        inner = light.where("n_convs > 1").unionByName(alone.where("begins").drop("begins")).withColumn("more", more)
        # where each conversation's path leaves the heavy levels
        left = self.rows.join(hot, KEY, "left").where("is_heavy is null").groupBy("conv_id").agg(F.min(F.struct("depth", "ka", "kb")).alias("t")).select("conv_id", F.col("t.depth").alias("top"), F.col("t.ka").alias("ta"), F.col("t.kb").alias("tb"))
        self.inner = inner.join(left, "conv_id")
        self.tails = alone.where("not begins").withColumn("more", more)

    def louds_shards(self) -> DataFrame:
        """``shard, n_nodes, louds`` and an array of 64-bit values for each of ARRAYS, in level order."""
        return _shards(self.inner, self.shards)

    def rollups(self) -> DataFrame:
        """``depth, ka, kb, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens`` of every node."""
        inner = durable(_rolled(self.louds_shards()))
        below = inner.where("is_top").groupBy((F.col("depth") - 1).alias("depth"), F.col("qa").alias("ka"), F.col("qb").alias("kb")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves_below"), F.sum("saved_tokens").alias("saved_below"))
        sums = [F.coalesce(c, F.lit(0)).alias(c) for c in ("kids", "leaves_below", "saved_below")]
        upper = durable(_merged(self.heavy.join(below, KEY, "left").select(*self.heavy.columns, *sums)))
        up = F.broadcast(self.heavy.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("qa"), F.col("kb").alias("qb"), F.col("conv_id").alias("up_conv")))
        out = [*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
        tops = inner.where("is_top").drop("parent_conv_id").join(up, ["depth", "qa", "qb"]).withColumnRenamed("up_conv", "parent_conv_id")
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        tails = self.tails.select(*KEY, "conv_id", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.col("more").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"))
        return upper.select(*out).unionByName(tops.select(*out)).unionByName(inner.where("not is_top").select(*out)).unionByName(tails)


def trie_nodes(rows: DataFrame, convs: DataFrame, **bounds) -> DataFrame:
    """Every node with its rollups and the hash of the ids that end there: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    trie = Trie(rows, convs, **bounds)
    nothing: Column = F.lit(hashlib.sha256(b"").hexdigest())
    found = trie.rollups().join(_ends(trie.rows, trie.convs), KEY, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
