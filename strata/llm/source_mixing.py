"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents, in the order of a hash, form one run of words that is cut into blocks of ``block`` words.  A source's
target says how many blocks are drawn: whole passes over it and, of one more pass, some blocks, the last of which is cut to the
word, so the words taken equal the rounded target.  The blocks of all sources are dealt to output shards from the root of a binary
tree: at each node a multivariate-hypergeometric draw says how many blocks of each source go to the left half of its shards, as if
all blocks had been shuffled and dealt out.  So a shard's quotas are exact and no block goes to two shards.  A shard's quota is a
range of the source's draws; a Feistel permutation says which block each draw is.  Within a shard blocks are put in the order of a
hash, each with its documents in turn.

The tree's nodes carry counts only (one for each source that still has blocks there).  Upper levels run in one task, which holds a
count for each source, the rest on all; documents meet their draws in one join on source and block, of which none is hot.

Null texts are empty; an empty document has no words and is in no block.  A null source is the last; null ids and repeated rows are
documents of their own (equal ones of one id, source and text share a place in the hash order, one behind the other).  An empty
table gives an empty result.  Results depend on the rows and the seed alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.resolve import numbered
from strata.plans.lineage import durable

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
BLOCK, MOST_BLOCKS = 256, 1 << 28  # words; a draw's counts must stay below numpy's 1e9
SHARD_WORDS = 1 << 20
GROUP = 2048  # documents of a source, or so, that are put in order together
UPPER = 1024  # nodes at most that the first task leaves
MASK = (1 << 64) - 1


def words(text: Column) -> Column:
    """How many words a text has: each is made one letter and what is between is taken out, so no list of them is made."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.translate(letters, "\t\n\x0b\f\r ", "")).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, none, source, size, h, copies``: equal rows are one with their number; ``none`` marks a null source."""
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("source"),
        words(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).alias("h"),
    )
    return rows.groupBy("doc_id", "none", "source", "size", "h").agg(F.count("*").alias("copies"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``none, source, source_size, place, weight, target``: ``share`` of all words dealt by weight, none above ``most`` times its source's size.

    ``sources`` has ``none, source, source_size``, one row each; they take the weights in turn, by code point, null last.  What a source
    can't take goes to those that still can, by weight, in rounds; each round takes two numbers to the driver.
    """
    ordered = numbered(sources, [], ["none", "source"], "place")
    table = F.array(*(F.lit(float(w)) for w in weights))
    weighed = durable(ordered.withColumn("weight", F.element_at(table, ((F.col("place") - 1) % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size")))
    left = share * float(weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    full, level = None, 0.0
    while True:
        open_ = weighed if full is None else weighed.where(~full)
        weight = open_.agg(F.sum("weight")).first()[0]
        spent = 0.0 if full is None else float(weighed.where(full).agg(F.coalesce(F.sum("cap"), F.lit(0.0))).first()[0])
        if not weight:
            break
        level = max(left - spent, 0.0) / weight
        over = F.col("weight") * level > F.col("cap")
        if not open_.where(over).limit(1).count():
            break
        full = over if full is None else full | over
    target = F.col("weight") * level if full is None else F.when(full, F.col("cap")).otherwise(F.col("weight") * level)
    return weighed.select("none", "source", "source_size", "place", "weight", target.alias("target"))


# ---------------------------------------------------------------- draws

def permuted(draw: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each ``draw`` below ``n`` another number below ``n``, a permutation for each ``key``: a Feistel network, walked until it comes back below n."""
    bits = np.array([max(1, (int(x - 1).bit_length() + 1) // 2) for x in np.unique(n)], np.uint64)
    half = bits[np.searchsorted(np.unique(n), n)]
    low = (np.uint64(1) << half) - np.uint64(1)
    x, out = draw.astype(np.uint64), np.zeros(len(draw), np.int64)
    todo = np.arange(len(draw))
    while len(todo):
        a, b, k, m, h = x[todo] >> half[todo], x[todo] & low[todo], key[todo].astype(np.uint64), low[todo], half[todo]
        for turn in range(6):
            with np.errstate(over="ignore"):
                f = (b + k + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, (a ^ (f >> np.uint64(31))) & m
        x[todo] = (a << h) | b
        done = x[todo] < n[todo].astype(np.uint64)
        out[todo[done]] = x[todo[done]].astype(np.int64)
        todo = todo[~done]
    return out


def split(lo: int, hi: int, quota: np.ndarray, seed: int) -> tuple[int, np.ndarray]:
    """The middle of shards [lo, hi) and how many blocks of each source go below it; the left part gets its share of slots."""
    mid = (lo + hi) // 2
    total = int(quota.sum())
    slots = total * (mid - lo) // (hi - lo)
    return mid, np.random.default_rng([seed & MASK, lo, hi]).multivariate_hypergeometric(quota, slots, method="marginals")


SOURCE = ("place", "n_blocks", "source_size", "wanted", "n_draws")  # what is known of a source all the way down
ARRAYS = (*SOURCE, "first", "quota")
NODE = "lo long, hi long, " + ", ".join(f"{c} array<long>" for c in ARRAYS)


def _subtree(lo: int, hi: int, node: dict[str, np.ndarray], seed: int, least: int) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """The parts of a node with at most ``least`` shards: (lo, hi, for each source that has blocks there its first draw and quota)."""
    stack = [(lo, hi, node)]
    while stack:
        lo, hi, node = stack.pop()
        if not len(node["quota"]):
            continue
        if hi - lo <= least:
            yield lo, hi, node
            continue
        mid, below = split(lo, hi, node["quota"], seed)
        for at, to, first, quota in ((mid, hi, node["first"] + below, node["quota"] - below), (lo, mid, node["first"], below)):
            stack.append((at, to, {c: v[quota > 0] for c, v in (node | {"first": first, "quota": quota}).items()}))


def _blocks(shard: int, node: dict[str, np.ndarray], block: int, seed: int, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, ...]]:
    """What a shard draws, some rows at a time: (shard, place, block, pass, the word of the source at which the block, or what is wanted of it, stops)."""
    ends = np.cumsum(node["quota"])
    for k in range(0, int(ends[-1]), most):
        slot = np.arange(k, min(k + most, int(ends[-1])))
        row = np.searchsorted(ends, slot, side="right")
        place, n, size, wanted, n_draws = (node[c][row] for c in SOURCE)
        draw = node["first"][row] + slot - (ends - node["quota"])[row]
        turn, index = draw // n, draw % n
        # a source's last block may be short and is the last of a pass; the others are permuted, anew in each pass
        with np.errstate(over="ignore"):
            key = (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (turn.astype(np.uint64) << np.uint64(40)) ^ np.uint64(seed & MASK)
        at = index.copy()
        some = np.flatnonzero(index < n - 1)
        at[some] = permuted(index[some], n[some] - 1, key[some])
        stop = np.minimum((at + 1) * block, size)
        rest = wanted % size
        cut = (draw == n_draws - 1) & (rest > 0)
        stop[cut] = (at * block + (rest - 1) % block + 1)[cut]
        yield np.full(len(slot), shard), place, at, turn, stop


def draws(sources: DataFrame, shards: int, block: int, seed: int = 11) -> DataFrame:
    """``shard, place, block, pass, stop`` of every block drawn; ``sources`` has the columns SOURCE, one row each."""
    import pyarrow as pa

    def upper(batches: Iterator) -> Iterator:
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got).sort_by("place")
            node = {c: t.column(c).to_numpy() for c in SOURCE}
            node |= {"first": np.zeros_like(node["place"]), "quota": node["n_draws"]}
            for lo, hi, part in _subtree(0, shards, node, seed, max(1, -(-shards // UPPER))):
                yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([hi]), *(pa.array([part[c].tolist()], pa.list_(pa.int64())) for c in ARRAYS)], [c.split()[0] for c in NODE.split(", ")])

    def lower(batches: Iterator) -> Iterator:
        for batch in batches:
            for row in batch.to_pylist():
                for shard, _, node in _subtree(row["lo"], row["hi"], {c: np.array(row[c], np.int64) for c in ARRAYS}, seed, 1):
                    for columns in _blocks(shard, node, block, seed):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["shard", "place", "block", "pass", "stop"])

    nodes = sources.where("n_draws > 0").select(*SOURCE).coalesce(1).mapInArrow(upper, NODE).repartition(min(shards, UPPER), "lo")
    return nodes.mapInArrow(lower, "shard long, place long, block long, pass long, stop long")


# ---------------------------------------------------------------- the mix

class Mix:
    """A mix of documents: ``sources`` with their targets, ``documents`` with their places, and what each shard takes of them.

    Documents are put in the order of their hash in groups by its upper bits, so a source of any size lies in many groups, and each
    group goes on from the words of those before it.
    """

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = 11, **columns):
        meta = durable(sized(docs, **columns))
        bits = max(0, (meta.count() // GROUP).bit_length())
        dealt = meta.withColumn("g", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")).withColumn("run", F.col("size") * F.col("copies"))
        groups = durable(dealt.groupBy("none", "source", "g").agg(F.sum("run").alias("words")))
        found = durable(targets(groups.groupBy("none", "source").agg(F.sum("words").alias("source_size")), weights, share, most))
        words_in, words_out = found.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
        self.block = b = max(block, -(-words_in // MOST_BLOCKS))
        self.shards, self.seed = max(1, round(words_out / shard_words)), seed
        s = found.withColumn("wanted", F.least(F.round("target").cast("long"), F.floor(most * F.col("source_size")).cast("long"))).withColumn("n_blocks", F.expr(f"(source_size + {b - 1}) div {b}"))
        self.sources = s.withColumn("n_draws", F.expr(f"coalesce(try_divide(wanted - pmod(wanted, source_size), source_size) * n_blocks, 0) + (coalesce(wanted % nullif(source_size, 0), 0) + {b - 1}) div {b}").cast("long"))
        earlier = Window.partitionBy("none", "source").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
        offset = groups.select("none", "source", "g", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset")).join(found.select("none", "source", "place", "source_size", "target"), ["none", "source"])
        inside = Window.partitionBy("none", "source", "g").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        at = dealt.withColumn("at", F.coalesce(F.sum("run").over(inside), F.lit(0))).join(offset, ["none", "source", "g"])
        each = at.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        self.documents = each.select("doc_id", "h", "copy", "size", "place", "source_size", "target", (F.col("offset") + F.col("at") + F.col("copy") * F.col("size")).alias("start"))

    def pieces(self) -> DataFrame:
        """The columns of ``documents`` with ``shard, block, pass, first_word, n_words``: what is taken of each document.

        ``first_word`` counts from 0 in the document.  A block of it that nobody draws, and an empty document, have one row with a null ``n_words``.
        """
        b = self.block
        cut = F.expr(f"case when size > 0 then sequence(start div {b}, (start + size - 1) div {b}) end")
        met = self.documents.withColumn("block", F.explode_outer(cut)).join(draws(self.sources, self.shards, b, self.seed).hint("merge"), ["place", "block"], "left")  # no plan can guess how many they are
        begin, end = F.greatest("start", F.col("block") * b), F.least(F.col("start") + F.col("size"), "stop")
        return met.withColumn("first_word", begin - F.col("start")).withColumn("n_words", F.when(F.col("stop").isNotNull() & (end > begin), end - begin))

    def taken(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken`` of every document."""
        one = self.pieces().groupBy("place", "start", "h", "copy", "doc_id", "size", "source_size", "target").agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("taken"))
        return one.select("doc_id", "size", "source_size", "target", "taken")

    def shuffled(self) -> DataFrame:
        """The mix itself: ``shard, position, doc_id, place, pass, first_word, n_words``; in a shard blocks come in the order of a hash, their documents as they lie."""
        some = self.pieces().where("n_words is not null").withColumn("turn", F.xxhash64(F.lit(self.seed), "place", "block", "pass"))
        order = Window.partitionBy("shard").orderBy("turn", "place", "block", "pass", "start", "h", "copy")
        return some.select("shard", (F.row_number().over(order) - 1).cast("long").alias("position"), "doc_id", "place", "pass", "first_word", "n_words")
