"""MinHash near-duplicates with odd sketches and exact confirmation.

Each text becomes a set of hashed word shingles.  Texts with equal sets are one node, with a
number of its own.  A node's MinHash samples give band keys, and fold into an odd sketch: a bitmap
that holds the parity of how many samples fall on each bit, so that the popcount of two
sketches' XOR estimates how many samples differ.

Nodes that share a band key form families (connected components over each key's smallest
member; no pair is listed).  First each node is held, on the full sets, against the one of
its keys' smallest members that its sketch is nearest to; most large groups of copies are
joined by that.  In families that are not, sketches rule out pairs that cannot reach the
threshold, and the rest are confirmed on the full sets, but only while the two are not yet
joined: a task returns a spanning forest of its confirmed links.  A family over ``BLOCK``
nodes is cut by set size (sets whose sizes differ too much cannot be linked) and slices of
those, and each pair of slices that can hold a link is one task, except where both are of
the family's largest part that is joined already; so no task grows with a family, and no
link between different components is lost.

The number of bands follows from the threshold: a pair at it shares no band key with
probability ``MISS``.  The sketch filter keeps pairs down to ``SLACK`` below the threshold.

Ids only name the result: a component is called by its smallest id that is not null (null if it
has none).  So rows with a null id link others as any row does, and where one id has several
texts each row gets the component of its own text.  A null text counts as empty; an empty set is
linked with nothing and called by its own id.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.graph import components

from .common import U64, Words, documents, durable, mix, pieces, rolling, texts_of

ROWS, MISS, BITS, SLACK, BLOCK, SALTS = 5, 1e-7, 512, 0.22, 500, 16
FEATURES = "doc_id long, t1 long, t2 long, n long, digest binary, sketch binary, bands array<long>"


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's distinct shingles of lower-cased words, hashed and sorted; a shorter text's whole sequence is one."""
    w = Words([t.lower() for t in texts])
    grams = rolling(w.hashes, size)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(rolling(w.hashes[a:b], int(b - a), 0xA0761D6478BD642F))
        else:
            out.append(np.zeros(0, U64))
    return out


def _functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * k + 1, dtype=U64) * U64(0x2545F4914F6CDD1D))
    return (seeds[:k] >> U64(32)).astype(np.uint32) | np.uint32(1), (seeds[k:] >> U64(32)).astype(np.uint32)


def signatures(sets: list[np.ndarray], bands: int, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (sets x bands) and odd sketches (sets x BITS/8 bytes) of non-empty sets."""
    k = bands * rows
    flat = np.concatenate(sets)
    low = (flat >> U64(32)).astype(np.uint32)
    starts = np.zeros(len(sets), np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=starts[1:])
    mins = np.empty((k, len(sets)), np.uint32)
    a, b = _functions(k)
    with np.errstate(over="ignore"):
        for i in range(k):
            mins[i] = np.minimum.reduceat(low * a[i] + b[i], starts)
        keys = np.empty((len(sets), bands), U64)
        for band in range(bands):
            acc = np.full(len(sets), band + 1, U64) * U64(0x9E3779B97F4A7C15)
            for r in range(rows):
                acc = mix(acc + mins[band * rows + r].astype(U64))
            keys[:, band] = acc
        bit = mix(mins.astype(U64) + np.arange(1, k + 1, dtype=U64)[:, None] * U64(0xD1342543DE82EF95)) % U64(BITS)
    spot = (np.arange(len(sets))[None, :] * BITS + bit.astype(np.int64)).ravel()
    parity = np.bincount(spot, minlength=len(sets) * BITS).astype(np.uint8) & 1
    return keys, np.packbits(parity.reshape(len(sets), BITS), axis=1)


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """Order-free 128-bit values of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.zeros(len(sets), np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=starts[1:])
    with np.errstate(over="ignore"):
        return np.stack([np.add.reduceat(mix(flat), starts), np.add.reduceat(mix(flat ^ U64(0xE7037ED1A0B428DB)), starts)], axis=1)


def features(df: DataFrame, size: int, bands: int) -> DataFrame:
    """Set size, digest, odd sketch and band keys of every row of (doc_id, t1, t2, text)."""

    def run(it):
        import pyarrow as pa

        for batch in it:
            texts = texts_of(batch)
            for a, b in pieces(texts):
                sets = shingle_sets(texts[a:b], size)
                some = [s for s in sets if len(s)]
                digest, sketch, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if some:
                    k, o = signatures(some, bands)
                    d = _digests(some)
                    k = k.view(np.int64)
                    at = [i for i, s in enumerate(sets) if len(s)]
                    for j, i in enumerate(at):
                        digest[i], sketch[i], keys[i] = d[j].tobytes(), o[j].tobytes(), k[j]
                named = [batch.column(c).slice(a, b - a) for c in ("doc_id", "t1", "t2")]
                yield pa.RecordBatch.from_arrays([*named, pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "t1", "t2", "n", "digest", "sketch", "bands"])

    return df.mapInArrow(run, FEATURES)


def estimate(differing: np.ndarray, samples: int, bits: int = BITS) -> np.ndarray:
    """Similarity from the popcount of two odd sketches' XOR."""
    share = np.minimum(2 * differing / bits, 0.999)
    return 1 + bits / (4 * samples) * np.log1p(-share)


def spanning_links(ids: np.ndarray, side: np.ndarray | None, part: np.ndarray, sets: list[np.ndarray], sketches: np.ndarray, samples: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the confirmed links between different parts; with ``side``, only of those between different sides.

    ``sketches``: uint64 words by row.  Every such pair in different trees is either ruled out by size or sketch, or checked on the full sets.
    """
    n = np.array([len(s) for s in sets], np.int64)
    left = np.arange(len(sets))  # not yet reached
    starts = np.zeros(len(sets) + 1, np.int64)
    np.cumsum(n, out=starts[1:])
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    out: list[tuple[int, int]] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            small, large = np.minimum(n[left], n[i]), np.maximum(n[left], n[i])
            may = (100 * small >= percent * large) & (part[left] != part[i])
            if side is not None:
                may &= side[left] != side[i]
            at = np.flatnonzero(may)
            if len(at):
                differing = np.bitwise_count(sketches[left[at]] ^ sketches[i]).sum(axis=1, dtype=np.int64)
                at = at[estimate(differing, samples) >= percent / 100 - SLACK]
            if not len(at):
                continue
            found = []
            for lo in range(0, len(at), 512):
                js = left[at[lo : lo + 512]]
                rows = np.concatenate([flat[starts[j] : starts[j + 1]] for j in js])
                k = np.searchsorted(sets[i], rows)
                k[k == n[i]] = 0
                both = np.add.reduceat((sets[i][k] == rows).astype(np.int64), np.concatenate([[0], np.cumsum(n[js])[:-1]]))
                found.append(100 * both >= percent * (n[i] + n[js] - both))
            at = at[np.concatenate(found)]
            out += [(int(ids[i]), int(ids[j])) for j in left[at]]
            queue += left[at].tolist()
            left = np.delete(left, at)
    return out


def _salted(many: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """Inner join of nodes with a table of one row a key: that row is repeated, so that a large family's nodes meet it in many tasks.

    Repeated rows shuffle small but are large in memory, so the join is never one by broadcast.
    """
    dealt = many.withColumn("__salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return dealt.hint("merge").join(few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), [*by, "__salt"]).drop("__salt")


def _tasks(open_nodes: DataFrame, percent: int, block: int) -> DataFrame:
    """``node, family, n, part`` to ``node, part, task, side``: a row for each task that a node takes part in."""
    ratio = math.log(100 / percent)
    sizes = open_nodes.groupBy("family", "part").agg(F.count("*").alias("m"))
    major = durable(sizes.groupBy("family").agg(F.max_by("part", F.struct("m", "part")).alias("major"), F.sum("m").alias("total")))
    cell = _salted(open_nodes, major, ["family"]).withColumn("cell", F.floor(F.log("n") / F.lit(ratio)).cast("int")).withColumn("other", (F.col("part") != F.col("major")).cast("int"))
    slices = cell.groupBy("family", "cell", "other").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("s"))
    spread = slices.select("family", F.explode(F.array(*(F.col("cell") + d for d in (-1, 0, 1)))).alias("cell"), F.struct(F.col("cell").alias("c"), F.col("other").alias("o"), F.col("s").alias("s")).alias("x"))
    plan = durable(spread.groupBy("family", "cell").agg(F.collect_list("x").alias("near")))  # six entries a cell at most
    dealt = _salted(cell, plan, ["family", "cell"])
    mine = F.struct(F.col("cell").alias("c"), F.col("other").alias("o"), F.pmod(F.xxhash64("node"), F.filter("near", lambda x: (x.c == F.col("cell")) & (x.o == F.col("other")))[0].s).cast("int").alias("k"))
    dealt = dealt.select("node", "part", "family", "total", mine.alias("mine"), "near")
    # the other slices met: all near ones, but none of the major part for one of its own
    met = F.filter("near", lambda x: (x.o == 1) | (F.col("mine.o") == 1))
    met = F.flatten(F.transform(met, lambda x: F.transform(F.sequence(F.lit(0), x.s - 1), lambda k: F.struct(x.c.alias("c"), x.o.alias("o"), k.alias("k")))))
    none = F.struct(F.lit(0).alias("c"), F.lit(0).alias("o"), F.lit(0).alias("k"))
    pair = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), F.lit(side).alias("side"))
    many = F.transform(met, lambda y: F.when(F.col("mine") < y, pair(F.col("mine"), y, 0)).when(F.col("mine") > y, pair(y, F.col("mine"), 1)).otherwise(pair(y, y, -1)))
    out = dealt.select("node", "part", "family", F.explode(F.when(F.col("total") <= block, F.array(pair(none, none, -1))).otherwise(many)).alias("x"))
    return out.select("node", "part", F.struct("family", "x.a", "x.b").alias("task"), F.col("x.side").alias("side"))


def _nearest(star: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """``node, low``: of each node's smallest members by key the one whose sketch is nearest, where sizes allow a link."""
    mine, theirs = sketches.select("node", F.col("sketch").alias("x"), "n"), sketches.select(F.col("node").alias("low"), F.col("sketch").alias("y"), F.col("n").alias("m"))
    both = star.join(mine, "node").join(theirs, "low").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))

    def differing(it):
        import pyarrow as pa

        for batch in it:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), U64).reshape(-1, BITS // 64) for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("low"), pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64))], ["node", "low", "d"])

    return both.select("node", "low", "x", "y").mapInArrow(differing, "node long, low long, d long").groupBy("node").agg(F.min_by("low", F.struct("d", "low")).alias("low"))


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of rows a, b, x, y whose sets x and y reach the threshold."""

    def run(it):
        import pyarrow as pa

        for batch in it:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, t1, t2, text``: the text's 128-bit value beside it, made without Python."""
    docs = documents(df, id_col, text_col)
    return docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")


def _grouped(df: DataFrame, id_col: str, text_col: str, size: int, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """All rows as ``doc_id, t1, t2, n, digest``; and ``digest, component_id, first`` of every set, where ``first`` (no_id, doc_id, t1, t2) is the least row of its component."""
    docs = _named(df, id_col, text_col)
    bands = bands_for(percent / 100)
    seen = durable(features(docs, size, bands))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")
    by_set = seen.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.min(row).alias("first"), F.min(F.struct("n", "sketch", "bands")).alias("x"))
    nodes = durable(by_set.select(F.monotonically_increasing_id().alias("node"), "digest", "id", "first", "x.n", "x.sketch", "x.bands"))
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    star = durable(keyed.join(shared, "key").where("node <> low").select("node", "low").distinct())
    family = components(star.select(F.col("node").alias("a"), F.col("low").alias("b"))).select("node", F.col("component").alias("family"))
    inside = durable(nodes.select("node", "n", "sketch", "first").join(family, "node"))

    def to_sets(it):
        import pyarrow as pa

        for batch in it:
            texts = texts_of(batch)
            for a, b in pieces(texts):
                sets = pa.array([s.tobytes() for s in shingle_sets(texts[a:b], size)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), sets], ["node", "set"])

    # one text of each node, fetched by its whole name; repeated rows of that name meet before the shuffle
    name = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "t1", "t2"]
    once = docs.select(*name, "text").groupBy("id", "no_id", "t1", "t2").agg(F.first("text").alias("text"))
    wanted = inside.select("node", "first.*").select("node", *name)
    sets = durable(once.join(wanted, ["id", "no_id", "t1", "t2"]).select("node", "text").mapInArrow(to_sets, "node long, set binary"))
    nearest = _nearest(star, inside, percent).join(sets.withColumnRenamed("set", "x"), "node").join(sets.select(F.col("node").alias("low"), F.col("set").alias("y")), "low")
    first = durable(_confirmed(nearest.select(F.col("node").alias("a"), F.col("low").alias("b"), "x", "y"), percent))
    parts = inside.join(components(first).select("node", F.col("component").alias("part")), "node", "left").select("node", "n", "sketch", "family", F.coalesce("part", "node").alias("part"))
    split = parts.groupBy("family").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("family")
    open_nodes = durable(_salted(parts, split, ["family"]))
    dealt = _tasks(open_nodes.select("node", "family", "n", "part"), percent, block)

    def links(group):
        import pyarrow as pa

        ids, raw, sk = group.column("node").to_numpy(), group.column("set").to_pylist(), group.column("sketch").to_pylist()
        side = group.column("side").to_numpy()
        sketches = np.frombuffer(b"".join(sk), U64).reshape(len(sk), BITS // 64)
        got = spanning_links(ids, None if (side < 0).all() else side, group.column("part").to_numpy(), [np.frombuffer(x, U64) for x in raw], sketches, bands * ROWS, percent)
        return pa.table({"a": pa.array([x for x, _ in got], pa.int64()), "b": pa.array([y for _, y in got], pa.int64())})

    confirmed = open_nodes.select("node", "sketch").join(sets, "node").join(dealt, "node").groupBy("task").applyInArrow(links, "a long, b long")
    joined = components(first.unionByName(confirmed)).select("node", "component")
    linked = nodes.select("node", "digest", "id", "first").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    called = durable(linked.groupBy("component").agg(F.min("id").alias("component_id"), F.min("first").alias("first")))
    return seen.select("doc_id", "t1", "t2", "n", "digest"), _salted(linked.select("node", "digest", "component"), called, ["component"]).select("digest", "component_id", "first")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: texts are linked from ``percent`` per cent of shared ``size``-word shingles on."""
    seen, sets = _grouped(df, id_col, text_col, size, percent, block)
    found = seen.select("doc_id", "n", "digest").join(sets.select("digest", "component_id", F.lit(True).alias("named")), "digest", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """The rows without near-duplicates, with the same columns: of each component the row of the smallest id stays (of one id's, that of the smallest text hash).

    Null ids come after all others.  Rows of one id and one text are one document: of those one stays, the least as JSON.
    Empty texts have no copies and all stay.
    """
    seen, sets = _grouped(df, id_col, text_col, size, percent, block)
    mine = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")
    rows = seen.where("n > 0").groupBy("doc_id", "t1", "t2", "digest").agg((F.count("*") > 1).alias("many"))
    verdict = durable(rows.join(sets, "digest").select("doc_id", "t1", "t2", "many", (mine == F.col("first")).alias("stays")).where("many or not stays"))
    text, cols = F.coalesce(F.col(text_col), F.lit("")), df.columns
    names = [f"__{n}" + "_" * max(map(len, cols)) for n in ("id", "t1", "t2")]  # longer than any column's, so new
    keyed = df.select("*", F.col(id_col).cast("long").alias(names[0]), F.xxhash64(text).alias(names[1]), F.xxhash64(F.lit(1), text).alias(names[2]))
    met = lambda v: keyed[names[0]].eqNullSafe(v["doc_id"]) & (keyed[names[1]] == v["t1"]) & (keyed[names[2]] == v["t2"])
    once = keyed.join(v := verdict.select("doc_id", "t1", "t2"), met(v), "left_anti")
    twice = keyed.join(v := verdict.where("many and stays").select("doc_id", "t1", "t2"), met(v), "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in cols))
    least = twice.groupBy(*names).agg(F.min_by(whole, F.to_json(whole)).alias("__row")).select(*(F.col("__row").getField(c).alias(c) for c in cols))
    return once.select(*(F.col(f"`{c}`") for c in cols)).unionByName(least)
