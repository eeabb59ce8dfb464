"""Picture signatures: small grey thumbnails that tell which pictures show the same, held against each other in blocks.

A signature is a picture's width and height and the grey levels (0 to 255) of a fixed number of cells.  Two match if their shapes are
within five per cent and the levels differ, summed up, by less than LIMIT of the larger ink (what is not white).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.plans.lineage import durable

# The share of ink under which a difference is none, the shapes' tolerance, and the ink that counts at least.
LIMIT, SHAPE, FAINT = 0.3, 0.05, 2 * 255
STRIDE = 4  # cells summed up before single ones are compared


def ink(levels: Column) -> Column:
    return F.transform(levels, lambda v: 255 - v)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v)


def difference(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")))


def same_shape(wa: Column, ha: Column, wb: Column, hb: Column) -> Column:
    a, b = wa / F.greatest(ha, F.lit(1)), wb / F.greatest(hb, F.lit(1))
    return F.abs(a - b) <= SHAPE * F.greatest(a, b)


def matches(a: Column, b: Column) -> Column:
    """Whether two signatures (``width, height, levels``) show the same picture; null where one is missing."""
    most = F.greatest(total(ink(a.levels)), total(ink(b.levels)), F.lit(FAINT))
    return same_shape(a.width, a.height, b.width, b.height) & (difference(a.levels, b.levels) < LIMIT * most)


def classes(pictures: DataFrame, key: str) -> DataFrame:
    """``key, class_id``: pictures of one signature share their smallest key; one without a signature has none."""
    sign = ["width", "height", "levels"]
    some = pictures.where("levels is not null and width is not null and height is not null").select(key, *sign)
    return some.join(some.groupBy(*sign).agg(F.min(key).alias("class_id")), sign).select(key, "class_id", *sign)


def _matched(mine, theirs, same: bool):
    """Arrow rows ``a, b`` of two blocks' pictures (``class_id, width, height, ink, cells``) that match; of one block with itself each pair once.

    What the inks, and the sums of STRIDE cells at a time, differ by is no more than what the cells do, so most pairs are settled by those.
    """
    import numpy as np
    import pyarrow as pa

    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def columns(rows):
        rows = rows.sort_by("ink")
        cells = np.frombuffer(b"".join(rows.column("cells").to_pylist()), np.int32).reshape(rows.num_rows, -1)
        shape = rows.column("width").to_numpy() / np.maximum(rows.column("height").to_numpy(), 1)
        sums = np.add.reduceat(cells, np.arange(0, cells.shape[1], STRIDE), axis=1).T.copy() if cells.shape[1] else np.zeros((0, rows.num_rows), np.int32)
        return rows.column("class_id").to_numpy(), shape, rows.column("ink").to_numpy(), cells, sums

    if mine.num_rows and theirs.num_rows:
        ids, shapes, inks, cells, sums = columns(mine)
        names, others, there, far, theirs_sums = columns(theirs)
        low = np.searchsorted(there, inks - LIMIT * np.maximum(inks, FAINT) - 1)
        high = np.searchsorted(there, np.maximum(inks / (1 - LIMIT), inks + LIMIT * FAINT) + 1, side="right")
        for i, (lo, hi) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
            lo = max(lo, i + 1) if same else lo
            if lo >= hi:
                continue
            most = LIMIT * np.maximum(np.maximum(there[lo:hi], inks[i]), FAINT)
            apart = np.zeros(hi - lo, np.int32)
            for mine_sum, their_sum in zip(sums[:, i], theirs_sums[:, lo:hi], strict=True):
                apart += np.abs(their_sum - mine_sum)
            fits = np.abs(others[lo:hi] - shapes[i]) <= SHAPE * np.maximum(others[lo:hi], shapes[i])
            at = np.flatnonzero((apart < most) & fits)
            at = at[np.abs(far[lo + at] - cells[i]).sum(axis=1) < most[at]]
            left.append(np.full(len(at), ids[i])), right.append(names[lo + at])
    x, y = np.concatenate(left), np.concatenate(right)
    return pa.table([pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())], names=["a", "b"])


def same_pictures(found: DataFrame, block: int = 16_384) -> DataFrame:
    """``a, b`` (a < b): classes (of ``class_id, width, height, levels``) that match, each pair once; none is lost.

    There are few cells, so no cell that pictures share tells many apart: a row for each two that meet in one would be a large part of
    all pairs.  Blocks of about ``block`` classes are held against each other instead, each two in a task, which returns matches only.
    """

    def packed(it):
        import numpy as np
        import pyarrow as pa

        for batch in it:
            rows = [np.array(x.values, np.int32).tobytes() for x in batch.column("cells")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class_id", "width", "height", "ink")), pa.array([len(r) for r in rows], pa.int32()), pa.array(rows, pa.binary())], ["class_id", "width", "height", "ink", "size", "cells"])

    known = found.where(~F.exists("levels", lambda v: v.isNull())).select("class_id", "width", "height", "levels").distinct()
    cells = known.select(*(F.col(c).cast("long").alias(c) for c in ("class_id", "width", "height")), total(ink(F.col("levels"))).alias("ink"), ink(F.col("levels")).cast("array<int>").alias("cells"))
    one = durable(cells.mapInArrow(packed, "class_id long, width long, height long, ink long, size int, cells binary"))
    n = one.count()
    k = max(-(-n // block), min(6, n // 1024), 1)
    own = F.pmod(F.xxhash64("class_id"), F.lit(k)).cast("int")

    def run(mine, theirs):
        import pyarrow as pa

        if not mine.num_rows or not theirs.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64())], names=["a", "b"])
        return _matched(mine, theirs, mine.column("p")[0] == mine.column("q")[0])

    # of two blocks the lower one comes from the left; pictures of other numbers of cells never match
    mine = one.withColumn("p", own).withColumn("q", F.explode(F.sequence(F.col("p"), F.lit(k - 1))))
    theirs = one.withColumn("q", own).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("q"))))
    return mine.groupBy("p", "q", "size").cogroup(theirs.groupBy("p", "q", "size")).applyInArrow(run, "a long, b long")


def linked_pictures(pictures: DataFrame, key: str) -> DataFrame:
    """``key, class_id, n_links`` of every picture with a signature: its class and how many other classes match it."""
    found = durable(classes(pictures, key))
    ends = same_pictures(found).select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return found.select(key, "class_id").join(ends, "class_id", "left").select(key, "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
