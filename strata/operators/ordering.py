"""Orders of lists that several versions changed: carried values, three-way order merge, stacking under constraints.

No list has to fit a task: rows are dealt by ranges of (group, order), parts are scanned by themselves and go on from what the parts
before them hold.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import sequences
from strata.operators.resolve import numbered
from strata.plans.lineage import durable


def carried(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last value that isn't null among a row and those of its group before it, however large a group is; ``order`` is unique in it."""
    placed = durable(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = placed.groupBy(*by, "__part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__end"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*by, "__part", F.last("__end", ignorenulls=True).over(earlier).alias("__before"))
    return placed.withColumn(name, inside).join(before, [*by, "__part"]).withColumn(name, F.coalesce(name, "__before")).drop("__part", "__before")


def out_of_place(lists: DataFrame, by: str, key: str, was: str, now: str) -> DataFrame:
    """``by, key`` of rows outside one longest run that both orders agree on.

    A group's places are one array, so an Arrow batch holds many groups and a small one costs no call of its own.
    """

    def run(arrays: pa.Array) -> pa.Array:
        out = []
        for places in arrays.to_pylist():
            keep = set(sequences.longest_increasing(places))
            out.append([k not in keep for k in range(len(places))])
        return pa.array(out, pa.list_(pa.bool_()))

    row = F.struct(F.col(now).alias("now"), F.col(was).cast("long").alias("was"), F.col(key).alias("key"))
    rows = lists.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    moved = rows.withColumn("off", F.arrow_udf(run, "array<boolean>")(F.transform("rows", lambda r: r.was)))
    return moved.select(by, F.explode(F.arrays_zip("rows", "off")).alias("r")).where("r.off").select(by, F.col("r.rows.key").alias(key))


def merged_order(base: DataFrame, ours: DataFrame, live: DataFrame, by: str, key: str, pos: str) -> DataFrame:
    """Three-way merge of orders: ``by, key, position, how, both_moved``.

    The tables hold ``by, key, pos`` (from 0 on) with unique keys and places in a group; ``live`` also ``kept``: a row that the source dropped
    and that stays.  The source's order is the ground, without what the live version deleted.  A kept row goes behind the nearest row
    before it in the base (``kept``); one that the live version picked up, behind the nearest before it there (``moved``), and so
    does one that only the live version has (``added``).  ``both_moved``: the source had moved a moved row as well.

    Each such row's nearest neighbour that stands by itself is a carried value and those behind one neighbour keep the order they
    have where they come from, so the whole is three scans and a sort, with no insertion one by one.
    """
    on = [by, key]
    b = base.select(*on, F.col(pos).alias("b_pos"))
    o = ours.select(*on, F.col(pos).alias("o_pos"))
    t = live.select(*on, F.col(pos).alias("t_pos"), F.coalesce("kept", F.lit(False)).alias("kept"))
    known = durable(b.join(o, on, "full_outer").join(t, on, "full_outer").withColumn("kept", F.coalesce("kept", F.lit(False)) & F.col("o_pos").isNull() & F.col("b_pos").isNotNull()))
    in_base, in_ours, in_live = (F.col(c).isNotNull() for c in ("b_pos", "o_pos", "t_pos"))
    existing = known.where(in_base & in_live & (in_ours | F.col("kept")))
    moved = out_of_place(existing.select(*on, "b_pos", "t_pos"), by, key, "b_pos", "t_pos").withColumn("is_moved", F.lit(True))
    source = out_of_place(existing.where(in_ours).select(*on, "b_pos", "o_pos"), by, key, "b_pos", "o_pos").withColumn("source_moved", F.lit(True))
    rows = known.join(moved, on, "left").join(source, on, "left").fillna(False, ["is_moved", "source_moved"])
    ground = in_ours & (in_live | ~in_base)
    # a ground row stands at its place in the source, a kept one behind the ground row before it in the base
    based = carried(rows.where(in_base).withColumn("at", F.when(ground, F.col("o_pos"))), [by], ["b_pos"], "at", "at").where("kept").select(*on, F.coalesce("at", F.lit(-1)).alias("kept_at"))
    rows = rows.join(based, on, "left").withColumn("stands", F.when(ground, F.struct(F.col("o_pos").alias("major"), F.lit(-1).cast("long").alias("minor"))).when(F.col("kept"), F.struct(F.col("kept_at").alias("major"), F.col("b_pos").cast("long").alias("minor"))))
    own = F.col("stands").isNotNull() & ~F.col("is_moved")
    lively = rows.where(in_live & (F.col("stands").isNotNull() | ~in_base)).withColumn("anchor", F.when(own, F.col("stands")))
    put = carried(lively, [by], ["t_pos"], "anchor", "anchor")
    front = F.struct(F.lit(-1).cast("long").alias("major"), F.lit(-2).cast("long").alias("minor"))
    put = put.select(*on, F.coalesce("anchor", front).alias("at"), F.when(own, -1).otherwise(F.col("t_pos")).cast("long").alias("behind"), F.when(F.col("is_moved"), "moved").when(F.col("kept"), "kept").when(own, "source").otherwise("added").alias("how"), (F.col("is_moved") & F.col("source_moved")).alias("both_moved"))
    new = rows.where(ground & ~in_live).select(*on, F.col("stands").alias("at"), F.lit(-1).cast("long").alias("behind"), F.lit("source").alias("how"), F.lit(False).alias("both_moved"))
    return numbered(put.unionByName(new), [by], ["at", "behind"], "position").select(*on, "position", "how", "both_moved")


# ---------------------------------------------------------------- stacking

def peeled(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes in rounds, each taking those that no edge left points at: (``node, value, depth``, the rest ``node, value``).

    ``nodes``: ``node, value``; ``edges``: ``src, dst`` between them.  A node's value becomes the largest of its own and of all that
    lead to it, nulls aside.  The depth is the number of edges of the longest way to it; nodes on or behind a ring are the rest.
    """
    rest, open_, done, depth = durable(nodes), durable(edges.distinct()), None, 0
    while True:
        ready = rest.join(open_.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        ready = durable(ready)
        if ready.isEmpty():
            return (ready if done is None else done), rest
        done = ready if done is None else done.unionByName(ready)
        told = open_.join(ready.select(F.col("node").alias("src"), F.col("value").alias("told")), "src").groupBy(F.col("dst").alias("node")).agg(F.max("told").alias("told"))
        rest = durable(rest.join(ready.select("node"), "node", "left_anti").join(told, "node", "left").select("node", F.greatest("value", "told").alias("value")))
        open_ = durable(open_.join(ready.select(F.col("node").alias("src")), "src", "left_anti"))
        depth += 1
        if depth % 16 == 0:
            done = durable(done)


def stacked(rows: DataFrame, edges: DataFrame, by: str, key: str, pos: str, rank: str) -> DataFrame:
    """Places new rows among those that stay, under constraints: ``by, key, position, told``.

    ``rows``: ``by, key`` (unique over all groups), ``pos`` (null for a new row) and ``rank``, the new rows' order where nothing else
    tells; ``edges``: ``below, above``.  Rows that stay keep their order.  A new row goes right above the highest row that it must be
    above, through other new rows as well; where it must also be below one that is no higher, that wins (``squeezed``).  Constraints
    between new rows hold, but for those between rows on rings or between rings, which are told (``cycle``) and dropped.  Edges between rows that stay ask nothing.
    """
    at = rows.select(F.col(key).alias("node"), F.col(pos).cast("double").alias("pos"))
    new = at.where("pos is null").select("node")
    e = edges.select("below", "above").distinct()
    e = e.join(at.select(F.col("node").alias("below"), F.col("pos").alias("from")), "below").join(at.select(F.col("node").alias("above"), F.col("pos").alias("to")), "above")
    e = durable(e)
    low = e.where("from is not null and to is null").groupBy(F.col("above").alias("node")).agg(F.max("from").alias("value"))
    high = e.where("from is null and to is not null").groupBy(F.col("below").alias("node")).agg(F.max(-F.col("to")).alias("value"))
    between = e.where("from is null and to is null").select(F.col("below").alias("src"), F.col("above").alias("dst"))
    back = between.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    with_low, with_high = new.join(low, "node", "left"), new.join(high, "node", "left")
    up, stuck_up = peeled(with_low, between)
    down, stuck_down = peeled(with_high, back)
    ring = durable(stuck_up.select("node").join(stuck_down.select("node"), "node", "left_semi").withColumn("cycle", F.lit(True)))
    if not ring.isEmpty():
        inside = lambda df, a, b: df.join(ring.select(F.col("node").alias(a)), a, "left_semi").join(ring.select(F.col("node").alias(b)), b, "left_semi").select(a, b)
        up, _ = peeled(with_low, between.exceptAll(inside(between, "src", "dst")))
        down, _ = peeled(with_high, back.exceptAll(inside(back, "src", "dst")))
    placed = up.select("node", F.coalesce("value", F.lit(float("-inf"))).alias("low"), "depth").join(down.select("node", (-F.col("value")).alias("high")), "node").join(ring, "node", "left")
    # places of rows that stay need not be whole numbers: right below one is above all that are lower
    squeezed = F.col("high").isNotNull() & (F.col("high") <= F.col("low"))
    told = F.when(F.col("cycle"), "cycle").when(squeezed, "squeezed").otherwise("placed")
    slot = placed.select("node", F.when(squeezed, F.col("high")).otherwise(F.col("low")).alias("slot"), F.when(squeezed, -1).otherwise(1).alias("side"), "depth", told.alias("told"))
    out = rows.select(by, key, F.col(pos).cast("double").alias("__pos"), F.col(rank).alias("__rank")).join(slot.withColumnRenamed("node", key), key, "left")
    out = out.withColumn("slot", F.coalesce("slot", "__pos")).fillna({"side": 0, "depth": 0, "told": "stays"})
    return numbered(out, [by], ["slot", "side", "depth", "__rank", key], "position").select(by, key, "position", "told")
