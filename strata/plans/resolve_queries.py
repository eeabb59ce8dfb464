"""Keys, joins, assignments, alignments and graph queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import graph, resolve, segment
from strata.sources.tables import table


def q7_occurrence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return resolve.occurrence_keys(orders, ["o_orderpriority", "day"], ["o_orderkey"]).select("o_orderkey", "n", "key")


Q7 = """
WITH o AS (SELECT o_orderkey, o_orderpriority || '/' || strftime(o_orderdate, '%Y-%m-%d') AS stem, row_number() OVER (PARTITION BY o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') ORDER BY o_orderkey) AS n FROM orders)
SELECT o_orderkey, n, CASE WHEN n = 1 THEN stem ELSE stem || '#' || n END AS key FROM o
"""


def q8_label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th event of a user and type meets the n-th in a version that lost every seventh."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    kept = events.where("event_id % 7 <> 0").withColumnRenamed("event_id", "new_id")
    return resolve.ordinal_join(events, kept, ["user_id", "event_type"], ["event_id"], ["new_id"]).select("user_id", "event_type", "ordinal", "event_id", "new_id")


Q8 = """
WITH a AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS ordinal FROM events),
b AS (SELECT user_id, event_type, event_id AS new_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS ordinal FROM events WHERE event_id % 7 <> 0)
SELECT user_id, event_type, ordinal, event_id, new_id FROM a JOIN b USING (user_id, event_type, ordinal)
"""


def q9_content_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a key take the keys of equal ones in a renumbered copy, first in, first out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content"))
    copy = docs.where("doc_id % 5 <> 0").select((F.col("doc_id") + 1_000_000).alias("copy_id"), "content")
    return resolve.ordinal_join(docs, copy, ["content"], ["doc_id"], ["copy_id"]).select("doc_id", "copy_id", "ordinal")


Q9 = """
WITH a AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS ordinal FROM documents),
b AS (SELECT doc_id + 1000000 AS copy_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS ordinal FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, copy_id, ordinal FROM a JOIN b USING (text, ordinal)
"""


_BLOCK = ["p_brand", "p_type", "p_size"]


def _name_score() -> Column:
    return F.round(1 - F.levenshtein("x", "y") / F.greatest(F.length("x"), F.length("y")), 6)


def _part_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Part names, and reworded ones."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", *_BLOCK)
    ours = parts.select(*_BLOCK, F.col("p_partkey").alias("a"), F.col("p_name").alias("x"))
    return ours, parts.where("p_partkey % 3 <> 0").select(*_BLOCK, F.col("p_partkey").alias("b"), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" new"))).otherwise(F.col("p_name")).alias("y"))


def _part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of part names against reworded ones of the same brand, type and size."""
    ours, theirs = _part_sides(spark, sf_dir)
    return ours.join(theirs, _BLOCK).withColumn("score", _name_score())


def q10_mutual_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and reworded ones that are clearly each other's best; names are scored once for all parts of a brand, type and size that share them."""
    ours, theirs = _part_sides(spark, sf_dir)
    return resolve.mutual_best_alike(ours, theirs, _BLOCK, "a", "x", "b", "y", _name_score(), 0.5, 0.1)


_NAMES = """
t AS (SELECT p_brand, p_type, p_size, p_partkey AS b, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' new' ELSE p_name END AS y FROM part WHERE p_partkey % 3 <> 0),
s AS (SELECT p_partkey AS a, b, round(1 - levenshtein(p_name, y)::DOUBLE / greatest(length(p_name), length(y)), 6) AS score FROM part JOIN t USING (p_brand, p_type, p_size))
"""
Q10 = f"""
WITH {_NAMES},
r AS (SELECT *, row_number() OVER l AS lr, lead(score) OVER l AS ln, row_number() OVER r AS rr, lead(score) OVER r AS rn FROM s WINDOW l AS (PARTITION BY a ORDER BY score DESC, b), r AS (PARTITION BY b ORDER BY score DESC, a))
SELECT a, b, score FROM r WHERE lr = 1 AND rr = 1 AND score >= 0.5 AND (ln IS NULL OR score - ln >= 0.1) AND (rn IS NULL OR score - rn >= 0.1)
"""


def q11_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and reworded ones taken best first; names are scored once for all parts of a brand, type and size that share them."""
    ours, theirs = _part_sides(spark, sf_dir)
    return resolve.greedy_match_alike(ours, theirs, _BLOCK, "a", "x", "b", "y", _name_score(), 0.35)


def q12_gap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose text changed, paired where exactly one is left on both sides between the same unchanged neighbours."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("content"))
    a = turns.withColumn("anchor", F.when(F.col("turn") % 3 != 1, F.col("turn")))
    b = turns.where("(conv_id + turn) % 11 <> 0 or turn % 3 <> 1").withColumn("anchor", F.when(F.col("turn") % 3 != 1, F.col("turn")))

    def lonely(df: DataFrame, name: str) -> DataFrame:
        left = segment.gap_ids(df, ["conv_id"], "turn", "anchor").where("anchor is null")
        return left.groupBy("conv_id", F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("after", F.lit(-1)).alias("after")).agg(F.count("*").alias("n"), F.min("turn").alias(name)).where("n = 1").drop("n")

    return lonely(a, "a_turn").join(lonely(b, "b_turn"), ["conv_id", "before", "after"])


Q12 = """
WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 <> 1 THEN turn END AS anchor FROM conversations),
u AS (SELECT * FROM t WHERE (conv_id + turn) % 11 <> 0 OR turn % 3 <> 1),
ga AS (SELECT *, coalesce(last_value(anchor IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before, coalesce(first_value(anchor IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS after FROM t),
gb AS (SELECT *, coalesce(last_value(anchor IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before, coalesce(first_value(anchor IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS after FROM u),
a AS (SELECT conv_id, before, after, min(turn) AS a_turn FROM ga WHERE anchor IS NULL GROUP BY ALL HAVING count(*) = 1),
b AS (SELECT conv_id, before, after, min(turn) AS b_turn FROM gb WHERE anchor IS NULL GROUP BY ALL HAVING count(*) = 1)
SELECT conv_id, before, after, a_turn, b_turn FROM a JOIN b USING (conv_id, before, after)
"""


def q13_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by the price range of their flag and status that holds them; each line goes to its first range."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    steps = spark.range(0, 40).select(F.col("id").alias("range_id"), (F.col("id") * 3000.0).alias("low"), (F.col("id") * 3000.0 + 2500.0).alias("high"))
    keys = lines.select("l_returnflag", "l_linestatus").distinct()
    ranges = keys.crossJoin(F.broadcast(steps))  # 40 ranges for each of a handful of flags
    met = resolve.interval_join(lines, "price", ranges, "low", "high", ["l_returnflag", "l_linestatus"], 5000.0)
    return met.groupBy("l_returnflag", "l_linestatus", "range_id").agg(F.count("*").alias("n_lines"), F.min("l_orderkey").alias("first_order"))


Q13 = """
WITH r AS (SELECT range AS range_id, range * 3000.0 AS low, range * 3000.0 + 2500.0 AS high FROM range(0, 40))
SELECT l_returnflag, l_linestatus, range_id, count(*) AS n_lines, min(l_orderkey) AS first_order FROM lineitem JOIN r ON l_extendedprice >= low AND l_extendedprice < high GROUP BY ALL
"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts laid out in rows of forty."""
    parts, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    x, y = (k % 40 * 9 + F.col("p_size") % 5).cast("double"), (F.floor(k / 40) * 7).cast("double")
    return parts.select("p_partkey", x.alias("x0"), y.alias("y0"), (x + 4 + F.col("p_size") % 5).alias("x1"), (y + 3 + F.col("p_size") % 4).alias("y1"))


def q14_spatial_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes at most one unit apart, joined up: each box with its component's smallest member."""
    found = boxes(spark, sf_dir)
    parts = graph.components(resolve.near_pairs(found, "p_partkey", [], 1.0, 16.0).select("a", "b"))
    return found.select("p_partkey").join(parts.withColumnRenamed("node", "p_partkey"), "p_partkey", "left").select("p_partkey", F.coalesce("component", "p_partkey").alias("component"))


BOX = "b AS (SELECT p_partkey AS k, (p_partkey % 40 * 9 + p_size % 5)::DOUBLE AS x0, (p_partkey // 40 * 7)::DOUBLE AS y0, (p_partkey % 40 * 9 + p_size % 5 + 4 + p_size % 5)::DOUBLE AS x1, (p_partkey // 40 * 7 + 3 + p_size % 4)::DOUBLE AS y1 FROM part)"
NEAR = "p.x0 - 0.5 <= q.x1 + 0.5 AND q.x0 - 0.5 <= p.x1 + 0.5 AND p.y0 - 0.5 <= q.y1 + 0.5 AND q.y0 - 0.5 <= p.y1 + 0.5"
Q14 = f"""
WITH RECURSIVE {BOX},
e AS (SELECT p.k AS a, q.k AS b FROM b p JOIN b q ON p.k <> q.k AND {NEAR}),
r(k, c) AS (SELECT k, k FROM b UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.k)
SELECT k AS p_partkey, min(c) AS component FROM r GROUP BY k
"""


def q14_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.near_pairs(boxes(spark, sf_dir), "p_partkey", [], 1.0, 16.0)


Q14P = f"WITH {BOX} SELECT p.k AS a, q.k AS b FROM b p JOIN b q ON p.k < q.k AND {NEAR}"


def q15_band_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as chunks over four bands of quantity; an order in which two lines claim a cell is refused whole."""
    lines = table(spark, sf_dir, "lineitem")
    items = lines.select("l_orderkey", (F.col("l_linenumber") % 3).cast("long").alias("row"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 6).alias("x1"))
    bands = lines.select("l_orderkey").distinct().withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("l_orderkey", F.col("col").cast("long").alias("col"), (F.col("col") * 14.0).alias("left"), (F.col("col") * 14.0 + 14).alias("right"))
    placed = resolve.band_cells(items, bands, ["l_orderkey"], 0.5)
    return placed.groupBy("l_orderkey").agg(F.bool_or("refused").alias("refused"), F.count("*").alias("n_cells"))


Q15 = """
WITH i AS (SELECT l_orderkey, (l_linenumber % 3)::BIGINT AS row, l_quantity AS x0, l_quantity + 6 AS x1 FROM lineitem), c AS (SELECT range AS col FROM range(0, 4)),
m AS (SELECT l_orderkey, row, col FROM i JOIN c ON least(x1, col * 14.0 + 14) - greatest(x0, col * 14.0) > 0.5),
n AS (SELECT l_orderkey, row, col, count(*) AS k FROM m GROUP BY ALL)
SELECT l_orderkey, max(k) > 1 AS refused, sum(k)::BIGINT AS n_cells FROM n GROUP BY l_orderkey
"""


def q17_kept_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders by date against their keys: those that kept their order, as counts."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("was"), (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 10_000 + F.col("o_orderkey") % 10_000).alias("now"))
    kept = resolve.kept_order(orders, "o_custkey", "was", "now")
    return kept.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.count_if("kept_order").alias("n_kept"))


# a longest increasing run's length by patience: each value takes the place of the first end that is no smaller, or goes behind all
Q17 = """
WITH o AS (SELECT o_custkey, o_orderkey AS was, epoch(o_orderdate::TIMESTAMP)::BIGINT * 10000 + o_orderkey % 10000 AS now FROM orders),
l AS (SELECT o_custkey, list([was] ORDER BY now) AS l FROM o GROUP BY o_custkey)
SELECT o_custkey, len(l)::BIGINT AS n_orders, len(list_reduce(l, lambda t, x: CASE WHEN x[1] > t[len(t)] THEN list_concat(t, x) ELSE list_transform(t, lambda y, i: CASE WHEN y >= x[1] AND (i = 1 OR t[i - 1] < x[1]) THEN x[1] ELSE y END) END))::BIGINT AS n_kept FROM l
"""


def q18_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation aligned with a version that lost and reworded some."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    other = turns.where("(conv_id + turn) % 6 <> 0").withColumn("text", F.when(F.col("turn") % 4 == 0, F.concat(F.col("text"), F.lit(" and more of it"))).otherwise(F.col("text")))
    return resolve.align_groups(turns, other, "conv_id", "turn", "text").select("conv_id", "a_pos", "b_pos", F.round("similarity", 6).alias("similarity"))


def j27_filled_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation aligned with a version that lost some and reworded others from end to end, which are paired by place."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    other = turns.where("(conv_id + turn) % 6 <> 0").withColumn("text", F.when(F.col("turn") % 4 == 1, F.lit("said anew throughout")).otherwise(F.col("text")))
    return resolve.align_groups(turns, other, "conv_id", "turn", "text", fill=True).select("conv_id", "a_pos", "b_pos", F.round("similarity", 6).alias("similarity"))


QUERIES = {f.__name__: f for f in (q7_occurrence_keys, q8_label_pairs, q9_content_fifo, q10_mutual_best, q11_greedy_match, q12_gap_join, q13_interval_join, q14_near_pairs, q14_spatial_components, q15_band_cells, q17_kept_order, q18_alignment, j27_filled_alignment)}
ORACLES = {"q7_occurrence_keys": Q7, "q8_label_pairs": Q8, "q9_content_fifo": Q9, "q10_mutual_best": Q10, "q12_gap_join": Q12, "q13_interval_join": Q13, "q14_near_pairs": Q14P, "q14_spatial_components": Q14, "q15_band_cells": Q15, "q17_kept_order": Q17}
