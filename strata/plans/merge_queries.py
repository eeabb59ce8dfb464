"""Three-way merges, residuals, audits and order merges over derived versions of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import text as tx
from strata.operators import audit, diff, merge, resolve
from strata.plans.lineage import durable
from strata.sources.tables import table

ORDER_FIELDS = ["cents", "status", "priority"]


def orders_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base orders; a source that drops, adds and reprices; a live version that does other things."""
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    k = F.col("k")
    ours = base.where(k % 7 != 0).withColumn("cents", F.when(k % 5 == 0, F.col("cents") + 100).otherwise(F.col("cents"))).withColumn("status", F.when(k % 13 == 0, "X").otherwise(F.col("status")))
    ours = ours.unionByName(base.where(k % 100 == 1).withColumn("k", -k))
    theirs = base.where(k % 11 != 0).withColumn("cents", F.when(k % 3 == 0, F.col("cents") + 200).when(k % 10 == 0, F.col("cents") + 100).otherwise(F.col("cents"))).withColumn("priority", F.when(k % 17 == 0, "0-LIVE").otherwise(F.col("priority")))
    return base, ours, theirs.unionByName(base.where(k % 100 == 2).withColumn("k", -k))


V3 = """
base AS (SELECT o_orderkey AS k, round(o_totalprice * 100)::BIGINT AS cents, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
ours AS (SELECT k, CASE WHEN k % 5 = 0 THEN cents + 100 ELSE cents END AS cents, CASE WHEN k % 13 = 0 THEN 'X' ELSE status END AS status, priority FROM base WHERE k % 7 <> 0 UNION ALL SELECT -k, cents, status, priority FROM base WHERE k % 100 = 1),
theirs AS (SELECT k, CASE WHEN k % 3 = 0 THEN cents + 200 WHEN k % 10 = 0 THEN cents + 100 ELSE cents END AS cents, status, CASE WHEN k % 17 = 0 THEN '0-LIVE' ELSE priority END AS priority FROM base WHERE k % 11 <> 0 UNION ALL SELECT -k, cents, status, priority FROM base WHERE k % 100 = 2),
j AS (SELECT coalesce(b.k, o.k, t.k) AS k, b.k IS NOT NULL AS hb, o.k IS NOT NULL AS ho, t.k IS NOT NULL AS ht,
  b.cents AS bc, o.cents AS oc, t.cents AS tc, b.status AS bs, o.status AS os, t.status AS ts, b.priority AS bp, o.priority AS op, t.priority AS tp
  FROM base b FULL JOIN ours o ON b.k = o.k FULL JOIN theirs t ON t.k = coalesce(b.k, o.k)),
f AS (SELECT *, (oc, os, op) IS DISTINCT FROM (bc, bs, bp) AS co, (tc, ts, tp) IS DISTINCT FROM (bc, bs, bp) AS ct, (oc, os, op) IS NOT DISTINCT FROM (tc, ts, tp) AS same,
  (oc <> bc AND tc <> bc AND oc <> tc) AS xc, (os <> bs AND ts <> bs AND os <> ts) AS xs, (op <> bp AND tp <> bp AND op <> tp) AS xp FROM j),
d AS (SELECT *, CASE WHEN NOT hb AND NOT ht THEN 'create' WHEN NOT hb AND NOT ho THEN 'keep_user' WHEN NOT hb THEN CASE WHEN same THEN 'adopt' ELSE 'conflict' END
  WHEN NOT ht AND NOT ho THEN 'gone' WHEN NOT ht THEN 'stay_deleted' WHEN NOT ho THEN CASE WHEN ct THEN 'keep_removed' ELSE 'delete' END
  WHEN NOT co AND NOT ct THEN 'keep' WHEN NOT ct THEN 'take_ours' WHEN NOT co THEN 'keep_theirs' WHEN same THEN 'converged' WHEN xc OR xs OR xp THEN 'conflict' ELSE 'merge' END AS decision FROM f)
"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.decisions(merge.versions(*orders_versions(spark, sf_dir), "k", ORDER_FIELDS), ORDER_FIELDS)


def m1_three_way_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merged(decided(spark, sf_dir), "k", ORDER_FIELDS)


M1 = f"""
WITH {V3}
SELECT k, decision, {", ".join(f"CASE WHEN decision = 'create' THEN o{c} WHEN NOT hb OR NOT ho THEN t{c} WHEN t{c} IS NOT DISTINCT FROM b{c} THEN o{c} ELSE t{c} END AS {n}" for c, n in (("c", "cents"), ("s", "status"), ("p", "priority")))}
FROM d WHERE decision NOT IN ('gone', 'stay_deleted', 'delete')
"""


def m2_column_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("b_seg"), F.col("c_nationkey").alias("b_nat"))
    k = F.col("k")
    c = c.withColumn("o_seg", F.when(k % 4 == 0, "OURS").when(k % 12 == 1, F.lit(None)).otherwise(F.col("b_seg"))).withColumn("t_seg", F.when(k % 6 == 0, "THEIRS").when(k % 8 == 0, "OURS").otherwise(F.col("b_seg")))
    c = c.withColumn("o_nat", F.when(k % 5 == 0, F.col("b_nat") + 1).otherwise(F.col("b_nat"))).withColumn("t_nat", F.when(k % 10 == 0, F.col("b_nat") + 2).otherwise(F.col("b_nat")))
    both = lambda f: (F.col(f"b_{f}"), F.col(f"o_{f}"), F.col(f"t_{f}"))
    return c.select("k", merge.merge3(*both("seg")).alias("segment"), merge.clash3(*both("seg")).alias("segment_clash"), merge.merge3(*both("nat")).alias("nation"), merge.clash3(*both("nat")).alias("nation_clash"))


M2 = """
WITH c AS (SELECT c_custkey AS k, c_mktsegment AS bs, c_nationkey AS bn, CASE WHEN c_custkey % 4 = 0 THEN 'OURS' WHEN c_custkey % 12 = 1 THEN NULL ELSE c_mktsegment END AS os, CASE WHEN c_custkey % 6 = 0 THEN 'THEIRS' WHEN c_custkey % 8 = 0 THEN 'OURS' ELSE c_mktsegment END AS ts,
  CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS onn, CASE WHEN c_custkey % 10 = 0 THEN c_nationkey + 2 ELSE c_nationkey END AS tn FROM customer)
SELECT k, CASE WHEN ts IS NOT DISTINCT FROM bs THEN os ELSE ts END AS segment, (os IS DISTINCT FROM bs AND ts IS DISTINCT FROM bs AND os IS DISTINCT FROM ts) AS segment_clash,
  CASE WHEN tn = bn THEN onn ELSE tn END AS nation, (onn <> bn AND tn <> bn AND onn <> tn) AS nation_clash FROM c
"""


def m3_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conflicts with ids; every third key's are settled for the source."""
    found = merge.conflicts(decided(spark, sf_dir), "k", ORDER_FIELDS, "order")
    settled, _ = merge.settle(found, found.where("k % 3 = 0"))
    return settled.select("k", "field", "base", "ours", "theirs", "takeable", "conflict_id", "resolution")


def _conflict_sql(field: str, c: str, flag: str) -> str:
    return f"SELECT k, '{field}' AS field, b{c}::VARCHAR AS base, o{c}::VARCHAR AS ours, t{c}::VARCHAR AS theirs, true AS takeable FROM d WHERE {flag} AND ho AND ht"


M3 = f"""
WITH {V3},
c AS ({_conflict_sql("cents", "c", "xc")} UNION ALL {_conflict_sql("status", "s", "xs")} UNION ALL {_conflict_sql("priority", "p", "xp")} UNION ALL SELECT k, 'existence', 'present', NULL, 'edited', false FROM d WHERE decision = 'keep_removed')
SELECT *, substr(sha256(encode(concat_ws(chr(31), 'order', k::VARCHAR, field, coalesce(base, '<null>'), coalesce(ours, '<null>'), coalesce(theirs, '<null>')))), 1, 16) AS conflict_id, CASE WHEN k % 3 = 0 AND takeable THEN 'ours' ELSE 'theirs' END AS resolution FROM c
"""


def m4_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).groupBy("decision").agg(F.count("*").alias("n_rows"), F.min("k").alias("first_key"), F.max("k").alias("last_key"))


M4 = f"WITH {V3} SELECT decision, count(*) AS n_rows, min(k) AS first_key, max(k) AS last_key FROM d GROUP BY decision"


def m5_live_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "supplier").withColumn("acct", F.round(F.col("s_acctbal") * 100).cast("long"))
    k = F.col("s_suppkey")
    live = base.where(k % 9 != 0).withColumn("acct", F.when(k % 4 == 0, F.col("acct") + 1).otherwise(F.col("acct"))).withColumn("s_name", F.when(k % 6 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")))
    return merge.edited_fields(base, live, "s_suppkey", ["s_name", "s_nationkey", "acct"]).select("s_suppkey", F.array_join("edits", ",").alias("edits"))


M5 = """
SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'deleted' ELSE concat_ws(',', CASE WHEN s_suppkey % 6 = 0 THEN 's_name' END, CASE WHEN s_suppkey % 4 = 0 THEN 'acct' END) END AS edits FROM supplier
"""


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    now = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    k = F.col("p_partkey")
    want = now.where(k % 50 != 3).withColumn("price", F.when(k % 4 == 0, F.col("price") + 0.25).when(k % 9 == 0, F.col("price") + 3).otherwise(F.col("price"))).withColumn("p_name", F.when(k % 8 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    return now, want.unionByName(now.where(k % 60 == 5).withColumn("p_partkey", -k))


def d1_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diff.residuals(*_parts(spark, sf_dir), "p_partkey", {"size": 2.0, "price": 0.5}, ["p_name"])
    return found.select("p_partkey", "kind", "field", "amount", "within")


D1 = """
WITH w AS (SELECT p_partkey AS k, p_retailprice AS price, CASE WHEN p_partkey % 4 = 0 THEN p_retailprice + 0.25 WHEN p_partkey % 9 = 0 THEN p_retailprice + 3 ELSE p_retailprice END AS want, p_name, CASE WHEN p_partkey % 8 = 0 THEN upper(p_name) ELSE p_name END AS want_name FROM part)
SELECT k AS p_partkey, 'number' AS kind, 'price' AS field, round(abs(price - want), 6) AS amount, round(abs(price - want), 6) <= 0.5 AS within FROM w WHERE k % 50 <> 3 AND price <> want
UNION ALL SELECT k, 'text', 'p_name', NULL, false FROM w WHERE k % 50 <> 3 AND p_name <> want_name
UNION ALL SELECT k, 'extra', '', NULL, false FROM w WHERE k % 50 = 3
UNION ALL SELECT -k, 'missing', '', NULL, false FROM w WHERE k % 60 = 5
"""


def d2_residual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.summary(diff.residuals(*_parts(spark, sf_dir), "p_partkey", {"size": 2.0, "price": 0.5}, ["p_name"]))


D2 = f"SELECT kind, count(*) AS n_open FROM ({D1}) WHERE NOT within GROUP BY kind"


def x1_lost_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that dropping each document's last line loses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    words = lambda t: F.explode(tx.words(t)).alias("word")
    before = docs.select("doc_id", words(F.array_join("lines", "\n")))
    after = docs.select("doc_id", words(F.array_join(F.slice("lines", F.lit(1), F.size("lines") - 1), "\n")))
    lost = audit.lost_words(before, after, "doc_id", "word")
    return lost.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum("n_lost").alias("n_lost"))


X1 = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
b AS (SELECT doc_id, unnest(regexp_extract_all(lower(array_to_string(l, chr(10))), '[\\p{L}\\p{N}_]+')) AS word FROM d),
a AS (SELECT doc_id, unnest(regexp_extract_all(lower(array_to_string(l[:-2], chr(10))), '[\\p{L}\\p{N}_]+')) AS word FROM d),
x AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
SELECT doc_id, count(DISTINCT word) AS n_words, count(*) AS n_lost FROM x GROUP BY doc_id
"""


def x2_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the line numbered 1 that claims them: unowned, shared and dangling ones."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey").where("o_orderkey % 10 <> 0")
    claims = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey")
    return audit.ownership(orders, claims, "o_orderkey", "l_orderkey")


X2 = """
WITH o AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0), c AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, CASE WHEN o_orderkey IS NULL THEN 'dangling' WHEN n IS NULL THEN 'unowned' ELSE 'shared' END AS problem, coalesce(n, 0) AS n
FROM o FULL JOIN c ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL OR n IS NULL OR n > 1
"""


def x3_junk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    both = docs.unionByName(pages)
    return both.groupBy("kind").agg(F.count("*").alias("n_rows"), F.count_if(tx.has_junk(F.col("text"))).alias("n_junk"), F.count_if(F.col("text").rlike("[&%$#*]{3}")).alias("n_garbled"))


X3 = """
WITH b AS (SELECT 'document' AS kind, text FROM documents UNION ALL SELECT 'page', html FROM pages)
SELECT kind, count(*) AS n_rows, count(*) FILTER (regexp_matches(text, '[\\p{Co}\\x{FFFD}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')) AS n_junk, count(*) FILTER (regexp_matches(text, '[&%$#*]{3}')) AS n_garbled FROM b GROUP BY kind
"""


def q7_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrival oracle over m1: source changes to untouched rows must show; one planted loss each 1,000 keys must be told."""
    base, ours, theirs = orders_versions(spark, sf_dir)
    result = m1_three_way_rows(spark, sf_dir).where("k % 1000 <> 5")
    return audit.arrived(base, ours, result, theirs, "k", "cents").select("k", F.col("b").alias("was"), F.col("o").alias("wanted"))


Q7A = f"WITH {V3} SELECT k, bc AS was, oc AS wanted FROM d WHERE hb AND ho AND ht AND oc <> bc AND tc = bc AND k % 1000 = 5"


def q19_text_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of every document: the source rewords each fifth line, the live one upper-cases each seventh and drops the last."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    ours = F.array_join(F.transform("l", lambda x, i: F.when(i % 5 == 1, F.concat(x, F.lit(" (ours)"))).otherwise(x)), "\n")
    theirs = F.array_join(F.transform(F.when(F.size("l") > 3, F.slice("l", F.lit(1), F.size("l") - 1)).otherwise(F.col("l")), lambda x, i: F.when(i % 7 == 1, F.upper(x)).otherwise(x)), "\n")
    merged = merge.merge_texts(docs.select("doc_id", F.array_join("l", "\n").alias("b"), ours.alias("o"), theirs.alias("t")), "doc_id", "b", "o", "t")
    return merged.select("doc_id", F.sha2("merged", 256).alias("merged_sha256"), F.col("conflicts").cast("long").alias("conflicts"))


def j19_anti_and_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with open orders only, with none, and orders of nobody."""
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    none = customers.join(orders, customers.c_custkey == orders.o_custkey, "left_anti").withColumn("what", F.lit("without"))
    any_open = customers.join(orders.where("o_orderstatus = 'O'"), customers.c_custkey == orders.o_custkey, "left_semi").withColumn("what", F.lit("open"))
    return none.unionByName(any_open).groupBy("what", "c_mktsegment").agg(F.count("*").alias("n_customers"))


J19 = """
SELECT 'without' AS what, c_mktsegment, count(*) AS n_customers FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY ALL
UNION ALL SELECT 'open', c_mktsegment, count(*) FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') GROUP BY ALL
"""


def o7_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but each customer's three newest orders."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return orders.withColumn("n", n.cast("long")).where("n > 3").select("o_custkey", "o_orderkey", "n")


O7 = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders QUALIFY n > 3"


def s1_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three generations: the merged version is the base of the next merge, whose source and live versions shift by generation."""
    base, _, _ = orders_versions(spark, sf_dir)
    for g in (1, 2, 3):
        k = F.col("k")
        ours = base.withColumn("cents", F.when(k % (4 + g) == 0, F.col("cents") + g).otherwise(F.col("cents")))
        theirs = base.where(k % (20 + g) != 0).withColumn("status", F.when(k % (6 + g) == 0, F.lit(f"G{g}")).otherwise(F.col("status")))
        base = merge.merged(merge.decisions(merge.versions(base, ours, theirs, "k", ORDER_FIELDS), ORDER_FIELDS), "k", ORDER_FIELDS).select("k", *ORDER_FIELDS)
        base = durable(base) if g < 3 else base  # else each generation would read its base three times over
    return base


S1 = """
WITH g0 AS (SELECT o_orderkey AS k, round(o_totalprice * 100)::BIGINT AS cents, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
g1 AS (SELECT k, CASE WHEN k % 5 = 0 THEN cents + 1 ELSE cents END AS cents, CASE WHEN k % 7 = 0 THEN 'G1' ELSE status END AS status, priority FROM g0 WHERE k % 21 <> 0),
g2 AS (SELECT k, CASE WHEN k % 6 = 0 THEN cents + 2 ELSE cents END AS cents, CASE WHEN k % 8 = 0 THEN 'G2' ELSE status END AS status, priority FROM g1 WHERE k % 22 <> 0)
SELECT k, CASE WHEN k % 7 = 0 THEN cents + 3 ELSE cents END AS cents, CASE WHEN k % 9 = 0 THEN 'G3' ELSE status END AS status, priority FROM g2 WHERE k % 23 <> 0
"""


def q16_order_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with odd keys go back behind the even one before them in a customer's list, the front if there is none."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    base = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderkey").alias("rank"))
    extra = orders.where("o_orderkey % 2 = 1").select("o_orderkey", F.col("o_orderkey").alias("rank"), (F.col("o_orderkey") - F.col("o_orderkey") % 10).alias("after"))
    placed = resolve.place_after_predecessor(base, extra, "o_orderkey", "rank", "after")
    return placed.select("o_orderkey", "major", F.col("minor").cast("long").alias("minor"))


Q16 = """
SELECT o_orderkey, o_orderkey::DOUBLE AS major, 0::BIGINT AS minor FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, (o_orderkey - o_orderkey % 10)::DOUBLE, row_number() OVER (PARTITION BY o_orderkey - o_orderkey % 10 ORDER BY o_orderkey) FROM orders WHERE o_orderkey % 2 = 1
"""

def w16_nearest_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's list of orders of which every third key stays and the others, but for those that 5 divides, go back behind the nearest one before them that stayed."""
    own = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("rank"), (F.expr("o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0")).alias("extra"))
    placed = resolve.place_after_nearest(own.where("o_orderkey % 3 = 0"), own, ["o_custkey"], "o_orderkey", "rank", "extra")
    return placed.select("o_custkey", "o_orderkey", "major", F.col("minor").cast("long").alias("minor"))


W16 = """
WITH b AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 = 0),
e AS (SELECT o_custkey, o_orderkey, coalesce((SELECT max(b.o_orderkey) FROM b WHERE b.o_custkey = o.o_custkey AND b.o_orderkey < o.o_orderkey), -1)::DOUBLE AS major FROM orders o WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0)
SELECT o_custkey, o_orderkey, o_orderkey::DOUBLE AS major, 0::BIGINT AS minor FROM b
UNION ALL SELECT o_custkey, o_orderkey, major, row_number() OVER (PARTITION BY o_custkey, major ORDER BY o_orderkey) FROM e
"""

QUERIES = {f.__name__: f for f in (m1_three_way_rows, m2_column_merge, m3_conflicts, m4_existence, m5_live_edits, d1_residuals, d2_residual_summary, x1_lost_words, x2_ownership, x3_junk_text, q7_arrival, q16_order_merge, w16_nearest_predecessor, q19_text_merge, j19_anti_and_semi, o7_retention, s1_chain)}
ORACLES = {"m1_three_way_rows": M1, "m2_column_merge": M2, "m3_conflicts": M3, "m4_existence": M4, "m5_live_edits": M5, "d1_residuals": D1, "d2_residual_summary": D2, "x1_lost_words": X1, "x2_ownership": X2, "x3_junk_text": X3, "q7_arrival": Q7A, "q16_order_merge": Q16, "w16_nearest_predecessor": W16, "j19_anti_and_semi": J19, "o7_retention": O7, "s1_chain": S1}
