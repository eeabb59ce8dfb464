"""Votes, censuses, rivals, numbering and set comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import sequences
from strata.functions import text as tx
from strata.operators import resolve, segment, stats
from strata.sources.tables import table


def a13_style_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey")
    return stats.census(parts, ["p_brand"], "p_type", "p_partkey").select("p_brand", "usual", "n_usual", "n_odd", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


A13 = """
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT p_brand, p_type AS usual, n AS n_usual FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1),
o AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part JOIN t USING (p_brand) WHERE p_type <> usual)
SELECT p_brand, usual, n_usual, coalesce(count(r), 0) AS n_odd, coalesce(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) FILTER (r <= 3), '') AS examples FROM t LEFT JOIN o USING (p_brand) GROUP BY ALL
"""


def a15_inherited_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.when(F.col("l_quantity") > 40, 1).when(F.col("l_quantity") > 20, 0).alias("vote"))
    return stats.inherited_vote(lines, ["l_orderkey", "l_returnflag"], "vote")


A15 = "SELECT l_orderkey, l_returnflag FROM lineitem GROUP BY ALL HAVING max(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) = 0 AND max(CASE WHEN l_quantity > 20 AND l_quantity <= 40 THEN 1 ELSE 0 END) = 1"


def a19_style_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.style_hash(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linestatus")


A19 = """
SELECT l_orderkey, sha1(string_agg(s, chr(30) ORDER BY s)) AS style_hash FROM (SELECT DISTINCT l_orderkey, concat_ws(chr(31), coalesce(l_returnflag, '<null>'), coalesce(l_linestatus, '<null>')) AS s FROM lineitem) GROUP BY l_orderkey
"""


def a22_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents as dropped, even ones of the same source as those that may have taken up their words."""
    docs = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(tx.words(F.col("text")))).alias("word"))
    both = docs.select((F.col("conv_id") * 100 + F.col("turn")).alias("item"), "turn", "word")
    return stats.absorbed(both.where("turn = 1").drop("turn"), both.where("turn = 3").select(F.col("item").alias("other"), "word"), "item", "other", "word", share=0.2).select("item", "other", F.round("share", 6).alias("share"))


A22 = """
WITH w AS (SELECT DISTINCT conv_id * 100 + turn AS item, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM conversations),
d AS (SELECT item, word FROM w WHERE turn = 1 AND length(word) >= 4), n AS (SELECT item, count(*) AS n FROM d GROUP BY 1 HAVING count(*) >= 6),
m AS (SELECT d.item, g.item AS other, count(*) / n AS share FROM d JOIN w g ON g.word = d.word AND g.turn = 3 JOIN n ON n.item = d.item GROUP BY d.item, g.item, n)
SELECT item, other, round(share, 6) AS share FROM m WHERE share >= 0.2 QUALIFY row_number() OVER (PARTITION BY item ORDER BY share DESC, other) = 1
"""


def a8_big_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("size"), F.lit(400.0).alias("body"))
    return stats.big_headings(turns, ["conv_id"], "turn", "size", "body").select("conv_id", "turn", "size")


A8 = """
WITH r AS (SELECT conv_id, turn, length(text)::DOUBLE AS size, row_number() OVER w AS r, lead(length(text)) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY length(text) DESC, turn))
SELECT conv_id, turn, size FROM r WHERE r = 1 AND size >= 1.3::DOUBLE * 400 AND (nxt IS NULL OR size >= 1.15::DOUBLE * nxt)
"""


def w5_carried_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 2).cast("long").alias("label"), F.col("text").alias("note"))
    return segment.carried_notes(turns, ["conv_id"], "turn", "label", "note").select("conv_id", "turn", "notes", "n_steps")


W5 = """
WITH t AS (SELECT conv_id, turn, turn // 2 AS label, text AS note FROM conversations),
c AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM label THEN 1 ELSE 0 END AS cut FROM t),
r AS (SELECT *, sum(cut) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT conv_id, max(turn) AS turn, coalesce(string_agg(note, chr(10) ORDER BY turn) FILTER (note <> ''), '') AS notes, count(*) AS n_steps FROM r GROUP BY conv_id, run
"""


def w12_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.broken_numbering(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("place")), ["l_orderkey"], "place", "l_linenumber")


W12 = """
WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey * 10 + l_linenumber) AS want FROM lineitem)
SELECT l_orderkey, min(want) AS first_wrong, count(*) AS n_wrong FROM r WHERE l_linenumber <> want GROUP BY l_orderkey
"""


def w21_best_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return segment.best_rounds(events, ["user_id", "event_type"], "event_id", "value").select("user_id", "event_type", "best_round", "best", "last", "revert")


W21 = "SELECT user_id, event_type, arg_max(event_id, (value, -event_id)) AS best_round, max(value) AS best, arg_max(value, event_id) AS last, arg_max(value, event_id) < max(value) AS revert FROM events GROUP BY user_id, event_type"


def j8_rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a customer's orders against each clerk-like group, with the best score of a rival pair."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 97).alias("grp"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    scored = orders.groupBy("o_custkey", "grp").agg(F.sum("cents").alias("score"))
    return resolve.rivals(scored, "o_custkey", "grp", "score").select("o_custkey", "grp", "score", "rival")


J8 = """
WITH s AS (SELECT o_custkey, o_orderkey % 97 AS grp, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS score FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER l AS lr, max(score) OVER (PARTITION BY o_custkey) AS l1, nth_value(score, 2) OVER (PARTITION BY o_custkey ORDER BY score DESC, o_custkey, grp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l2,
  row_number() OVER g AS gr, max(score) OVER (PARTITION BY grp) AS g1, nth_value(score, 2) OVER (PARTITION BY grp ORDER BY score DESC, o_custkey, grp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS g2
  FROM s WINDOW l AS (PARTITION BY o_custkey ORDER BY score DESC, o_custkey, grp), g AS (PARTITION BY grp ORDER BY score DESC, o_custkey, grp))
SELECT o_custkey, grp, score, greatest(CASE WHEN lr = 1 THEN l2 ELSE l1 END, CASE WHEN gr = 1 THEN g2 ELSE g1 END) AS rival FROM r
"""


def j11_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") * 7919 % 100_003).alias("other"))
    return resolve.crossings(orders, ["o_custkey"], "o_orderkey", "other").groupBy("o_custkey", "o_orderkey").agg(F.sum("crossings").alias("crossings"))


J11 = """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey * 7919 % 100003 AS other FROM orders)
SELECT a.o_custkey, a.o_orderkey, count(*) AS crossings FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND (a.o_orderkey < b.o_orderkey) <> (a.other < b.other) AND a.o_orderkey <> b.o_orderkey GROUP BY ALL
"""


def j11_crossed_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders, each three of them paired in reverse, with made scores for places at most two apart."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", place.alias("i"))
    other = orders.select("o_custkey", F.col("o_orderkey").alias("other"), F.col("i").alias("j"))
    pairs = orders.withColumn("j", (F.col("i") - F.col("i") % 3) + 2 - F.col("i") % 3).join(other, ["o_custkey", "j"])
    near = orders.withColumn("j", F.explode(F.sequence(F.col("i") - 2, F.col("i") + 2))).join(other, ["o_custkey", "j"])
    scored = near.withColumn("score", (F.col("o_orderkey") * 31 + F.col("other") * 17) % 5 / F.lit(100.0))
    return resolve.crossed_twins(pairs, scored, ["o_custkey"], "o_orderkey", "other", "score")


J11_TWINS = """
WITH o AS (SELECT o_custkey, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
p AS (SELECT a.o_custkey, a.k AS l, b.k AS r FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.i = a.i - a.i % 3 + 2 - a.i % 3)
SELECT x.o_custkey, x.l AS left_1, x.r AS right_1, y.l AS left_2, y.r AS right_2 FROM p x JOIN p y ON x.o_custkey = y.o_custkey AND x.l < y.l AND x.r > y.r
WHERE (x.l * 31 + y.r * 17) % 5 >= (x.l * 31 + x.r * 17) % 5 - 2 AND (y.l * 31 + x.r * 17) % 5 >= (y.l * 31 + y.r * 17) % 5 - 2
"""


def j16_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    points = parts.select("p_brand", "p_partkey", (k * 37 % 500).cast("double").alias("x"), (k * 61 % 400).cast("double").alias("y"))
    panels = parts.where("p_partkey % 11 = 0").select("p_brand", k.alias("panel"), (k * 13 % 450).cast("double").alias("x0"), (k * 29 % 350).cast("double").alias("y0"), (k * 13 % 450 + 60).cast("double").alias("x1"), (k * 29 % 350 + 45).cast("double").alias("y1"))
    return resolve.points_in_rectangles(points, "p_partkey", panels, "panel", ["p_brand"], 50.0)


J16 = """
WITH r AS (SELECT p_brand, p_partkey AS panel, p_partkey * 13 % 450 AS x0, p_partkey * 29 % 350 AS y0 FROM part WHERE p_partkey % 11 = 0)
SELECT p.p_brand, p_partkey, min(panel) AS panel FROM part p JOIN r ON r.p_brand = p.p_brand AND p_partkey * 37 % 500 BETWEEN x0 AND x0 + 60 AND p_partkey * 61 % 400 BETWEEN y0 AND y0 + 45 GROUP BY ALL
"""


def j5_paragraph_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation paired with those of a reworded version by word ratio, best first."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("a"), F.col("text").alias("x"))
    other = turns.where("a % 5 <> 0").select("conv_id", F.col("a").alias("b"), F.concat(F.col("x"), F.lit(" indeed")).alias("y"))
    scored = turns.join(other, "conv_id").withColumn("score", resolve.word_similarity(F.col("x"), F.col("y")))
    return resolve.greedy_match(scored, "a", "b", "score", 0.34).select("a", "b", F.round("score", 6).alias("score"))


def k6_group_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a forest: each one's parent is the one at a fifth of its key; places add up from the root."""
    nodes = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 50 != 1, F.floor(F.col("p_partkey") / 5)).alias("parent"), F.col("p_size").alias("x"))
    nodes = nodes.withColumn("parent", F.when(F.col("parent") != F.col("p_partkey"), F.col("parent")))
    return resolve.flatten_groups(nodes, "p_partkey", "parent", "x")


K6 = """
WITH RECURSIVE n AS (SELECT p_partkey, CASE WHEN p_partkey % 50 <> 1 AND p_partkey // 5 <> p_partkey THEN p_partkey // 5 END AS parent, p_size::DOUBLE AS x FROM part),
t AS (SELECT p_partkey, p_partkey AS root, 0::BIGINT AS depth, x FROM n WHERE parent IS NULL UNION ALL SELECT n.p_partkey, t.root, t.depth + 1, t.x + n.x FROM n JOIN t ON n.parent = t.p_partkey)
SELECT * FROM t
"""


def t4_symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that only the user's or only the assistant's turns of a conversation hold."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(tx.words(F.col("text"))).alias("word")).distinct()
    mine, other = (words.where(F.col("role") == r).select("conv_id", "word") for r in ("user", "assistant"))
    only = lambda a, b, what: a.exceptAll(b).groupBy("conv_id").agg(F.count("*").alias("n_words")).withColumn("only", F.lit(what))
    return only(mine, other, "user").unionByName(only(other, mine, "assistant"))


T4 = """
WITH w AS (SELECT DISTINCT conv_id, role, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM conversations),
u AS (SELECT conv_id, word FROM w WHERE role = 'user'), a AS (SELECT conv_id, word FROM w WHERE role = 'assistant')
SELECT conv_id, count(*) AS n_words, 'user' AS only FROM (SELECT * FROM u EXCEPT SELECT * FROM a) GROUP BY conv_id UNION ALL SELECT conv_id, count(*), 'assistant' FROM (SELECT * FROM a EXCEPT SELECT * FROM u) GROUP BY conv_id
"""


def c15_text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.script_counts(F.col("text")).alias("s"), F.round(tx.prose_share(F.col("text")), 6).alias("prose"), tx.first_words(F.col("text"), 5).alias("snippet"))
    return docs.select("doc_id", "s.latin", "s.greek", "s.cyrillic", "s.han", "prose", "snippet")


C15 = """
WITH d AS (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents),
w AS (SELECT doc_id, text, string_split(flat, ' ') AS ws FROM d)
SELECT doc_id, len(regexp_extract_all(text, '\\p{Latin}')) AS latin, len(regexp_extract_all(text, '\\p{Greek}')) AS greek, len(regexp_extract_all(text, '\\p{Cyrillic}')) AS cyrillic, len(regexp_extract_all(text, '\\p{Han}')) AS han,
  round(len(list_filter(ws, lambda x: regexp_full_match(x, '\\p{L}{2,}'))) / len(ws), 6) AS prose, array_to_string(ws[:5], ' ') AS snippet FROM w
"""


def c10_edit_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit scripts that turn each user turn into a reworded one: operations, and whether applying them gives it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.concat(F.lit("Well, "), F.regexp_replace("text", r"\be", "E")).alias("target"))

    def run(batches):
        for pdf in batches:
            scripts = [sequences.edit_script(a or "", b or "") for a, b in zip(pdf["text"], pdf["target"], strict=True)]
            good = [sequences.apply_script(a or "", s) == (b or "") for a, b, s in zip(pdf["text"], pdf["target"], scripts, strict=True)]
            yield pdf[["conv_id", "turn"]].assign(n_ops=[len(s) for s in scripts], round_trip=good)

    return turns.mapInPandas(run, "conv_id long, turn long, n_ops long, round_trip boolean")


def s21_request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as groups of requests, as many as their lines, cut into batches of at most twelve between groups."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    groups = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("block"), "n")
    return segment.batches(groups, "doc", "block", "n", 12).groupBy("doc", "batch").agg(F.sum("n").alias("n_requests"), F.count("*").alias("n_groups"))


S21 = """
WITH RECURSIVE g AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
t AS (SELECT doc, k, n, n AS total, 0::BIGINT AS batch FROM g WHERE k = 1
  UNION ALL SELECT g.doc, g.k, g.n, CASE WHEN t.total + g.n > 12 THEN g.n ELSE t.total + g.n END, t.batch + CASE WHEN t.total + g.n > 12 THEN 1 ELSE 0 END FROM t JOIN g ON g.doc = t.doc AND g.k = t.k + 1)
SELECT doc, batch, sum(n)::BIGINT AS n_requests, count(*) AS n_groups FROM t GROUP BY ALL
"""

QUERIES = {f.__name__: f for f in (a8_big_headings, a13_style_census, a15_inherited_vote, a19_style_hash, a22_absorbed, w5_carried_notes, w12_numbering, w21_best_rounds, j5_paragraph_pairs, j8_rivals, j11_crossings, j11_crossed_twins, j16_panels, k6_group_tree, t4_symmetric_difference, c10_edit_scripts, c15_text_measures, s21_request_batches)}
ORACLES = {"a8_big_headings": A8, "a13_style_census": A13, "a15_inherited_vote": A15, "a19_style_hash": A19, "a22_absorbed": A22, "w5_carried_notes": W5, "w12_numbering": W12, "w21_best_rounds": W21, "j8_rivals": J8, "j11_crossings": J11, "j11_crossed_twins": J11_TWINS, "j16_panels": J16, "k6_group_tree": K6, "t4_symmetric_difference": T4, "c15_text_measures": C15, "s21_request_batches": S21}
