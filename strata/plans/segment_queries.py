"""Segmentation and statistics over documents, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import text as tx
from strata.operators import segment, stats
from strata.sources.tables import table

SHARE = 0.02


def q1_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.repeated_lines(table(spark, sf_dir, "documents"), "source", "doc_id", "text", SHARE)
    return found.select("source", "line", "n_members", "group_size")


Q1 = f"""
WITH lines AS (SELECT DISTINCT source, doc_id, trim(line, ' ') AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
counts AS (SELECT source, line, count(*) AS n_members FROM lines WHERE line <> '' GROUP BY ALL),
sizes AS (SELECT source, count(DISTINCT doc_id) AS group_size FROM documents GROUP BY source)
SELECT source, line, n_members, group_size FROM counts JOIN sizes USING (source) WHERE n_members >= greatest(3.0, {SHARE}::DOUBLE * group_size)
"""


def q2_weighted_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    mode = stats.weighted_mode(lines, ["l_returnflag", "l_linestatus"], F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long"))
    return mode.select("l_returnflag", "l_linestatus", F.col("mode").alias("quantity"), F.col("weight").alias("cents"))


Q2 = """
WITH s AS (SELECT l_returnflag, l_linestatus, l_quantity::BIGINT AS quantity, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, quantity, cents FROM s QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY cents DESC, quantity) = 1
"""


def q3_group_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return stats.common_to_all(lines, ["l_returnflag"], F.col("l_quantity").cast("long"), F.date_format("l_shipdate", "yyyy")).select("l_returnflag", F.col("member").alias("quantity"), "n_groups")


Q3 = """
WITH p AS (SELECT DISTINCT l_returnflag, l_quantity::BIGINT AS quantity, strftime(l_shipdate, '%Y') AS m FROM lineitem),
n AS (SELECT l_returnflag, count(DISTINCT m) AS n_groups FROM p GROUP BY 1)
SELECT l_returnflag, quantity, n_groups FROM p JOIN n USING (l_returnflag) GROUP BY ALL HAVING count(*) = n_groups
"""


def q4_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    cut = segment.islands(events, ["user_id"], ["ts", "event_id"], before.isNull() | (F.col("ts") > before + F.expr("INTERVAL 30 MINUTES")))
    return cut.groupBy("user_id", "island").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.round(F.sum("value"), 2).alias("total"))


Q4 = """
WITH e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM e)
SELECT user_id, island, count(*) AS n_events, min(event_id) AS first_event, max(event_id) AS last_event, round(sum(value), 2) AS total FROM i GROUP BY user_id, island
"""


def q5_merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.substring("event_type", 1, 1).alias("mark"))
    return segment.merge_equal_neighbours(events, ["user_id"], "event_id", ["event_type"], "mark").select("user_id", "event_type", "first", "last", "parts", "mark")


Q5 = """
WITH e AS (SELECT user_id, event_id, event_type, substr(event_type, 1, 1) AS mark, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS cut FROM events),
i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS parts, string_agg(mark, '' ORDER BY event_id) AS mark FROM i GROUP BY user_id, run, event_type
"""


def q6_overlay_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") / 2).cast("long").alias("label"), tx.words(F.col("text")).alias("words"))
    return segment.overlay_steps(turns, ["conv_id"], "turn", "label", "words", 0.3).select("conv_id", "turn", F.round("share", 6).alias("share"), "superseded")


Q6 = """
WITH t AS (SELECT conv_id, turn, turn // 2 AS label, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS words FROM conversations),
n AS (SELECT *, lead(label) OVER w AS next_label, lead(words) OVER w AS next_words FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, CASE WHEN len(words) > 0 THEN coalesce(len(list_filter(words, lambda x: list_contains(next_words, x))), 0) / len(words) ELSE 1.0 END AS share FROM n)
SELECT conv_id, turn, round(share, 6) AS share, coalesce(next_label = label AND share >= 0.3, false) AS superseded FROM s
"""


def a21_label_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels")
    j = docs.join(labels, "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if(F.col("quality") == 0).alias("n_low"))


A21 = """
SELECT lang, count(*) AS n_docs, count(*) FILTER (quality IS NULL) AS unlabelled, count(*) FILTER (toxic = 1) AS n_toxic, count(*) FILTER (quality = 0) AS n_low
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
"""


def b1_group_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    out = stats.auc(j, ["lang"], F.col("quality") == 1, F.col("n_chars"))
    return out.select("lang", "positives", "negatives", F.round("auc", 6).alias("auc"))


B1 = """
WITH j AS (SELECT lang, quality = 1 AS pos, n_chars AS score FROM labels JOIN documents USING (doc_id)),
g AS (SELECT lang, score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM j GROUP BY ALL),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT lang, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN round(sum(p * (below + n / 2))::DOUBLE / (sum(p) * sum(n))::DOUBLE, 6) END AS auc FROM b GROUP BY lang
"""


def b2_mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometric mean of clipped ratios of each document, and the mean of each source's and of all, two levels deep."""
    docs = table(spark, sf_dir, "documents")
    lines, n_words, chars = F.size(F.split("text", "\n")), F.size(tx.words(F.col("text"))), F.length("text")
    clip = lambda x: F.least(F.greatest(x, F.lit(0.01)), F.lit(1.0))
    parts = [clip(20.0 / lines), clip(300.0 / F.greatest(n_words, F.lit(1))), clip(2000.0 / F.greatest(chars, F.lit(1)))]
    scored = docs.select("source", F.pow(parts[0] * parts[1] * parts[2], F.lit(1.0 / 3)).alias("score"))
    means = scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.avg("score").alias("score"))
    return means.rollup("source").agg(F.sum("n_docs").alias("n_docs"), F.round(F.avg("score"), 6).alias("score")).select(F.coalesce("source", F.lit("all")).alias("source"), "n_docs", "score")


B2 = """
WITH d AS (SELECT source, pow(greatest(least(20.0::DOUBLE / len(string_split(text, chr(10))), 1.0), 0.01) * greatest(least(300.0::DOUBLE / greatest(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')), 1), 1.0), 0.01) * greatest(least(2000.0::DOUBLE / greatest(length(text), 1), 1.0), 0.01), 1.0::DOUBLE / 3) AS score FROM documents),
m AS (SELECT source, count(*) AS n_docs, avg(score) AS score FROM d GROUP BY source)
SELECT source, n_docs, round(score, 6) AS score FROM m UNION ALL SELECT 'all', sum(n_docs)::BIGINT, round(avg(score), 6) FROM m
"""


def w19_run_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return segment.run_offsets(turns, ["conv_id"], "turn", "text").select("conv_id", "turn", "start", "stop", "start16", "stop16")


W19 = """
WITH t AS (SELECT conv_id, turn, length(text) AS n, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS n16 FROM conversations),
s AS (SELECT conv_id, turn, n, n16, sum(n) OVER w AS stop, sum(n16) OVER w AS stop16 FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, (stop - n)::BIGINT AS start, stop::BIGINT AS stop, (stop16 - n16)::BIGINT AS start16, stop16::BIGINT AS stop16 FROM s
"""


def a20_word_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns against assistant turns of each conversation as bags of words."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(tx.words(F.col("text"))).alias("word"))
    return stats.word_error(words.where("role = 'user'"), words.where("role = 'assistant'"), ["conv_id"], "word")


A20 = """
WITH w AS (SELECT conv_id, role, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM conversations),
c AS (SELECT conv_id, word, count(*) FILTER (role = 'user') AS a, count(*) FILTER (role = 'assistant') AS b FROM w WHERE role IN ('user', 'assistant') GROUP BY ALL)
SELECT conv_id, sum(abs(a - b))::BIGINT AS word_error FROM c GROUP BY conv_id
"""

QUERIES = {f.__name__: f for f in (q1_repeated_lines, q2_weighted_mode, q3_group_intersect, q4_islands, q5_merged_runs, q6_overlay_steps, a20_word_error, a21_label_survey, b1_group_auc, b2_mean_scores, w19_run_offsets)}
ORACLES = {"q1_repeated_lines": Q1, "q2_weighted_mode": Q2, "q3_group_intersect": Q3, "q4_islands": Q4, "q5_merged_runs": Q5, "q6_overlay_steps": Q6, "a20_word_error": A20, "a21_label_survey": A21, "b1_group_auc": B1, "b2_mean_scores": B2, "w19_run_offsets": W19}
