"""Elements: titles, majorities, columns, bands, style ranges, moves, units, bullets, covers, round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import geometry as geo
from strata.functions import sequences
from strata.functions import text as tx
from strata.operators import merge, report, resolve, segment, stats
from strata.plans.merge_queries import V3, decided, orders_versions
from strata.plans.resolve_queries import BOX, NEAR, boxes
from strata.sources import html, strict_json
from strata.sources.tables import table


def a7_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("size"), "text")
    return stats.titles(turns, ["conv_id"], "turn", "size", "text")


A7 = """
WITH t AS (SELECT conv_id, turn, length(text)::DOUBLE AS size, max(length(text)::DOUBLE) OVER (PARTITION BY conv_id) AS top, text FROM conversations)
SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS title, max(top) AS size FROM t WHERE size >= 0.9::DOUBLE * top GROUP BY conv_id
"""


def a10_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.majority(table(spark, sf_dir, "events"), ["user_id"], "event_type")


A10 = "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) = 1"


def a11_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    cells = table(spark, sf_dir, "part").select("p_brand", (k % 4).alias("col"), (k % 4 * 100.0 + F.when(k % 4 == 1, k % 7).when(k % 4 == 2, k % 5).when(k % 4 == 3, k % 11).otherwise(0)).alias("x0"), (k % 4 * 100.0 + F.when(k % 4 == 0, k % 9 + 10).when(k % 4 == 1, 60).when(k % 4 == 2, 50 - k % 5).otherwise(k % 13 + 20)).alias("x1"))
    return stats.columns(cells, ["p_brand", "col"], "x0", "x1")


A11 = """
WITH c AS (SELECT p_brand, p_partkey % 4 AS col, p_partkey % 4 * 100.0::DOUBLE + CASE p_partkey % 4 WHEN 1 THEN p_partkey % 7 WHEN 2 THEN p_partkey % 5 WHEN 3 THEN p_partkey % 11 ELSE 0 END AS x0,
  p_partkey % 4 * 100.0::DOUBLE + CASE p_partkey % 4 WHEN 0 THEN p_partkey % 9 + 10 WHEN 1 THEN 60 WHEN 2 THEN 50 - p_partkey % 5 ELSE p_partkey % 13 + 20 END AS x1 FROM part)
SELECT p_brand, col, min(x0) AS x0, max(x1) AS x1, count(*) AS n_cells, CASE WHEN max(x0) - min(x0) <= 1 THEN 'left' WHEN max(x1) - min(x1) <= 1 THEN 'right' WHEN max((x0 + x1) / 2) - min((x0 + x1) / 2) <= 1 THEN 'center' ELSE 'mixed' END AS align FROM c GROUP BY ALL
"""


def w22_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.bands(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", 500).select("o_custkey", "band", "first", "last", "n_places")


W22 = """
WITH d AS (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR o_orderkey - b > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS band FROM d)
SELECT o_custkey, band, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS n_places FROM i GROUP BY ALL
"""


def w20_style_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of a benchmark item's characters whose style was to be another."""
    chars = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "")).alias("pos", "c")).where("c <> ''")
    styled = chars.select("item_id", F.col("pos").cast("long").alias("pos"), "c", F.when(F.col("pos") % 40 < 25, "plain").otherwise("bold").alias("was"), F.when(F.col("pos") % 30 < 20, "plain").otherwise("italic").alias("want"))
    return segment.differing_ranges(styled, ["item_id"], "pos", "was", "want", F.col("c").isin(" ", "\n"))


W20 = """
WITH p AS (SELECT item_id, string_split(text, '') AS cs FROM benchmark), u AS (SELECT item_id, unnest(cs) AS c, (generate_subscripts(cs, 1) - 1)::BIGINT AS pos FROM p),
s AS (SELECT item_id, pos, CASE WHEN pos % 40 < 25 THEN 'plain' ELSE 'bold' END AS was, CASE WHEN pos % 30 < 20 THEN 'plain' ELSE 'italic' END AS want FROM u WHERE c NOT IN (' ', chr(10), '')),
i AS (SELECT *, sum(cut) OVER (PARTITION BY item_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT *, CASE WHEN lag(was || want) OVER (PARTITION BY item_id ORDER BY pos) IS DISTINCT FROM was || want THEN 1 ELSE 0 END AS cut FROM s))
SELECT item_id, was, want, min(pos) AS first, max(pos) AS last FROM i WHERE was <> want GROUP BY item_id, r, was, want
"""


def j12_label_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as labels, order groups as slides: is another group's share of their money clearly larger than their own group's?"""
    orders = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 7).alias("grp"), F.round(F.col("o_totalprice") / 100_000).alias("w"))
    scored = orders.groupBy("o_custkey", "grp").agg(F.sum("w").alias("score"))
    return resolve.label_moves(scored, "o_custkey", "grp", F.col("grp") == F.col("o_custkey") % 7, "score", 5.0, 3.0).select("o_custkey", "own", "best", "to", "verdict")


J12 = """
WITH s AS (SELECT o_custkey, o_orderkey % 7 AS grp, sum(round(o_totalprice / 100000)) AS score FROM orders GROUP BY ALL),
b AS (SELECT o_custkey, max(score) FILTER (grp = o_custkey % 7) AS own, max(score) FILTER (grp <> o_custkey % 7) AS best, arg_max(grp, (score, -grp)) FILTER (grp <> o_custkey % 7) AS "to" FROM s GROUP BY o_custkey)
SELECT *, CASE WHEN best >= 5 AND best - coalesce(own, 0) >= 3 THEN 'moved' WHEN best >= 5 AND best > coalesce(own, 0) THEN 'unsure' ELSE 'stays' END AS verdict FROM b
"""


def j18_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where("p_partkey % 9 <> 4").select("p_partkey", F.when(F.col("p_partkey") % 3 == 1, F.col("p_partkey") - 1).alias("anchor"))
    return resolve.units(parts, "p_partkey", "anchor")


J18 = """
WITH e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 1 THEN p_partkey - 1 END AS a FROM part WHERE p_partkey % 9 <> 4)
SELECT coalesce(x.k, e.k) AS unit, count(*) AS n, min(e.k) AS first_member, max(e.k) AS last_member FROM e LEFT JOIN e x ON x.k = e.a GROUP BY 1
"""


def f10_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    lead = F.when(k % 6 == 0, "• ").when(k % 6 == 1, F.concat((k % 40).cast("string"), F.lit(". "))).when(k % 6 == 2, "(b) ").when(k % 6 == 3, "  - ").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", tx.bullet(F.concat(lead, F.col("p_name"))).alias("b")).select("p_partkey", "b.kind", "b.label", "b.rest")


F10 = """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'glyph' WHEN 1 THEN 'number' WHEN 2 THEN 'letter' WHEN 3 THEN 'glyph' ELSE 'none' END AS kind, CASE p_partkey % 6 WHEN 0 THEN '•' WHEN 1 THEN (p_partkey % 40)::VARCHAR WHEN 2 THEN 'b' WHEN 3 THEN '-' ELSE '' END AS label, p_name AS rest FROM part
"""


def f12_would_hide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = boxes(spark, sf_dir).withColumn("x1", F.col("x1") + 6)
    hidden = resolve.hidden_shares(resolve.near_pairs(wide, "p_partkey", [], 1.0, 16.0), wide, "p_partkey", 0.2)
    return hidden.select("a", "b", F.round("share", 6).alias("share"))


F12 = f"""
WITH {BOX}, w AS (SELECT k, x0, y0, x1 + 6 AS x1, y1 FROM b),
o AS (SELECT p.k AS a, q.k AS b, greatest(least(p.x1, q.x1) - greatest(p.x0, q.x0), 0) * greatest(least(p.y1, q.y1) - greatest(p.y0, q.y0), 0) / ((p.x1 - p.x0) * (p.y1 - p.y0)) AS share FROM w p JOIN w q ON p.k < q.k AND {NEAR})
SELECT a, b, round(share, 6) AS share FROM o WHERE share > 0.2
"""


def f14_has_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.has_writes(decided(spark, sf_dir))


F14 = f"WITH {V3} SELECT bool_or(decision IN ('create', 'delete', 'take_ours', 'merge')) AS has_writes, count(*) AS n_rows FROM d"


def t2_union_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, ours, _ = orders_versions(spark, sf_dir)
    return merge.union_of_keys(ours, base, "k").select("k", "side", "cents")


T2 = f"WITH {V3} SELECT k, 'ours' AS side, cents FROM ours UNION ALL SELECT k, 'base', cents FROM base WHERE k NOT IN (SELECT k FROM ours)"


def s11_html_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written as HTML and read again: pages and blocks that come back the same."""
    found = html.blocks(table(spark, sf_dir, "pages"), "page_id", "html")
    again = html.blocks(html.write(found), "page_id", "html")
    same = found.join(again, ["page_id", "pos", "kind", "level", "text"], "left_semi").groupBy("page_id").agg(F.count("*").alias("n_same"))
    return found.groupBy("page_id").agg(F.count("*").alias("n_blocks")).join(same, "page_id", "left")


def p3_text_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word operations between each turn and a reworded one, a row each."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text", F.regexp_replace("text", r"\b(en|die|the)\b", "X").alias("want"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(k, n, c.start, c.stop, " ".join(c.new)) for k, a, b in zip(pdf["k"], pdf["text"], pdf["want"], strict=True) for n, c in enumerate(sequences.changes((a or "").split(), (b or "").split()))]
            yield pd.DataFrame(rows, columns=["k", "n", "start", "stop", "new"])

    return turns.mapInPandas(run, "k long, n long, start long, stop long, new string")


P3 = r"""
WITH t AS (SELECT conv_id * 1000 + turn AS k, regexp_split_to_array(trim(text), '\s+') AS w FROM conversations),
p AS (SELECT k, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS a FROM t), c AS (SELECT k, i, regexp_replace(a, '(^|[^\p{L}\p{N}_])(en|die|the)($|[^\p{L}\p{N}_])', '\1X\3', 'g') AS b FROM p WHERE b <> a),
g AS (SELECT *, i - row_number() OVER (PARTITION BY k ORDER BY i) AS run FROM c)
SELECT k, row_number() OVER (PARTITION BY k ORDER BY min(i)) - 1 AS n, min(i) AS start, max(i) + 1 AS stop, string_agg(b, ' ' ORDER BY i) AS new FROM g GROUP BY k, run
"""


def c9_table_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as small tables in three versions, merged cell by cell."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")

    def run(batches):
        for pdf in batches:
            out = []
            for k, s, p in zip(pdf["o_orderkey"], pdf["o_orderstatus"], pdf["o_orderpriority"], strict=True):
                base = [[s, p], ["x", "y z"]]
                ours = [[s + "!", p], ["x", "y w" if k % 4 == 0 else "y z"]]
                theirs = [[s, p.lower()], ["x", "y v" if k % 6 == 0 else "y z"]] + ([["new", "row"]] if k % 10 == 0 else [])
                out.append(sequences.merge_grid(base, ours, theirs))
            yield pdf[["o_orderkey"]].assign(merged=[None if m is None else "\n".join("\t".join(r) for r in m[0]) for m in out], clash=[m is not None and m[1] for m in out])

    return o.mapInPandas(run, "o_orderkey long, merged string, clash boolean")


C9 = """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus || '!' || chr(9) || lower(o_orderpriority) || chr(10) || 'x' || chr(9) || CASE WHEN o_orderkey % 6 = 0 THEN 'y v' WHEN o_orderkey % 4 = 0 THEN 'y w' ELSE 'y z' END END AS merged, o_orderkey % 10 <> 0 AND o_orderkey % 12 = 0 AS clash FROM orders
"""

def a6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.shares(table(spark, sf_dir, "conversations"), ["conv_id"], F.length("text").cast("long"), F.col("role") == "assistant")


A6 = """
SELECT conv_id, sum(length(text))::BIGINT AS total, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS native, CASE WHEN sum(length(text)) > 0 THEN round(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::DOUBLE / sum(length(text)), 3) ELSE 0.0 END AS share FROM conversations GROUP BY conv_id
"""


def a9_median_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.median_pitch(table(spark, sf_dir, "events"), ["user_id"], "event_id")


A9 = "SELECT user_id, median(d) AS pitch, count(d) AS n_gaps FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) GROUP BY user_id"


def w2_tracked_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand's parts at places whose spacing changes by stretches."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select((k % 20).alias("line"), k.alias("pos"), (k * 3 + F.when(k % 400 < 200, k % 400).otherwise(k % 7 * 5)).cast("double").alias("x"))
    return segment.tracked_runs(parts, ["line"], "pos", "x", 0.5)


W2 = """
WITH p AS (SELECT p_partkey % 20 AS line, p_partkey AS pos, (p_partkey * 3 + CASE WHEN p_partkey % 400 < 200 THEN p_partkey % 400 ELSE p_partkey % 7 * 5 END)::DOUBLE AS x FROM part),
g AS (SELECT line, pos, gap, lag(gap) OVER (PARTITION BY line ORDER BY pos) AS before FROM (SELECT *, x - lag(x) OVER (PARTITION BY line ORDER BY pos) AS gap FROM p) WHERE gap IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR abs(gap - before) > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT line, min(pos) AS first, max(pos) AS last, count(*) AS n_gaps, median(gap) AS gap FROM i GROUP BY line, run HAVING count(*) >= 4
"""


def w17_drawn_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select("p_partkey", F.when((k % 50 != 1) & (k >= 5), F.floor(k / 5)).alias("parent"), (k * 7 % 11).alias("z"))
    return resolve.drawn_order(nodes, "p_partkey", "parent", "z")


W17 = """
WITH RECURSIVE n AS (SELECT p_partkey, CASE WHEN p_partkey % 50 <> 1 AND p_partkey >= 5 THEN p_partkey // 5 END AS parent, p_partkey * 7 % 11 AS z FROM part),
t AS (SELECT p_partkey, p_partkey AS root, [z, p_partkey] AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.p_partkey, t.root, list_concat(t.path, [n.z, n.p_partkey]) FROM n JOIN t ON n.parent = t.p_partkey)
SELECT p_partkey, root, row_number() OVER (PARTITION BY root ORDER BY path) AS rank FROM t
"""


def f5_off_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boxes(spark, sf_dir).withColumn("r", F.struct((F.col("x0") - 20).alias("x0"), (F.col("y0") - 10).alias("y0"), (F.col("x1") - 20).alias("x1"), (F.col("y1") - 10).alias("y1")))
    turn = geo.turned(F.col("r.x0"), F.col("r.y0"), F.lit(100.0), F.lit(50.0), F.lit(90.0))
    return found.select("p_partkey", geo.off_page(F.col("r"), F.lit(250.0), F.lit(140.0)).alias("off"), F.round(turn.x, 6).alias("x"), F.round(turn.y, 6).alias("y"))


F5 = f"WITH {BOX} SELECT k AS p_partkey, (x1 <= 20 OR y1 <= 10 OR x0 >= 270 OR y0 >= 150) AS off, round(100 - (y0 - 10 - 50), 6) AS x, round(50 + (x0 - 20 - 100), 6) AS y FROM b"


def n5_key_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of event properties that no record reads, some nested ones added by rule."""
    k = F.col("event_id")
    events = table(spark, sf_dir, "events").select("event_id", F.when(k % 20 == 0, F.lit('{"k": 1, "more": {"a": [1, {"b": 2}]}}')).when(k % 20 == 1, F.lit("not json")).otherwise(F.col("props")).alias("props"))
    return strict_json.key_paths(events, "event_id", "props", ("$.k",)).groupBy("path").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


N5 = "SELECT path, count(*) AS n, min(event_id) AS first_event FROM events, (SELECT unnest(['$.more', '$.more.a', '$.more.a[].b']) AS path) WHERE event_id % 20 = 0 GROUP BY path"


def s24_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decided(spark, sf_dir)
    return report.summary(found, merge.conflicts(found, "k", ["cents", "status", "priority"], "order"))


S24 = f"""
WITH {V3}, c AS (SELECT 'cents' AS field FROM d WHERE xc AND ho AND ht UNION ALL SELECT 'status' FROM d WHERE xs AND ho AND ht UNION ALL SELECT 'priority' FROM d WHERE xp AND ho AND ht UNION ALL SELECT 'existence' FROM d WHERE decision = 'keep_removed')
SELECT 'decisions' AS section, decision AS what, count(*) AS n FROM d GROUP BY decision UNION ALL SELECT 'conflicts', field, count(*) FROM c GROUP BY field
"""

QUERIES = {f.__name__: f for f in (a7_titles, a10_majority, a11_columns, w20_style_ranges, w22_bands, j12_label_moves, j18_units, f10_bullets, f12_would_hide, f14_has_writes, t2_union_of_keys, s11_html_round_trip, p3_text_residuals, c9_table_merge, a6_shares, a9_median_pitch, w2_tracked_runs, w17_drawn_order, f5_off_page, n5_key_paths, s24_report)}
ORACLES = {"p3_text_residuals": P3, "a7_titles": A7, "a10_majority": A10, "a11_columns": A11, "w20_style_ranges": W20, "w22_bands": W22, "j12_label_moves": J12, "j18_units": J18, "f10_bullets": F10, "f12_would_hide": F12, "f14_has_writes": F14, "t2_union_of_keys": T2, "c9_table_merge": C9, "a6_shares": A6, "a9_median_pitch": A9, "w2_tracked_runs": W2, "w17_drawn_order": W17, "f5_off_page": F5, "n5_key_paths": N5, "s24_report": S24}
