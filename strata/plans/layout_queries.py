"""Layout, geometry and strict reading, over pages made of the tables by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import geometry as geo
from strata.operators import grid, layout, listings, stats
from strata.sources import strict_json
from strata.sources.tables import table


def _chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as a page of characters: lines of sixty, blanks not painted, two fonts."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"), F.posexplode(F.split("text", "")).alias("pos", "c")).where("c not in (' ', '\n', '')")
    col, row = F.col("pos") % 60, F.floor(F.col("pos") / 60)
    x = col * 5.0 + F.when(F.col("pos") % 97 > 90, 2.0).otherwise(0.0)
    return items.select("page", F.col("pos").cast("long").alias("pos"), "c", x.alias("x0"), (x + 5).alias("x1"), (row * 12.0).alias("y"), F.lit(10.0).alias("size"), F.when(row % 4 == 0, "bold").otherwise("plain").alias("font"), F.lit("#000000").alias("color"))


CHARS = """
p AS (SELECT item_id AS page, string_split(text, '') AS cs FROM benchmark),
u AS (SELECT page, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS pos FROM p),
ch AS (SELECT page, pos::BIGINT AS pos, c, (pos % 60) * 5.0::DOUBLE + CASE WHEN pos % 97 > 90 THEN 2.0 ELSE 0.0 END AS x0, (pos // 60) * 12.0::DOUBLE AS y, CASE WHEN (pos // 60) % 4 = 0 THEN 'bold' ELSE 'plain' END AS font FROM u WHERE c NOT IN (' ', chr(10), '')),
g AS (SELECT *, (x0 - lag(x0 + 5) OVER w) / 10 AS gap, abs(y - lag(y) OVER w) / 10 AS shift, lag(font) OVER w IS DISTINCT FROM font AS other FROM ch WINDOW w AS (PARTITION BY page ORDER BY pos)),
i AS (SELECT *, sum(CASE WHEN other OR gap >= 0.3 OR gap < -0.5 OR shift >= 0.8 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS span FROM g),
sp AS (SELECT page, span, font, string_agg(CASE WHEN gap >= 0.15 AND pos > f THEN ' ' || c ELSE c END, '' ORDER BY pos) AS text, min(x0) AS x0, max(x0 + 5) AS x1, min(y) AS y, min(pos) AS first, max(pos) AS last FROM (SELECT *, min(pos) OVER (PARTITION BY page, span) AS f FROM i) GROUP BY page, span, font)
"""


def w1_glyph_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.spans(_chars(spark, sf_dir), ["page"]).select("page", "span", "font", "text", "x0", "x1", "y", "first", "last")


W1 = f"WITH {CHARS} SELECT page, span, font, text, x0, x1, y, first, last FROM sp"


def k2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines(layout.spans(_chars(spark, sf_dir), ["page"]), ["page"]).select("page", "line", "baseline", "text", "n_spans")


K2 = f"WITH {CHARS}, l AS (SELECT page, y AS baseline, string_agg(text, ' ' ORDER BY x0, first) AS text, count(*) AS n_spans FROM sp GROUP BY page, y) SELECT page, row_number() OVER (PARTITION BY page ORDER BY baseline) AS line, baseline, text, n_spans FROM l"


def w9_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.paragraphs(layout.lines(layout.spans(_chars(spark, sf_dir), ["page"]), ["page"]), "page", 10.0)


def a1_body_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as texts set in a size by role and length; the body size of each conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "text", F.when(F.length("text") < 100, 14.0).when(F.col("role") == "user", 10.02).otherwise(11.0).alias("size"))
    return layout.body_size(turns, ["conv_id"])


A1 = """
WITH t AS (SELECT conv_id, round(CASE WHEN length(text) < 100 THEN 14.0 WHEN role = 'user' THEN 10.02 ELSE 11.0 END::DOUBLE, 1) AS body_size, sum(length(regexp_replace(text, '\\s', '', 'g')))::BIGINT AS n_chars FROM conversations GROUP BY ALL)
SELECT conv_id, body_size, n_chars FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n_chars DESC, body_size) = 1
"""


def a2_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as texts of a supplier's pages: flags that most months show near their usual place."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("frame"), F.concat_ws("/", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("text"), F.col("l_quantity").alias("x0"))
    return layout.furniture(items, "l_suppkey", "frame", "text", F.lit(40.0), share=0.1).select("l_suppkey", "text", "n_frames", "frames")


A2 = """
WITH i AS (SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS frame, l_returnflag || '/' || l_linestatus || '/' || l_linenumber AS text, l_quantity AS x0 FROM lineitem),
m AS (SELECT l_suppkey, text, median(x0) AS middle FROM i GROUP BY ALL), n AS (SELECT l_suppkey, count(DISTINCT frame) AS frames FROM i GROUP BY 1),
c AS (SELECT l_suppkey, text, count(DISTINCT frame) AS n_frames FROM i JOIN m USING (l_suppkey, text) WHERE abs(x0 - middle) <= 20 GROUP BY ALL)
SELECT l_suppkey, text, n_frames, frames FROM c JOIN n USING (l_suppkey) WHERE frames >= 3 AND n_frames >= greatest(3.0, frames * 0.1::DOUBLE)
"""


def w8_regular_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as rows by key, with as many cells as their status says."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("double").alias("y"), F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3).cast("long").alias("cells"))
    return layout.regular_rows(rows, ["o_custkey"], "y", "cells", 2000.0, spread=6.0, least=2).select("o_custkey", "cells", "n_rows", "top", "bottom")


W8 = """
WITH r AS (SELECT o_custkey, o_orderkey::DOUBLE AS y, CASE o_orderstatus WHEN 'F' THEN 2 ELSE 3 END::BIGINT AS cells FROM orders WHERE o_orderstatus <> 'P'),
p AS (SELECT *, y - lag(y) OVER w AS pitch, lag(cells) OVER w AS before FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY y)),
i AS (SELECT *, sum(CASE WHEN pitch IS NULL OR pitch > 4000 OR cells <> before THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY y ROWS UNBOUNDED PRECEDING) AS stretch FROM p),
n AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY o_custkey, stretch ORDER BY y) > 1 THEN pitch END AS inn FROM i)
SELECT o_custkey, cells, count(*) AS n_rows, min(y) AS top, max(y) AS bottom FROM n GROUP BY o_custkey, stretch, cells HAVING count(*) >= 2 AND max(inn) <= 6 * min(inn)
"""


def w11_list_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") * 3 % 47).cast("double").alias("x"))
    return layout.list_levels(items, ["p_brand"], "x").select("p_partkey", F.col("level").cast("long").alias("level"))


W11 = """
WITH i AS (SELECT p_partkey, p_brand, (p_size * 3 % 47)::DOUBLE AS x FROM part), d AS (SELECT DISTINCT p_brand, x FROM i),
l AS (SELECT p_brand, x, sum(CASE WHEN before IS NULL OR x - before > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY x ROWS UNBOUNDED PRECEDING)::BIGINT AS level FROM (SELECT *, lag(x) OVER (PARTITION BY p_brand ORDER BY x) AS before FROM d))
SELECT p_partkey, level FROM i JOIN l USING (p_brand, x)
"""


def o1_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 40 == 7, "title").otherwise("body").alias("role"), (F.col("p_partkey") * 7 % 400).cast("double").alias("y0"), (F.col("p_partkey") * 13 % 300).cast("double").alias("x0"))
    return layout.reading_order(parts, ["p_brand"]).select("p_brand", "pos", "order")


O1 = """
SELECT p_brand, p_partkey AS pos, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_partkey % 40 = 7 THEN 0 ELSE 1 END, round_even((p_partkey * 7 % 400)::DOUBLE / 4, 0), (p_partkey * 13 % 300)::DOUBLE, p_partkey) AS "order" FROM part
"""


def f1_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as characters in painting order, every ninth also an opaque cover; those that are seen, counted by brand."""
    k = F.col("p_partkey")
    x, y = (k * 37 % 400).cast("double"), (k * 53 % 300).cast("double")
    chars = table(spark, sf_dir, "part").select("p_brand", k.alias("pos"), k.alias("obj"), F.when(k % 19 == 0, 0).otherwise(255).alias("alpha"), x.alias("x0"), y.alias("y0"), (x + 8).alias("x1"), (y + 10).alias("y1"))
    covers = chars.where("pos % 9 = 0").withColumn("x1", F.col("x0") + 40).withColumn("y1", F.col("y0") + 30)
    return layout.visible(chars, covers, ["p_brand"]).groupBy("p_brand").agg(F.count("*").alias("n_visible"), F.sum("pos").alias("key_sum"))


F1 = """
WITH c AS (SELECT p_brand, p_partkey AS pos, (p_partkey * 37 % 400)::DOUBLE AS x0, (p_partkey * 53 % 300)::DOUBLE AS y0 FROM part WHERE p_partkey % 19 <> 0),
v AS (SELECT p_brand, p_partkey AS cover, (p_partkey * 37 % 400)::DOUBLE AS a0, (p_partkey * 53 % 300)::DOUBLE AS b0 FROM part WHERE p_partkey % 9 = 0),
p AS (SELECT p_brand, pos, i, j, x0 + i * 4.0 AS x, y0 + j * 5.0 AS y FROM c, (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1, 2]) AS j)),
h AS (SELECT DISTINCT p.p_brand, pos, i, j FROM p JOIN v ON p.p_brand = v.p_brand AND cover > pos AND x > a0 AND x < a0 + 40 AND y > b0 AND y < b0 + 30),
g AS (SELECT pos FROM h GROUP BY pos HAVING count(*) >= 5)
SELECT p_brand, count(*) AS n_visible, sum(pos)::BIGINT AS key_sum FROM c WHERE pos NOT IN (SELECT pos FROM g) GROUP BY p_brand
"""


def g1_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    m = lambda *v: F.struct(*(F.lit(x).cast("double").alias(n) if not isinstance(x, Column) else x.cast("double").alias(n) for n, x in zip("abcdef", v, strict=True)))
    parts = table(spark, sf_dir, "part").select("p_partkey", geo.compose(m(2, 0, 0, 3, k % 10, k % 7), m(0, 1, -1, 0, k % 5, 1)).alias("m"), F.col("p_size").cast("double").alias("w"))
    box = parts.select("p_partkey", geo.transformed_box(F.col("m"), F.col("w"), F.lit(2.0)).alias("r"))
    return box.select("p_partkey", "r.x0", "r.y0", "r.x1", "r.y1")


G1 = """
WITH t AS (SELECT p_partkey, p_size::DOUBLE AS w, (2 * (p_partkey % 5) + p_partkey % 10)::DOUBLE AS e, (3 + p_partkey % 7)::DOUBLE AS f FROM part)
SELECT p_partkey, e - 4.0 AS x0, f AS y0, e AS x1, f + 3.0 * w AS y1 FROM t
"""


def g2_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale and shift between two measures of each brand's parts, the shift common to them if there is one, and a mean phase."""
    parts = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("double").alias("x"), (F.col("p_size") * 1.5 + 4 + F.col("p_partkey") % 3).alias("y"))
    scale, shift = geo.placement(F.col("x"), F.col("y"))
    return parts.groupBy("p_brand").agg(F.round(scale, 6).alias("scale"), F.round(shift, 6).alias("shift"), F.round(geo.common_shift(F.col("y") - F.col("x") * 1.5, 3.0), 6).alias("common"), F.round(geo.circular_mean(F.col("x"), 24.0), 6).alias("phase"))


G2 = """
WITH p AS (SELECT p_brand, p_size::DOUBLE AS x, (p_size * 1.5 + 4 + p_partkey % 3)::DOUBLE AS y FROM part),
a AS (SELECT p_brand, regr_slope(y, x) AS scale, regr_intercept(y, x) AS shift, max(y - x * 1.5::DOUBLE) - min(y - x * 1.5::DOUBLE) AS spread, avg(y - x * 1.5::DOUBLE) AS common, atan2(avg(sin(x * 2 * pi() / 24)), avg(cos(x * 2 * pi() / 24))) * 24 / (2 * pi()) AS phase FROM p GROUP BY p_brand)
SELECT p_brand, round(scale, 6) AS scale, round(shift, 6) AS shift, CASE WHEN spread <= 3 THEN round(common, 6) END AS common, round(CASE WHEN phase < 0 THEN phase + 24 ELSE phase END, 6) AS phase FROM a
"""


def g10_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = lambda c: F.lower(F.concat(F.lit("#"), F.lpad(F.hex(c % 16_777_216), 6, "0")))
    parts = table(spark, sf_dir, "part").select("p_partkey", hexed(F.col("p_partkey") * 7919).alias("a"), hexed(F.col("p_partkey") * 104_729).alias("b"))
    return parts.select("p_partkey", geo.colour_distance(F.col("a"), F.col("b")).alias("distance"))


G10 = """
WITH p AS (SELECT p_partkey, p_partkey * 7919 % 16777216 AS a, p_partkey * 104729 % 16777216 AS b FROM part)
SELECT p_partkey, abs(a // 65536 - b // 65536) + abs(a // 256 % 256 - b // 256 % 256) + abs(a % 256 - b % 256) AS distance FROM p
"""


def f3_point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    arrow = F.array(*(corner(*p) for p in ((0, 0), (50, 0), (50, 30), (25, 10), (0, 30))))
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7 % 61 + 0.5).alias("x"), (F.col("p_partkey") * 11 % 41 + 0.25).alias("y"))
    return parts.select("p_partkey", geo.winding(F.col("x"), F.col("y"), arrow).alias("inside"))


F3 = """
WITH p AS (SELECT p_partkey, p_partkey * 7 % 61 + 0.5::DOUBLE AS x, p_partkey * 11 % 41 + 0.25::DOUBLE AS y FROM part)
SELECT p_partkey, x < 50 AND y < CASE WHEN x < 25 THEN 30 - 0.8::DOUBLE * x ELSE 10 + 0.8::DOUBLE * (x - 25) END AS inside FROM p
"""


def s7_strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties against a strict schema, some of them spoiled by rule."""
    k = F.col("event_id")
    events = table(spark, sf_dir, "events").select("event_id", F.when(k % 50 == 0, F.lit('{"k": "x"}')).when(k % 50 == 1, F.lit('{"k": 1, "z": 2}')).when(k % 50 == 2, F.lit("{}")).when(k % 50 == 3, F.lit('{"k": 1')).otherwise(F.col("props")).alias("props"))
    return strict_json.violations(events, "event_id", "props", {"k": "integer"})


S7 = """
SELECT event_id, CASE event_id % 50 WHEN 0 THEN '$.k' WHEN 1 THEN '$.z' WHEN 2 THEN '$.k' ELSE '$' END AS path, CASE event_id % 50 WHEN 0 THEN 'type' WHEN 1 THEN 'unknown' WHEN 2 THEN 'missing' ELSE 'malformed' END AS problem FROM events WHERE event_id % 50 < 4
"""


def a18_uniform_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price class that all lines of an order were given, if it is one and differs for some."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.floor(F.col("l_discount") * 100 / 5).cast("long").alias("was"), F.when(F.col("l_orderkey") % 3 == 0, F.col("l_orderkey") % 5).otherwise(F.floor(F.col("l_discount") * 100 / 5)).cast("long").alias("now"))
    return stats.uniform_change(lines, ["l_orderkey"], "was", "now").where("value is not null")


A18 = """
WITH l AS (SELECT l_orderkey, floor(l_discount * 100 / 5)::BIGINT AS was, CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey % 5 ELSE floor(l_discount * 100 / 5)::BIGINT END AS now FROM lineitem)
SELECT l_orderkey, max(now) AS value FROM l GROUP BY l_orderkey HAVING count(DISTINCT now) = 1 AND bool_or(was <> now)
"""

def listed_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as glyphs, conversations as lines and fifty of them as a page: tokens of four glyphs in columns of seven points, an empty column behind each; some tokens off their columns, some pages letter-spaced."""
    c, k = F.col("conv_id"), F.col("turn")
    token, page = F.floor(k / 4), F.floor(c / 50).cast("long")
    advance = F.when(page % 5 == 4, 4.0).otherwise(4.0 + (c + token) % 3 * 0.5)
    glue = (28.0 - 4 * advance) / 5
    x = 35.0 * token + page % 3 * 2.5 + F.when((c % 7 == 0) & (token % 2 == 1), 2.3).otherwise(0.0) + glue + k % 4 * (advance + glue)
    return table(spark, sf_dir, "conversations").select(page.alias("page"), c.alias("line"), k.alias("pos"), x.alias("x"), advance.alias("advance"), F.lit(10.0).alias("size"))


def w3_column_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grid.column_grid(listed_glyphs(spark, sf_dir), ["page"], "line", "pos")
    return found.select("page", "line", F.round("pitch", 6).alias("pitch"), F.round(F.pmod(F.col("edge") + 1e-7, F.col("pitch")), 5).alias("edge"), "n_stretches", F.round("worst", 6).alias("worst"), "on_grid")


def w6_leader_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines, some of which are nothing but dots."""
    c, k = F.col("conv_id"), F.col("turn")
    n = c % 7 + 2
    text = F.when((c + k) % 3 == 0, F.repeat(F.lit(" ."), n.cast("int"))).when((c + k) % 3 == 1, F.repeat(F.lit("."), n.cast("int"))).otherwise(F.col("text"))
    pitch = listings.leader_pitch(text, F.lit(10.0), 10.0 + n * (4.0 + k % 3), 9.0 + k % 2, (c + k) % 5 == 0)
    return table(spark, sf_dir, "conversations").select(c, k, pitch.alias("pitch")).where("pitch is not null")


W6 = r"""
WITH t AS (SELECT conv_id, turn, conv_id % 7 + 2 AS n, 9.0::DOUBLE + turn % 2 AS size, CASE (conv_id + turn) % 3 WHEN 0 THEN repeat(' .', conv_id % 7 + 2) WHEN 1 THEN repeat('.', conv_id % 7 + 2) ELSE text END AS text FROM conversations)
SELECT conv_id, turn, round((n * (4.0 + turn % 3) - 0.278 * size) / (n - 1) / size, 4) AS pitch FROM t WHERE regexp_full_match(trim(text), '\.(\s*\.){3,}') AND (conv_id + turn) % 5 <> 0
"""


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines, four conversations a page, each a column of its own; some count on, some don't, some stand beside code."""
    c, k = F.col("conv_id"), F.col("turn")
    first = F.when((c + k) % 9 == 4, "word").when(c % 3 == 1, ((k * 5) % 7).cast("string")).otherwise((k + 3).cast("string"))
    return table(spark, sf_dir, "conversations").select(F.floor(c / 4).cast("long").alias("page"), (c * 1000 + k).alias("line"), first.alias("first"), (c % 4 * 60.0 + k % 3 * 0.4).alias("right"), (k * 12.0).alias("baseline"), F.when((c % 11 == 0) & (k == 2), 7.0).otherwise(9.0).alias("size"), ((c + k) % 4 < c % 5).alias("code"))


def w7_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.line_numbers(numbered_lines(spark, sf_dir), "page", "line")


W7 = """
WITH t AS (SELECT conv_id AS c, turn AS k, CASE WHEN (conv_id + turn) % 9 = 4 THEN NULL WHEN conv_id % 3 = 1 THEN turn * 5 % 7 ELSE turn + 3 END AS n, (conv_id + turn) % 4 < conv_id % 5 AS code, CASE WHEN conv_id % 11 = 0 AND turn = 2 THEN 7 ELSE 9 END AS size FROM conversations),
m AS (SELECT * FROM t WHERE n IS NOT NULL),
g AS (SELECT *, coalesce(n > lag(n) OVER (PARTITION BY c ORDER BY k), true) AS up FROM m),
a AS (SELECT c, count(*) >= 3 AND bool_and(up) AND count(DISTINCT size) = 1 AND count(*) FILTER (code) >= greatest(2, count(*) / 2) AS good, row_number() OVER (PARTITION BY c // 4 ORDER BY c) AS col FROM g GROUP BY c)
SELECT m.c // 4 AS page, m.c * 1000 + k AS line, col AS "column", good AS numbers_code FROM m JOIN a ON a.c = m.c
"""


def measured_pictures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns as holes of a page's lines, and pictures somewhat off them."""
    c, k = F.col("conv_id"), F.col("turn")
    t = table(spark, sf_dir, "conversations").select(c.alias("page"), k.alias("k"))
    h = (F.col("page") * 5 + F.col("k") * 3) % 13
    x, y = 9.0 * F.col("k"), 6.0 * (F.col("k") % 3)
    box = lambda dx, dy: ((x + dx).alias("x0"), (y + dy).alias("y0"), (x + dx + 8.0).alias("x1"), (y + dy + 6.0).alias("y1"))
    holes = t.where(h != 0).select("page", F.col("k").alias("hole"), *box(0.0, 0.0), F.lit(10.0).alias("size"))
    return t.where(h != 1).select("page", (F.col("k") + 500).alias("picture"), *box(h - 6.0, h % 5 * 3.0 - 5.0)), holes


def j32_over_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.over_holes(*measured_pictures(spark, sf_dir), "page", "picture", "hole")


QUERIES = {f.__name__: f for f in (w1_glyph_spans, k2_lines, w9_paragraphs, a1_body_size, a2_furniture, w8_regular_rows, w11_list_levels, o1_reading_order, f1_visible, g1_transforms, g2_placement, g10_colours, f3_point_in_polygon, s7_strict_json, a18_uniform_change, w3_column_grid, w6_leader_pitch, w7_line_numbers, j32_over_holes)}
ORACLES = {"w1_glyph_spans": W1, "k2_lines": K2, "a1_body_size": A1, "a2_furniture": A2, "w8_regular_rows": W8, "w11_list_levels": W11, "o1_reading_order": O1, "f1_visible": F1, "g1_transforms": G1, "g2_placement": G2, "g10_colours": G10, "f3_point_in_polygon": F3, "s7_strict_json": S7, "a18_uniform_change": A18, "w6_leader_pitch": W6, "w7_line_numbers": W7}
