"""Drawings, pixels and elements, made of the tables by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import diagrams, elements, figures, pictures, trees
from strata.sources.tables import table


def f2_visible_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as drawings, some of whose fills and strokes are at opacity 0."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(
        k, F.element_at(F.array(F.lit("f"), F.lit("s"), F.lit("fs")), (k % 3 + 1).cast("int")).alias("type"), F.when(k % 4 == 0, 0.0).when(k % 4 == 1, None).otherwise(0.5).alias("fill_opacity"),
        F.when(k % 5 == 0, 0.0).when(k % 5 == 2, None).otherwise(1.0).alias("stroke_opacity"), F.col("p_brand").alias("color"), F.col("p_size").alias("width"), (k % 7).alias("dash_phase"), F.col("p_type").alias("fill"),
    )
    return figures.visible_drawings(parts)


F2 = """
WITH d AS (SELECT p_partkey, ['f', 's', 'fs'][p_partkey % 3 + 1] AS type, CASE WHEN p_partkey % 4 = 0 THEN 0.0 WHEN p_partkey % 4 <> 1 THEN 0.5 END::DOUBLE AS fill_opacity,
  CASE WHEN p_partkey % 5 = 0 THEN 0.0 WHEN p_partkey % 5 <> 2 THEN 1.0 END::DOUBLE AS stroke_opacity, p_brand, p_size, p_type FROM part),
s AS (SELECT *, type <> 's' AND coalesce(fill_opacity, 1) > 0 AS f, type <> 'f' AND coalesce(stroke_opacity, 1) > 0 AS s FROM d)
SELECT p_partkey, CASE WHEN f AND s THEN 'fs' WHEN f THEN 'f' ELSE 's' END AS type, CASE WHEN f OR type = 's' THEN fill_opacity END AS fill_opacity, CASE WHEN s OR type = 'f' THEN stroke_opacity END AS stroke_opacity,
  CASE WHEN s OR type = 'f' THEN p_brand END AS color, CASE WHEN s OR type = 'f' THEN p_size END AS width, CASE WHEN s OR type = 'f' THEN p_partkey % 7 END AS dash_phase, CASE WHEN f OR type = 's' THEN p_type END AS fill FROM s WHERE f OR s
"""


def g4_curve_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubic curves whose points follow from a part's key."""
    k = F.col("p_partkey")
    point = lambda *steps: [(k * a % m).cast("double") for a, m in steps]
    x, y = point((7, 101), (31, 257), (57, 307), (11, 127)), point((13, 113), (29, 211), (3, 17), (41, 139))
    box = figures.curve_box(x, y)
    return table(spark, sf_dir, "part").select(k, box.alias("b")).select(k, *(F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


def _axis(p: tuple[str, str, str, str]) -> str:
    return f"""SELECT k, least(a, d, v0, v1, v2) AS lo, greatest(a, d, v0, v1, v2) AS hi FROM (SELECT *, {", ".join(f"CASE WHEN t{n} > 0 AND t{n} < 1 THEN (1-t{n})**3*a + 3*(1-t{n})**2*t{n}*b + 3*(1-t{n})*t{n}**2*c + t{n}**3*d END AS v{n}" for n in range(3))}
  FROM (SELECT *, CASE WHEN abs(p) < 1e-9 AND abs(q) > 1e-9 THEN -r / q END AS t0, CASE WHEN abs(p) >= 1e-9 AND q*q - 4*p*r >= 0 THEN (-q + sqrt(greatest(q*q - 4*p*r, 0))) / (2*p) END AS t1,
    CASE WHEN abs(p) >= 1e-9 AND q*q - 4*p*r >= 0 THEN (-q - sqrt(greatest(q*q - 4*p*r, 0))) / (2*p) END AS t2
  FROM (SELECT *, -a + 3*b - 3*c + d AS p, 2*(a - 2*b + c) AS q, b - a AS r FROM (SELECT p_partkey AS k, ({p[0]})::DOUBLE AS a, ({p[1]})::DOUBLE AS b, ({p[2]})::DOUBLE AS c, ({p[3]})::DOUBLE AS d FROM part))))"""


_of = lambda *steps: tuple(f"p_partkey * {a} % {m}" for a, m in steps)
G4 = f"""SELECT x.k AS p_partkey, round(x.lo, 6) AS x0, round(y.lo, 6) AS y0, round(x.hi, 6) AS x1, round(y.hi, 6) AS y1
FROM ({_axis(_of((7, 101), (31, 257), (57, 307), (11, 127)))}) x JOIN ({_axis(_of((13, 113), (29, 211), (3, 17), (41, 139)))}) y USING (k)"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as pixels of pages, one for each supplier."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_suppkey").alias("page"), (F.col("l_partkey") % 12).cast("long").alias("x"), (F.col("l_orderkey") % 15).cast("long").alias("y"), (F.col("l_linenumber") * 65536 + F.col("l_quantity").cast("long") % 3).cast("long").alias("rgb"))


_PIXELS = "WITH px AS (SELECT l_suppkey AS page, (l_partkey % 12)::BIGINT AS x, (l_orderkey % 15)::BIGINT AS y, (l_linenumber * 65536 + l_quantity::BIGINT % 3)::BIGINT AS rgb FROM lineitem)"


def a26_page_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.page_ground(_pixels(spark, sf_dir), ["page"]).select("page", "ground", F.round("share", 6).alias("share"))


A26 = _PIXELS + ", n AS (SELECT page, rgb, count(*) AS n FROM px GROUP BY ALL) SELECT page, arg_max(rgb, n * 1000000000 - rgb) AS ground, round(max(n) / sum(n), 6) AS share FROM n GROUP BY page"


def g11_ink_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two masks of each page: pixels of odd lines, and of lines under four moved by one."""
    px = _pixels(spark, sf_dir)
    line = F.floor(F.col("rgb") / 65536)
    return figures.ink_overlap(px.where(line % 2 == 1), px.where(line < 4).withColumn("x", F.col("x") + 1), ["page"]).select("page", F.round("overlap", 6).alias("overlap"))


G11 = _PIXELS + """, a AS (SELECT DISTINCT page, x, y FROM px WHERE rgb // 65536 % 2 = 1), b AS (SELECT DISTINCT page, x + 1 AS x, y FROM px WHERE rgb // 65536 < 4),
h AS (SELECT page, count(*) AS n FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.page = a.page AND abs(b.x - a.x) + abs(b.y - a.y) <= 1) GROUP BY page
  UNION ALL SELECT page, count(*) FROM b WHERE EXISTS (SELECT 1 FROM a WHERE b.page = a.page AND abs(b.x - a.x) + abs(b.y - a.y) <= 1) GROUP BY page),
t AS (SELECT page, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY page)
SELECT t.page, round(coalesce((SELECT sum(n) FROM h WHERE h.page = t.page), 0) / t.n, 6) AS overlap FROM t"""


def q2_text_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each page that are no specks, by page."""
    return figures.text_mask(_pixels(spark, sf_dir).where("rgb % 65536 <> 1"), ["page"]).groupBy("page").agg(F.count("*").alias("n_pixels"))


Q2M = _PIXELS + """, i AS (SELECT DISTINCT page, x, y FROM px WHERE rgb % 65536 <> 1), c AS (SELECT a.page, a.x, a.y FROM i a JOIN i b ON a.page = b.page AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL HAVING count(*) >= 4)
SELECT page, count(*) AS n_pixels FROM c GROUP BY page"""


def g12_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each supplier's page that one line in five inks, by connected shape."""
    cells = _pixels(spark, sf_dir).where("rgb % 65536 = 0 and rgb < 2 * 65536").withColumn("x", F.col("x") * 2 % 23)
    label = F.col("page") * (1 << 40) + F.col("label_y") * (1 << 20) + F.col("label_x")
    return figures.labels(cells, "page").groupBy("page", label.alias("label")).agg(F.count("*").alias("n_cells"), F.min("x").alias("x0"), F.max("x").alias("x1"))


G12 = _PIXELS.replace("WITH px", "WITH RECURSIVE px") + """, c AS (SELECT DISTINCT page, x * 2 % 23 AS x, y FROM px WHERE rgb % 65536 = 0 AND rgb < 2 * 65536), k AS (SELECT *, page * 1099511627776 + y * 1048576 + x AS k FROM c),
r AS (SELECT page, x, y, k AS label FROM k UNION SELECT k.page, k.x, k.y, r.label FROM r JOIN k ON k.page = r.page AND abs(k.x - r.x) <= 1 AND abs(k.y - r.y) <= 1),
l AS (SELECT page, x, y, min(label) AS label FROM r GROUP BY ALL)
SELECT page, label, count(*) AS n_cells, min(x) AS x0, max(x) AS x1 FROM l GROUP BY ALL"""


def g12_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the outlines of each page's ink enclose, holes taken off, and how long they are."""
    cells = _pixels(spark, sf_dir).where("rgb < 2 * 65536")
    return figures.contours(cells, "page").groupBy("page").agg(F.sum("area").alias("area"), F.sum("n_edges").alias("n_edges"))


G12C = _PIXELS + """, c AS (SELECT DISTINCT page, x, y FROM px WHERE rgb < 2 * 65536),
s AS (SELECT c.page, c.x, c.y, count(n.x) AS n FROM c LEFT JOIN c n ON n.page = c.page AND abs(n.x - c.x) + abs(n.y - c.y) = 1 GROUP BY ALL)
SELECT page, count(*) AS area, sum(4 - n)::BIGINT AS n_edges FROM s GROUP BY page"""


def q1_lost_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each page that none of its elements' boxes covers."""
    px = _pixels(spark, sf_dir)
    boxes = px.where("rgb < 2 * 65536").select("page", F.col("x").cast("double").alias("x0"), F.col("y").cast("double").alias("y0"), (F.col("x") + 2.0).alias("x1"), (F.col("y") + 1.0).alias("y1"))
    return figures.uncovered(px, boxes, ["page"], 4.0).groupBy("page").agg(F.count("*").alias("n_lost"))


Q1L = _PIXELS + """, i AS (SELECT DISTINCT page, x, y FROM px), b AS (SELECT DISTINCT page, x, y FROM px WHERE rgb < 2 * 65536)
SELECT page, count(*) AS n_lost FROM i WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = i.page AND i.x BETWEEN b.x AND b.x + 2 AND i.y BETWEEN b.y AND b.y + 1) GROUP BY page"""


def c12_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as elements of four kinds, a turn each a paragraph, table row or node; very short turns are formulas."""
    run = F.struct(F.col("text"), (F.length("text") < 40).alias("hole"))
    role = F.struct(F.concat(F.lit(" "), F.col("role")).alias("text"), F.lit(False).alias("hole"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.array(run, role).alias("p"), F.array(F.array(role), F.array(run)).alias("c")).alias("t"))
    found = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).withColumn("kind", F.element_at(F.array(*map(F.lit, ("text", "table", "diagram", "image"))), (F.col("conv_id") % 4 + 1).cast("int")))
    words = elements.plain_text(F.col("kind"), F.transform("t", lambda t: t.p), F.transform("t", lambda t: t.c), F.transform("t", lambda t: t.c), F.concat(F.lit("No. "), F.col("conv_id").cast("string")))
    return found.select("conv_id", "kind", F.sha2(words, 256).alias("words_sha256"), F.length(words).cast("long").alias("n_chars"))


C12 = """
WITH t AS (SELECT conv_id, turn, role, CASE WHEN length(text) < 40 THEN '□' ELSE text END AS w FROM conversations),
e AS (SELECT conv_id, ['text', 'table', 'diagram', 'image'][conv_id % 4 + 1] AS kind, CASE conv_id % 4 WHEN 0 THEN string_agg(w || ' ' || role, chr(10) ORDER BY turn) WHEN 1 THEN string_agg(role || chr(9) || trim(w, ' '), chr(10) ORDER BY turn)
  WHEN 2 THEN string_agg(role || ' ' || trim(w, ' '), chr(10) ORDER BY turn) ELSE 'No. ' || conv_id END AS words FROM t GROUP BY conv_id)
SELECT conv_id, kind, sha256(words) AS words_sha256, length(words)::BIGINT AS n_chars FROM e
"""


def c18_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as spans of a line of ten points, of several sizes and heights."""
    q = F.col("l_quantity").cast("long")
    size, base = 5.0 + q % 8 * 0.75, 100.0 + (F.col("l_partkey") % 17 - 8) * 0.5
    text = F.when(F.col("l_suppkey") % 3 == 0, "_exit").otherwise("x")
    what = elements.script_of(size, base, F.lit(10.0), F.lit(100.0), text)
    return table(spark, sf_dir, "lineitem").groupBy(F.coalesce(what, F.lit("none")).alias("script"), (q % 8).alias("size")).agg(F.count("*").alias("n"))


C18 = """
WITH s AS (SELECT l_quantity::BIGINT % 8 AS size, 5.0 + l_quantity::BIGINT % 8 * 0.75 AS z, (l_partkey % 17 - 8) * 0.5 AS d, l_suppkey % 3 = 0 AS code FROM lineitem)
SELECT CASE WHEN (z < 8.5 AND d < -1.2) OR (z >= 8.5 AND z < 9.5 AND d <= -3) THEN CASE WHEN code THEN 'none' ELSE 'super' END WHEN z < 8.5 AND d > 1 THEN 'sub' ELSE 'none' END AS script, size, count(*) AS n FROM s GROUP BY ALL
"""


def f13_editable_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as blocks whose lines are runs, some frozen."""
    n, empty = F.col("l_linenumber"), F.lit(None).cast("string")
    chip = F.element_at(F.array(*map(F.lit, ("image", "person", "date", "link"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    run = F.struct((F.col("l_suppkey") % 3 == 0).alias("frozen"), chip.alias("chip"), F.when(n % 2 == 0, "v").otherwise(empty).alias("value"), F.when(n % 3 == 0, "u").alias("uri"), F.lit("s").alias("src"), (n % 5 == 0).alias("missing"))
    blocks = table(spark, sf_dir, "lineitem").select("l_orderkey", run.alias("r")).groupBy("l_orderkey").agg(F.collect_list("r").alias("runs"))
    return blocks.select("l_orderkey", elements.editable_block(F.when(F.col("l_orderkey") % 10 == 0, "toc").otherwise("paragraph"), F.col("runs")).alias("editable"))


F13 = """
SELECT l_orderkey, l_orderkey % 10 <> 0 AND bool_and(l_suppkey % 3 <> 0 OR CASE l_partkey % 4 WHEN 0 THEN l_linenumber % 3 = 0 OR l_linenumber % 5 <> 0 WHEN 3 THEN false ELSE l_linenumber % 2 = 0 END) AS editable
FROM lineitem GROUP BY l_orderkey
"""


def m4_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose words and places both sides changed, some to the same."""
    k = F.col("p_partkey")
    live = F.when(k % 3 == 0, F.regexp_replace("p_name", " ", "  ")).when(k % 3 == 1, F.upper("p_name")).otherwise(F.col("p_name"))
    edits = F.when(k % 4 == 0, F.array(F.lit("text"))).when(k % 4 == 1, F.array(F.lit("geometry"))).when(k % 4 == 2, F.array(F.lit("text"), F.lit("geometry"))).otherwise(F.array().cast("array<string>"))
    place = (k % 50).cast("double"), (k % 70).cast("double")
    kind = F.when(k % 13 == 0, "image").when(k % 11 == 0, "table").otherwise("text")
    scales = F.array(*(F.lit(x) for x in (1.0, 0.0, 0.0, 1.0))), F.array((1 + k % 6 * 0.0003), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    got = elements.converged_fields(F.col("p_name"), live, (place[0] + k % 5 * 0.8, place[1] - k % 7 * 0.5), place, edits, kind=kind, alone=k % 9 != 4, scales=scales)
    return table(spark, sf_dir, "part").select(k, F.array_join(got, ",").alias("converged"))


M4C = """
SELECT p_partkey, CASE WHEN p_partkey % 9 = 4 THEN '' ELSE concat_ws(',', CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 4 IN (0, 2) AND (p_partkey % 3 <> 1 OR upper(p_name) = p_name) THEN 'text' END,
  CASE WHEN p_partkey % 4 IN (1, 2) AND p_partkey % 5 * 0.8 <= 2 AND p_partkey % 7 * 0.5 <= 2 AND p_partkey % 6 < 4 THEN 'geometry' END) END AS converged FROM part
"""


def m17_edit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as edits of a text, some at one place."""
    at = F.col("l_partkey") % 9
    edits = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", at.alias("start"), (at + F.when(F.col("l_suppkey") % 2 == 0, 3).otherwise(0)).alias("stop"))
    return elements.edit_plan(edits, ["l_orderkey"], "start", "stop", "l_linenumber").select("l_orderkey", "l_linenumber", "step")


M17 = """
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 9 DESC, l_suppkey % 2, l_linenumber DESC) AS step FROM lineitem
"""


def f6_compared_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as texts on a page, with titles, footers and counters."""
    t = F.col("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", t, F.when(t == 1, "title").when((F.col("conv_id") + t) % 5 == 0, "footer").otherwise("body").alias("kind"), F.when((F.col("conv_id") + t) % 7 == 0, " 3 / 9 ").otherwise(F.col("text")).alias("text"), (t * 37 % 40).cast("double").alias("x"), (t * 13 % 30 + 0.5).alias("y"))
    return elements.compared_texts(turns, ["conv_id"], ["footer"], role="kind", key="turn").select("conv_id", "turn", "kind", "order")


F6 = r"""
WITH t AS (SELECT conv_id, turn, CASE WHEN turn = 1 THEN 'title' WHEN (conv_id + turn) % 5 = 0 THEN 'footer' ELSE 'body' END AS kind, CASE WHEN (conv_id + turn) % 7 = 0 THEN ' 3 / 9 ' ELSE text END AS text, turn * 37 % 40 AS x, turn * 13 % 30 + 0.5 AS y FROM conversations)
SELECT conv_id, turn, kind, row_number() OVER (PARTITION BY conv_id ORDER BY kind <> 'title', round(y / 4), x, turn) - 1 AS "order" FROM t
WHERE kind <> 'footer' AND trim(text, ' ') <> '' AND (kind = 'title' OR NOT regexp_full_match(text, '\s*\d+\s*(/\s*\d+)?\s*'))
"""


def n1_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as JSON trees with ids, anchors, links to pages and numbers of many places."""
    k = F.col("p_partkey")
    width = (k * 7 % 900 * 10 + 3) / 1000.0
    text = F.format_string('{"w": %s, "id": "x%d", "anchor": "old", "parts": [{"px": 3, "name": "p12t%d", "to": "#page=%d"}, null, true, %d]}', width.cast("string"), k, k, k % 4, k)
    slides = F.create_map(*(x for n in range(3) for x in (F.lit(n), F.lit(f"s{n}"))))
    rows = table(spark, sf_dir, "part").select(k, text.alias("tree"), F.concat(F.lit("key"), k.cast("string")).alias("anchor"), slides.alias("pages"))
    return trees.canonical_json(rows, "p_partkey", "tree", "anchor", "pages")


N1J = """
SELECT p_partkey, '{"anchor":"key' || p_partkey || '","parts":[{"name":"t' || p_partkey || '","to":"#slide=' || CASE WHEN p_partkey % 4 < 3 THEN 's' || p_partkey % 4 ELSE 'None' END || '"},null,true,' || p_partkey || '],"w":' || round((p_partkey * 7 % 900 * 10 + 3) / 1000.0::DOUBLE, 2)::VARCHAR || '}' AS canonical FROM part
"""


def n6_same_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requests and the same with noise in one number, of several kinds and sizes."""
    k = F.col("p_partkey")
    tree = lambda mag, tx, sx, at: F.format_string('{"size": {"magnitude": %d, "unit": "EMU"}, "m": {"translateX": %d, "scaleX": %s}, "index": %d}', mag, tx, sx.cast("string"), at)
    one = lambda n, step: F.when(k % 4 == n, step).otherwise(0)
    b = tree(k * 100 + one(0, k % 3 * 6350), k + one(1, k % 3 * 6350), F.lit(2.0) + F.when(k % 4 == 2, (k % 3) * 0.0015).otherwise(0.0), k + one(3, k % 3))
    return trees.same_trees(table(spark, sf_dir, "part").select(k, tree(k * 100, k, F.lit(2.0), k).alias("a"), b.alias("b")), "p_partkey", "a", "b")


N6 = "SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN p_partkey % 3 = 0 ELSE p_partkey % 3 < 2 END AS same FROM part"

def n6_renamed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as requests whose ids stand in values and keys, with and without suffixes, some ids being the beginning of others."""
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    old = F.concat(F.lit("b2s_"), c)
    text = F.concat(F.lit('{"objectId": "'), old, F.lit('", "'), old, F.lit('_g": ["'), old, t, F.lit('", "'), old, F.lit('_n'), t, F.lit('"], "role": "'), F.col("role"), F.lit('", "n": '), t, F.lit("}"))
    mapping = F.create_map(old, F.concat(F.lit("new"), t), F.concat(old, F.lit("_g")), F.lit("group"))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("k"), text.alias("tree"), mapping.alias("ids"))
    return trees.renamed_ids(rows, "k", "tree", "ids")


N6R = """
SELECT conv_id * 1000000 + turn AS k, '{"objectId": "new' || turn || '", "group": ["b2s_' || conv_id || turn || '", "new' || turn || '_n' || turn || '"], "role": "' || role || '", "n": ' || turn || '}' AS renamed FROM conversations
"""

def k7_diagram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as boxes, some with one in them, and lines from each towards the next, which end in, at or off them."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("k"))
    h = (F.col("page") * 5 + F.col("k") * 3) % 22
    x, y = 150.0 * (F.col("k") % 2), 50.0 * F.col("k")
    nodes = t.select("page", F.col("k").alias("node"), x.alias("x0"), y.alias("y0"), (x + 120.0).alias("x1"), (y + 40.0).alias("y1"))
    nodes = nodes.unionByName(t.where(h % 4 == 0).select("page", (F.col("k") + 1000).alias("node"), (x + 40.0).alias("x0"), (y + 20.0).alias("y0"), (x + 80.0).alias("x1"), (y + 40.0).alias("y1")))
    down = 150.0 * ((F.col("k") + 1) % 2) + 60.0
    lines = t.select("page", F.col("k").alias("line"), F.when(h == 7, x + 135.0).otherwise(x + 60.0).alias("fx"), F.when(h == 7, y + 20.0).otherwise(y + 38.0 + h % 8 * 2).alias("fy"), F.when(h == 9, x + 10.0).otherwise(down).alias("tx"), F.when(h == 9, y + 10.0).otherwise(y + 50.0 - h % 5 * 3).alias("ty"))
    beside = t.where(h == 7).select("page", (F.col("k") + 2000).alias("node"), (x + 150.0).alias("x0"), y.alias("y0"), (x + 151.0).alias("x1"), (y + 40.0).alias("y1"))
    return diagrams.edges(lines, nodes.unionByName(beside), ["page"], "line", "node", 15.0, 60.0)


K7 = """
WITH t AS (SELECT conv_id AS page, turn AS k, (conv_id * 5 + turn * 3) % 22 AS h, 150.0::DOUBLE * (turn % 2) AS x, 50.0::DOUBLE * turn AS y FROM conversations),
n AS (SELECT page, k AS node, x AS x0, y AS y0, x + 120 AS x1, y + 40 AS y1 FROM t UNION ALL SELECT page, k + 1000, x + 40, y + 20, x + 80, y + 40 FROM t WHERE h % 4 = 0 UNION ALL SELECT page, k + 2000, x + 150, y, x + 151, y + 40 FROM t WHERE h = 7),
e AS (SELECT page, k AS line, 0 AS e, CASE WHEN h = 7 THEN x + 135 ELSE x + 60 END AS px, CASE WHEN h = 7 THEN y + 20 ELSE y + 38 + h % 8 * 2 END AS py FROM t
  UNION ALL SELECT page, k, 1, CASE WHEN h = 9 THEN x + 10 ELSE 150.0 * ((k + 1) % 2) + 60 END, CASE WHEN h = 9 THEN y + 10 ELSE y + 50 - h % 5 * 3 END FROM t),
g AS (SELECT e.*, node, (x1 - x0) * (y1 - y0) AS area, round(sqrt(greatest(x0 - px, px - x1, 0) ** 2 + greatest(y0 - py, py - y1, 0) ** 2), 6) AS gap FROM e JOIN n ON n.page = e.page),
r AS (SELECT *, row_number() OVER (PARTITION BY page, line, e ORDER BY gap, CASE WHEN gap = 0 THEN area ELSE 0 END, node) AS i, count(*) OVER (PARTITION BY page, line, e, gap) AS m FROM g WHERE gap <= 15),
b AS (SELECT page, line, max(CASE WHEN e = 0 THEN node END) AS src, max(CASE WHEN e = 1 THEN node END) AS dst, bool_or(gap > 0 AND m > 1) AS tied FROM r WHERE i = 1 GROUP BY page, line)
SELECT t.page, k AS line, src, dst, CASE WHEN src IS NULL AND dst IS NULL THEN 'open' WHEN src IS NULL OR dst IS NULL THEN 'dangling' WHEN tied THEN 'tied' WHEN src = dst THEN 'loop' ELSE 'edge' END AS verdict FROM t LEFT JOIN b ON b.page = t.page AND line = k
"""


def coloured_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as pixels of a page: two places, three colours that follow them more or less, some far off."""
    e = lambda k: F.col("embedding")[k].cast("double")
    off = F.when(F.col("vec_id") % (F.col("label") + 3) == 0, 60.0 * e(5)).otherwise(0.0)
    colours = [(40.0 * e(0) - 25.0 * e(1) + 8.0 * k + off + 4.0 * e(2 + k)).alias(f"c{k}") for k in range(3)]
    return table(spark, sf_dir, "embeddings").select("label", F.lit(1.0).alias("one"), e(0).alias("px"), e(1).alias("py"), *colours)


def a27_trimmed_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's colours as a plane over its pixels, fitted anew without the worst tenth where the plain fit explains too few."""
    return diagrams.trimmed_fit(coloured_pixels(spark, sf_dir), "label", ["one", "px", "py"], ["c0", "c1", "c2"], 1.5)


def thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as thumbnails, mostly white; every third is one of the vector before it with a little noise."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    drawn = F.transform("embedding", lambda e: F.least(F.greatest(F.floor((e.cast("double") - 0.1) * 1500), F.lit(0)), F.lit(255)).cast("long"))
    n = F.col("vec_id") % 3
    own = v.select((F.col("vec_id") - n).alias("first"), "vec_id", drawn.alias("d"), n.alias("n"))
    base = own.where("n = 0").select("first", F.col("d").alias("base"))
    both = own.join(base, "first", "left")
    noisy = F.transform("base", lambda x, i: F.greatest(F.least(x + F.when((i + F.col("vec_id")) % 9 == 0, 12).otherwise(0), F.lit(255)), F.lit(0)))
    ink = F.when((F.col("n") == 1) & F.col("base").isNotNull(), noisy).when((F.col("vec_id") % 30 == 2), F.transform("d", lambda x, i: F.when(i == F.col("vec_id") % 60, 40).otherwise(0))).otherwise(F.col("d"))
    return both.select("vec_id", F.when(F.col("vec_id") % 7 == 0, 104).otherwise(100).cast("long").alias("width"), F.lit(100).cast("long").alias("height"), F.transform(ink, lambda x: (255 - x).cast("long")).alias("levels"))


def c28_same_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures.linked_pictures(thumbnails(spark, sf_dir), "vec_id")


C28 = """
WITH v AS (SELECT vec_id, vec_id % 3 AS n, list_transform(embedding, lambda e: least(greatest(floor((e::DOUBLE - 0.1) * 1500), 0), 255)::BIGINT) AS d FROM embeddings),
b AS (SELECT v.vec_id, v.n, v.d, o.d AS base FROM v LEFT JOIN v o ON o.vec_id = v.vec_id - v.n AND o.n = 0),
i AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 104 ELSE 100 END AS w, CASE WHEN n = 1 AND base IS NOT NULL THEN list_transform(base, lambda x, i: least(x + CASE WHEN (i - 1 + vec_id) % 9 = 0 THEN 12 ELSE 0 END, 255)) WHEN vec_id % 30 = 2 THEN list_transform(d, lambda x, i: CASE WHEN i - 1 = vec_id % 60 THEN 40 ELSE 0 END) ELSE d END AS k FROM b),
s AS (SELECT *, list_sum(k) AS s FROM i),
c AS (SELECT min(vec_id) AS id, w, k, s FROM s GROUP BY w, k, s),
m AS (SELECT a.id AS a, count(*) AS n FROM c a JOIN c b ON a.id <> b.id AND abs(a.w - b.w) / 100.0 <= 0.05 * greatest(a.w, b.w) / 100.0 AND list_sum(list_transform(list_zip(a.k, b.k), lambda z: abs(z[1] - z[2]))) < 0.3 * greatest(a.s, b.s, 510) GROUP BY a.id)
SELECT s.vec_id, c.id AS class_id, coalesce(n, 0) AS n_links FROM s JOIN c ON c.w = s.w AND c.k = s.k LEFT JOIN m ON m.a = c.id
"""

QUERIES = {f.__name__: f for f in (f2_visible_drawings, g4_curve_boxes, a26_page_ground, g11_ink_overlap, q2_text_mask, g12_labels, g12_contours, q1_lost_ink, c12_plain_text, c18_scripts, f13_editable_blocks, m4_converged, m17_edit_plan, f6_compared_texts, n1_canonical_json, n6_same_trees, n6_renamed_ids, k7_diagram_edges, a27_trimmed_fit, c28_same_pictures)}
ORACLES = {"f2_visible_drawings": F2, "g4_curve_boxes": G4, "a26_page_ground": A26, "g11_ink_overlap": G11, "q2_text_mask": Q2M, "g12_labels": G12, "g12_contours": G12C, "q1_lost_ink": Q1L, "c12_plain_text": C12, "c18_scripts": C18, "f13_editable_blocks": F13, "m4_converged": M4C, "m17_edit_plan": M17, "f6_compared_texts": F6, "n1_canonical_json": N1J, "n6_same_trees": N6, "n6_renamed_ids": N6R, "k7_diagram_edges": K7, "c28_same_pictures": C28}
