"""Versions of one thing against each other: foreign pairing, doubtful alignments, merged orders, stacking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import alignment, audit, locate, marks, merge, ordering, pairing, resolve
from strata.sources.tables import table


def foreign_page(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns as elements of a page and as the objects of a foreign version: some gone, shifted, reworded, doubled, drawn by a layout or inside a table."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("k"), "role", "text")
    h = (F.col("page") * 31 + F.col("k") * 17) % 20
    x, y = F.when(F.col("role") == "user", 20.0).otherwise(60.0), 80.0 * F.col("k")
    box = lambda dx, dy: (x + dx, y + dy, x + dx + 500.0, y + dy + 60.0)
    named = lambda b: [c.alias(n) for c, n in zip(b, pairing.BOX, strict=True)]
    # an element split off another's, as a converter splits off a bullet's picture
    ours = turns.select("page", (F.col("k") * 10).alias("a"), F.when(h == 3, "diagram").otherwise("text").alias("kind"), *named(box(0.0, 0.0)), "text")
    icons = turns.where((F.col("page") + F.col("k")) % 4 == 0).select("page", (F.col("k") * 10 + 1).alias("a"), F.lit("image").alias("kind"), (x + 5.0).alias("x0"), (y + 5.0).alias("y0"), (x + 25.0).alias("x1"), (y + 25.0).alias("y1"), F.lit("").alias("text"))
    shift = F.when(h == 4, 25.0).when(h == 5, 300.0).otherwise(F.col("k") % 3 * 1.0)
    words = F.when(h == 6, F.concat("text", F.lit(" and more"))).when(h == 7, F.reverse("text")).otherwise(F.col("text"))
    kind = F.when(h == 7, "table").otherwise("text")
    theirs = turns.where(h != 2).select("page", (F.col("k") * 10).alias("b"), kind.alias("kind"), *named(box(shift, shift)), words.alias("text"), (h == 8).alias("inherited"))
    twice = turns.where(h == 9).select("page", (F.col("k") * 10 + 1).alias("b"), F.lit("text").alias("kind"), *named(box(2.0, 2.0)), "text", F.lit(False).alias("inherited"))
    return ours.unionByName(icons), theirs.unionByName(twice)


def j29_foreign_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element with the foreign object it was drawn from, or the reason why none."""
    return pairing.explain(*foreign_page(spark, sf_dir), ["page"], "a", "b")


def twin_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns and a version with some gone, reworded or said twice, labels on some and titles on every third."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    h = (F.col("conv_id") * 7 + F.col("turn") * 5) % 12
    title = F.when(F.col("turn") % 3 == 0, F.concat("role", F.lit(" "), (F.col("turn") % 2).cast("string"))).otherwise("")
    label = F.when(h < 2, F.concat(F.lit("l"), F.col("turn").cast("string"))).otherwise("")
    base = turns.select("conv_id", (F.col("turn") * 2).alias("pos"), title.alias("title"), label.alias("label"), "text", (h == 7).alias("removed"))
    echo = turns.where(h == 5).select("conv_id", (F.col("turn") * 2 + 1).alias("pos"), F.lit("").alias("title"), F.lit("").alias("label"), "text", F.lit(False).alias("removed"))
    words = F.when(h == 3, F.concat_ws(" ", F.lit("anew"), "text", F.lit("indeed"))).when(h == 4, F.concat_ws(" ", F.slice(F.split("text", " "), 1, 2), F.lit("the rest is other words than before"))).otherwise(F.col("text"))
    renamed = F.when(h == 1, F.concat(F.lit("new"), F.col("turn").cast("string"))).otherwise(label)
    ours = turns.where(h != 6).select("conv_id", (F.col("turn") * 2).alias("pos"), title.alias("title"), renamed.alias("label"), words.alias("text"), F.lit(False).alias("removed"))
    return base.unionByName(echo), ours


def j26_weak_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-keeping pairs with those marked that another reading of the same worth could replace."""
    return alignment.aligned(alignment.scores(*twin_versions(spark, sf_dir), "conv_id"), "conv_id")


def moved_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders of turns: the source moves, drops and adds some, the live version moves, deletes and adds others."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("k"))
    h = lambda m, s: (F.col("conv_id") * 13 + F.col("k") * 7 + s) % m
    base = turns.select("conv_id", (F.col("k") * 10).alias("key"), (F.col("k") * 10).alias("pos"))
    ours = turns.where(h(9, 0) != 1).select("conv_id", (F.col("k") * 10).alias("key"), F.when(h(11, 1) == 0, F.col("k") * 10 + 35).otherwise(F.col("k") * 10).alias("pos"))
    ours = ours.unionByName(turns.where(h(5, 2) == 0).select("conv_id", (F.col("k") * 10 + 1).alias("key"), (F.col("k") * 10 + 1).alias("pos")))
    moved = F.when(h(8, 3) == 0, F.greatest(F.col("k") * 10 - 27, F.lit(0) + F.col("k") % 7)).otherwise(F.col("k") * 10)
    live = turns.where(h(10, 4) != 2).select("conv_id", (F.col("k") * 10).alias("key"), moved.alias("pos"), (h(2, 5) == 0).alias("kept"))
    own = turns.where(h(6, 6) == 0).select("conv_id", (F.col("k") * 10 + 2).alias("key"), (F.col("k") * 10 + 2).alias("pos"), F.lit(False).alias("kept"))
    return base, ours, live.unionByName(own)


def o8_order_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.merged_order(*moved_versions(spark, sf_dir), "conv_id", "key", "pos")


def k8_stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn is drawn anew: above the one before it and, now and then, the new one before it; below the one two further on, or one far below."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    name = lambda t: (F.col("conv_id") * 1_000_000 + t).alias
    t, fresh = F.col("turn"), F.col("turn") % 3 == 0
    rows = turns.select("conv_id", name(t)("key"), F.when(~fresh, t).alias("pos"), (-t).alias("rank"))
    new = turns.where(fresh)
    edges = new.select(name(t - 1)("below"), name(t)("above")).unionByName(new.select(name(t)("below"), name(t + 2)("above")))
    edges = edges.unionByName(new.where((F.col("conv_id") + t) % 2 == 0).select(name(t - 3)("below"), name(t)("above"))).unionByName(new.where((F.col("conv_id") + t) % 7 == 0).select(name(t)("below"), name(t - 4)("above")))
    return ordering.stacked(rows, edges, "conv_id", "key", "pos", "rank")


K8 = """
WITH RECURSIVE r AS (SELECT conv_id, turn, conv_id * 1000000 + turn AS key, CASE WHEN turn % 3 <> 0 THEN turn END AS pos FROM conversations),
e AS (SELECT conv_id * 1000000 + turn - 1 AS below, conv_id * 1000000 + turn AS above FROM conversations WHERE turn % 3 = 0
  UNION ALL SELECT conv_id * 1000000 + turn, conv_id * 1000000 + turn + 2 FROM conversations WHERE turn % 3 = 0
  UNION ALL SELECT conv_id * 1000000 + turn - 3, conv_id * 1000000 + turn FROM conversations WHERE turn % 3 = 0 AND (conv_id + turn) % 2 = 0
  UNION ALL SELECT conv_id * 1000000 + turn, conv_id * 1000000 + turn - 4 FROM conversations WHERE turn % 3 = 0 AND (conv_id + turn) % 7 = 0),
n AS (SELECT below, above, a.pos AS p, b.pos AS q FROM e JOIN r a ON a.key = below JOIN r b ON b.key = above),
up(node, depth, start) AS (SELECT key, 0, key FROM r WHERE pos IS NULL UNION ALL SELECT above, depth + 1, start FROM up JOIN n ON below = node WHERE p IS NULL AND q IS NULL),
lows AS (SELECT node, max(depth) AS depth, max(n.p) AS low FROM up LEFT JOIN n ON n.above = start AND n.p IS NOT NULL GROUP BY node),
highs AS (SELECT start AS node, min(n.q) AS high FROM up LEFT JOIN n ON n.below = up.node AND n.q IS NOT NULL GROUP BY start),
s AS (SELECT r.*, CASE WHEN pos IS NOT NULL THEN 'stays' WHEN high <= low THEN 'squeezed' ELSE 'placed' END AS told, coalesce(pos, CASE WHEN high <= low THEN high ELSE coalesce(low, -1) END) AS slot,
  CASE WHEN pos IS NOT NULL THEN 0 WHEN high <= low THEN -1 ELSE 1 END AS side, coalesce(depth, 0) AS depth FROM r LEFT JOIN lows ON lows.node = key LEFT JOIN highs ON highs.node = key)
SELECT conv_id, key, row_number() OVER (PARTITION BY conv_id ORDER BY slot, side, depth, -turn, key) AS position, told FROM s
"""

def styled_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns' texts in three versions and their marks: words of each side's edits, bold and colour on stretches that each side keeps, moves or adds to."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("block"), "text")
    h = F.col("block") % 1_000_000 * 7 + F.floor(F.col("block") / 1_000_000)
    word, n = F.split("text", " "), F.size(F.split("text", " "))
    put = lambda at, new: F.array_join(F.transform(word, lambda w, i: F.when(i == at, F.concat(w, F.lit(new))).otherwise(w)), " ")
    cut = lambda at: F.array_join(F.filter(word, lambda w, i: i != at), " ")
    ours = F.when(h % 4 == 1, put(h % n, " of ours")).when(h % 4 == 2, cut(h * 3 % n)).otherwise(F.col("text"))
    theirs = F.when(h % 3 == 1, put(h * 5 % n, " theirs")).when(h % 3 == 2, cut((h * 3 + h % 2) % n)).otherwise(F.col("text"))
    texts = turns.select("block", F.col("text").alias("base"), ours.alias("ours"), theirs.alias("theirs"))
    every = turns.select("block", "text", h.alias("h"), F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 40).cast("int"))).alias("mark"))
    at = F.col("mark") * 40 + (F.col("h") + F.col("mark")) % 11
    g = (F.col("h") + F.col("mark") * 3) % 10

    def of(side: str, keep, prop, value, start=at, length=None) -> DataFrame:
        stop = start + (F.lit(9) + F.col("mark") % 13 if length is None else length)
        row = every.where(keep).select("block", F.lit(side).alias("side"), F.col("mark").cast("long").alias("mark"), prop.alias("prop"), value.alias("value"), start.cast("long").alias("start"), stop.cast("long").alias("stop"))
        return row.where("stop > start")

    bold, colour = F.lit("bold"), F.lit("colour")
    prop = F.when(g % 2 == 0, bold).otherwise(colour)
    one = F.when(g % 2 == 0, F.lit("true")).otherwise(F.lit("#cc0000"))
    found = of("base", g < 7, prop, one)
    found = found.unionByName(of("ours", (g < 7) & (g != 2), prop, F.when(g == 3, F.lit("#0000cc")).otherwise(one)))
    found = found.unionByName(of("theirs", (g < 7) & (g != 4), prop, F.when((g == 3) | (g == 5), F.lit("#00cc00")).otherwise(one))).unionByName(of("theirs", g == 8, bold, F.lit("true"), length=F.lit(5)))
    return texts, found


def m10_block_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marks of the merged texts."""
    return marks.merge_styled(*styled_versions(spark, sf_dir), "block")[1]


def m21_styling_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks that clash, and those whose words the merge no longer has."""
    return marks.merge_styled(*styled_versions(spark, sf_dir), "block")[2]


def written_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns as elements, some reworded, and their conversations as pages; both are made of turns dealt once."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").repartition("conv_id")
    page = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t.text), "\n\n").alias("text"))
    h, word = (F.col("conv_id") * 3 + F.col("turn")) % 5, F.split("text", " ")
    edit = F.when(h == 1, F.array_join(F.transform(word, lambda w, i: F.when(i % 9 == 4, F.concat(w, F.lit(","))).when(i % 9 == 7, F.upper(w)).otherwise(w)), " "))
    edit = edit.when(h == 2, F.array_join(F.filter(word, lambda w, i: i % 8 != 3), " ")).when(h == 3, F.concat(F.lit("Now "), "text", F.lit(" indeed"))).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", edit.alias("text")), page


def j30_located_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each element's words stand on its page, from the first to the last, and how many were found."""
    found = locate.located(*written_pages(spark, sf_dir), "conv_id", "turn")
    return locate.blocks(found, "conv_id", "turn")


def j31_frame_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages whose words vote for the frames that their numbers as lines fall into; some conversations have no votes that count."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "role", F.length("text").alias("n_chars"))
    file = F.concat(F.lit("f"), (F.col("page") % 2).cast("string"))
    frames = turns.select("doc", F.col("page").alias("frame"), file.alias("file"), (F.col("page") * 10).alias("first"), (F.col("page") * 10 + F.when(F.col("page") % 3 == 0, 30).otherwise(7)).alias("last"))
    votes = turns.where("doc % 4 <> 0").select("doc", "page", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"), "n_chars")
    votes = votes.select("doc", "page", F.concat(F.lit("f"), (F.col("k") % 2).cast("string")).alias("file"), (F.col("page") * 10 + F.col("k") * 7 - 9).alias("line"), (F.col("n_chars") % (F.col("k") + 2)).cast("long").alias("n")).where("n > 0")
    return locate.voted_frames(votes, frames, turns.select("doc", "page", F.col("role").alias("label")), "doc")


J31 = """
WITH t AS (SELECT conv_id AS doc, turn AS page, role, length(text) AS c FROM conversations),
f AS (SELECT doc, page AS frame, 'f' || page % 2 AS file, page * 10 AS lo, page * 10 + CASE WHEN page % 3 = 0 THEN 30 ELSE 7 END AS hi FROM t),
v AS (SELECT doc, page, 'f' || k % 2 AS file, page * 10 + k * 7 - 9 AS line, c % (k + 2) AS n FROM t, range(0, 6) r(k) WHERE doc % 4 <> 0),
m AS (SELECT v.doc, v.page, v.file, line, n, max(frame) AS frame FROM v JOIN f ON f.doc = v.doc AND f.file = v.file AND line BETWEEN lo AND hi WHERE n > 0 GROUP BY ALL),
s AS (SELECT doc, page, frame, sum(n) AS votes FROM m GROUP BY ALL),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY votes DESC, frame) = 1),
g AS (SELECT doc, page, sum(new) OVER (PARTITION BY doc ORDER BY page) - 1 AS guess FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY doc ORDER BY page) = role THEN 0 ELSE 1 END AS new FROM t))
SELECT g.doc, g.page, CASE WHEN g.doc IN (SELECT doc FROM b) THEN b.frame WHEN EXISTS (SELECT 1 FROM f WHERE f.doc = g.doc AND f.frame = guess) THEN guess END::BIGINT AS frame, coalesce(b.votes, 0)::BIGINT AS votes FROM g LEFT JOIN b ON b.doc = g.doc AND b.page = g.page
"""

def q6_untold_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and whole turns that a live version had beyond the base and lost in a sync, less those that were told."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), "turn", "text")
    h, word = F.col("doc") * 3 + F.col("turn") * 7, F.split("text", " ")
    n = F.size(word)
    put = lambda at, new: F.transform(word, lambda w, i: F.when(i == at, F.concat(w, new)).otherwise(w))
    live = F.when(h % 3 == 1, put(h * 5 % n, F.concat(F.lit("_"), F.col("turn").cast("string")))).otherwise(word)
    cut = h % 6 == 4
    t = t.select("doc", "turn", h.alias("h"), word.alias("base"), live.alias("before"), F.when(cut, F.filter(live, lambda w, i: i != h * 5 % n)).when(h % 15 == 0, put(F.lit(0), F.lit("!"))).otherwise(live).alias("after"), F.when(cut & (h % 12 == 4), F.element_at(live, (h * 5 % n + 1).cast("int"))).alias("said"))

    def units(version: str) -> DataFrame:
        rows = t.select("doc", F.lit("row").alias("kind"), F.md5(F.array_join(version, " ")).alias("unit"))
        return rows.unionByName(t.select("doc", F.lit("word").alias("kind"), F.explode(version).alias("unit")))

    told = t.where("said is not null").select("doc", F.lit("word").alias("kind"), F.col("said").alias("unit"), F.lit(1).cast("long").alias("n"))
    return audit.untold_losses(units("base"), units("before"), units("after"), told, ["doc"])


Q6 = """
WITH t AS (SELECT conv_id AS doc, turn, conv_id * 3 + turn * 7 AS h, string_split(text, ' ') AS base FROM conversations),
l AS (SELECT *, h * 5 % len(base) + 1 AS spot, CASE WHEN h % 3 = 1 THEN list_transform(base, lambda w, i: CASE WHEN i = h * 5 % len(base) + 1 THEN w || '_' || turn ELSE w END) ELSE base END AS live FROM t),
s AS (SELECT *, CASE WHEN h % 6 = 4 THEN live[1:spot - 1] || live[spot + 1:len(live)] WHEN h % 15 = 0 THEN [base[1] || '!'] || base[2:len(base)] ELSE live END AS post FROM l),
u AS (SELECT doc, 'word' AS kind, unnest(base) AS unit, 1 AS a, 0 AS b, 0 AS c FROM s UNION ALL SELECT doc, 'word', unnest(live), 0, 1, 0 FROM s UNION ALL SELECT doc, 'word', unnest(post), 0, 0, 1 FROM s
  UNION ALL SELECT doc, 'row', md5(array_to_string(base, ' ')), 1, 0, 0 FROM s UNION ALL SELECT doc, 'row', md5(array_to_string(live, ' ')), 0, 1, 0 FROM s UNION ALL SELECT doc, 'row', md5(array_to_string(post, ' ')), 0, 0, 1 FROM s),
g AS (SELECT doc, kind, unit, greatest(sum(b) - sum(a), 0)::BIGINT AS own, greatest(sum(b) - sum(c), 0)::BIGINT AS less FROM u GROUP BY ALL),
m AS (SELECT doc, live[spot] AS unit, count(*) AS n FROM s WHERE h % 12 = 4 GROUP BY ALL),
r AS (SELECT g.doc, kind, g.unit, own, least(own, less) AS gone, least(coalesce(n, 0), least(own, less)) AS told FROM g LEFT JOIN m ON m.doc = g.doc AND m.unit = g.unit AND kind = 'word')
SELECT *, gone - told AS lost FROM r WHERE gone > told
"""

def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as units of pages: some dropped by the source, whose words it joined to the next turn, some of those in a clash."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    h = (F.col("conv_id") * 3 + F.col("turn")) % 6
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("above"))
    return t.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", F.when(h == 1, "delete").when((h == 2) & (F.col("conv_id") % 2 == 0), "conflict").when(h == 4, "take_ours").otherwise("keep").alias("decision"), F.col("text").alias("base"), F.when(h == 2, F.concat_ws("  ", "above", "text")).otherwise(F.col("text")).alias("ours"))


def m5_kept_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.kept_joined(_units(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "decision", "into")


M5 = r"""
WITH t AS (SELECT conv_id, turn, (conv_id * 3 + turn) % 6 AS h, trim(regexp_replace(text, '\s+', ' ', 'g')) AS words FROM conversations),
u AS (SELECT t.conv_id, t.turn, CASE WHEN t.h = 1 THEN 'delete' WHEN t.h = 2 AND t.conv_id % 2 = 0 THEN 'conflict' WHEN t.h = 4 THEN 'take_ours' ELSE 'keep' END AS decision, t.words, CASE WHEN t.h = 2 THEN trim(coalesce(b.words, '') || ' ' || t.words) ELSE t.words END AS ours
  FROM t LEFT JOIN t b ON b.conv_id = t.conv_id AND b.turn = t.turn - 1),
j AS (SELECT a.conv_id, a.turn, min(b.turn) AS kept FROM u a JOIN u b ON b.conv_id = a.conv_id AND a.decision = 'delete' AND b.decision = 'conflict' AND a.words <> '' AND contains(b.ours, a.words) GROUP BY ALL)
SELECT u.conv_id, u.turn, CASE WHEN kept IS NOT NULL THEN 'kept_joined' ELSE decision END AS decision, kept AS "into" FROM u LEFT JOIN j ON j.conv_id = u.conv_id AND j.turn = u.turn
"""


def m6_held_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose label could be another's are left alone: turns' roles as labels, scored by made evidence."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    label = F.col("conv_id")
    scored = t.select(label.alias("label"), (label + F.col("turn") % 3).alias("slide"), ((label * 31 + F.col("turn") * 17) % 10 / 10.0).alias("score")).groupBy("label", "slide").agg(F.max("score").alias("score"))
    moves = resolve.label_moves(scored, "label", "slide", F.col("label") == F.col("slide"), "score", 0.6, 0.2).withColumnRenamed("label", "conv_id")
    return merge.held_pages(_units(spark, sf_dir), moves, "conv_id").groupBy("conv_id", "decision").agg(F.count("*").alias("n"))


M6 = """
WITH s AS (SELECT conv_id AS label, conv_id + turn % 3 AS slide, max((conv_id * 31 + turn * 17) % 10 / 10.0::DOUBLE) AS score FROM conversations GROUP BY ALL),
v AS (SELECT label, max(score) FILTER (label = slide) AS own, max(score) FILTER (label <> slide) AS best FROM s GROUP BY label),
d AS (SELECT label FROM v WHERE best >= 0.6 AND best > coalesce(own, 0) AND NOT best - coalesce(own, 0) >= 0.2),
u AS (SELECT conv_id, CASE WHEN conv_id IN (SELECT label FROM d) THEN 'hold' WHEN (conv_id * 3 + turn) % 6 = 1 THEN 'delete' WHEN (conv_id * 3 + turn) % 6 = 2 AND conv_id % 2 = 0 THEN 'conflict' WHEN (conv_id * 3 + turn) % 6 = 4 THEN 'take_ours' ELSE 'keep' END AS decision FROM conversations)
SELECT conv_id, decision, count(*) AS n FROM u GROUP BY ALL
"""

def paragraph_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as texts, a turn each a paragraph, which one side or both begin anew."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", "\n", " ").alias("text"))
    h = F.col("conv_id") + F.col("turn") * 3
    side = lambda m, word: F.when(h % m == 1, F.concat(F.lit(word), F.col("turn").cast("string"), F.regexp_replace("text", "^[^ ]*", ""))).otherwise(F.col("text"))
    rows = t.select("conv_id", F.struct("turn", F.col("text").alias("b"), side(2, "ours").alias("o"), side(3, "theirs").alias("t")).alias("p")).groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    part = lambda c: F.array_join(F.transform("p", lambda x: x[c]), "\n")
    return rows.select("conv_id", part("b").alias("base"), part("o").alias("ours"), part("t").alias("theirs"))


def m8_settled_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clashing paragraphs, every second of which is settled for ours."""
    texts = paragraph_versions(spark, sf_dir)
    told = merge.text_conflicts(merge.merge_texts(texts, "conv_id", "base", "ours", "theirs"), "conv_id")
    taken = told.where("paragraph % 2 = 0").select("conflict_id")
    settled, _ = merge.settled_texts(texts, "conv_id", "base", "ours", "theirs", taken)
    return settled.select("conv_id", F.md5("merged").alias("merged"), F.col("conflicts").cast("long").alias("conflicts"))


M8 = r"""
WITH t AS (SELECT conv_id, turn, replace(text, chr(10), ' ') AS b, conv_id + turn * 3 AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
v AS (SELECT *, CASE WHEN h % 2 = 1 THEN 'ours' || turn || regexp_replace(b, '^[^ ]*', '') ELSE b END AS o, CASE WHEN h % 3 = 1 THEN 'theirs' || turn || regexp_replace(b, '^[^ ]*', '') ELSE b END AS t FROM t),
m AS (SELECT *, h % 2 = 1 AND h % 3 = 1 AND n > 1 AS clash FROM v)
SELECT conv_id, md5(string_agg(CASE WHEN clash AND k % 2 = 0 THEN o WHEN h % 3 = 1 THEN t ELSE o END, chr(10) ORDER BY turn)) AS merged, count(*) FILTER (clash AND k % 2 = 1) AS conflicts FROM m GROUP BY conv_id
"""

QUERIES = {f.__name__: f for f in (j29_foreign_pairs, j26_weak_alignment, o8_order_merge, k8_stacking, m10_block_marks, m21_styling_told, j30_located_words, j31_frame_votes, q6_untold_losses, m5_kept_joined, m6_held_pages, m8_settled_paragraphs)}
ORACLES = {"k8_stacking": K8, "j31_frame_votes": J31, "q6_untold_losses": Q6, "m5_kept_joined": M5, "m6_held_pages": M6, "m8_settled_paragraphs": M8}
