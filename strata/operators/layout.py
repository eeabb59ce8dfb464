"""Page layout from positioned characters: spans, lines, body size, furniture, regular rows, reading order, visibility.

Measures are in points.  Thresholds are in ems of the character's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.text import half_point
from strata.operators import segment

SPACE_GAP, WORD_GAP, BASELINE_SHIFT, LINE_GAP = 0.15, 0.3, 0.8, 1.0


def spans(chars: DataFrame, by: list[str], pos: str = "pos", style: tuple[str, ...] = ("font", "size", "color")) -> DataFrame:
    """Runs of characters (c, x0, x1, y, size and style) in painting order.

    A run ends where the style changes, the next character starts a word gap further on, steps back, or leaves the baseline.
    A gap short of that but wider than a space's gets a space between the two characters.
    """
    w = Window.partitionBy(*by).orderBy(pos)
    gap = (F.col("x0") - F.lag("x1").over(w)) / F.col("size")
    shift = F.abs(F.col("y") - F.lag("y").over(w)) / F.col("size")
    other = F.lag(pos).over(w).isNull()
    for c in style:
        other = other | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    cut = segment.islands(chars.withColumn("gap", gap).withColumn("shift", shift), by, [pos], other | (F.col("gap") >= WORD_GAP) | (F.col("gap") < -0.5) | (F.col("shift") >= BASELINE_SHIFT), "span")
    first = F.row_number().over(Window.partitionBy(*by, "span").orderBy(pos)) == 1
    cut = cut.withColumn("piece", F.when(~first & (F.col("gap") >= SPACE_GAP), F.concat(F.lit(" "), F.col("c"))).otherwise(F.col("c")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "piece"))), lambda x: x.piece), "")
    return cut.groupBy(*by, "span", *style).agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.first("y").alias("y"), F.min(pos).alias("first"), F.max(pos).alias("last"))


def lines(found: DataFrame, by: list[str]) -> DataFrame:
    """Spans of a page on one baseline (within the half-point grid), left to right: ``line`` numbered downwards and the text joined by spaces."""
    rows = found.withColumn("baseline", half_point(F.col("y")))
    joined = rows.groupBy(*by, "baseline").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "first", "text"))), lambda s: s.text), " ").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n_spans"))
    return joined.withColumn("line", F.row_number().over(Window.partitionBy(*by).orderBy("baseline")).cast("long"))


def body_size(found: DataFrame, by: list[str]) -> DataFrame:
    """The size, to a tenth, that most non-blank characters of a document are set in; the smaller of two that tie."""
    from strata.operators.stats import weighted_mode

    return weighted_mode(found, by, F.round("size", 1), F.length(F.regexp_replace("text", r"\s", ""))).select(*by, F.col("mode").alias("body_size"), F.col("weight").alias("n_chars"))


def furniture(found: DataFrame, doc: str, label: str, text: str, em: Column, least: int = 3, share: float = 0.5) -> DataFrame:
    """Texts repeated on at least ``share`` of a document's labelled frames (and ``least``), within half an em of their median place."""
    middle = found.groupBy(doc, text).agg(F.median("x0").alias("middle"))
    near = found.join(middle, [doc, text]).where(F.abs(F.col("x0") - F.col("middle")) <= em / 2)
    counts = near.groupBy(doc, text).agg(F.count_distinct(label).alias("n_frames"))
    total = found.groupBy(doc).agg(F.count_distinct(label).alias("frames"))
    return counts.join(total, doc).where((F.col("frames") >= least) & (F.col("n_frames") >= F.greatest(F.lit(float(least)), F.col("frames") * share)))


def regular_rows(rows: DataFrame, by: list[str], y: str, cells: str, size: float, most: float = 2.0, spread: float = 1.25, least: int = 3) -> DataFrame:
    """Stretches of rows with one number of cells (two or more) at a pitch of at most ``most`` ems that varies by no more than ``spread``."""
    w = Window.partitionBy(*by).orderBy(y)
    pitch = F.col(y) - F.lag(y).over(w)
    cut = segment.islands(rows.where(F.col(cells) >= 2).withColumn("pitch", pitch), by, [y], F.col("pitch").isNull() | (F.col("pitch") > most * size) | (F.col(cells) != F.lag(cells).over(w)), "stretch")
    inner = F.when(F.row_number().over(Window.partitionBy(*by, "stretch").orderBy(y)) > 1, F.col("pitch"))
    cut = cut.withColumn("inner", inner)
    return cut.groupBy(*by, "stretch", cells).agg(F.count("*").alias("n_rows"), F.min(y).alias("top"), F.max(y).alias("bottom"), F.min("inner").alias("low"), F.max("inner").alias("high")).where((F.col("n_rows") >= least) & (F.col("high") <= spread * F.col("low")))


def list_levels(items: DataFrame, by: list[str], x: str, apart: float = 2.0) -> DataFrame:
    """Levels of list items by clusters of their bullets' places: a new one starts more than ``apart`` right of the last place."""
    places = items.select(*by, x).distinct()
    w = Window.partitionBy(*by).orderBy(x)
    ranked = segment.islands(places, by, [x], F.lag(x).over(w).isNull() | (F.col(x) - F.lag(x).over(w) > apart), "level")
    return items.join(ranked, [*by, x])


def reading_order(elements: DataFrame, by: list[str]) -> DataFrame:
    """The title first, then bands of four points downwards, then left to right, then as painted."""
    w = Window.partitionBy(*by).orderBy((F.col("role") != "title").cast("int"), F.bround(F.col("y0") / 4), "x0", "pos")
    return elements.withColumn("order", F.row_number().over(w).cast("long"))


def visible(chars: DataFrame, covers: DataFrame, by: list[str], cell: float = 24.0) -> DataFrame:
    """Characters that a reader sees: not transparent, and not under later opaque rectangles at five of nine sample points.

    Sample points meet covers by cells of a grid, so no page is joined with itself.
    """
    at = [F.struct((F.col("x0") + (F.col("x1") - F.col("x0")) * i / 2).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * j / 2).alias("y")) for i in range(3) for j in range(3)]
    inner = lambda v, lo, hi: F.least(F.greatest(v, lo), hi)
    points = chars.where("alpha > 0").select(*by, "obj", "pos", F.posexplode(F.array(*at)).alias("k", "p")).select(*by, "obj", "pos", "k", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    points = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    boxes = covers.select(*by, F.col("obj").alias("cover"), F.col("x0").alias("a0"), F.col("y0").alias("b0"), F.col("x1").alias("a1"), F.col("y1").alias("b1")).withColumn("cx", span(F.col("a0"), F.col("a1"))).withColumn("cy", span(F.col("b0"), F.col("b1")))
    hit = points.join(boxes, [*by, "cx", "cy"]).where("cover > obj and x > a0 and x < a1 and y > b0 and y < b1").select(*by, "pos", "k").distinct()
    hidden = hit.groupBy(*by, "pos").agg(F.count("*").alias("covered")).where("covered >= 5").select(*by, "pos")
    return chars.where("alpha > 0").join(hidden, [*by, "pos"], "left_anti")


PARAGRAPH = "text string, top double, bottom double, x0 double, n_lines long"


def paragraphs(found: DataFrame, by: str, em: float, pitch: float = 1.6, indent: float = 1.0) -> DataFrame:
    """Lines of a page folded into paragraphs: a line joins the last paragraph that it follows at its pitch and left edge.

    The fold is order-dependent, so it runs over one page at a time.
    """

    def run(pdf):
        import pandas as pd

        out: list[dict] = []
        for r in pdf.sort_values(["baseline", "x0"]).itertuples():
            for p in reversed(out):
                step = r.baseline - p["bottom"]
                if 0 < step <= pitch * em and abs(r.x0 - p["x0"]) <= indent * em and (p["step"] is None or abs(step - p["step"]) <= 0.25 * em):
                    hyphen = p["text"].endswith("-") and r.text[:1].islower()
                    p["text"] = p["text"][:-1] + r.text if hyphen else f"{p['text']} {r.text}"
                    p["bottom"], p["step"], p["n_lines"] = r.baseline, step, p["n_lines"] + 1
                    break
            else:
                out.append({by: getattr(r, by), "text": r.text, "top": r.baseline, "bottom": r.baseline, "x0": r.x0, "n_lines": 1, "step": None})
        return pd.DataFrame(out, columns=[by, "text", "top", "bottom", "x0", "n_lines", "step"]).drop(columns="step")

    return found.select(by, "baseline", "x0", "text").groupBy(by).applyInPandas(run, f"{by} {dict(found.dtypes)[by]}, {PARAGRAPH}")
