"""Pairing the elements of a page with a foreign version's objects, and saying of every element left over why it has none.

Both sides are tables of elements: the page's columns, a key (long), ``kind``, a box ``x0, y0, x1, y1`` and ``text`` (null counts as
empty).  Candidates come from a grid, so only what could score is scored; what two texts can share at most, by their lengths, drops
pairs before any text is compared.  All choices are aggregations and joins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import geometry, sequences
from strata.plans.lineage import durable

# The least score of a pair, how far behind a rival must be, the share of words in a score, how far centres may be
# apart to count at all, and how kinds that differ count.
SURE, MARGIN, WORDS, REACH = 0.45, 0.08, 0.55, 60.0
DRAWN, SWAPPED, OTHER = ("image", "diagram"), 0.7, 0.5
# How far the sides of one drawing seen twice may differ (flat, and of the longer side), how far the same words may
# stand out of a box, and how much of an element a box must cover to hold it.
SLACK, SHARE, INSIDE, HOLDS = 8.0, 0.25, 2.0, 0.85

BOX = ("x0", "y0", "x1", "y1")


def _side(df: DataFrame, by: list[str], key: str, p: str, *more: Column) -> DataFrame:
    text = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""), " ")
    return df.select(*by, F.col(key).alias(p), F.struct(F.col("kind"), text.alias("text"), *(F.col(c).cast("double").alias(c) for c in BOX)).alias(f"{p}_el"), *more)


def near(a: DataFrame, b: DataFrame, by: list[str], cell: float = 2 * REACH) -> DataFrame:
    """Pairs of elements of one page whose boxes meet or whose centres are less than REACH apart, each once."""
    low = lambda e, c: F.floor((e[c] - REACH / 2) / cell)
    high = lambda e, c: F.floor((e[c] + REACH / 2) / cell)

    def dealt(df: DataFrame, p: str) -> DataFrame:
        e = F.col(f"{p}_el")
        df = df.withColumn("cx", F.explode(F.sequence(low(e, "x0"), high(e, "x1"))))
        return df.withColumn("cy", F.explode(F.sequence(low(e, "y0"), high(e, "y1"))))

    x, y = F.col("a_el"), F.col("b_el")
    home = (F.greatest(low(x, "x0"), low(y, "x0")) == F.col("cx")) & (F.greatest(low(x, "y0"), low(y, "y0")) == F.col("cy"))
    met = dealt(a, "a").join(dealt(b, "b"), [*by, "cx", "cy"]).where(home)
    return met.where(geometry.likeness(x, y, REACH) > 0).drop("cx", "cy")


def kind_fit(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).when(a.isin(*DRAWN) | b.isin(*DRAWN), SWAPPED).otherwise(OTHER)


def _text_ratio(a: Column, b: Column, need: Column) -> Column:
    def run(x: pd.Series, y: pd.Series, need: pd.Series) -> pd.Series:
        return pd.Series([sequences.ratio_from(*row) for row in zip(x, y, need, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b, need)


def scored(a: DataFrame, b: DataFrame, by: list[str], least: float) -> DataFrame:
    """Near pairs with their ``score``: kinds, times words and place weighed (place alone where neither has words).

    A score under ``least`` is told as 0; most such pairs' words are never compared, by what their lengths, and then a common
    subsequence, allow.
    """
    x, y = F.col("a_el"), F.col("b_el")
    place, silent = geometry.likeness(x, y, REACH), (x.text == "") & (y.text == "")
    together = F.length(x.text) + F.length(y.text)
    at_most = F.when(together > 0, 2 * F.least(F.length(x.text), F.length(y.text)) / together).otherwise(0.0)
    found = near(a, b, by).withColumn("fit", kind_fit(x.kind, y.kind)).withColumn("place", place)
    weigh = lambda words: F.col("fit") * F.when(silent, F.col("place")).otherwise(WORDS * words + (1 - WORDS) * F.col("place"))
    words = F.when(silent | (x.text == y.text), F.lit(1.0)).when((at_most == 0) | (F.round(weigh(at_most), 4) < least), F.lit(0.0))
    need = ((least - 5e-5) / F.col("fit") - (1 - WORDS) * F.col("place")) / WORDS - 1e-9
    found = found.withColumn("words", words).withColumn("need", need)
    told = found.where("words is not null").unionByName(found.where("words is null").withColumn("words", _text_ratio(x.text, y.text, F.col("need"))))
    score = F.round(weigh(F.col("words")), 4)
    return told.withColumn("score", F.when(score >= least, score).otherwise(0.0)).drop("fit", "place", "words", "need")


def _two_best(pairs: DataFrame, by: list[str], side: str, other: str) -> DataFrame:
    """For each element of ``side`` its best partner, that score and the next (0 where there is none)."""
    n = F.row_number().over(Window.partitionBy(*by, side).orderBy(F.desc("score"), other))
    top = pairs.select(*by, side, other, "score").withColumn("n", n).where("n <= 2")
    pick = lambda k, c: F.max(F.when(F.col("n") == k, F.col(c)))
    return top.groupBy(*by, side).agg(pick(1, other).alias(f"{side}_best"), pick(1, "score").alias(f"{side}_score"), F.coalesce(pick(2, "score"), F.lit(0.0)).alias(f"{side}_next"))


def mutual(pairs: DataFrame, by: list[str]) -> DataFrame:
    """``by, a, b, score, verdict`` of every element of the first side that has a sure candidate: ``paired``, ``not_best`` or ``ambiguous``.

    ``pairs`` must hold all that score within MARGIN of SURE.
    """
    mine, theirs = _two_best(pairs, by, "a", "b"), _two_best(pairs, by, "b", "a")
    best = mine.where(F.col("a_score") >= SURE).withColumnRenamed("a_best", "b").join(theirs, [*by, "b"])
    rival = F.when(F.col("b_best") == F.col("a"), F.col("b_next")).otherwise(F.col("b_score"))
    score = F.col("a_score")
    close = (F.round(score - F.col("a_next"), 4) < MARGIN) | (F.round(score - rival, 4) < MARGIN)
    return best.select(*by, "a", "b", score.alias("score"), F.when(rival > score, "not_best").when(close, "ambiguous").otherwise("paired").alias("verdict"))


def one_drawing(x: Column, y: Column) -> Column:
    """Whether two elements are one drawing seen twice: the same words inside the second's box, or sides of about the same length."""
    inside = (x.x0 >= y.x0 - INSIDE) & (x.y0 >= y.y0 - INSIDE) & (x.x1 <= y.x1 + INSIDE) & (x.y1 <= y.y1 + INSIDE)
    alike = lambda side: F.abs(side(x) - side(y)) <= SLACK + SHARE * F.greatest(side(x), side(y))
    return ((x.text != "") & (x.text == y.text) & inside) | (alike(geometry.width) & alike(geometry.height))


def holds(outer: Column, inner: Column) -> Column:
    """Whether a box covers enough of another."""
    return (geometry.area(inner) > 0) & (geometry.overlap(inner, outer) / geometry.area(inner) >= HOLDS)


def explain(a: DataFrame, b: DataFrame, by: list[str], key_a: str, key_b: str, inherited: str = "inherited") -> DataFrame:
    """Every element of ``a`` with the object of ``b`` it was drawn from, or the reason why none: ``by, a, b, score, verdict, owner``.

    Rows of ``b`` marked ``inherited`` are drawn by the page's layout and never paired.  What the mutual pairing leaves is explained by
    what is near it, the first that holds: the layout draws it (``layout``); it stands in a table (``table``); it stands in an object
    that another element is tied to (``drawn_from``, the first such element in ``owner``).  The rest are ``not_best``, ``ambiguous`` or
    ``no_candidate``.  Keys are unique within a page.  Near pairs are made once, as a narrow table that all of this is read from.
    """
    named, x, y = [*by, "a"], F.col("a_el"), F.col("b_el")
    left, right = _side(a, by, key_a, "a"), _side(b, by, key_b, "b", F.coalesce(F.col(inherited), F.lit(False)).alias("inherited"))
    holding = F.when(~F.col("inherited"), holds(y, x)).otherwise(False)
    met = scored(left, right, by, SURE - MARGIN).select(*named, "b", "inherited", "score", holding.alias("held"), (F.col("inherited") & one_drawing(x, y)).alias("drawing"), (y.kind == "table").alias("is_table"))
    met = durable(met.where("score > 0 or held"))
    first = durable(mutual(met.where("not inherited and score > 0"), by))
    paired = first.where("verdict = 'paired'")
    around = met.groupBy(*named).agg(F.bool_or(F.col("drawing") & (F.col("score") >= SURE)).alias("layout"), F.bool_or(F.col("held") & F.col("is_table")).alias("in_table"))
    owners = met.where("held").join(paired.select(*by, "b", F.col("a").alias("mate")), [*by, "b"]).groupBy(*named).agg(F.min("mate").alias("owner"))
    rows = left.select(*named).join(first, named, "left").join(around, named, "left").join(owners, named, "left")
    is_paired = F.coalesce(F.col("verdict") == "paired", F.lit(False))
    why = F.when(is_paired, "paired").when(F.col("layout"), "layout").when(F.col("in_table"), "table").when(F.col("owner").isNotNull(), "drawn_from").otherwise(F.coalesce("verdict", F.lit("no_candidate")))
    told = rows.withColumn("b", F.when(is_paired, F.col("b"))).withColumn("verdict", why)
    return told.select(*named, "b", "score", "verdict", F.when(F.col("verdict") == "drawn_from", F.col("owner")).alias("owner"))
