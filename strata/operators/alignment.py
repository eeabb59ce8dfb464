"""Order-keeping alignment of two versions' items by content, with what makes a pair of it doubtful.

A group is one thing's items in two versions.  Its pairs are held against what their words could make at most inside the join, so
only those that may reach the threshold leave it, and only these are compared word by word.  The alignment of a group is a heaviest
chain over the pairs that do.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import chains, sequences, text

# The least similarity, what the same title adds, how close another reading counts as one, and how much less an item counts that the source dropped.
MATCH, TITLE, TIE, DROPPED = 0.6, 0.5, 0.02, 1e-4
SPACE = r"[ \t\n\x0b\f\r]+"
UNIT = 1_000_000  # similarities become whole numbers of millionths


def _side(df: DataFrame, by: str, p: str) -> DataFrame:
    """Items dealt by their group once, as plain texts; what is made of the words is made where it is used."""
    raw = df.select(F.col(by).alias("g"), F.col("pos").cast("long").alias("pos"), "title", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("removed", F.lit(False)).alias("removed")).repartition("g")
    bag = F.filter(F.split("text", SPACE), lambda w: w != "")
    made = {p: F.col("pos"), f"{p}_title": text.norm_title(F.coalesce("title", F.lit(""))), f"{p}_label": F.col("label"), f"{p}_text": F.col("text"), f"{p}_removed": F.col("removed"), f"{p}_n": F.size(bag), f"{p}_set": F.array_distinct(F.transform(bag, lambda w: F.xxhash64(w)))}
    return raw.select("g", *(c.alias(n) for n, c in made.items()))


def at_most(a: Column, b: Column, m: Column, n: Column) -> Column:
    """The largest ratio that two texts of m and n words could have, by their distinct words: what is shared, and words said again."""
    shared = F.size(F.array_intersect(a, b)) + F.least(m - F.size(a), n - F.size(b))
    return F.when(m + n == 0, 1.0).otherwise(2 * F.least(shared, m, n) / (m + n))


def _ratio(a: str, b: str) -> Column:
    words = re.compile(r"[^ \t\n\x0b\f\r]+").findall

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([1.0 if i == j else sequences.ratio(words(i), words(j)) for i, j in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def pairable() -> Column:
    """Whether an item of each side may be one: not if both have labels that differ, unless neither label exists on the other side.

    A join's condition over ``a_label, b_label`` and ``a_known, b_known``, which ``with_known`` adds.
    """
    both = (F.col("a_label") != "") & (F.col("b_label") != "")
    return ~both | (F.col("a_label") == F.col("b_label")) | (~F.col("a_known") & ~F.col("b_known"))


def with_known(df: DataFrame, other: DataFrame, by: str, p: str) -> DataFrame:
    """Whether an item's label is among the labels of the other side's group (``other``: ``by, label``)."""
    labels = other.where("label <> ''").groupBy(F.col(by).alias("g")).agg(F.collect_set("label").alias("labels"))
    return df.join(labels, "g", "left").withColumn(f"{p}_known", F.coalesce(F.array_contains("labels", F.col(f"{p}_label")), F.lit(False))).drop("labels")


def scores(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Scored pairs ``by, a, b, worth, b_label`` that may be one and reach MATCH; ``worth`` in millionths."""
    left, right = with_known(_side(a, by, "a"), b, by, "a"), with_known(_side(b, by, "b"), a, by, "b").withColumnRenamed("g", "h")
    title = F.when((F.col("a_title") != "") & (F.col("a_title") == F.col("b_title")), TITLE).otherwise(0.0)
    m, n = F.col("a_n"), F.col("b_n")
    least = MATCH - title
    long_enough = 2 * F.least(m, n) >= least * (m + n) - 1e-9
    enough = at_most(F.col("a_set"), F.col("b_set"), m, n) >= least - 1e-9
    both = left.join(right, (F.col("g") == F.col("h")) & pairable() & long_enough & enough)
    worth = _ratio("a_text", "b_text") + title - F.when(F.col("a_removed"), DROPPED).otherwise(0.0)
    told = both.withColumn("worth", F.round(worth * UNIT).cast("long")).where(F.col("worth") >= int(MATCH * UNIT))
    return told.select(F.col("g").alias(by), "a", "b", "worth", "b_label")


PAIR = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64()), ("weak", pa.string())])


def aligned(scored: DataFrame, by: str, near: float = TIE) -> DataFrame:
    """``by, a, b, similarity, weak``: a best order-keeping alignment; ``twins`` for a pair without a label on the second side that another reading could replace.

    A group's scored pairs are one array, so an Arrow batch holds many groups.
    """

    def run(arrays: pa.Array) -> pa.Array:
        out = []
        for pairs in arrays.to_pylist():
            label = {p["b"]: p["b_label"] for p in pairs}
            got = chains.aligned([(p["a"], p["b"], p["worth"]) for p in pairs], round(near * UNIT))
            out.append([{"a": i, "b": j, "similarity": s / UNIT, "weak": "twins" if tie and not label[j] else None} for i, j, s, tie in got])
        return pa.array(out, pa.list_(PAIR))

    pairs = scored.groupBy(by).agg(F.collect_list(F.struct("a", "b", "worth", "b_label")).alias("pairs"))
    return pairs.select(by, F.explode(F.arrow_udf(run, "array<struct<a:long,b:long,similarity:double,weak:string>>")("pairs")).alias("p")).select(by, "p.*")
