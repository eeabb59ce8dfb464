"""Order-dependent segmentation: islands, runs, gaps, overlay steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], order: list, starts: Column, name: str = "island") -> DataFrame:
    """Number the islands of each partition from 1.  ``starts`` says, with lag() over the same window if it likes, where a new one starts; null counts as no."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__start", F.coalesce(starts.cast("int"), F.lit(0))).withColumn(name, F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.when(F.first("__start").over(w) == 0, 1).otherwise(0)).drop("__start")


def previous(df_by: list[str], order: list, col: Column) -> Column:
    return F.lag(col).over(Window.partitionBy(*df_by).orderBy(*order))


def merge_equal_neighbours(df: DataFrame, by: list[str], order: str, style: list[str], text: str) -> DataFrame:
    """Neighbouring rows with the same style become one, texts joined in order; empty texts are dropped first."""
    full = df.where(F.length(text) > 0)
    w = Window.partitionBy(*by).orderBy(order)
    changed = F.lag(order).over(w).isNull()
    for c in style:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    numbered = islands(full, by, [order], changed, "run")
    return numbered.groupBy(*by, "run", *style).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("parts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias(text))


def run_offsets(df: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """Start and end of each run in its partition's joined text, in code points and in UTF-16 units."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    units = (F.octet_length(F.encode(F.col(text), "UTF-16BE")) / 2).cast("long")
    out = df.withColumn("stop", F.sum(F.length(text)).over(w)).withColumn("stop16", F.sum(units).over(w))
    return out.withColumn("start", F.col("stop") - F.length(text)).withColumn("start16", F.col("stop16") - units)


def overlay_steps(df: DataFrame, by: list[str], order: str, label: str, words: str, share: float = 0.8) -> DataFrame:
    """Marks rows that the next one of the same label repeats: at least ``share`` of their words (with repeats) are among its words."""
    w = Window.partitionBy(*by).orderBy(order)
    out = df.withColumn("next_label", F.lead(label).over(w)).withColumn("__next", F.lead(words).over(w))
    inside = F.size(F.filter(F.col(words), lambda x: F.array_contains(F.col("__next"), x)))
    out = out.withColumn("share", F.when(F.size(words) > 0, inside / F.size(words)).otherwise(F.lit(1.0)))
    return out.withColumn("superseded", F.coalesce((F.col("next_label") == F.col(label)) & (F.col("share") >= share), F.lit(False))).drop("__next")


def gap_ids(df: DataFrame, by: list[str], order: str, anchor: str) -> DataFrame:
    """Gives each row without an anchor the anchors around it (null at either end)."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.last(anchor, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(anchor, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn("before", before).withColumn("after", after)


def carried_notes(df: DataFrame, by: list[str], order: str, label: str, note: str) -> DataFrame:
    """The last step of each run of one label gets the notes of all its steps, in order; the others none."""
    w = Window.partitionBy(*by).orderBy(order)
    runs = islands(df, by, [order], F.lag(order).over(w).isNull() | ~F.col(label).eqNullSafe(F.lag(label).over(w)), "run")
    notes = F.transform(F.array_sort(F.collect_list(F.struct(order, note))), lambda x: x[note])
    return runs.groupBy(*by, "run", label).agg(F.max(order).alias(order), F.array_join(F.filter(notes, lambda x: x.isNotNull() & (x != "")), "\n").alias("notes"), F.count("*").alias("n_steps"))


def broken_numbering(df: DataFrame, by: list[str], order: str, number: str) -> DataFrame:
    """Numbered lists that don't run from 1 upwards without gaps, with their first wrong place."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("__want", F.row_number().over(w)).where(F.col(number) != F.col("__want")).groupBy(*by).agg(F.min("__want").cast("long").alias("first_wrong"), F.count("*").alias("n_wrong"))


def batches(df: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """Numbers batches of whole groups: a group that would pass ``most`` together with those since the last cut starts the next.

    Each list ``by`` is cut by itself, in one task, as a cut follows from all before it; it has one row a group of requests.
    """

    def run(pdf):
        total, n, out = 0, 0, []
        for s in pdf.sort_values(order)[size]:
            if total and total + s > most:
                n, total = n + 1, 0
            total += s
            out.append(n)
        pdf = pdf.sort_values(order)
        pdf["batch"] = out
        return pdf

    kinds = dict(df.dtypes)
    return df.groupBy(by).applyInPandas(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", batch long")


def best_rounds(df: DataFrame, by: list[str], round_: str, score: str) -> DataFrame:
    """The round of each item's best score (the first that tie) and whether its last round left it worse."""
    best = df.groupBy(*by).agg(F.max_by(round_, F.struct(score, -F.col(round_))).alias("best_round"), F.max(score).alias("best"), F.max_by(score, round_).alias("last"))
    return best.withColumn("revert", F.col("last") < F.col("best"))


def bands(df: DataFrame, by: list[str], place: str, gap: float) -> DataFrame:
    """Runs of places that are at most ``gap`` apart: first, last and number of distinct places."""
    rows = df.select(*by, place).distinct()
    w = Window.partitionBy(*by).orderBy(place)
    before = F.lag(place).over(w)
    return islands(rows, by, [place], before.isNull() | (F.col(place) - before > gap), "band").groupBy(*by, "band").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n_places"))


def differing_ranges(df: DataFrame, by: list[str], pos: str, was: str, want: str, neutral: Column) -> DataFrame:
    """Maximal ranges of places whose two styles differ, each with one pair of styles; neutral places (white space) neither start, end nor break one."""
    told = df.where(~neutral)
    w = Window.partitionBy(*by).orderBy(pos)
    pair = F.struct(F.col(was), F.col(want))
    runs = islands(told.withColumn("__pair", pair), by, [pos], F.lag(pos).over(w).isNull() | ~F.col("__pair").eqNullSafe(F.lag("__pair").over(w)), "range")
    return runs.where(~F.col(was).eqNullSafe(F.col(want))).groupBy(*by, "range", was, want).agg(F.min(pos).alias("first"), F.max(pos).alias("last")).drop("range")


def tracked_runs(df: DataFrame, by: list[str], pos: str, place: str, tolerance: float, least: int = 4) -> DataFrame:
    """Stretches of at least ``least`` gaps that stay within ``tolerance`` of the gap before: first, last, middle gap."""
    w = Window.partitionBy(*by).orderBy(pos)
    gaps = df.withColumn("gap", F.col(place) - F.lag(place).over(w)).where("gap is not null")
    runs = islands(gaps, by, [pos], F.lag("gap").over(w).isNull() | (F.abs(F.col("gap") - F.lag("gap").over(w)) > tolerance), "run")
    return runs.groupBy(*by, "run").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n_gaps"), F.median("gap").alias("gap")).where(F.col("n_gaps") >= least).drop("run")
