"""Data-quality queries: what was lost, owned twice, left over or broken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lost_words(before: DataFrame, after: DataFrame, by: str, word: str) -> DataFrame:
    """Words of a group that occur fewer times afterwards, with how many are missing."""
    signed = lambda df, sign: df.select(by, word, F.lit(sign).cast("long").alias("n_lost"))
    return signed(before, 1).unionByName(signed(after, -1)).groupBy(by, word).agg(F.sum("n_lost").alias("n_lost")).where("n_lost > 0")


def ownership(items: DataFrame, owners: DataFrame, item: str, claim: str) -> DataFrame:
    """Items that no owner or more than one owner claims, and claims on nothing: ``item, problem, n``."""
    claims = owners.groupBy(F.col(claim).alias(item)).agg(F.count("*").alias("n"))
    j = items.select(item, F.lit(True).alias("__here")).join(claims, item, "full_outer")
    problem = F.when(F.col("__here").isNull(), "dangling").when(F.col("n").isNull(), "unowned").when(F.col("n") > 1, "shared")
    return j.select(item, problem.alias("problem"), F.coalesce("n", F.lit(0)).alias("n")).where("problem is not null")


def arrived(base: DataFrame, ours: DataFrame, merged: DataFrame, theirs: DataFrame, key: str, field: str) -> DataFrame:
    """Source changes to untouched rows that the merged version does not show."""
    pick = lambda df, n: df.select(key, F.col(field).alias(n))
    j = pick(base, "b").join(pick(ours, "o"), key).join(pick(theirs, "t"), key).join(pick(merged, "m"), key, "left")
    return j.where(~F.col("o").eqNullSafe(F.col("b")) & F.col("t").eqNullSafe(F.col("b")) & ~F.col("m").eqNullSafe(F.col("o")))


def repeated(df: DataFrame, by: list[str]) -> DataFrame:
    """Groups with more than one row."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def ledger(versions: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """One row for each unit (``by, kind, unit``) with how often each version has it; every table is ``by, kind, unit`` or more columns."""
    rows = None
    for name, df in versions.items():
        one = df.select(*by, "kind", "unit", *(F.lit(int(name == v)).alias(v) for v in versions))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*by, "kind", "unit").agg(*(F.sum(v).cast("long").alias(v) for v in versions))


def untold_losses(base: DataFrame, before: DataFrame, after: DataFrame, told: DataFrame, by: list[str]) -> DataFrame:
    """What a sync took from the reader and did not say: ``by, kind, unit, own, gone, told, lost``.

    ``base``: what was last written; ``before`` and ``after``: the live version around the sync; each a row for every word, mark, cell or
    row of it (``kind, unit``).  The reader's ``own`` units are those of ``before`` beyond ``base``.  Of these ``gone`` are missing
    after, wherever in ``by`` they stood; ``told`` (``by, kind, unit, n``) takes off what was reported; what is left is ``lost``.
    Units are counted, so of two alike that one is lost is seen; what the source itself took away of the base is no loss.
    """
    counts = ledger({"base": base, "before": before, "after": after}, by)
    own = F.greatest(F.col("before") - F.col("base"), F.lit(0))
    gone = F.least(own, F.greatest(F.col("before") - F.col("after"), F.lit(0)))
    missing = counts.withColumn("own", own).withColumn("gone", gone).where("gone > 0")
    said = told.groupBy(*by, "kind", "unit").agg(F.sum("n").alias("told"))
    out = missing.join(said, [*by, "kind", "unit"], "left").withColumn("told", F.least(F.coalesce("told", F.lit(0)), "gone").cast("long"))
    return out.select(*by, "kind", "unit", F.col("own").cast("long").alias("own"), F.col("gone").cast("long").alias("gone"), "told", (F.col("gone") - F.col("told")).cast("long").alias("lost")).where("lost > 0")
