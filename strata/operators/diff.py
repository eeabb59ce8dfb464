"""Typed residuals of two versions under tolerances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def residuals(current: DataFrame, target: DataFrame, key: str, numbers: dict[str, float], texts: list[str]) -> DataFrame:
    """``key, kind, field, was, want, amount, within``: missing and extra rows, numbers off by more than nothing (with whether within tolerance), and differing texts."""
    c = current.select(key, F.struct(*numbers, *texts).alias("c"))
    t = target.select(key, F.struct(*numbers, *texts).alias("t"))
    j = c.join(t, key, "full_outer")
    nothing = F.lit(None).cast("string")

    def residual(kind: str, field: str, was: Column, want: Column, amount: Column, within: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), was.alias("was"), want.alias("want"), amount.alias("amount"), within.alias("within"))

    none, no = F.lit(None).cast("double"), F.lit(False)
    both = F.col("c").isNotNull() & F.col("t").isNotNull()
    found = [F.when(F.col("c").isNull(), residual("missing", "", nothing, nothing, none, no)), F.when(F.col("t").isNull(), residual("extra", "", nothing, nothing, none, no))]
    for f, tolerance in numbers.items():
        a, b = F.col(f"c.{f}"), F.col(f"t.{f}")
        off = F.round(F.abs(a - b), 6)
        found.append(F.when(both & ~a.eqNullSafe(b), residual("number", f, a.cast("string"), b.cast("string"), off, F.coalesce(off <= tolerance, no))))
    for f in texts:
        a, b = F.col(f"c.{f}"), F.col(f"t.{f}")
        found.append(F.when(both & ~a.eqNullSafe(b), residual("text", f, a, b, none, no)))
    return j.select(key, F.explode(F.array_compact(F.array(*found))).alias("r")).select(key, "r.*")


def summary(found: DataFrame) -> DataFrame:
    """Open residuals by kind."""
    return found.where("not within").groupBy("kind").agg(F.count("*").alias("n_open"))
