"""Three-way merging of rows, fields and texts with typed, settleable conflicts.

``base`` is what was last written, ``ours`` the new source, ``theirs`` the live version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import sequences
from strata.plans.lineage import durable


def merge3(base: Column, ours: Column, theirs: Column) -> Column:
    """Ours where only ours changed; else theirs."""
    return F.when(theirs.eqNullSafe(base), ours).otherwise(theirs)


def clash3(base: Column, ours: Column, theirs: Column) -> Column:
    """Whether both sides changed, and differently."""
    return ~ours.eqNullSafe(base) & ~theirs.eqNullSafe(base) & ~ours.eqNullSafe(theirs)


def versions(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Three-way full outer join on the key: structs b, o, t (null where a version lacks the row)."""
    side = lambda df, n: df.select(key, F.struct(*fields).alias(n))
    return side(base, "b").join(side(ours, "o"), key, "full_outer").join(side(theirs, "t"), key, "full_outer")


def decisions(joined: DataFrame, fields: list[str]) -> DataFrame:
    """What is to be done with each row.

    A row the source dropped goes if nobody touched it and stays, told as kept, if somebody did.  A row dropped in the live
    version stays dropped whatever the source did.  A row new in the source is created, one only the live version has stays.
    """
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    changed = lambda x: reduce(lambda p, q: p | q, (~x[f].eqNullSafe(b[f]) for f in fields))
    clashes = reduce(lambda p, q: p | q, (clash3(b[f], o[f], t[f]) for f in fields))
    same = reduce(lambda p, q: p & q, (o[f].eqNullSafe(t[f]) for f in fields))
    rule = (
        F.when(b.isNull() & t.isNull(), "create")
        .when(b.isNull() & o.isNull(), "keep_user")
        .when(b.isNull(), F.when(same, "adopt").otherwise("conflict"))
        .when(t.isNull() & o.isNull(), "gone")
        .when(t.isNull(), "stay_deleted")
        .when(o.isNull(), F.when(changed(t), "keep_removed").otherwise("delete"))
        .when(~changed(o) & ~changed(t), "keep")
        .when(~changed(t), "take_ours")
        .when(~changed(o), "keep_theirs")
        .when(same, "converged")
        .when(clashes, "conflict")
        .otherwise("merge")
    )
    return joined.withColumn("decision", rule)


def merged(decided: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The rows of the merged version, field by field."""
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    value = lambda f: F.when(F.col("decision") == "create", o[f]).when(F.col("decision").isin("keep_user", "keep_removed", "adopt"), t[f]).when(b.isNull(), t[f]).otherwise(merge3(b[f], o[f], t[f]))
    return decided.where(~F.col("decision").isin("gone", "stay_deleted", "delete")).select(key, "decision", *(value(f).alias(f) for f in fields))


def conflicts(decided: DataFrame, key: str, fields: list[str], kind: str) -> DataFrame:
    """A row for each clashing field and each clash of existence, with an id made of its content."""
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    text = lambda x: F.coalesce(x.cast("string"), F.lit("<null>"))
    per_field = [F.when(clash3(b[f], o[f], t[f]) & o.isNotNull() & t.isNotNull(), F.struct(F.lit(f).alias("field"), b[f].cast("string").alias("base"), o[f].cast("string").alias("ours"), t[f].cast("string").alias("theirs"), F.lit(True).alias("takeable"))) for f in fields]
    nothing = F.lit(None).cast("string")
    existence = F.when(F.col("decision") == "keep_removed", F.struct(F.lit("existence").alias("field"), F.lit("present").alias("base"), nothing.alias("ours"), F.lit("edited").alias("theirs"), F.lit(False).alias("takeable")))
    rows = decided.select(key, F.explode(F.array_compact(F.array(*per_field, existence))).alias("c")).select(key, "c.*")
    ident = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(kind), F.col(key).cast("string"), F.col("field"), text(F.col("base")), text(F.col("ours")), text(F.col("theirs"))), 256), 1, 16)
    return rows.withColumn("conflict_id", ident)


def settle(found: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conflicts with how each is resolved, and the ids that settle nothing (stale, or of existence)."""
    ids = taken.select("conflict_id").distinct().withColumn("asked", F.lit(True))
    out = found.join(ids, "conflict_id", "left").withColumn("resolution", F.when(F.col("asked") & F.col("takeable"), "ours").otherwise("theirs")).drop("asked")
    return out, ids.select("conflict_id").join(found.where("takeable").select("conflict_id"), "conflict_id", "left_anti")


def edited_fields(base: DataFrame, live: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The fields in which the live version departs from the base; ``deleted`` for rows it lacks."""
    j = base.select(key, F.struct(*fields).alias("b")).join(live.select(key, F.struct(*fields).alias("t")), key, "left")
    names = F.array_compact(F.array(*(F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"t.{f}")), F.lit(f)) for f in fields)))
    return j.select(key, F.when(F.col("t").isNull(), F.array(F.lit("deleted"))).otherwise(names).alias("edits"))


MERGED_TEXT = "merged string, conflicts int, clashes array<struct<base:string,ours:string,theirs:string,paragraph:int>>"


def merge_texts(df: DataFrame, key: str, base: str, ours: str, theirs: str, take: str | None = None) -> DataFrame:
    """Paragraph- and word-wise three-way merge of text columns.  Nulls count as empty.

    ``take`` names a column that settles clashes for ours: a boolean for all of a row's, or an array of the paragraphs whose are.
    """
    kinds = dict(df.dtypes)
    cols = [F.col(key), *(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((base, "b"), (ours, "o"), (theirs, "t"))), (F.col(take) if take else F.lit(False)).alias("take")]
    every = not take or kinds[take] == "boolean"

    def run(batches):
        import pyarrow as pa

        clash = pa.list_(pa.struct([("base", pa.string()), ("ours", pa.string()), ("theirs", pa.string()), ("paragraph", pa.int32())]))
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("b", "o", "t", "take")), strict=True)
            out = [sequences.merge_paragraphs(b, o, t, bool(k) if every else k or ()) for b, o, t, k in rows]
            told = pa.array([[c._asdict() for c in clashes] for _, clashes in out], clash)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([m for m, _ in out], pa.string()), pa.array([len(c) for _, c in out], pa.int32()), told], [key, "merged", "conflicts", "clashes"])

    return df.select(*cols).mapInArrow(run, f"{key} {kinds[key]}, {MERGED_TEXT}")


def text_conflicts(merged: DataFrame, key: str) -> DataFrame:
    """A row for each clash of ``merge_texts``: ``key, paragraph`` (its place in theirs; null for a text of one paragraph), its three versions and an id made of all that."""
    c = merged.select(key, F.explode("clashes").alias("c")).select(key, "c.paragraph", "c.base", "c.ours", "c.theirs")
    ident = F.substring(F.sha2(F.concat_ws("\x1f", F.lit("text"), F.col(key).cast("string"), F.coalesce(F.col("paragraph").cast("string"), F.lit("-")), "base", "ours", "theirs"), 256), 1, 16)
    return c.withColumn("conflict_id", ident)


def settled_texts(df: DataFrame, key: str, base: str, ours: str, theirs: str, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts merged again with the clashes named in ``taken`` (``conflict_id``) settled for ours, each paragraph by itself, and the ids that settle nothing.

    Keys are unique.  An id is of one clash as it was told, so one whose texts have changed since is stale and changes nothing.
    """
    told = durable(text_conflicts(merge_texts(df, key, base, ours, theirs), key))
    ids = taken.select("conflict_id").distinct()
    chosen = told.join(ids, "conflict_id").groupBy(key).agg(F.collect_set(F.coalesce("paragraph", F.lit(-1))).alias("__take"))
    again = df.select(key, base, ours, theirs).join(chosen, key, "left").withColumn("__take", F.coalesce("__take", F.array().cast("array<int>")))
    whole = F.array_contains("__take", -1)
    kept = merge_texts(again.where(~whole), key, base, ours, theirs, "__take")
    one = merge_texts(again.where(whole).withColumn("__all", F.lit(True)), key, base, ours, theirs, "__all")
    return kept.unionByName(one), ids.join(told.select("conflict_id"), "conflict_id", "left_anti")


def has_writes(decided: DataFrame) -> DataFrame:
    """One row: whether carrying out the decisions would change the live version."""
    return decided.agg(F.coalesce(F.bool_or(F.col("decision").isin("create", "delete", "take_ours", "merge")), F.lit(False)).alias("has_writes"), F.count("*").alias("n_rows"))


def union_of_keys(ours: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """The source's rows, and the base's that it lacks."""
    return ours.withColumn("side", F.lit("ours")).unionByName(base.join(ours.select(key), key, "left_anti").withColumn("side", F.lit("base")))


def kept_joined(units: DataFrame, by: str, key: str, decision: str = "decision", base: str = "base", ours: str = "ours") -> DataFrame:
    """Units with ``kept_joined`` for those to be deleted whose words live on inside a unit of the same page that stays as the live version has it, and ``into``, the first such unit.

    ``units``: ``by, key``, the decision (``delete``, ``conflict`` and others), and its words in the base and in the source.  A clash
    keeps the live version's words, so the source's joined words would not arrive, and deleting the unit they came from would lose them.
    """
    words = lambda c: F.array_join(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda w: w != ""), " ")
    gone = units.where(F.col(decision) == "delete").select(by, key, words(base).alias("__words")).where("__words <> ''")
    stays = units.where(F.col(decision) == "conflict").select(F.col(by).alias("__by"), F.col(key).alias("into"), words(ours).alias("__text")).where("__text <> ''")
    held = gone.join(stays, (F.col(by) == F.col("__by")) & F.col("__text").contains(F.col("__words"))).groupBy(by, key).agg(F.min("into").alias("into"))
    out = units.join(held, [by, key], "left")
    return out.withColumn(decision, F.when(F.col("into").isNotNull(), "kept_joined").otherwise(F.col(decision)))


def held_pages(decided: DataFrame, moves: DataFrame, by: str, decision: str = "decision") -> DataFrame:
    """Decisions with ``hold`` for all of a page on which something would be written while it is unsure which page it is: ``moves`` has ``by, verdict`` (moved, unsure, stays)."""
    doubt = moves.where("verdict = 'unsure'").select(by, F.lit(True).alias("__doubt")).distinct()
    return decided.join(doubt, by, "left").withColumn(decision, F.when(F.col("__doubt"), "hold").otherwise(F.col(decision))).drop("__doubt")
