"""Revisions as a stream: windows with a watermark, per-document generations with late rows told, and chained merges.

Every runner reads what is there (``availableNow``), keeps its checkpoint in the shared
folder and can be started again after a failure: sinks are Parquet folders written per batch
under the batch's number, so a batch that is run twice leaves one result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strata.operators import merge
from strata.operators.state import SnapshotStore
from strata.plans.lineage import shared_folder


def run_once(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its result; ``complete`` keeps the last batch's, other modes add batches up."""
    spark = stream.sparkSession
    top = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/out" if mode == "complete" else f"{top}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out").select(*stream.columns)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files as a stream; a single file is read as the only match in its folder."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def windowed_counts(events: DataFrame, time: str, by: list[str], value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window; rows later than the watermark are dropped."""
    at = events.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", late)
    return at.groupBy(F.window("__at", width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    at = events.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", late)
    return at.groupBy(F.session_window("__at", gap).alias("w"), *by).agg(F.count("*").alias("n")).select(*by, F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def generations(revisions: DataFrame, key: str, order: str, generation: str) -> DataFrame:
    """``key, order, generation, status``: a revision is ``applied`` if its generation is above all before it, else ``late``.

    The state of a document is one number.
    """

    def run(k: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        status = []
        for g in rows[generation]:
            fresh = last is None or g > last
            status.append("applied" if fresh else "late")
            last = g if fresh else last
        state.update((int(last),))
        yield pd.DataFrame({key: rows[key], order: rows[order], generation: rows[generation], "status": status})

    kinds = dict(revisions.dtypes)
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, {generation} {kinds[generation]}, status string"
    return revisions.select(key, order, generation).groupBy(key).applyInPandasWithState(run, out, "last long", "append", GroupStateTimeout.NoTimeout)


def merge_revisions(revisions: DataFrame, store: SnapshotStore, key: str, fields: list[str], checkpoint: str) -> None:
    """Chains merges: each batch of live rows (key, fields, ``deleted``) is merged into the last snapshot, which becomes the next base.

    Batch n writes version n + 1 of the store only if that is not there yet, so a batch run again after a failure changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if store.version() > number + 1:
            return
        base = store.read(number + 1)
        live = batch.where("not deleted").select(key, *fields)
        untouched = base.join(batch.select(key), key, "left_anti")
        decided = merge.decisions(merge.versions(base, base, untouched.unionByName(live), key, fields), fields)
        store.write(merge.merged(decided, key, fields).select(key, *fields), number + 1)

    revisions.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start().awaitTermination()
