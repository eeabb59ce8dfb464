"""Durable cuts of lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MOST_BYTES = 1 << 50  # a guess above this is forgotten
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="strata-checkpoint-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; on one machine, where it is unset, a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None and sc._jsc.sc().isLocal():
        folder = _local_folder()
    if folder is None:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Queries made and run inside remove their shuffle files when they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; the shuffle files that led to it are removed once it is written."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    with tidy(spark):
        kept = df.select("*").checkpoint(eager=True)  # a new plan, as a plan keeps the setting it was made under
    # a checkpoint also keeps the size guessed for its plan; in loops of joins such guesses multiply without end
    made = kept._jdf.queryExecution()
    if int(made.optimizedPlan().stats().sizeInBytes()) < MOST_BYTES:
        return kept
    return type(kept)(spark._jsparkSession.internalCreateDataFrame(made.toRdd(), kept._jdf.schema(), False), spark)


def stored(df: DataFrame, at: str) -> DataFrame:
    """Written as Parquet and read again."""
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.parquet(at)


def delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
