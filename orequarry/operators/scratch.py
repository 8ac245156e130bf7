"""Cutting lineage in iterative operators, in a way that outlives a lost executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary folder only in local mode."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="orequarry-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint df in the folder of spark.checkpoint.dir; a temporary folder only in local mode."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the same folder, deleted at exit: compressed, so smaller than a checkpoint; its shuffles' files go at once."""
    spark = df.sparkSession
    path = f"{_checkpoint_dir(spark)}/orequarry-{uuid.uuid4().hex}"
    _written.append((spark, path))
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def forget() -> None:
    """Delete every table that written() wrote in this process."""
    while _written:
        spark, path = _written.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            continue


atexit.register(forget)
