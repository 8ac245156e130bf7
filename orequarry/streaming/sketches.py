"""Structured Streaming forms of the sketches; each micro-batch is a batch of the report."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orequarry.functions.scalars import md5_number
from orequarry.operators.similarity import PRIME, hash_parameters
from orequarry.operators.sketches import BITS, distinct_estimates


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Works through all that is there now and stops; a restart goes on where the checkpoint is."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def work_folder(spark: SparkSession) -> str:
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="orequarry-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def keyed(stream: DataFrame, key: str) -> DataFrame:
    return stream.select(F.col(key).cast("string").alias("key"), F.pmod(md5_number(F.col(key).cast("string")), F.lit(PRIME)).alias("x"))


def distinct_stream(stream: DataFrame, key: str, spark: SparkSession, n_hashes: int = 10, how: str = "median") -> DataFrame:
    """batch_id, truth, estimate, appended by each micro-batch."""
    folder = work_folder(spark)

    def sink(batch: DataFrame, batch_id: int) -> None:
        made = distinct_estimates(keyed(batch, key).withColumn("batch_id", F.lit(batch_id).cast("long")), n_hashes, how=how)
        made.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")  # a repeated batch replaces its own rows

    run_once(stream, sink, f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("batch_id", "truth", "estimate")


_FILTER_STATE = "bits binary, seen binary"


def _bloom_step(n_hashes: int, size: int):
    params = np.array(hash_parameters(n_hashes), np.int64)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.getOption
        table = np.frombuffer(bytearray(old[0]), np.uint8).copy() if old else np.zeros(size, np.uint8)
        seen = set(np.frombuffer(bytes(old[1]), np.int64).tolist()) if old else set()
        fp = unseen = n = 0
        for pdf in batches:
            for x in pdf["x"]:
                at = (params[:, 0] * int(x) + params[:, 1]) % PRIME % size
                new = int(x) not in seen
                unseen += new
                fp += bool(new and table[at].all())
                table[at] = 1
                seen.add(int(x))
                n += 1
        state.update((table.tobytes(), np.array(sorted(seen), np.int64).tobytes()))
        yield pd.DataFrame({"part": [key[0]], "n": [n], "fp": [fp], "unseen": [unseen]})

    return step


def bloom_stream(stream: DataFrame, key: str, spark: SparkSession, parts: int = 8, n_hashes: int = 16, size: int = BITS) -> DataFrame:
    """part, n, fp, unseen of each micro-batch: one filter for each of `parts` hash parts of the keys, kept as state.

    Elements are tested and then inserted, in arrival order of their part. The set of seen keys is only for the
    report's truth.
    """
    folder = work_folder(spark)
    dealt = keyed(stream, key).withColumn("part", F.pmod(F.col("x"), F.lit(parts)))
    made = dealt.groupBy("part").applyInPandasWithState(_bloom_step(n_hashes, size), "part long, n long, fp long, unseen long", _FILTER_STATE, "append", GroupStateTimeout.NoTimeout)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    run_once(made, sink, f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("batch_id", "part", "n", "fp", "unseen")


def _reservoir_step(k: int):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [tuple(x) for x in zip(*state.getOption, strict=True)] if state.exists else []
        for pdf in batches:
            rows = sorted([*rows, *zip(pdf["draw"].tolist(), pdf["id"].tolist(), strict=True)])[:k]
        state.update(([r[0] for r in rows], [r[1] for r in rows]))
        yield pd.DataFrame({"draw": [r[0] for r in rows], "id": [r[1] for r in rows]})

    return step


def reservoir_stream(stream: DataFrame, id_col: str, spark: SparkSession, k: int = 100, seed: int = 553, parts: int = 8) -> DataFrame:
    """batch_id, place, id: after each micro-batch the k ids of the smallest keyed draws so far.

    Each of `parts` parts keeps its own k as state; the sample of the whole is the k smallest of theirs.
    """
    folder = work_folder(spark)
    draw = md5_number(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    dealt = stream.select(draw.alias("draw"), F.col(id_col).cast("long").alias("id")).withColumn("part", F.pmod("draw", F.lit(parts)))
    made = dealt.groupBy("part").applyInPandasWithState(_reservoir_step(k), "draw long, id long", "draws array<long>, ids array<long>", "update", GroupStateTimeout.NoTimeout)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{folder}/parts/batch={batch_id}")

    run_once(made, sink, f"{folder}/checkpoint", "update")
    return spark.read.parquet(f"{folder}/parts").select("batch_id", "draw", "id")
