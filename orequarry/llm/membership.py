"""A membership filter of a table's keys: broadcast in a bounded number of bits, built where the keys are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orequarry.llm import textnum as T

#: Parts of a filter, each built by one task.
SEGMENTS = 64
#: Bits of filter for each key, and the most bits of all. Beyond that more keys pass that are none, and no key is lost.
BITS_PER_KEY, MOST_BITS = 12, 1 << 28


def _build(bits: int):
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, segment = batch.column("key").to_numpy(), batch.column("segment").to_numpy()
            for s in np.unique(segment).tolist():
                if s not in held:
                    held[s] = np.zeros(bits, bool)
                held[s][T.member_places(keys[segment == s], bits).ravel().astype(np.int64)] = True
        for s, table in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([np.packbits(table).tobytes()], pa.binary())], ["segment", "bits"])

    return run


def membership_filter(keys: DataFrame, count: int) -> tuple[Broadcast, int]:
    """A broadcast filter of the long column `key` of about `count` rows, and the bits of one segment, for maybe_members().

    At most MOST_BITS / 8 bytes (32 MB) reach the driver and the workers.
    """
    bits = -(-min(MOST_BITS, max(1 << 16, count * BITS_PER_KEY)) // SEGMENTS // 64) * 64
    dealt = keys.select("key", F.pmod("key", F.lit(SEGMENTS)).alias("segment")).repartition(SEGMENTS, "segment")
    got = dealt.mapInArrow(_build(bits), "segment long, bits binary").toArrow()
    whole = np.zeros((SEGMENTS, bits // 8), np.uint8)
    for segment, made in zip(got["segment"].to_pylist(), got["bits"], strict=True):
        whole[segment] = np.frombuffer(made.as_py(), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole.tobytes()), bits
