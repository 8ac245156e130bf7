"""Exact Jaccard pairs of sets, block by block of sets: shared members are counted where they meet, and only similar pairs leave."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orequarry.operators import copairs, relational
from orequarry.operators.scratch import written

#: Pairs of sets that share a member, counted once for each, in a block.
BLOCK = 100_000_000


def similar(sets: DataFrame, least: float) -> DataFrame:
    """a < b, similarity: pairs that share a member and have Jaccard of at least `least`. sets: id, member, each once."""
    rows = sets.where(F.col("id").isNotNull() & F.col("member").isNotNull())
    if sets.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        made = _similar(rows.select(F.col("id").cast("long").alias("id"), "member"), least)
        kind = sets.schema["id"].dataType
        return made.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "similarity")
    index = written(relational.dictionary(rows, "id"))
    numbered = rows.join(index, "id").select(F.col("index").alias("id"), "member")
    a, b = (index.select(F.col("index").alias(f"n{x}"), F.col("id").alias(x)) for x in "ab")
    made = _similar(numbered, least).withColumnsRenamed({"a": "na", "b": "nb"})
    return made.join(a, "na").join(b, "nb").select("a", "b", "similarity")


def _similar(sets: DataFrame, least: float) -> DataFrame:
    whole = written(sets.groupBy("id").agg(F.collect_set("member").alias("m")))
    flat = whole.select("id", F.size("m").alias("n"), F.explode("m").alias("member"))
    pairs = flat.groupBy("member").count().agg(F.sum(F.col("count") * (F.col("count") - 1.0) / 2).alias("x")).first().x or 0
    blocks = math.ceil(pairs / BLOCK)
    cuts = flat.agg(F.percentile_approx("id", [k / blocks for k in range(1, blocks)], 10_000).alias("x")).first().x if blocks > 1 else []
    bounds = np.unique(np.array(cuts, np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, lens = copairs._flat(batch.column("held"))
            ids, sizes = (held.field(c).to_numpy(zero_copy_only=False) for c in ("id", "n"))
            row, block = np.repeat(np.arange(len(lens)), lens), np.searchsorted(bounds, ids, "right").astype(np.int32)
            first = np.flatnonzero(np.append(len(ids) > 0, (np.diff(row) != 0) | (np.diff(block) != 0)))
            here = np.diff(np.append(first, len(ids)))
            size = np.cumsum(lens)[row[first]] - first
            # each part of at most so many ids as a list column can hold
            for part in np.split(np.arange(len(first)), np.flatnonzero(np.diff(np.cumsum(size) // 4_000_000)) + 1):
                at = copairs._ranges(first[part], size[part])
                columns = [pa.array(block[first[part]]), pa.array(here[part]), copairs._lists(ids[at], size[part]), copairs._lists(sizes[at], size[part])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "here", "id", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in copairs.by_block(batches):
            for a, b, similarity in _counted(pa.Table.from_batches(held), least):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(similarity)], ["a", "b", "similarity"])

    postings = flat.groupBy("member").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("held")).where(F.size("held") > 1).select("held")
    dealt = postings.mapInArrow(deal, "block int, here long, id array<long>, n array<int>").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(count, "a long, b long, similarity double")


def _counted(table: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """a < b, similarity of a block's sets with those after them. A row of table: a member's sets in order, the first `here` in the block."""
    column = lambda c: pa.concat_arrays(table.column(c).chunks)
    (ids, lens), (sizes, _) = copairs._flat(column("id")), copairs._flat(column("n"))
    here, ends = column("here").to_numpy(), np.cumsum(lens)
    ids, sizes = ids.to_numpy(), sizes.to_numpy()
    names, at = np.unique(ids, return_inverse=True)
    n = np.zeros(len(names), np.int64)
    n[at] = sizes
    left = copairs._ranges(ends - lens, here)
    stop = np.repeat(ends, here)
    order = np.argsort(at[left], kind="stable")
    left, stop = left[order], stop[order]
    cuts = np.append(np.flatnonzero(np.append(len(left) > 0, np.diff(at[left]) != 0)), len(left))
    left_list, stop_list, found, held = left.tolist(), stop.tolist(), [], 0
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        a = at[left_list[low]]
        others = np.concatenate([at[p + 1 : e] for p, e in zip(left_list[low:high], stop_list[low:high], strict=True)])
        if not len(others):
            continue
        if len(names) - a > 16 * len(others):
            b, shared = np.unique(others, return_counts=True)
        else:
            counts = np.bincount(others)
            b = np.flatnonzero(counts >= max(1, least * n[a] * (1 - 1e-9)))  # fewer shared members than that are too few for any b
            shared = counts[b]
        similarity = shared / (n[a] + n[b] - shared)
        kept = similarity >= least
        if kept.any():
            found.append((np.full(kept.sum(), names[a]), names[b[kept]], similarity[kept]))
            held += len(found[-1][0])
        if held > 100_000:
            yield tuple(np.concatenate(x) for x in zip(*found, strict=True))
            found, held = [], 0
    if found:
        yield tuple(np.concatenate(x) for x in zip(*found, strict=True))
