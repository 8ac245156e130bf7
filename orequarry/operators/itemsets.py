"""Frequent itemsets: baskets, pair buckets, level-wise counting, FP-growth and the two-pass partition scheme."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orequarry.functions.scalars import pairs, without_each
from orequarry.operators.scratch import cut_lineage


def baskets(rows: DataFrame, basket: str, item: str, larger_than: int = 0) -> DataFrame:
    """basket, items: sorted distinct items; baskets of more than `larger_than` items."""
    made = rows.groupBy(F.col(basket).alias("basket")).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return made.where(F.size("items") > larger_than)


def pair_buckets(table: DataFrame, n: int, bucket: Column) -> DataFrame:
    """bucket, pairs: how many item pairs of baskets fall in each of n buckets; `bucket` is an expression on `pair`."""
    exploded = table.select(F.explode(pairs(F.col("items"))).alias("pair"))
    return exploded.groupBy(F.pmod(bucket, F.lit(n)).alias("bucket")).agg(F.count(F.lit(1)).alias("pairs"))


def frequent_singles(table: DataFrame, support: int) -> DataFrame:
    counted = table.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("freq"))
    return counted.where(F.col("freq") >= support).select(F.array("item").alias("items"), "freq")


def bucket_candidates(table: DataFrame, support: int, n: int, bucket: Column) -> DataFrame:
    """items: pairs of frequent items whose bucket, of n, is hit by at least `support` pairs; `bucket` is an expression on `pair`."""
    hashed = table.select(F.explode(pairs(F.col("items"))).alias("pair")).withColumn("bucket", F.pmod(bucket, F.lit(n)))
    full = pair_buckets(table, n, bucket).where(F.col("pairs") >= support)
    often = frequent_singles(table, support).select(F.col("items")[0].alias("item"))
    kept = hashed.distinct().join(F.broadcast(full), "bucket", "left_semi")  # at most n rows
    kept = kept.withColumn("one", F.col("pair")[0]).withColumn("two", F.col("pair")[1])
    kept = kept.join(often.withColumnRenamed("item", "one"), "one", "left_semi").join(often.withColumnRenamed("item", "two"), "two", "left_semi")
    return kept.select(F.col("pair").alias("items"))


def candidates(frequent: DataFrame) -> DataFrame:
    """Itemsets one larger: joined on all but the last item, kept if every subset is frequent."""
    parts = frequent.select(F.slice("items", F.lit(1), F.size("items") - 1).alias("head"), F.element_at("items", -1).alias("tail"))
    other = parts.select("head", F.col("tail").alias("next"))
    joined = parts.join(other, "head").where("tail < next").select(F.concat("head", F.array("tail", "next")).alias("items"))
    subset = joined.select("items", F.explode(without_each(F.col("items"))).alias("subset"), (F.size("items")).alias("k"))
    held = subset.join(frequent.select(F.col("items").alias("subset")), "subset", "left_semi")
    return held.groupBy("items", "k").agg(F.count(F.lit(1)).alias("n")).where("n = k").select("items")


def count_candidates(table: DataFrame, found: DataFrame, support: int) -> DataFrame:
    """Baskets that contain each candidate, at least `support`.

    Candidates meet baskets by their first item, then the rest is tested: no candidate list is sent to every task.
    """
    keyed = found.select("items", F.element_at("items", 1).alias("item"))
    rows = table.select(F.col("items").alias("all"), F.explode("items").alias("item"))
    hits = rows.join(keyed, "item").where(F.size(F.array_except("items", "all")) == 0)
    return hits.groupBy("items").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= support)


def level_wise(table: DataFrame, support: int, largest: int) -> DataFrame:
    """items, freq of all itemsets up to `largest` items that at least `support` baskets contain."""
    level = cut_lineage(frequent_singles(table, support))
    out = level
    for _ in range(2, largest + 1):
        level = cut_lineage(count_candidates(table, candidates(level), support))
        if level.isEmpty():
            break
        out = out.union(level)
    return out


def fp_growth(table: DataFrame, support: int, n_baskets: int | None = None) -> DataFrame:
    """items (sorted), freq by FP-growth; the relative support is set just below and the counts are tested."""
    n = n_baskets or table.count()
    if n == 0:
        return frequent_singles(table, support)
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (support - 0.5) / n), minConfidence=1.0).fit(table)
    return model.freqItemsets.where(F.col("freq") >= support).select(F.array_sort("items").alias("items"), "freq")


def partition_candidates(table: DataFrame, support: int, total: int, largest: int) -> DataFrame:
    """First pass of the two-pass scheme: itemsets that are frequent in some partition at its share of the support."""

    def mine(batches):
        rows = [list(x) for pdf in batches for x in pdf["items"]]
        if not rows:
            return
        least = support * len(rows) / total
        counts = Counter(i for r in rows for i in r)
        level = {(i,) for i, n in counts.items() if n >= least}
        found = sorted(level)
        for k in range(2, largest + 1):
            singles = {i for s in level for i in s}
            counts = Counter(c for r in rows for c in combinations([i for i in r if i in singles], k) if all(s in level for s in combinations(c, k - 1)))
            level = {c for c, n in counts.items() if n >= least}
            if not level:
                break
            found += sorted(level)
        yield pd.DataFrame({"items": [list(x) for x in found]})

    return table.select("items").mapInPandas(mine, "items array<string>").distinct()


def two_pass(table: DataFrame, support: int, largest: int = 3) -> DataFrame:
    """items, freq: candidates of partitions, then one exact count. Every frequent itemset is a candidate somewhere."""
    total = table.count()
    return count_candidates(table, partition_candidates(table, support, max(total, 1), largest), support)
