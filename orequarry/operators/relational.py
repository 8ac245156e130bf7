"""Relational operators: encoders, lookups, moments and partition profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orequarry.operators.scratch import cut_lineage


def top_k(table: DataFrame, key: str, k: int, n: str = "n") -> DataFrame:
    """The k most frequent keys, ties to the smaller key."""
    return table.groupBy(key).agg(F.count(F.lit(1)).alias(n)).orderBy(F.desc(n), key).limit(k)


def dictionary(table: DataFrame, key: str, partitions: int = 32) -> DataFrame:
    """key, index: 0 to n-1 in key order.

    Keys are ranged over partitions and numbered inside them; only the partitions' counts meet in one place.
    """
    keys = table.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(partitions, key)
    held = cut_lineage(keys.withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return held.withColumn("place", place).join(F.broadcast(offsets), "part").select(key, (F.col("place") + F.col("offset")).cast("long").alias("index"))


def encode(table: DataFrame, key: str, index: DataFrame, name: str) -> DataFrame:
    return table.join(index.withColumnRenamed("index", name), key)


def decode(table: DataFrame, name: str, index: DataFrame) -> DataFrame:
    return table.join(index.withColumnRenamed("index", name), name)


def moments(table: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, mean, var (population), std (population)."""
    v = F.col(value)
    return table.groupBy(key).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.stddev_pop(v).alias("std"))


def centred(table: DataFrame, key: str, value: str, name: str = "centred") -> DataFrame:
    """value minus the mean of its key; a hot key is aggregated before it is joined back."""
    means = table.groupBy(key).agg(F.avg(value).alias("__mean"))
    return table.join(means, key).withColumn(name, F.col(value) - F.col("__mean")).drop("__mean")


def lookup(table: DataFrame, key: str, features: DataFrame, strict: bool = False) -> DataFrame:
    """Features by key: nulls where the key is missing, or no row at all if strict."""
    return table.join(features, key, "inner" if strict else "left")


def guarded_lookup(table: DataFrame, first: tuple[str, DataFrame], second: tuple[str, DataFrame]) -> DataFrame:
    """Features of both keys; if either side is missing, all of them are null."""
    out, present = table, F.lit(True)
    names: list[str] = []
    for n, (key, features) in enumerate((first, second)):
        names += [c for c in features.columns if c != key]
        out = out.join(features.withColumn(f"__hit{n}", F.lit(True)), key, "left")
        present = present & F.col(f"__hit{n}").isNotNull()
    kept = [F.when(present, F.col(c)).alias(c) if c in names else F.col(c) for c in out.columns if not c.startswith("__hit")]
    return out.select(*kept)


def in_either(table: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Rows whose key is in at least one of the other tables."""
    keys = others[0].select(key)
    for other in others[1:]:
        keys = keys.union(other.select(key))
    return table.join(keys.distinct(), key, "left_semi")


def in_both(table: DataFrame, key: str, a: DataFrame, b: DataFrame) -> DataFrame:
    return table.join(a.select(key).intersect(b.select(key)), key, "left_semi")


def cold(table: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Distinct keys that are not known."""
    return table.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def first_letter_bucket(key: Column, n: int) -> Column:
    """The bucket of the code of the first character."""
    return F.pmod(F.ascii(F.substring(key, 1, 1)), F.lit(n))


def partition_profile(table: DataFrame) -> DataFrame:
    """partition, rows of the table as it is dealt out."""
    return table.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


def mean_by_group_outer(facts: DataFrame, groups: DataFrame, key: str, group: str, value: str, keep_unmatched: bool) -> DataFrame:
    """Mean of value by group over a full outer join; unmatched sides are left out, or shown with nulls."""
    joined = groups.join(facts, key, "full")
    if not keep_unmatched:
        joined = joined.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    return joined.groupBy(group).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
