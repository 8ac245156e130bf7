"""Registering queries with their SQL, and the views that many of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries and SQL of one module."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """user, item, stars: a customer's mean quantity from a supplier; by_user: dealt out by user, for what is grouped by user next."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if by_user:
        joined = joined.select("o_custkey", "l_suppkey", "l_quantity").repartition("o_custkey")
    return joined.groupBy(F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item")).agg(F.avg("l_quantity").alias("stars"))


RATINGS_SQL = """ratings AS (
  SELECT o_custkey AS "user", l_suppkey AS item, avg(l_quantity) AS stars
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def small_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ratings with stars on the scale 1 to 5, dealt out by user."""
    return ratings(spark, sf_dir, by_user=True).withColumn("stars", F.col("stars") / 10.0)


SMALL_RATINGS_SQL = RATINGS_SQL.replace("avg(l_quantity) AS", "avg(l_quantity) / 10.0 AS")


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """basket, items: the sorted brands of an order."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("l_orderkey").alias("basket")).agg(F.array_sort(F.collect_set("p_brand")).alias("items"))


BASKET_ROWS_SQL = """basket_rows AS (
  SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def supplier_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, member: the distinct suppliers of a customer."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_custkey").alias("id"), F.col("l_suppkey").alias("member")).distinct()


SETS_SQL = """sets AS (
  SELECT DISTINCT o_custkey AS id, l_suppkey AS member FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def hashed(key: str | Column, *salt) -> Column:
    """A non-negative 32-bit number from md5, the same in SQL engines."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.lit(s) for s in salt], F.col(key).cast("string") if isinstance(key, str) else key)), 1, 8), 16, 10).cast("long")


def hashed_sql(key: str, *salt) -> str:
    parts = ", ".join([f"'{s}'" for s in salt] + [f"CAST({key} AS VARCHAR)"])
    return f"(('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::BIGINT)"
