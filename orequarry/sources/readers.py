"""Readers: text, JSON lines, rating and transaction CSV, points, generators, saved models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orequarry.functions.scalars import doubled
from orequarry.sources import schemas


def read_text(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Lines as `value`; `partitions` deals them out evenly."""
    lines = spark.read.text(path)
    return lines.repartition(partitions) if partitions else lines


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines of any size; the files are split, so nothing is read in chunks by hand."""
    return spark.read.schema(schema).json(path)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.REVIEW)


def read_businesses(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.BUSINESS)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.USER)


def read_ratings(spark: SparkSession, path: str, with_stars: bool = True, business_first: bool = False) -> DataFrame:
    """user_id, business_id[, stars] of a CSV with a header; business_first swaps the ids."""
    table = spark.read.option("header", True).option("enforceSchema", True).schema(schemas.RATING).csv(path)
    ids = ["business_id", "user_id"] if business_first else ["user_id", "business_id"]
    return table.select(*ids, *(["stars"] if with_stars else []))


def read_baskets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(schemas.BASKET).csv(path)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """date_customer, product: quoted CSV; the century and leading zeros are dropped."""
    raw = spark.read.option("header", True).option("quote", '"').csv(path)
    day, customer, product = (F.btrim(F.col(f"`{raw.columns[i]}`"), F.lit('"')) for i in (0, 1, 5))
    return raw.select(F.concat_ws("-", short_year(day), customer.cast("long").cast("string")).alias("date_customer"), product.cast("long").cast("string").alias("product"))


def short_year(day: Column) -> Column:
    """M/D/YYYY as M/D/YY."""
    return F.concat(day.substr(F.lit(1), F.length(day) - 4), F.right(day, F.lit(2)))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """id, label, features of a CSV without header and with any number of features."""
    parts = F.split("value", ",")
    return spark.read.text(path).where(F.length("value") > 0).select(
        parts[0].cast("int").alias("id"), parts[1].cast("int").alias("label"), F.slice(parts, 3, F.size(parts) - 2).cast("array<double>").alias("features")
    )


def slices(points: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """Adds `slice` 0..n-1: a shuffled split into n nearly equal parts, the same at every run."""
    return points.withColumn("slice", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col))), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """user_id, business_id, prediction: an answer file is a table joined by key, not by line."""
    return spark.read.option("header", True).schema("user_id string, business_id string, prediction double").csv(path)


def draws(lines: DataFrame, key: str, batches: int, size: int, seed: int = 553) -> DataFrame:
    """batch_id, seq, value: `size` uniform draws with replacement for each of `batches`, by keyed hashes.

    Row numbers of the lines are dealt in hash ranges, so drawing is an equi-join and no line file is held by a task.
    """
    from orequarry.operators.relational import dictionary

    index = dictionary(lines, key)
    n = index.count()
    spark = lines.sparkSession
    asks = spark.range(batches * size).select((F.col("id") / size).cast("long").alias("batch_id"), F.col("id").alias("seq"))
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("seq"))), 1, 12), 16, 10).cast("long"), F.lit(max(n, 1)))
    return asks.withColumn("index", pick).join(index, "index").select("batch_id", "seq", F.col(key).alias("value"))


def read_generated(spark: SparkSession, path: str) -> DataFrame:
    """a, b: two strings per file, each a line of letters and lines of positions that double it in turn."""
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    grow = lambda done, line: F.when(line.rlike("^[A-Za-z]+$"), F.concat(done, F.array(line))).otherwise(
        F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(doubled(F.element_at(done, -1), F.array(line.cast("int")))))
    )
    made = spark.read.text(path, wholetext=True).select(F.aggregate(lines, F.array().cast("array<string>"), grow).alias("s"))
    return made.select(F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))


def from_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of numbers with NaN and null as 0."""
    table = spark.read.parquet(path)
    return table.select(*[F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c) if t in ("double", "float") else F.coalesce(F.col(c), F.lit(0)).alias(c) for c, t in table.dtypes])


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
