"""Writers: reports, CSV and text layouts; all are distributed and none gathers rows on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON, one object per row."""
    report.write.mode("overwrite").json(path)


def write_csv(table: DataFrame, path: str) -> None:
    """CSV with a header: similarity (business_id_1, business_id_2, similarity), predictions, city means and the like."""
    table.write.mode("overwrite").option("header", True).csv(path)


def write_city_means(means: DataFrame, path: str) -> None:
    """city, stars with the mean rounded half-even to one decimal."""
    write_csv(means.select("city", F.bround("stars", 1).alias("stars")), path)


def itemset_text(items: Column) -> Column:
    """('a') for one item, ('a', 'b') for more."""
    return F.concat(F.lit("('"), F.array_join(items, "', '"), F.lit("')"))


def write_itemsets(itemsets: DataFrame, path: str) -> None:
    """One line for each section and size: the itemsets of the size, in order. itemsets: section, items."""
    sized = itemsets.select("section", F.size("items").alias("size"), "items")
    lines = sized.orderBy("section", "size", "items").select("section", "size", itemset_text(F.col("items")).alias("value"))
    lines.write.mode("overwrite").partitionBy("section", "size").text(path)


def edge_text(src: Column, dst: Column, value: Column) -> Column:
    """('u', 'v'), value with five decimals at most."""
    return F.concat(F.lit("('"), src, F.lit("', '"), dst, F.lit("'), "), F.round(value, 5).cast("string"))


def write_betweenness(edges: DataFrame, path: str) -> None:
    edges.orderBy(F.desc("value"), "src", "dst").select(edge_text(F.col("src"), F.col("dst"), F.col("value"))).write.mode("overwrite").text(path)


def community_text(members: Column) -> Column:
    return F.concat(F.lit("'"), F.array_join(F.array_sort(members), "', '"), F.lit("'"))


def write_communities(communities: DataFrame, path: str) -> None:
    """One sorted list of members a line, short ones first. communities: members."""
    ordered = communities.orderBy(F.size("members"), F.array_sort("members"))
    ordered.select(community_text(F.col("members"))).write.mode("overwrite").text(path)


def append_batch(path: str):
    """A foreachBatch function that appends a micro-batch's rows as CSV."""

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").option("header", True).csv(path)

    return append


def write_clusters(rounds: DataFrame, points: DataFrame, path: str) -> None:
    """Counts of each round, and point, cluster (-1: outlier)."""
    write_csv(rounds, f"{path}/rounds")
    write_csv(points, f"{path}/points")


def write_alignment(alignment: DataFrame, path: str) -> None:
    """cost, both strings, milliseconds and memory, one object a row."""
    write_report(alignment, path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
