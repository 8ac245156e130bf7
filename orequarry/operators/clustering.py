"""Cluster summaries and out-of-core clustering by discard, compression and retained sets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orequarry.functions.scalars import scaled_distance
from orequarry.operators.scratch import cut_lineage


def summaries(points: DataFrame, label: str = "cluster") -> DataFrame:
    """label, n, sum, sumsq (arrays): sufficient statistics of each cluster. points: features array<double>."""
    long = points.select(label, F.posexplode("features").alias("pos", "v"))
    per = long.groupBy(label, "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    entries = F.array_sort(F.collect_list(F.struct("pos", "s", "ss")))
    made = per.groupBy(label).agg(F.max("n").alias("n"), entries.alias("e"))
    return made.select(label, "n", F.transform("e", lambda x: x["s"]).alias("sum"), F.transform("e", lambda x: x["ss"]).alias("sumsq"))


def with_centres(stats: DataFrame) -> DataFrame:
    """Adds centre and std; a zero variance counts as a very small one."""
    centre = F.transform("sum", lambda s: s / F.col("n"))
    spread = F.zip_with("sumsq", "centre", lambda ss, c: F.sqrt(F.greatest(ss / F.col("n") - c * c, F.lit(1e-12))))
    return stats.withColumn("centre", centre).withColumn("std", spread)


def nearest(points: DataFrame, stats: DataFrame, label: str = "cluster") -> DataFrame:
    """points with cluster and distance (per-coordinate std) of the nearest summary, ties to the smaller label.

    Summaries are as many as the clusters asked for, a parameter, so they are sent to every task.
    """
    sent = with_centres(stats).select(F.struct(label, "centre", "std").alias("s")).agg(F.collect_list("s").alias("all"))
    joined = points.drop(label).join(F.broadcast(sent), F.lit(True))
    found = F.array_min(F.transform("all", lambda s: F.struct(scaled_distance(F.col("features"), s["centre"], s["std"]).alias("distance"), s[label].alias(label))))
    return joined.withColumn("__n", found).drop("all").select(*points.drop(label).columns, F.col(f"__n.{label}").alias(label), F.col("__n.distance").alias("distance"))


@dataclass
class Summary:
    """One cluster on the driver: statistics only, never points."""

    n: int
    s: np.ndarray
    ss: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        return self.s / self.n

    @property
    def std(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.ss / self.n - self.centre**2, 1e-12))

    def merged(self, other: Summary) -> Summary:
        return Summary(self.n + other.n, self.s + other.s, self.ss + other.ss)


def cluster_distance(a: Summary, b: Summary) -> float:
    """The smaller of the distances in either cluster's own scale."""
    d = a.centre - b.centre
    return float(min(np.sqrt(((d / a.std) ** 2).sum()), np.sqrt(((d / b.std) ** 2).sum())))


def _fit(points: DataFrame, k: int, seed: int, label: str) -> DataFrame:
    vectors = points.withColumn("__v", array_to_vector("features"))
    model = KMeans(k=max(2, k), seed=seed, featuresCol="__v", predictionCol=label, maxIter=20).fit(vectors)
    return model.transform(vectors).drop("__v")


def _pull(stats: DataFrame) -> dict[int, Summary]:
    """Summaries to the driver: as many as clusters, never points."""
    return {int(r["cluster"]): Summary(r["n"], np.array(r["sum"]), np.array(r["sumsq"])) for r in stats.collect()}


def _push(spark, found: dict[int, Summary]) -> DataFrame:
    rows = [(c, x.n, x.s.tolist(), x.ss.tolist()) for c, x in found.items()]
    return spark.createDataFrame(rows, "cluster int, n long, sum array<double>, sumsq array<double>")


def merge_close(found: dict[int, Summary], limit: float, into: dict[int, int]) -> dict[int, Summary]:
    """Merges pairs nearer than limit until none is left; `into` follows where labels went."""
    while True:
        labels = sorted(found)
        hit = next(((a, b) for i, a in enumerate(labels) for b in labels[i + 1 :] if cluster_distance(found[a], found[b]) < limit), None)
        if hit is None:
            return found
        a, b = hit
        found[a] = found[a].merged(found.pop(b))
        into.update({old: a for old, new in list(into.items()) if new == b} | {b: a})


def out_of_core(points: DataFrame, k: int, rounds: int = 5, over: int = 5, least: int = 10, seed: int = 553) -> tuple[DataFrame, list[dict]]:
    """(id, cluster with -1 for outliers; counts of each round). points: id, slice (0..rounds-1), features.

    The first slice is clustered finely; points of clusters below `least` are set aside, the rest makes k discard
    sets. Later slices join the nearest discard set within twice the root of the dimension, else a compression set,
    else they are retained and clustered among themselves. Close compression sets merge; at the end they join discard sets.
    """
    spark = points.sparkSession
    points = cut_lineage(points.select("id", "slice", "features"))
    if points.isEmpty():
        return points.select("id", F.lit(-1).alias("cluster")), []
    limit = 2 * float(np.sqrt(points.select(F.size("features").alias("d")).first()["d"]))
    start = points.where("slice = 0").drop("slice")
    fine = _fit(start, min(over * k, max(2, start.count() - 1)), seed, "cluster")
    sizes = fine.groupBy("cluster").count()
    odd = fine.join(sizes.where(F.col("count") < least), "cluster", "left_semi").drop("cluster")
    core = fine.join(sizes.where(F.col("count") >= least), "cluster", "left_semi").drop("cluster")
    if core.isEmpty():  # too few points for any fine cluster to reach `least`
        core, odd = start, start.limit(0)
    assigned = cut_lineage(_fit(core, k, seed, "cluster").select("id", "cluster"))
    discard = _pull(summaries(points.join(assigned, "id")))
    compressed: dict[int, Summary] = {}
    into: dict[int, int] = {}
    fresh = 1_000_000  # labels of compression sets never meet those of discard sets
    retained, report = cut_lineage(odd.select("id", "features")), []
    for turn in range(rounds):
        if turn:
            batch = points.where(F.col("slice") == turn).drop("slice")
            for own in (discard, compressed):
                if own and not batch.isEmpty():
                    near = cut_lineage(nearest(batch, _push(spark, own)))
                    hit = near.where(F.col("distance") < limit).select("id", "cluster")
                    assigned = cut_lineage(assigned.union(hit))
                    for c, more in _pull(summaries(batch.join(hit, "id"))).items():
                        own[c] = own[c].merged(more)
                    batch = cut_lineage(batch.join(hit, "id", "left_anti"))
            retained = cut_lineage(retained.union(batch.select("id", "features")))
        n = retained.count()
        if n > 2:
            tight = _fit(retained, min(over * k, n - 1), seed, "cluster")
            tight = cut_lineage(tight.join(tight.groupBy("cluster").count().where("count > 1"), "cluster", "left_semi").withColumn("cluster", (F.col("cluster") + fresh).cast("int")))
            fresh += over * k + 1
            compressed |= _pull(summaries(tight))
            assigned = cut_lineage(assigned.union(tight.select("id", "cluster")))
            retained = cut_lineage(retained.join(tight.select("id"), "id", "left_anti"))
            compressed = merge_close(compressed, limit, into)
        report.append({"round": turn + 1, "n_discard": sum(x.n for x in discard.values()), "n_compression": len(compressed), "n_compressed": sum(x.n for x in compressed.values()), "n_retained": retained.count()})
    for c in sorted(compressed):
        best = min(discard, key=lambda d: cluster_distance(discard[d], compressed[c]))
        if cluster_distance(discard[best], compressed[c]) < limit:
            into.update({old: best for old, new in list(into.items()) if new == c} | {c: best})
    moves = spark.createDataFrame([(a, b) for a, b in into.items()], "cluster int, to int")
    final = assigned.join(F.broadcast(moves), "cluster", "left").select("id", F.coalesce("to", "cluster").cast("int").alias("cluster"))
    outliers = retained.select("id", F.lit(-1).alias("cluster"))
    return final.union(outliers), report


def purity(clusters: DataFrame, truth: DataFrame) -> DataFrame:
    """purity: share of points in their cluster's most frequent true label. truth: id, label."""
    per = clusters.join(truth, "id").groupBy("cluster", "label").count()
    best = per.groupBy("cluster").agg(F.max("count").alias("best"), F.sum("count").alias("n"))
    return best.agg((F.sum("best") / F.sum("n")).alias("purity"))
