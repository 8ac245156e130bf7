"""Graphs as DataFrames: vertices(id), edges(src, dst) with undirected edges stored both ways."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orequarry.operators.scratch import cut_lineage
from orequarry.operators.similarity import overlap_at_least


def cooccurrence(sets: DataFrame, least: int) -> DataFrame:
    """src, dst both ways: ids that share at least `least` members; ids without a partner are no vertices."""
    pairs = overlap_at_least(sets, least)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select("b", "a"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def both_directions(pairs: DataFrame) -> DataFrame:
    return pairs.select("src", "dst").union(pairs.select("dst", "src")).distinct()


def components(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """id, component: its smallest member. Labels move along edges and then jump to their label's label."""
    now = cut_lineage((ids if ids is not None else vertices(edges)).select("id", F.col("id").alias("component")))
    while True:
        near = edges.join(now.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        moved = now.join(near, "id", "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"))
        far = moved.select(F.col("id").alias("component"), F.col("component").alias("far"))
        after = cut_lineage(moved.join(far, "component").select("id", F.least("component", "far").alias("component")))
        same = after.join(now.withColumnRenamed("component", "before"), "id").where("component <> before").isEmpty()
        now = after
        if same:
            return now


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id, label after `rounds` rounds in which all take their neighbours' most frequent label, ties to the smallest."""
    now = vertices(edges).select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        votes = edges.join(now.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id"), "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("id").agg(F.max(F.struct("n", (-F.col("label")).alias("minus"))).alias("best"))
        now = cut_lineage(best.select("id", (-F.col("best.minus")).alias("label")))
    return now


def communities(labels: DataFrame, label: str) -> DataFrame:
    """members: sorted ids of each label, short communities first."""
    made = labels.groupBy(label).agg(F.array_sort(F.collect_list("id")).alias("members"))
    return made.select("members").orderBy(F.size("members"), "members")


def shortest_paths(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """root, id, level, paths: distance and number of shortest paths from each root, all roots at once."""
    roots = roots if roots is not None else vertices(edges)
    frontier = cut_lineage(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("level"), F.lit(1.0).alias("paths")))
    seen, level = frontier, 0
    while True:
        level += 1
        step = frontier.join(edges, F.col("id") == F.col("src")).groupBy("root", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        fresh = step.join(seen.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", F.lit(level).alias("level"), "paths")
        frontier = cut_lineage(fresh)
        if frontier.isEmpty():
            return seen
        seen = cut_lineage(seen.union(frontier))


def edge_betweenness(edges: DataFrame) -> DataFrame:
    """src < dst, value: the sum over all roots of the flow along each edge, halved."""
    paths = shortest_paths(edges)
    deepest = paths.agg(F.max("level").alias("level")).first()["level"] or 0
    child = paths.select("root", F.col("id").alias("dst"), F.col("level").alias("dl"), F.col("paths").alias("dp"))
    parent = paths.select("root", F.col("id").alias("src"), F.col("level").alias("sl"), F.col("paths").alias("sp"))
    links = cut_lineage(child.join(edges, "dst").join(parent, ["root", "src"]).where("dl = sl + 1").select("root", "src", "dst", "dl", (F.col("sp") / F.col("dp")).alias("share")))
    flows = None
    credit = paths.sparkSession.createDataFrame([], paths.select("root", F.col("id"), F.col("paths").alias("more")).schema)
    for level in range(deepest, 0, -1):  # from the leaves up; a vertex passes on one and what it received
        own = links.where(F.col("dl") == level).join(credit.select("root", F.col("id").alias("dst"), "more"), ["root", "dst"], "left")
        flow = cut_lineage(own.select("root", "src", "dst", (F.col("share") * (1 + F.coalesce("more", F.lit(0.0)))).alias("flow")))
        flows = flow if flows is None else flows.union(flow)
        credit = flow.groupBy("root", F.col("src").alias("id")).agg(F.sum("flow").alias("more"))
    if flows is None:
        return edges.select("src", "dst", F.lit(0.0).alias("value")).where("src < dst")
    total = flows.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg((F.sum("flow") / 2).alias("value"))
    return cut_lineage(total)


def cut_edges(edges: DataFrame, betweenness: DataFrame, all_ties: bool = True) -> DataFrame:
    """edges without those of the highest betweenness: all that tie (to 9 decimals), or only the first."""
    value = F.round("value", 9)
    if all_ties:
        top = betweenness.agg(F.max(value).alias("top"))
        gone = betweenness.join(F.broadcast(top), value == F.col("top")).select("src", "dst")  # one row
    else:
        gone = betweenness.orderBy(F.desc(value), "src", "dst").limit(1).select("src", "dst")
    return edges.join(both_directions(gone), ["src", "dst"], "left_anti")


def modularity(edges: DataFrame, labels: DataFrame, label: str = "component", half_sum: bool = False) -> DataFrame:
    """modularity of a partition of the graph `edges`; half_sum: over unordered pairs only, about half the usual value."""
    place = labels.select("id", F.col(label).alias("c"))
    ends = edges.join(place.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(place.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst")
    per = ends.groupBy(F.col("cs").alias("c")).agg(F.count(F.lit(1)).alias("d"), F.count_if(F.col("cs") == F.col("cd")).alias("inside"))
    if not half_sum:
        total = per.agg(F.sum("d").alias("w"), F.sum("inside").alias("i"), F.sum(F.col("d") * F.col("d")).alias("dd"))
        return total.select((F.col("i") / F.col("w") - F.col("dd") / (F.col("w").cast("double") * F.col("w"))).alias("modularity"))
    squares = degrees(edges).join(place, "id").groupBy("c").agg(F.sum(F.col("degree") * F.col("degree")).alias("own"))
    total = per.join(squares, "c").agg(F.sum("d").alias("w"), F.sum("inside").alias("i"), F.sum(F.col("d") * F.col("d") - F.col("own")).alias("dd"))
    return total.select(((F.col("i") / 2 - F.col("dd") / 2 / F.col("w")) / F.col("w")).alias("modularity"))


def girvan_newman(edges: DataFrame, max_rounds: int | None = None, all_ties: bool = True, half_sum: bool = False) -> tuple[DataFrame, list[float]]:
    """(id, component of the best partition; modularity of each round, the whole graph's components first).

    Betweenness is counted anew each round on what is left; modularity always on the original graph.
    Rounds go on, also while nothing splits, until modularity falls or no edge is left; max_rounds stops earlier.
    """
    ids = cut_lineage(vertices(edges))
    left, best, scores = cut_lineage(edges), None, []
    for done in count():
        found = components(left, ids)
        value = modularity(edges, found, half_sum=half_sum).first()["modularity"]
        if value is None:
            return found, scores
        if not scores or value > max(scores):
            best = found
        falls = bool(scores) and value < scores[-1]
        scores.append(float(value))
        if falls or done == max_rounds or left.isEmpty():
            break
        left = cut_lineage(cut_edges(left, edge_betweenness(left), all_ties))
    return best, scores


def strongest_first(betweenness: DataFrame) -> DataFrame:
    return betweenness.orderBy(F.desc("value"), "src", "dst")
