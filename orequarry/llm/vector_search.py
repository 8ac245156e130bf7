"""Approximate nearest neighbours by inner product: a robust-pruned directed graph in each shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orequarry.llm.storage import materialize

#: Edges of a node, slack of the pruning, beam while building and queries that walk together.
DEGREE, ALPHA, BUILD_BEAM, TOGETHER = 32, 1.2, 64, 256


def lifted(x: np.ndarray) -> np.ndarray:
    """One more coordinate that makes all norms equal, so that the largest inner product is the least distance."""
    norms = np.einsum("ij,ij->i", x, x)
    return np.hstack([x, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]]).astype(np.float32)


def beam_search(points: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances (without the query's own norm) of each query's beam, nearest first; -1 where there are fewer.

    All queries walk at once: in a step each opens its `wide` nearest unopened nodes and looks at their edges.
    """
    n, many = len(points), len(queries)
    norms = np.einsum("ij,ij->i", points, points)
    seen = np.zeros((many, n + 1), bool)
    seen[:, n] = True  # where missing edges point
    beam = min(beam, n)
    ids = np.full((many, beam + len(starts)), n)
    dist = np.full(ids.shape, np.inf, np.float32)
    opened = np.ones(ids.shape, bool)
    ids[:, : len(starts)] = starts
    dist[:, : len(starts)] = norms[starts] - 2 * queries @ points[starts].T
    opened[:, : len(starts)] = False
    seen[:, starts] = True
    order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
    ids, dist, opened = (np.take_along_axis(x, order, 1) for x in (ids, dist, opened))
    live = np.arange(many)
    while len(live):
        unopened = np.where(opened[live], np.inf, dist[live])
        pick = np.argsort(unopened, axis=1, kind="stable")[:, :wide]
        good = np.isfinite(np.take_along_axis(unopened, pick, 1))
        live, pick, good = live[good.any(1)], pick[good.any(1)], good[good.any(1)]
        if not len(live):
            break
        opened[live[:, None], pick] |= good
        node = np.where(good, ids[live[:, None], pick], n)
        reach = np.where(node[:, :, None] < n, edges[np.minimum(node, n - 1)], n).reshape(len(live), -1)
        reach = np.sort(reach, axis=1)
        fresh = ~seen[live[:, None], reach]
        fresh[:, 1:] &= reach[:, 1:] != reach[:, :-1]
        seen[live[:, None], reach] = True
        safe = np.where(fresh, reach, 0)
        d = norms[safe] - 2 * np.matmul(points[safe], queries[live][:, :, None])[:, :, 0]
        d = np.where(fresh, d, np.inf)
        all_ids, all_dist = np.hstack([ids[live], reach]), np.hstack([dist[live], d])
        all_open = np.hstack([opened[live], ~fresh])
        order = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        ids[live], dist[live], opened[live] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_dist, all_open))
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    return np.where(np.isfinite(dist), ids, -1), dist


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges of each node of `own` from its row of candidates (-1: none): the nearest first, and after each choice
    those that are alpha times nearer to it than to the node drop out."""
    n = len(points)
    safe = np.maximum(candidates, 0)
    gap = points[safe] - points[own][:, None, :]
    d = np.einsum("ijk,ijk->ij", gap, gap)
    d = np.where((candidates < 0) | (candidates == own[:, None]), np.inf, d)
    order = np.argsort(d, axis=1, kind="stable")
    candidates, d = np.take_along_axis(safe, order, 1), np.take_along_axis(d, order, 1)
    near = points[candidates]
    norms = np.einsum("ijk,ijk->ij", near, near)
    between = np.maximum(norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(near, near.transpose(0, 2, 1)), 0)
    alive, out, taken = np.isfinite(d), np.full((len(own), degree), n), np.zeros(len(own), np.int64)
    for i in range(candidates.shape[1]):
        choose = np.flatnonzero(alive[:, i] & (taken < degree))
        if not len(choose):
            continue
        out[choose, taken[choose]] = candidates[choose, i]
        taken[choose] += 1
        alive[choose] &= alpha * alpha * between[choose, i] > d[choose]
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Edges (len(points) where a node has fewer) and start nodes. Points join in doubling groups: greedy searches of
    the graph so far propose neighbours, pruning keeps diverse ones, and edges back are pruned in turn."""
    n = len(points)
    draw = np.random.default_rng(seed)
    order = draw.permutation(n)
    centre = points.mean(0)
    middle = int(np.argmin(((points - centre) ** 2).sum(1)))
    starts = np.unique(np.concatenate([[middle], order[: min(n, 16)]]))
    edges = np.full((n, degree), n)
    rest = order[~np.isin(order, starts)]
    first = robust_prune(points, starts, np.tile(starts, (len(starts), 1)), degree, alpha)
    edges[starts] = first
    done = 0
    while done < len(rest):
        group = rest[done : done + min(TOGETHER, max(16, done + len(starts)))]
        found, _ = beam_search(points, edges, starts, points[group], beam)
        mates = np.tile(group[None, :32], (len(group), 1)) if len(group) > 1 else np.full((1, 1), -1)
        edges[group] = robust_prune(points, group, np.hstack([found, mates]), degree, alpha)
        target, source = edges[group].ravel(), np.repeat(group, degree)
        target, source = target[target < n], source[target < n]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        while len(target):  # edges back, a bounded number for each node at a time
            begin = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            place = np.arange(len(target)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(target)]])))
            now = place < degree
            nodes = target[begin]
            extra = np.full((len(nodes), degree), -1)
            extra[np.searchsorted(nodes, target[now]), place[now]] = source[now]
            have = np.where(edges[nodes] < n, edges[nodes], -1)
            full = (have >= 0).sum(1) + (extra >= 0).sum(1) > degree
            for low in range(0, int(full.sum()), TOGETHER):
                pick = np.flatnonzero(full)[low : low + TOGETHER]
                edges[nodes[pick]] = robust_prune(points, nodes[pick], np.hstack([have[pick], extra[pick]]), degree, alpha)
            easy = np.sort(np.hstack([np.where(have >= 0, have, n), np.where(extra >= 0, extra, n)])[~full], axis=1)
            easy[:, 1:] = np.where(easy[:, 1:] == easy[:, :-1], n, easy[:, 1:])
            edges[nodes[~full]] = np.sort(easy, axis=1)[:, :degree]
            target, source = target[~now], source[~now]
        done += len(group)
    return edges, starts


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]) if column.num_chunks else np.empty(0)
    return flat.reshape(len(column), -1).astype(np.float64)


def _build(degree: int, alpha: float, beam: int):
    def run(table: pa.Table) -> pa.Table:
        x = lifted(_matrix(table["vector"]))
        n = len(x)
        edges, starts = build_graph(x, degree, alpha, beam)
        is_start = np.zeros(n, bool)
        is_start[starts] = True
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * edges.shape[1], pa.int32()), pa.array(edges.ravel(), pa.int32()))
        for name, column in (("node", pa.array(np.arange(n), pa.int32())), ("edges", lists), ("is_start", pa.array(is_start))):
            table = table.append_column(name, column)
        return table.select(["shard", "node", "vector", "ids", "edges", "is_start"])

    return run


def _search(k: int, beam: int):
    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(shard) or not len(asked):
            return empty
        shard = shard.sort_by("node")
        exact = _matrix(shard["vector"])
        points = lifted(exact)
        starts = np.flatnonzero(shard["is_start"].to_numpy())
        edges = np.array(shard["edges"].to_pylist(), np.int64)
        ids, query_ids, queries = shard["ids"].to_pylist(), asked["query_id"].to_numpy(), _matrix(asked["vector"])
        out_q, out_v, out_s = [], [], []
        for low in range(0, len(queries), TOGETHER):
            own = queries[low : low + TOGETHER]
            padded = np.hstack([own, np.zeros((len(own), 1))]).astype(np.float32)
            found, _ = beam_search(points, edges, starts, padded, max(beam, k + 1))
            found = found[:, : 2 * (k + 1)]  # ordered in single precision, so a few more than asked are rescored
            scores = (exact[np.maximum(found, 0)] * own[:, None, :]).sum(axis=2)
            for i, (nodes, row) in enumerate(zip(found.tolist(), scores.tolist(), strict=True)):
                query = int(query_ids[low + i])
                best = sorted((-s, v) for node, s in zip(nodes, row, strict=True) if node >= 0 for v in ids[node] if v != query)[:k]
                out_q += [query] * len(best)
                out_v += [v for _, v in best]
                out_s += [-s for s, _ in best]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (array<double>) of the rows that take part."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))


def nearest_vectors(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    shard_rows: int = 8192,
    block_queries: int = 8192,
    beam: int = 128,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest by inner product, ties to the smaller id.

    vectors and queries have the same two columns; a query is no candidate of its own. Rows with a null
    id, a null or zero vector or null or non-finite components take no part; vectors of other lengths
    than the query's are no candidates. With fewer candidates than k all are given. Rows that repeat
    an id and vector count once. Other columns are ignored; no rows give no rows.

    Equal vectors are one node that carries its k + 1 smallest ids, which is all that a result can
    hold, however many copies there are. Nodes are dealt to shards of about `shard_rows`; each shard
    builds its graph once and stores it. Blocks of queries then walk every shard, and the best of all
    shards are merged. Scores are inner products of the given vectors in double precision.
    """
    rows = usable(vectors, id_col, vector_col).distinct()
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    nodes = materialize(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    shards = nodes.groupBy(F.size("vector").alias("length")).agg(F.expr(f"greatest(1, ceil(count(1) / {shard_rows}))").alias("shards"))
    place = F.pmod(F.xxhash64("vector"), F.col("shards"))
    dealt = nodes.withColumn("length", F.size("vector")).join(F.broadcast(shards), "length")  # one row per vector length
    dealt = dealt.select(F.struct("length", place.alias("number")).alias("shard"), "vector", "ids")
    kind = "shard struct<length: int, number: bigint>, node int, vector array<double>, ids array<bigint>, edges array<int>, is_start boolean"
    graph = materialize(dealt.groupBy("shard").applyInArrow(_build(DEGREE, ALPHA, BUILD_BEAM), kind))
    asked = usable(queries, id_col, vector_col).distinct().select(F.col("vec_id").alias("query_id"), "vector")
    blocks = max(1, -(-asked.count() // block_queries))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("length", F.size("vector")).join(F.broadcast(shards), "length")
    asked = asked.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    asked = asked.select(F.struct("length", "number").alias("shard"), "block", "query_id", "vector")
    index = graph.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_search(k, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
