"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of the vectors.

Equal vectors are one point of the index; each point keeps its smallest row ids, as many as an answer can name. Points are
dealt to shards of bounded size by a hash. In a shard all points start with random neighbours. Then, in batches, a greedy
beam search from the middle proposes neighbours for each point; going through them from near to far, one is kept and
strikes out all that are closer to it, by the factor `ALPHA`, than to the point. Kept edges are also entered backwards,
and a point with too many is pruned in the same way. A search runs a beam in every shard, and the answers are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.session import settle

DEGREE, BEAM, AT_ONCE, ALPHA = 24, 48, 4, 1.2
SHARD_ROWS, QUERY_BLOCK, BATCH = 4096, 512, 512
SEARCH_BEAM = 80
ENTRIES = 8  # nearest starting points that a search begins with


def distances(points: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of each query (B x d) to its own candidates (B x k ids)."""
    gap = points[ids] - queries[:, None, :]
    return np.einsum("bkd,bkd->bk", gap, gap)


def spread(points: np.ndarray) -> np.ndarray:
    """Starting points: the one nearest to the mean, then always the one farthest from those taken, twice the root of all."""
    taken = [int((points**2).sum(axis=1).argmin())]
    gap = ((points - points[taken[0]]) ** 2).sum(axis=1)
    while len(taken) < 2 * np.sqrt(len(points)) and gap.max() > 0:
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[taken[-1]]) ** 2).sum(axis=1))
    return np.array(taken)


def beam_search(points: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ids and squared distances of the best points met, nearest first; -1 fills up.

    A query begins with its nearest starting points. All queries go on together: each opens its nearest unopened points until
    its beam holds opened ones only.
    """
    n, b = len(points), len(queries)
    met = np.zeros((b, n + 1), dtype=bool)
    met[:, n] = True
    ids = np.full((b, beam), n)
    gaps = np.full((b, beam), np.inf, dtype=points.dtype)
    all_starts = np.broadcast_to(starts, (b, len(starts)))
    far = distances(points, all_starts, queries)
    first = np.argsort(far, axis=1, kind="stable")[:, :ENTRIES]
    m = first.shape[1]
    ids[:, :m], gaps[:, :m] = starts[first], np.take_along_axis(far, first, axis=1)
    met[np.arange(b)[:, None], ids[:, :m]] = True
    opened = np.ones((b, beam), dtype=bool)
    opened[:, :m] = False
    live = np.arange(b)
    while len(live):
        waiting = np.where(opened[live], np.inf, gaps[live])
        pick = np.argsort(waiting, axis=1, kind="stable")[:, :AT_ONCE]
        real = np.isfinite(np.take_along_axis(waiting, pick, axis=1))
        keep = real.any(axis=1)
        live, pick, real = live[keep], pick[keep], real[keep]
        if not len(live):
            break
        rows = live[:, None]
        chosen = np.where(real, ids[rows, pick], n)
        opened[rows, pick] = True
        near = graph[chosen].reshape(len(live), -1)
        near = np.where(met[rows, near], n, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        met[rows, near] = True
        far = distances(points, np.minimum(near, n - 1), queries[live])
        far[near == n] = np.inf
        all_ids, all_gaps = np.concatenate((ids[live], near), axis=1), np.concatenate((gaps[live], far), axis=1)
        all_opened = np.concatenate((opened[live], near == n), axis=1)
        order = np.argsort(all_gaps, axis=1, kind="stable")[:, :beam]
        ids[live], gaps[live] = np.take_along_axis(all_ids, order, axis=1), np.take_along_axis(all_gaps, order, axis=1)
        opened[live] = np.take_along_axis(all_opened, order, axis=1)
    return np.where(np.isfinite(gaps), ids, -1), gaps


def prune(points: np.ndarray, own: np.ndarray, ids: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Diverse neighbours of each point among its candidates (B x k, -1 fills up), at most `degree`; n fills up."""
    n = len(points)
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    ids[ids == own[:, None]] = -1
    gaps = distances(points, np.maximum(ids, 0), points[own])
    gaps[ids < 0] = np.inf
    order = np.argsort(gaps, axis=1, kind="stable")[:, : 4 * degree]
    ids, gaps = np.take_along_axis(ids, order, axis=1), np.take_along_axis(gaps, order, axis=1)
    some = points[np.maximum(ids, 0)] - points[own][:, None, :]  # near its point: products lose no digits of close neighbours
    size = np.einsum("bkd,bkd->bk", some, some)
    between = size[:, :, None] + size[:, None, :] - 2 * some @ some.transpose(0, 2, 1)
    left = ids >= 0
    out = np.full((len(own), degree), n)
    rows = np.arange(len(own))
    for k in range(degree):
        first = left.argmax(axis=1)
        any_left = left[rows, first]
        if not any_left.any():
            break
        out[any_left, k] = ids[any_left, first[any_left]]
        left &= alpha**2 * between[rows, first] > gaps
        left[rows, first] = False
    return out


def centred(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """`others` seen from the mean of `points`: keeps all digits of distances for clouds far from the origin."""
    return others - points.mean(axis=0)


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each centred point (n x degree, n fills up; one more row for the filler) and the points to start from."""
    n = len(points)
    rng = np.random.default_rng(seed)
    graph = np.full((n + 1, degree), n)
    if n > 1:
        graph[:n, : min(degree, n - 1)] = rng.integers(0, n, (n, min(degree, n - 1)))
    starts = spread(points)
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for s in range(0, n, BATCH):
            own = order[s : s + BATCH]
            found, _ = beam_search(points, graph, starts, points[own], beam)
            old = np.where(graph[own] == n, -1, graph[own])
            graph[own] = prune(points, own, np.concatenate((found, old), axis=1), alpha, degree)
            source, target = np.repeat(own, degree), graph[own].ravel()
            source, target = source[target < n], target[target < n]
            by = np.lexsort((((points[source] - points[target]) ** 2).sum(axis=1), target))
            source, target = source[by], target[by]
            heads, first, count = np.unique(target, return_index=True, return_counts=True)
            nth = np.arange(len(target)) - np.repeat(first, count)
            near = nth < 2 * degree  # of very many edges into one point the nearest stand for all
            more = np.full((len(heads), 2 * degree), -1)
            more[np.repeat(np.arange(len(heads)), count)[near], nth[near]] = source[near]
            for t in range(0, len(heads), BATCH):
                h = heads[t : t + BATCH]
                old = np.where(graph[h] == n, -1, graph[h])
                graph[h] = prune(points, h, np.concatenate((old, more[t : t + BATCH]), axis=1), alpha, degree)
    return graph, starts


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_points(vectors: DataFrame, keep: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`point` (smallest row id of the vector), `v`, `dim`, and `members`: the `keep` smallest row ids.

    Ids are ranked per vector, which Spark trims before the shuffle, so a very common vector is no large group.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        usable(F.col("v")) & F.col("vec_id").isNotNull())
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero
    once = rows.groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("n")).drop("n")
    first = once.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= keep)
    return first.groupBy("v").agg(F.min("vec_id").alias("point"), F.sort_array(F.collect_list("vec_id")).alias("members")).select(
        "point", "v", F.size("v").alias("dim"), "members")


def build_index(points: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: `dim, shard`, its points' ids, vectors, graph and starts, written to the shared folder."""
    sizes = points.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))
    dealt = points.join(sizes, "dim").select("dim", F.pmod(F.xxhash64("point"), F.col("shards")).alias("shard"), "point", "v")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("point")
        v = np.stack(g["v"].to_numpy())
        graph, starts = build_graph(centred(v, v))
        return pd.DataFrame({"dim": [int(g["dim"].iloc[0])], "shard": [int(g["shard"].iloc[0])], "n": [len(g)], "starts": [starts.astype("<i4").tobytes()],
                             "ids": [g["point"].to_numpy().astype("<i8").tobytes()], "vectors": [v.astype("<f8").tobytes()],
                             "graph": [graph.astype("<i4").tobytes()]})

    tasks = sizes.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0]  # a shard is much work on few bytes: no merging of tasks
    made = dealt.repartition(int(tasks), "dim", "shard").groupBy("dim", "shard").applyInPandas(
        run, "dim int, shard long, n int, starts binary, ids binary, vectors binary, graph binary")
    return settle(made, "vamana")


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """`q, point, score`: for each query (`q`, `v`, `dim`) the `k` nearest points found in every shard.

    Queries go in blocks; a block meets each shard of its dimension once, in a task of its own.
    """
    many = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    shards = index.groupBy("dim").agg(F.count(F.lit(1)).alias("shards"))
    asked = queries.join(many, "dim").join(shards, "dim").select(
        "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"),
        F.pmod(F.xxhash64("q"), F.col("blocks")).alias("block"), "q", "v")
    offered = index.join(many, "dim").select(
        "dim", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "n", "starts", "ids",
        "vectors", "graph")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q": np.zeros(0, np.int64), "point": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(left) or not len(right):
            return empty
        r = left.iloc[0]
        n = int(r["n"])
        exact = np.frombuffer(r["vectors"], "<f8").reshape(n, -1)
        ids, graph = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["graph"], "<i4").reshape(n + 1, -1).astype(np.int64)
        asked_for = np.stack(right["v"].to_numpy())
        starts = np.frombuffer(r["starts"], "<i4").astype(np.int64)
        found, _ = beam_search(centred(exact, exact), graph, starts, centred(exact, asked_for), max(beam, 2 * k))
        gap = np.sqrt(((exact[np.maximum(found, 0)] - asked_for[:, None, :]) ** 2).sum(axis=2))
        gap[found < 0] = np.inf
        point = np.where(found < 0, np.iinfo(np.int64).max, ids[np.maximum(found, 0)])
        order = np.lexsort((point, gap))[:, :k]
        gap, point = np.take_along_axis(gap, order, axis=1), np.take_along_axis(point, order, axis=1)
        fine = np.isfinite(gap)
        return pd.DataFrame({"q": np.repeat(right["q"].to_numpy(), fine.sum(axis=1)), "point": point[fine], "score": gap[fine]})

    key = ["dim", "shard", "block"]
    return offered.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(run, "q long, point long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`query_id, rank, vec_id, score`: the `k` nearest rows found for each query row, by Euclidean distance.

    `is_query` is a condition on the column `vec_id`. A row is never its own neighbour; ties go to the smaller id. Rows
    with a null id or an unusable vector take no part. Vectors of different lengths are never neighbours. A repeated id
    with one vector is one row. Other columns are ignored; an empty table gives an empty frame. All is double precision, from
    the mean of a shard, so scale and place of the vectors do not matter as long as squared distances are finite.
    """
    points = settle(distinct_points(vectors, k + 1, vec_id, vector), "points")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        is_query & usable(F.col("v"))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    asked = rows.dropDuplicates(["vec_id", "v"]).select(F.col("vec_id").alias("q"), "v", F.size("v").alias("dim"))
    found = search_index(build_index(points), asked, k + 1)
    near = Window.partitionBy("q").orderBy("score", "point")
    best = found.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)
    rows = best.join(points.select("point", "members"), "point").select(
        F.col("q").alias("query_id"), F.explode("members").alias("vec_id"), "score").where(F.col("vec_id") != F.col("query_id"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
