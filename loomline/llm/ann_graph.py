"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard of vectors.

Each distinct vector is a node. From a random graph, points are inserted in batches: a greedy beam search
from the medoid proposes candidates, and relaxed pruning keeps the nearest candidate and drops those
that are nearer to a kept one by the factor ``alpha`` than to the point; reverse edges are added and
pruned alike. Two passes (alpha 1, then 1.2). A query runs a beam search in every shard; distances of
what it finds are computed anew in double precision and the shards' answers merged.

Shards hold about SHARD vectors, so building parallelises and its memory is bounded; a query's cost
grows with the number of shards. Vectors that are equal are one node that carries its ``k + 1`` smallest
ids: ties go to smaller ids, so no answer of k needs another copy.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, as query or candidate; vectors of another length are not compared; a query never finds its own
row, but finds equal vectors at distance 0; fewer candidates than k give fewer rows; rows that repeat
an id count once; an empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, store
from .near_dedup import _runs

SHARD, QUERY_BLOCK = 4096, 2048
DEGREE, BEAM_BUILD, BEAM_SEARCH, ALPHA, WIDTH = 32, 64, 128, 1.2, 4


def distances(x: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of each row of q to the rows ``at`` of x."""
    v = x[at]
    v -= q[:, None, :]
    return np.einsum("ijk,ijk->ij", v, v)


def beam(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, distances, expanded) of the best ``length`` found for each query; expanded: all nodes whose edges were followed, -1 to fill."""
    n, rows = len(x), len(q)
    ids, d = np.full((rows, length), -1), np.full((rows, length), np.inf, "f4")
    ids[:, 0], d[:, 0] = entry, distances(x, q, np.full((rows, 1), entry))[:, 0]
    open_ = np.zeros((rows, length), bool)
    open_[:, 0] = True
    seen = np.zeros((rows, n), bool)
    seen[:, entry] = True
    trail = []
    own = np.arange(rows)
    while len(own):
        best = np.argsort(np.where(open_[own], d[own], np.inf), axis=1, kind="stable")[:, :WIDTH]
        r = own[:, None]
        live = open_[r, best]
        open_[r, best] = False
        p = np.where(live, ids[r, best], -1)
        step = np.full((rows, WIDTH), -1)
        step[own] = p
        trail.append(step)
        near = np.where((p >= 0)[:, :, None], graph[p], -1).reshape(len(own), -1)
        near.sort(axis=1)
        near = near[:, (near >= 0).any(0)]
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[r, near]
        at = np.where(fresh, near, 0)
        seen[np.broadcast_to(r, at.shape)[fresh], near[fresh]] = True
        got = np.where(fresh, distances(x, q[own], at), np.inf)
        all_d, all_ids = np.concatenate([d[own], got], 1), np.concatenate([ids[own], np.where(fresh, near, -1)], 1)
        all_open = np.concatenate([open_[own], fresh], 1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :length]
        k = np.arange(len(own))[:, None]
        d[own], ids[own], open_[own] = all_d[k, keep], all_ids[k, keep], all_open[k, keep]
        own = own[open_[own].any(1)]
    return ids, d, np.concatenate(trail, 1) if trail else np.full((rows, 1), -1)


def prune(x: np.ndarray, points: np.ndarray, found: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Out-edges [points, degree] chosen from the candidates ``found`` [points, any], -1 to fill."""
    found = np.sort(np.where(found == points[:, None], -1, found), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    v = x[np.maximum(found, 0)]
    to_point = v - x[points][:, None, :]
    d = np.where(found >= 0, np.einsum("ijk,ijk->ij", to_point, to_point), np.inf)
    alive = found >= 0
    out = np.full((len(points), degree), -1)
    k = np.arange(len(points))
    for i in range(degree):
        best = np.where(alive, d, np.inf).argmin(1)
        ok = alive[k, best]
        if not ok.any():
            break
        out[:, i] = np.where(ok, found[k, best], -1)
        gap = v - v[k, best][:, None, :]
        alive &= alpha * alpha * np.einsum("ijk,ijk->ij", gap, gap) > d
        alive[k, best] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, length: int = BEAM_BUILD, seed: int = 3, batch: int = 256) -> tuple[np.ndarray, int]:
    """The graph [n, degree] and its entry point."""
    n, rng = len(x), np.random.default_rng(seed)
    graph = rng.integers(0, n, (n, degree)) if n > 1 else np.full((n, degree), -1)
    graph[graph == np.arange(n)[:, None]] = -1
    centre = x.mean(0, keepdims=True)
    entry = int(distances(x, centre, np.arange(n)[None, :])[0].argmin())
    for alpha in (1.0, ALPHA) if n > 1 else ():
        order = rng.permutation(n)
        for s in range(0, n, batch):
            p = order[s : s + batch]
            ids, _, trail = beam(x, graph, entry, x[p], length)
            graph[p] = prune(x, p, np.concatenate([trail, ids, graph[p]], 1), alpha, degree)
            to, of = graph[p].ravel(), np.repeat(p, degree)
            to, of = to[to >= 0], of[to >= 0]
            by = np.argsort(to, kind="stable")
            to, of = to[by], of[by]
            q, first, count = np.unique(to, return_index=True, return_counts=True)
            for c in np.unique(np.minimum(count, 2 * degree)):  # points with about as many new edges together
                some = np.flatnonzero(np.minimum(count, 2 * degree) == c)
                most = int(count[some].max())
                k = np.arange(most)[None, :]
                new = np.where(k < count[some][:, None], of[np.minimum(first[some][:, None] + k, len(of) - 1)], -1)
                both = np.concatenate([graph[q[some]], new], 1)
                for t in range(0, len(some), 512):
                    graph[q[some[t : t + 512]]] = prune(x, q[some[t : t + 512]], both[t : t + 512], alpha, degree)
    return repaired(x, graph, entry, length), entry


def reached(graph: np.ndarray, entry: int) -> np.ndarray:
    """Which nodes a walk along edges from the entry point reaches."""
    seen = np.zeros(len(graph), bool)
    seen[entry] = True
    front = np.array([entry])
    while len(front):
        near = np.unique(graph[front])
        near = near[near >= 0]
        front = near[~seen[near]]
        seen[front] = True
    return seen


def repaired(x: np.ndarray, graph: np.ndarray, entry: int, length: int, least: int = 2, room: int = 8) -> np.ndarray:
    """The graph with extra edges, so that each node is reached and has ``least`` incoming edges from near nodes.

    A round adds at most ``room`` edges to a node, which bounds the width of the table.
    """
    n = len(x)
    for _ in range(64):
        lost = ~reached(graph, entry)
        poor = lost | (np.bincount(graph[graph >= 0], minlength=n) < min(least, n - 1))
        poor[entry] = False
        p = np.flatnonzero(poor)
        if not len(p):
            break
        of, to = [], []
        for s in range(0, len(p), 512):
            own = p[s : s + 512]
            near, d, _ = beam(x, graph, entry, x[own], length)
            near = np.where(near == own[:, None], -1, near)
            rank = np.cumsum(near >= 0, axis=1)
            ok = (near >= 0) & (rank <= least)
            of.append(near[ok])
            to.append(np.broadcast_to(own[:, None], near.shape)[ok])
        of, to = np.concatenate(of), np.concatenate(to)
        by = np.argsort(of, kind="stable")
        of, to = of[by], to[by]
        q, first, count = np.unique(of, return_index=True, return_counts=True)
        k = np.arange(len(of)) - np.repeat(first, count)
        more = np.full((n, min(room, int(count.max()))), -1)
        more[of[k < room], k[k < room]] = to[k < room]
        graph = np.concatenate([graph, more], 1)
        if not lost.any():
            break
    return graph


def valid(v: Column) -> Column:
    x = v.cast("array<double>")
    return F.coalesce(
        F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists(x, lambda a: a != 0), F.lit(False))


def nodes(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each distinct vector with its k smallest ids."""
    salted = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = salted.withColumn("r", F.expr("row_number() over (partition by v, salt order by id)")).where(F.col("r") <= k)
    second = first.withColumn("r", F.expr("row_number() over (partition by v order by id)")).where(F.col("r") <= k)
    return second.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def index(vectors: DataFrame, k: int, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """A stored table with a row for each shard: its vectors, ids and graph, packed."""
    rows = vectors.where(valid(F.col(vec)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    found = store(nodes(rows, k + 1).withColumn("dim", F.size("v")), "ann-nodes")
    counts = {r["dim"]: r["count"] for r in found.groupBy("dim").count().collect()}
    shards = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, -(-n // SHARD))]) if counts else F.create_map(F.lit(0), F.lit(1))
    dealt = found.withColumn("shard", F.pmod(F.xxhash64(F.element_at("ids", 1)), shards[F.col("dim")]).cast("int"))
    # a task for each shard: without a number Spark would join several small ones
    dealt = dealt.repartition(max(1, sum(-(-n // SHARD) for n in counts.values())), "dim", "shard").sortWithinPartitions("dim", "shard")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["dim", "shard"]):
            t = t.combine_chunks()
            v = t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            ids = t.column("ids").combine_chunks()
            sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
            graph, entry = build(v.astype("f4"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([t.column("dim")[0].as_py()], pa.int32()), pa.array([t.column("shard")[0].as_py()], pa.int32()), pa.array([entry], pa.int32()),
                 *(pa.array([a.tobytes()], pa.binary()) for a in (v, graph.astype("<i4"), ids.flatten().to_numpy(), sizes))],
                ["dim", "shard", "entry", "vectors", "graph", "ids", "sizes"])

    return store(dealt.select("dim", "shard", "v", "ids").mapInArrow(run, "dim int, shard int, entry int, vectors binary, graph binary, ids binary, sizes binary"), "ann-index")


def search(shards: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query row, other rows only."""
    q = queries.where(valid(F.col(vec)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).distinct()
    q = q.withColumn("dim", F.size("v"))
    blocks = -(-max(1, q.count()) // QUERY_BLOCK)
    spread = shards.groupBy("dim").agg(F.max("shard").alias("last"))
    q = q.join(spread, "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.expr("sequence(0, last)"))).drop("last")
    at = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        dim = left.column("dim")[0].as_py()
        own = left.column("id").to_numpy()
        v = left.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        x = np.frombuffer(right.column("vectors")[0].as_py()).reshape(-1, dim)
        graph = np.frombuffer(right.column("graph")[0].as_py(), "<i4").reshape(len(x), -1)
        ids, sizes = (np.frombuffer(right.column(c)[0].as_py(), np.int64) for c in ("ids", "sizes"))
        first = np.cumsum(sizes) - sizes
        out = []
        for s in range(0, len(own), 512):
            found, _, _ = beam(x.astype("f4"), graph, right.column("entry")[0].as_py(), v[s : s + 512].astype("f4"), max(BEAM_SEARCH, 2 * k))
            for i, near in enumerate(found):
                near = near[near >= 0]
                gap = x[near] - v[s + i]
                d = np.sqrt((gap * gap).sum(1))
                n = sizes[near]
                to = np.cumsum(n)
                who = ids[np.repeat(first[near] - to + n, n) + np.arange(to[-1])]
                d = np.repeat(d, n)[who != own[s + i]]
                who = who[who != own[s + i]]
                best = np.lexsort((who, d))[:k]
                out.append((np.full(len(best), own[s + i]), who[best], d[best]))
        return pa.table([np.concatenate(a) for a in zip(*out, strict=True)], schema=schema)

    found = q.groupBy("dim", "shard", "block").cogroup(at.groupBy("dim", "shard", "block")).applyInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # an id counts once, at its nearest vector
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def report(vectors: DataFrame, k: int = 10) -> DataFrame:
    return search(index(vectors, k), vectors.where("vec_id % 100 = 0"), k)
