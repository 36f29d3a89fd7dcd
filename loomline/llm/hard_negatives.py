"""Hard negatives by one-dimensional distance keys.

Vectors of integers get one more component that makes them all equally long, ``sqrt(M - |x|^2)`` with the largest squared norm M;
an anchor gets 0 there. Then ``|q - x|^2 = |q|^2 + M - 2 q.x``: the largest inner products are the nearest vectors. Each vector
belongs to the nearest of its group's pivots (a group is a hash of the label; pivots are learnt from a bounded sample) and is
stored in the order of (pivot, distance to the pivot), cut into blocks of BLOCK vectors with their first and last key.

A row within radius r of an anchor that is ``a`` from a pivot has a key in [a - r, a + r]. The search opens, round by round, the
blocks whose keys lie in the annuli between the last radius and the next one, and ends for an anchor as soon as what it
wants is certified: no row that has not been seen can score above the bound of the radius. The next radius is where the k-th row
found so far would be, beyond which nothing can matter, or a step on the way there. First the positives are searched, in the
blocks of the anchor's group alone; then the negatives, from the score of the first positive down to 80 % of the last one.

Anchors travel to the blocks, never blocks to anchors: a block is read by one task, its anchors pass by in batches, and where
more than ASKED anchors want a block it is read by several. A task holds one block and one batch. Copies, rows with one vector
and one label, are one node that carries its k + 1 smallest ids: ties go to smaller ids, so no answer needs another copy.

Scores are exact: products of integers in double precision while M is below 2^53, else by Python's integers, cut to the
range of long. Keys are widened by more than their rounding. Defined results: rows with a null id, label or vector, an empty
vector, or a null or non-finite component take no part; of rows that repeat an id the one with the least (label, vector) counts; vectors
of another length are not compared; an anchor without positives, or without negatives in range, gives no rows, as does an empty
table. A component beyond the range of long is cut to it. Other columns take no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ann_graph import nodes
from .common import lean, small, store

POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100
#: Groups of labels, pivots of a group at most, rows that pivots are learnt from at most.
GROUPS, PIVOTS, SAMPLE = 32, 8, 4096
#: Share of the best score that can be expected to which the first round looks.
START = 0.9
#: Vectors of a block, anchors that one task passes by a block, blocks of a task.
BLOCK, ASKED, BLOCKS_A_TASK = 1024, 1 << 16, 8
MAX_BLOCKS = 500_000


def rows_of(vectors: DataFrame, vec_id: str, vec: str, label: str) -> DataFrame:
    """(id, label, v): the rows that take part, with their integers."""
    x = F.col(vec).cast("array<double>")
    fit = F.coalesce(F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & (F.size(x) > 0), F.lit(False))
    own = vectors.where(fit & F.col(vec_id).isNotNull() & F.col(label).isNotNull())
    own = own.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(x, lambda a: F.floor(a * 256).cast("long")).alias("v"))
    return own.groupBy("id").agg(F.min(F.struct("label", "v")).alias("m")).select("id", "m.label", "m.v")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def group_of(label: str) -> Column:
    return F.pmod(F.xxhash64(label), F.lit(GROUPS)).cast("int")


class Keys:
    """Pivots by (length, group), and what follows from the largest squared norm."""

    def __init__(self, most: float, pivots: dict[tuple[int, int], np.ndarray]):
        self.most, self.pivots = most, pivots
        self.first: dict[tuple[int, int], int] = {}
        for k in sorted(pivots):
            self.first[k] = sum(len(pivots[x]) for x in self.first)

    @staticmethod
    def learn(most: float, sample: dict[tuple[int, int], np.ndarray]) -> Keys:
        pivots = {}
        for k, x in sample.items():
            x = Keys.longer(x.astype(float), most)
            p = x[np.unique(np.linspace(0, len(x) - 1, PIVOTS).astype(int))]
            for _ in range(8):
                at = Keys.gaps(x, p).argmin(1)
                p = np.stack([x[at == i].mean(0) if (at == i).any() else p[i] for i in range(len(p))])
            pivots[k] = np.unique(p, axis=0)
        return Keys(most, pivots)

    @staticmethod
    def longer(x: np.ndarray, most: float) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))])

    @staticmethod
    def gaps(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Distances of each row of x to each of p."""
        return np.stack([np.sqrt(((x - one) ** 2).sum(1)) for one in p], 1) if len(p) else np.zeros((len(x), 0))

    def of(self, size: int, group: int) -> tuple[int, np.ndarray]:
        """The number of the first pivot of a group, and its pivots; the origin, of number -1, for a group that was not in the sample."""
        k = (size, group)
        return (self.first[k], self.pivots[k]) if k in self.pivots else (-1, np.zeros((1, size + 1)))

    @property
    def slack(self) -> float:
        """More than the rounding of a distance between vectors of these lengths."""
        return 1e-6 * (1 + np.sqrt(self.most))


def stored(rows: DataFrame, keep: int) -> tuple[DataFrame, DataFrame, Keys]:
    """The store (size, group, pivot, key, label, v, ids, block), its directory of blocks, and the keys."""
    packed = rows.select("id", F.struct("label", "v").alias("v"))
    found = nodes(packed, keep).select("v.label", "v.v", "ids", F.size("v.v").alias("size"))
    found = store(found.withColumn("group", group_of("label")), "hard-nodes")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, most = found.agg(F.count("*"), F.coalesce(F.max(norm), F.lit(0.0))).first()
    share = -(-n // SAMPLE) if n else 1
    sample: dict[tuple[int, int], list[list[int]]] = {}
    for r in found.select("size", "group", "v").where(F.expr(f"pmod(xxhash64(ids[0], 7), {share}) = 0")).orderBy(F.xxhash64(F.element_at("ids", 1))).limit(SAMPLE).collect():  # a documented bound
        sample.setdefault((r["size"], r["group"]), []).append(r["v"])
    keys = Keys.learn(most, {k: np.array(x) for k, x in sample.items()})

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, group = b.column("size").to_numpy(), b.column("group").to_numpy()
            pivot, key = np.zeros(len(size), np.int64), np.zeros(len(size))
            for s, g in set(zip(size.tolist(), group.tolist(), strict=True)):
                at = np.flatnonzero((size == s) & (group == g))
                first, p = keys.of(s, g)
                d = Keys.gaps(Keys.longer(matrix(b.column("v").take(pa.array(at))).astype(float), keys.most), p)
                near = d.argmin(1)
                pivot[at], key[at] = first + near, d[np.arange(len(at)), near]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(key)], [*b.schema.names, "pivot", "key"])

    keyed = found.mapInArrow(run, "label long, v array<long>, ids array<long>, size int, group int, pivot long, key double")
    many = max(1, -(-n // (64 * BLOCK)))
    order = ["size", "group", "pivot", "key", F.element_at("ids", 1)]
    sorted_rows = keyed.repartitionByRange(many, *order).sortWithinPartitions(*order)

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nth, block = None, 0, -1
        for b in batches:
            out = []
            for now in zip(*(b.column(c).to_pylist() for c in ("size", "group", "pivot")), strict=True):
                if now != last or nth == BLOCK:
                    last, nth, block = now, 0, block + 1
                nth += 1
                out.append(block)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "nth"])

    blocks = sorted_rows.mapInArrow(cut, "label long, v array<long>, ids array<long>, size int, group int, pivot long, key double, nth long")
    blocks = store(blocks.withColumn("block", F.expr("shiftleft(cast(spark_partition_id() as bigint), 32) + nth")).drop("nth"), "hard-store")
    directory = blocks.groupBy("size", "group", "pivot", "block").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    return blocks, small(store(directory, "hard-blocks"), MAX_BLOCKS), keys


def opened(asking: DataFrame, directory: DataFrame, keys: Keys, same_group: bool) -> DataFrame:
    """(block, id): the blocks whose keys lie in an anchor's annuli between ``inner`` (opened before) and ``outer``."""
    pairs = sorted(keys.pivots) if keys.pivots else []

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, group = b.column("size").to_numpy(), b.column("group").to_numpy()
            for s in np.unique(size).tolist():
                of = np.flatnonzero(size == s)
                x = matrix(b.column("v").take(pa.array(of))).astype(float)
                x = np.column_stack([x, np.zeros(len(x))])
                lost = [(s, g) for g in range(GROUPS) if (s, g) not in keys.pivots]
                for k in [p for p in pairs if p[0] == s] + lost:
                    own = group[of] == k[1] if same_group else np.ones(len(of), bool)
                    if not own.any():
                        continue
                    first, p = keys.of(*k)
                    d = Keys.gaps(x[own], p)
                    rows, cols = np.indices(d.shape).reshape(2, -1)
                    at = of[own][rows]
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id").take(pa.array(at)), pa.array(np.full(n, s), pa.int32()), pa.array(np.full(n, k[1]), pa.int32()), pa.array(first + cols), pa.array(d.reshape(-1)), b.column("inner").take(pa.array(at)), b.column("outer").take(pa.array(at))],
                        ["id", "size", "group", "pivot", "d", "inner", "outer"])

    places = asking.select("id", "size", "group", "v", "inner", "outer").mapInArrow(run, "id long, size int, group int, pivot long, d double, inner double, outer double")
    near = F.greatest(F.lit(0.0), F.col("low") - F.col("d"), F.col("d") - F.col("high"))  # no row of the block is nearer
    return places.join(directory, ["size", "group", "pivot"]).withColumn("near", near).where("near <= outer and near > inner").select("block", "id")


def scored(asking: DataFrame, blocks: DataFrame, wanted: DataFrame, keys: Keys, same_label: bool) -> DataFrame:
    """(id, nth, score, other): of each block what may be among an anchor's answers.

    The positives (nth 0), or the negatives of the nth positive: at most k of a block, by score and id.
    """
    asks = store(wanted.join(asking.select("id", "label", "v", "bounds"), "id"), "hard-asks")
    per = store(asks.groupBy("block").agg(F.count("*").alias("n")).withColumn("parts", F.expr(f"cast((n - 1) div {ASKED} + 1 as int)")).drop("n"), "hard-parts")
    tasks = -(-(per.agg(F.sum("parts")).first()[0] or 1) // BLOCKS_A_TASK)
    per = small(per, MAX_BLOCKS)
    ask = asks.join(per, "block").select("block", F.expr("cast(pmod(xxhash64(id), parts) as int)").alias("part"), F.lit(1).alias("kind"), "id", "label", "v", "bounds", F.lit(None).cast("array<long>").alias("ids"))
    have = blocks.join(per, "block").select("block", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "label", "v", F.lit(None).cast("array<long>").alias("bounds"), "ids")
    k = POSITIVES if same_label else NEGATIVES
    exact = keys.most < 2**53

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for b in batches:
            block, part, kind = (b.column(c).to_numpy() for c in ("block", "part", "kind"))
            cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), b.num_rows]
            for s, e in itertools.pairwise(cuts):
                if s == e:
                    continue
                if kind[s] == 0:
                    if now != (block[s], part[s]):
                        now, held, ready = (block[s], part[s]), [], None
                    held.append(b.slice(s, e - s))
                elif now == (block[s], part[s]):
                    if ready is None:
                        t = pa.Table.from_batches(held).combine_chunks()
                        ids = t.column("ids").combine_chunks()
                        ready = (matrix(t.column("v")), t.column("label").to_numpy(), ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy()))
                        held = []
                    for at in range(s, e, 1024):
                        yield answers(b.slice(at, min(1024, e - at)), *ready)

    def answers(asked: pa.RecordBatch, x: np.ndarray, labels: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        q = matrix(asked.column("v"))
        products = (q.astype(float) @ x.T.astype(float)).astype(np.int64) if exact else np.clip(q.astype(object) @ x.T.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)
        first, own, own_label = np.cumsum(sizes) - sizes, asked.column("id").to_numpy(), asked.column("label").to_numpy()
        out = [(np.zeros(0, np.int64),) * 4]
        for i, bounds in enumerate(asked.column("bounds").to_pylist()):
            s = products[i]
            alike = labels == own_label[i]
            for nth, top in enumerate(bounds or [None]):
                if same_label:
                    at = np.flatnonzero(alike)
                else:  # 80 top <= 100 s <= 100 top
                    at = np.flatnonzero(~alike & (s <= top) & (s >= -(-LOW * top // HIGH)))
                if len(at) > k + 1:  # the anchor's own row may be one; ties stay until ids are compared
                    at = at[s[at] >= np.partition(s[at], len(at) - k - 1)[len(at) - k - 1]]
                if not len(at):
                    continue
                n = sizes[at]
                to = np.cumsum(n)
                who = ids[np.repeat(first[at] - to + n, n) + np.arange(to[-1])]
                score = np.repeat(s[at], n)[who != own[i]]
                who = who[who != own[i]]
                best = np.lexsort((who, -score))[:k]
                out.append((np.full(len(best), own[i]), np.full(len(best), nth), score[best], who[best]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["id", "nth", "score", "other"])

    both = have.unionByName(ask).repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "kind")
    return both.mapInArrow(run, "id long, nth long, score long, other long")


def best(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by id, nth order by score desc, other)"))
    return ranked.where(F.col("rank") <= k)


def step(keys: Keys, score: Column) -> Column:
    """The radius that certifies all rows of at least this score; without end for a null score."""
    r = F.sqrt(F.greatest(F.col("norm") + F.lit(keys.most) - 2 * score.cast("double"), F.lit(0.0))) + F.lit(keys.slack)
    return F.coalesce(r, F.lit(float("inf")))


def scan(anchors: DataFrame, blocks: DataFrame, directory: DataFrame, keys: Keys, same_label: bool) -> DataFrame:
    """(id, nth, score, other, rank): the positives of each anchor (nth 0), or the negatives of its nth positive.

    ``anchors`` has (id, label, size, group, v, norm, start, bounds): the score to which the first round looks, and the positives' scores.
    """
    k, found = POSITIVES if same_label else NEGATIVES, None
    left = store(anchors.withColumn("inner", F.lit(-1.0)).withColumn("outer", step(keys, F.col("start"))), "hard-left")
    # the least score that still matters: that of the k-th row found, or the end of the range of negatives
    least = "array(cast(kth[0L] as double))" if same_label else f"transform(bounds, (t, i) -> if(t < 0, double('Infinity'), greatest({LOW / HIGH}D * t - 1D, coalesce(cast(kth[cast(i as long)] as double), -double('Infinity')))))"
    while found is None or left.limit(1).count():
        new = scored(left, blocks, opened(left, directory, keys, same_label), keys, same_label)
        found = store(best(new if found is None else found.drop("rank").unionByName(new), k), "hard-found")
        kth = found.where(F.col("rank") == k).groupBy("id", "nth").agg(F.min("score").alias("s")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("nth", "s"))).alias("kth"))  # at most k entries
        rest = left.join(kth, "id", "left").withColumn("goal", step(keys, F.expr(f"array_min({least})"))).where("goal > outer")
        # half of the way at first, as nearer rows bring the goal nearer, then all of it
        outer = F.when((F.col("inner") < 0) & (F.col("goal") < float("inf")), (F.col("goal") + F.col("outer")) / 2).otherwise(F.col("goal"))
        left = store(rest.withColumns({"inner": F.col("outer"), "outer": outer}).drop("kth", "goal"), "hard-left")
    return found


def mine(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows ``id`` that ``anchor`` chooses."""
    rows = store(rows_of(vectors, vec_id, vec, label), "hard-rows")
    blocks, directory, keys = stored(rows, max(POSITIVES, NEGATIVES) + 1)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    own = rows.where(anchor).withColumns({"size": F.size("v"), "group": group_of("label"), "norm": norm})
    positives = scan(own.withColumns({"start": F.col("norm") * START, "bounds": F.lit(None).cast("array<long>")}), blocks, directory, keys, True)
    bounds = positives.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("bounds"))  # at most k
    start = F.expr(f"{START}D * array_min(filter(bounds, t -> t >= 0))")
    negatives = scan(own.join(bounds.where("exists(bounds, t -> t >= 0)"), "id").withColumn("start", start), blocks, directory, keys, False)
    of = positives.select(F.col("id").alias("anchor_id"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).cast("long").alias("nth"))
    return negatives.withColumnsRenamed({"id": "anchor_id", "other": "negative_id", "score": "negative_score"}).join(of, ["anchor_id", "nth"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def report(vectors: DataFrame) -> DataFrame:
    noisy = vectors.select("vec_id", "embedding", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"))
    return mine(noisy, F.col("id") % 100 == 0)


ORACLE = f"""
with r as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id as a, b.id as b, a.label = b.label as alike, list_dot_product(a.v, b.v)::bigint as score from r a join r b on a.id <> b.id and len(a.v) = len(b.v) where a.id % 100 = 0),
p as (select a, b as positive_id, score as positive_score from s where alike qualify row_number() over (partition by a order by score desc, b) <= {POSITIVES})
select p.a as anchor_id, positive_id, (row_number() over (partition by p.a, positive_id order by s.score desc, s.b))::int as rank, s.b as negative_id, positive_score, s.score as negative_score
from p join s on p.a = s.a and not s.alike and {LOW} * positive_score <= {HIGH} * s.score and s.score <= positive_score
qualify row_number() over (partition by p.a, positive_id order by s.score desc, s.b) <= {NEGATIVES}
"""
