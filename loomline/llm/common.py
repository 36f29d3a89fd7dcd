"""Helpers shared by the training-data operators: scratch tables, text basics, components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Read from ``spark.checkpoint.dir``. A local folder is made where none is named and all runs on one machine; on a
    cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.sparkContext.setCheckpointDir(_own_dir[app])
    return _own_dir[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/loomline/{name}-{uuid.uuid4().hex}"


#: The setting by which Spark removes what a query has shuffled when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str, compression: str = "uncompressed", tidy: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back; if ``tidy``, what was shuffled for it goes."""
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    if tidy:
        conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)  # mostly hashes, which do not shrink
    finally:
        if tidy:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Give memory that is free back to the system; where the C library has no such call, nothing happens."""
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a Python worker that holds no more memory than it uses: workers live on after a task, and Arrow's own pool keeps what it had."""

    def watched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b
            del b
            trim()

    @functools.wraps(run)
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(watched(batches))
        trim()

    return call


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sheltered(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``run(docs, ...)`` with columns of ``docs`` that begin with two underscores, as the operators' own do, under other names meanwhile."""

    @functools.wraps(run)
    def call(docs: DataFrame, *args, **more) -> DataFrame:
        away = {}
        for c in docs.columns:
            if c.startswith("__"):
                name = f"sheltered{len(away)}"
                while name in docs.columns:
                    name += "_"
                away[c] = name
        return run(docs.withColumnsRenamed(away), *args, **more).withColumnsRenamed({v: k for k, v in away.items()})

    return call


#: Bytes, as JSON, that a table may have to be sent to every executor.
SENT_BYTES = 48 << 20


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint for ``df`` only when it is proven to hold at most ``max_rows`` rows and SENT_BYTES bytes."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and total <= SENT_BYTES else df


#: Edges up to which a graph is connected by one task.
ONE_TASK = 1_000_000


def _connected(edges: DataFrame) -> DataFrame:
    """(node, component) of a graph that is counted to be small, by union-find in one task."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                for x in (a, b):
                    root.setdefault(x, x)
                while root[a] != a:
                    root[a] = a = root[root[a]]
                while root[b] != b:
                    root[b] = b = root[root[b]]
                if a != b:
                    root[max(a, b)] = min(a, b)
        nodes = sorted(root)
        for x in nodes:  # a root is smaller than what points to it, so it is settled before
            root[x] = root[root[x]]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root[x] for x in nodes], pa.int64())], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component = smallest node.

    ``edges`` has long columns (a, b). Nodes without an edge to another do not appear. Up to ``one_task`` edges, a proven
    bound, are connected by one task, which spares many small jobs. More go in rounds: every node moves to that of
    itself and its neighbours whose hash, another one each round, is least, and the edges are contracted along;
    chains shrink by a constant factor whatever their numbering, and stars vanish in two rounds. The rounds'
    pointers are then followed back. All steps are sums and joins that Spark may split where a node has
    very many edges.
    """
    left = store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "edges")
    if left.limit(one_task + 1).count() <= one_task:
        return _connected(left)
    left = store(left.distinct(), "edges")
    steps: list[DataFrame] = []
    while not steps or left.limit(1).count():
        if len(steps) > max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        drawn = lambda c, r=len(steps): F.struct(F.xxhash64(c, F.lit(r)).alias("h"), F.col(c).alias("id"))
        near = left.union(left.select("b", "a")).groupBy("a").agg(F.min(drawn("b")).alias("m"))
        step = store(near.select(F.col("a").alias("v"), F.least(drawn("a"), "m")["id"].alias("to")), "steps")
        steps.append(step)
        moved = left.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").where("x <> y")
        left = store(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    out = steps[-1].toDF("node", "root")
    for step in steps[-2::-1]:  # from the few nodes of the last round to all of the first
        out = step.toDF("node", "__to").join(out.toDF("__to", "__root"), "__to", "left").select("node", F.coalesce("__root", "__to").alias("root"))
    out = store(out, "roots")
    return out.join(out.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
