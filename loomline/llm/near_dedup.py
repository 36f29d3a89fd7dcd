"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct 5-word shingles. Each shingle gives every register one value,
exponentially distributed and drawn in ascending intervals, in an order of registers of its own
(a register per interval); a register keeps the least value, cut to a power of b = 1.001. Equal
registers are about as likely as the Jaccard similarity J, sketches of parts merge by maximum, and a
document needs only as many intervals as fill its registers.

1. One pass makes (set hash, size, band hashes, low bytes of 126 registers) of each document; equal sets become one class.
2. Bands of six registers are buckets. Each member of a bucket meets only the bucket's hub, its smallest
   class, and a pair that meets in many bands is tried once, so the work is linear in the members. Members that agree
   with the hub in HIGH of the 126 bytes leave the bucket, those that agree in fewer, down to a bound, join its family
   but stay. By the triangle inequality of 1 - J the bound is so low that two classes that link cannot be
   parted by this (to 4.5 deviations), whatever the size of the bucket. Buckets whose members now are of one family are
   done; in the others the rest goes on with four times as many hubs.
3. Members of a family come together with their full sets and registers, in blocks that bound the memory. In a block J
   is estimated jointly by maximum likelihood from the numbers of greater, smaller and equal registers, and pairs whose
   estimate can reach the limit are confirmed on full sets in order of their estimate, unless confirmed links
   connect them already: a block emits no more links than rows. A family of several blocks sends its most central
   members (those in the largest buckets) to every block. Only members that this leaves outside the family's
   largest component are then compared with its other blocks.
4. Components of the confirmed links.

A pair at the limit shares no band with a probability of 2e-6. There is no cap on members of a bucket, a family or a class.

Defined results: null or wordless text has an empty set and links with nothing; fewer than five words
are one shingle; repeated rows are copies; rows that share an id are one node; a row without id is
kept, links with nothing and has no component; an empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lean, sheltered, small, store
from .langid import buffers, slices
from .ngram_lm import tokens
from .token_files import mix

SHINGLE, REGISTERS, RATE = 5, 331, 20.0
B = 1.001
MAX_REGISTER = (1 << 16) - 1
#: Registers in a band, and the probability that a pair at the limit shares none.
ROWS, MISS = 6, 2e-6
#: Registers whose low bytes are compared to place a class with a hub, seven to a long; the share of equal ones with which it leaves the bucket.
SIGNS, HIGH = 126, 0.55
#: Bounds of a block: rows, and shingles in all. Central members that are sent to all blocks of a family.
BLOCK_ROWS, BLOCK_SHINGLES, CENTRAL = 1024, 400_000, 8
MAX_SENT = 1_000_000


def bands_for(percent: int) -> int:
    """Bands of ROWS registers."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after another, and the offsets of the texts in them."""
    t, counts = tokens(data, offsets)
    edge = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        h = np.zeros(len(t), np.uint64)
        for k in range(SHINGLE):
            n = max(len(t) - k, 0)  # a batch may hold fewer words
            h[:n] = mix(h[:n] * np.uint64(0x9E3779B97F4A7C15) + t[k:], 11)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i in range(len(counts)):
        words = int(counts[i]) - 1  # without the end
        if not words:
            continue
        if words >= SHINGLE:
            s = np.sort(h[edge[i] : edge[i] + words - SHINGLE + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            s = np.array([words], np.uint64)
            for x in t[edge[i] : edge[i] + words]:
                with np.errstate(over="ignore"):
                    s = mix(s * np.uint64(0x9E3779B97F4A7C15) + x, 12)
        out.append(s)
        sizes[i] = len(s)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def sketch(h: np.ndarray, offsets: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers [sets, m] (uint16) of sets of hashes; an empty set has zeros. m is a prime."""
    n = len(offsets) - 1
    least = np.full((n, m), np.inf, "f4")
    of = np.repeat(np.arange(n), np.diff(offsets))
    at, stride = (mix(h, 21) % np.uint64(m)).astype(np.int64), (mix(h, 22) % np.uint64(m - 1)).astype(np.int64) + 1
    level, row = 0, of * m
    flat = least.reshape(-1)
    while len(h) and level < m:
        for _ in range(1 + level // 4):
            if level == m:
                break
            u = (mix(h, 1000 + level) >> np.uint64(40)).astype("f4") * np.float32(2.0**-24)
            np.minimum.at(flat, row + at, u + np.float32(level))
            at += stride
            at[at >= m] -= m
            level += 1
        some = np.unique(of)
        wanting = np.zeros(n, bool)
        wanting[some] = ~np.isfinite(least[some]).all(1)
        left = wanting[of]
        h, of, row, at, stride = h[left], of[left], row[left], at[left], stride[left]
    with np.errstate(divide="ignore"):
        x = -np.log1p(-np.minimum(least.astype("f8"), m * (1 - 1e-12)) / m) / RATE
        k = np.floor(1 - np.log(x) / np.log(B))
    k = np.clip(k + 20_000, 0, MAX_REGISTER).astype(np.uint16)  # so that small sets do not fall under 0
    k[np.diff(offsets) == 0] = 0
    return k


def estimate(equal: np.ndarray, more: np.ndarray, less: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """The J of greatest likelihood for pairs of sets of nu and nv members with so many equal, greater and smaller registers."""
    u, v = nu / (nu + nv), nv / (nu + nv)
    top = np.minimum(u, v) / np.maximum(u, v)
    f, log_b = (B - 1) / B, np.log(B)
    low, high = np.zeros(len(u)), top.copy()
    for _ in range(24):
        j = (low + high) / 2
        a, b = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        pa_, pb = -np.log1p(-a * f) / log_b, -np.log1p(-b * f) / log_b
        da, db = -v * f / (1 - a * f) / log_b, -u * f / (1 - b * f) / log_b
        slope = more * da / pa_ + less * db / pb - equal * (da + db) / np.maximum(1 - pa_ - pb, 1e-12)
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2


def compare(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Estimated J of each row of x with the same row of y."""
    return estimate((x == y).sum(1), (x > y).sum(1), (x < y).sum(1), nx.astype("f8"), ny.astype("f8"))


def band_hashes(k: np.ndarray, bands: int) -> np.ndarray:
    """A hash [sets, bands] of each band of ROWS registers."""
    x = k[:, : bands * ROWS].reshape(len(k), bands, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(k), bands))
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[:, :, j], 70)
    return h


def signs(k: np.ndarray) -> np.ndarray:
    """The low bytes of the first SIGNS registers, seven to a long [sets, SIGNS / 7]."""
    out = np.zeros((len(k), SIGNS // 7, 8), np.uint8)
    out[:, :, :7] = k[:, :SIGNS].astype(np.uint8).reshape(len(k), -1, 7)
    return out.view(np.int64)[:, :, 0]


def describe(docs: DataFrame, key: str, text: str, bands: int) -> DataFrame:
    """(doc_id, n, h1, h2, b0.., s0..) of each row: size and hashes of the set, band hashes, low bytes of registers."""
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    names = ["doc_id", "n", "h1", "h2", *(f"b{i}" for i in range(bands)), *(f"s{i}" for i in range(SIGNS // 7))]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "t"):
                h, offsets = shingles(*buffers(b.column("t")))
                k = sketch(h, offsets)
                n = np.diff(offsets)
                sums = []
                for seed in (31, 32):
                    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h, seed), dtype=np.uint64)])
                    with np.errstate(over="ignore"):
                        sums.append((s[offsets[1:]] - s[offsets[:-1]]).view(np.int64))
                columns = [*band_hashes(k, bands).view(np.int64).T, *signs(k).T]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), *(pa.array(np.ascontiguousarray(c)) for c in (*sums, *columns))], names)

    return src.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def least_estimate(percent: int) -> float:
    """An estimate under this is 4.5 deviations under the limit."""
    limit = percent / 100
    return limit - 4.5 * (limit * (1 - limit) / REGISTERS) ** 0.5


def families(classes: DataFrame, bands: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, component): families of classes that may link, without those of one class; and (rep, weight), how central each is."""
    sign = [f"s{i}" for i in range(SIGNS // 7)]
    side = classes.select("rep", *sign)
    left = classes.select("rep", F.explode(F.array(*[f"b{i}" for i in range(bands)])).alias("bucket"))
    apart = " + ".join(f"bit_count(((((x.{c} ^ y.{c}) & {0x7F7F7F7F7F7F7F}L) + {0x7F7F7F7F7F7F7F}L) | (x.{c} ^ y.{c})) & {0x80808080808080}L)" for c in sign)
    loss = 1 - percent / 100
    low = HIGH - loss - 4.5 * (loss / SIGNS) ** 0.5
    edges = weights = None
    hubs = 1
    while True:
        buckets = left.groupBy("bucket").agg(F.count("*").alias("k"), *[F.min(F.expr(f"if(pmod(xxhash64(rep), {hubs}) = {i}, rep, null)")).alias(f"hub{i}") for i in range(hubs)]).where("k > 1")
        met = left.join(buckets, "bucket").select("bucket", "rep", "k", F.array_compact(F.array(*[f"hub{i}" for i in range(hubs)])).alias("hubs"))
        members = store(met, "near-members")
        if weights is None:
            weights = members.groupBy("rep").agg(F.sum("k").alias("weight"))
        tried = members.select(F.explode("hubs").alias("hub"), "rep").where("hub <> rep").distinct()
        tried = tried.join(side.select(F.col("rep").alias("hub"), F.struct(*sign).alias("x")), "hub").join(side.select("rep", F.struct(*sign).alias("y")), "rep")
        found = store(tried.select("hub", "rep", F.expr(f"{SIGNS} - ({apart})").alias("same")).where(f"same >= {low * SIGNS:.3f}"), "near-plausible")
        own = found.select(F.col("hub").alias("a"), F.col("rep").alias("b"))
        edges = own if edges is None else edges.union(own)
        gone = found.where(f"same >= {HIGH * SIGNS:.3f}").groupBy("rep").agg(F.collect_set("hub").alias("near"))
        rest = members.where("not array_contains(hubs, rep)").join(gone, "rep", "left").where("near is null or not arrays_overlap(hubs, near)").select("rep", "bucket")
        family = store(components(edges), "near-family")
        edges = family.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        rest = store(rest.join(family.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "bucket", F.coalesce("component", "rep").alias("f")), "near-rest")
        split = rest.groupBy("bucket").agg(F.min("f").alias("x"), F.max("f").alias("y")).where("x <> y").select("bucket")
        left = store(rest.join(split, "bucket").select("rep", "bucket"), "near-left")
        if not left.limit(1).count():
            return family, weights
        hubs *= 4


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """The runs of rows that agree in ``columns``."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy() for c in columns])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(k[:, s].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _link(t: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that connect the rows of one unit as far as links do.

    Rows of kind 0 are compared with one another; rows of kind 1 with those of kind 2, where their labels differ."""
    t = t.combine_chunks()
    rep, n, kind, label = (t.column(c).to_numpy() for c in ("rep", "n", "kind", "label"))
    raw = t.column("hashes").to_pylist()
    head = np.array([np.frombuffer(x, np.int64, 1)[0] for x in raw])
    _, order = np.unique(np.stack([kind.astype(np.int64), rep, n, head]), axis=1, return_index=True)  # a central row meets itself in its own block
    rep, n, kind, label = rep[order], n[order], kind[order], label[order]
    sets = [np.frombuffer(raw[i], np.uint64) for i in order.tolist()]
    offsets = np.concatenate([[0], np.cumsum(n)])
    k = np.empty((len(rep), REGISTERS), np.uint16)
    s = 0
    while s < len(rep):  # some 50,000 shingles at a time, or one set
        e = max(s + 1, int(np.searchsorted(offsets, offsets[s] + 50_000)))
        k[s:e] = sketch(np.concatenate(sets[s:e]), offsets[s : e + 1] - offsets[s])
        s = e
    cut = int(np.searchsorted(kind, 2)) if kind[-1] == 2 else 0
    floor = least_estimate(percent)
    left, right = [], []
    for i in range(cut or len(rep)):
        others = np.arange(cut or i + 1, len(rep))
        others = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
        if cut:
            others = others[label[others] != label[i]]
        if len(others):
            others = others[(k[others] == k[i]).sum(1) >= (floor - 0.05) * REGISTERS]
            left.append(np.full(len(others), i))
            right.append(others)
    if not left:
        return []
    i, j = np.concatenate(left), np.concatenate(right)
    j_est = np.concatenate([compare(k[i[s : s + 4096]], k[j[s : s + 4096]], n[i[s : s + 4096]], n[j[s : s + 4096]]) for s in range(0, len(i), 4096)]) if len(i) else np.zeros(0)
    by = np.argsort(-j_est, kind="stable")
    by = by[j_est[by] >= floor]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    node = label if cut else rep
    for a, b in zip(i[by].tolist(), j[by].tolist(), strict=True):
        ra, rb = find(int(node[a])), find(int(node[b]))
        if ra != rb:
            x, y = (sets[a], sets[b]) if len(sets[a]) < len(sets[b]) else (sets[b], sets[a])
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if 100 * both >= percent * (len(x) + len(y) - both):
                root[ra] = rb
                out.append((int(rep[a]), int(rep[b])))
    return out


def confirmed(docs: DataFrame, placed: DataFrame, percent: int, key: str, text: str) -> DataFrame:
    """(a, b): links within the units of ``placed`` (rep, family, units, kind, label); units: structs (i, j)."""
    src = docs.select(F.col(key).cast("long").alias("rep"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    src = src.join(small(placed, MAX_SENT), "rep")
    rest = ["rep", "family", "units", "kind", "label"]

    @lean
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "t"):
                h, offsets = shingles(*buffers(b.column("t")))
                raw = [h[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(np.diff(offsets)), pa.array(raw, pa.binary())], [*rest, "n", "hashes"])

    full = src.select(*rest, "t").mapInArrow(sets, "rep long, family long, units array<struct<i:int,j:int>>, kind int, label long, n long, hashes binary").where("n > 0")
    units = full.withColumn("unit", F.explode("units")).select("family", "unit.i", "unit.j", "rep", "n", "kind", "label", "hashes")
    units = units.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["family", "i", "j"]):
            if found := _link(t, percent):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return store(units.mapInArrow(run, "a long, b long"), "near-links")


def links(docs: DataFrame, classes: DataFrame, percent: int, key: str, text: str) -> DataFrame:
    """(a, b): confirmed links between classes, enough to connect what is connected."""
    family, weights = families(classes, bands_for(percent), percent)
    sizes = family.withColumnsRenamed({"node": "rep", "component": "family"}).join(classes.select("rep", "n"), "rep").join(weights, "rep", "left")
    sizes = store(sizes, "near-family")
    many = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int")
    own = store(sizes.join(sizes.groupBy("family").agg(many.alias("blocks")), "family").withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)")), "near-placed")
    central = own.where("blocks > 1").groupBy("family", F.expr(f"pmod(xxhash64(rep, 1), {CENTRAL})")).agg(F.max(F.struct("weight", "rep")).alias("c")).select(F.col("c.rep").alias("rep"), F.lit(True).alias("central"))
    one = "transform({0}, i -> struct(i as i, 0 as j))"
    placed = own.join(central, "rep", "left").select("rep", "family", F.expr(f"if(central, {one.format('sequence(0, blocks - 1)')}, {one.format('array(block)')})").alias("units"), F.lit(0).alias("kind"), F.col("rep").alias("label"))
    found = confirmed(docs, store(placed, "near-units"), percent, key, text)
    wide = own.where("blocks > 1").select("rep", "n", "family", "blocks", "block")
    if not wide.limit(1).count():
        return found
    labels = store(wide.join(components(found).withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component"), "near-parts")
    parts = labels.groupBy("family", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    parts = store(parts.join(parts.groupBy("family").agg(F.max(F.struct("c", "label")).alias("m")), "family").where("label <> m.label").select("family", "label", "c", "s"), "near-strays")
    if not parts.limit(1).count():
        return found
    teams = parts.groupBy("family").agg(F.greatest(F.ceil(F.sum("s") / BLOCK_SHINGLES), F.ceil(F.sum("c") / BLOCK_ROWS)).cast("int").alias("teams"))
    rest = labels.join(teams, "family").join(parts.select("family", "label", F.lit(True).alias("stray")), ["family", "label"], "left").withColumn("team", F.expr("cast(pmod(xxhash64(rep), teams) as int)"))
    strays = rest.where("stray").select("rep", "family", F.expr("transform(sequence(0, blocks - 1), j -> struct(team as i, j as j))").alias("units"), F.lit(1).alias("kind"), "label")
    whole = rest.select("rep", "family", F.expr("transform(sequence(0, teams - 1), i -> struct(i as i, block as j))").alias("units"), F.lit(2).alias("kind"), "label")
    return found.union(confirmed(docs, store(strays.union(whole), "near-units"), percent, key, text))


def groups(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    bands = bands_for(percent)
    all_rows = store(describe(docs, key, text, bands), "near-rows")
    own = all_rows.where("n > 0 and doc_id is not null")
    rest = [c for c in all_rows.columns if c not in ("doc_id", "n", "h1", "h2")]
    classes = store(own.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in rest]), "near-classes")
    same_id = own.select("doc_id", "h1", "h2").distinct().join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    nodes = classes.select("rep").distinct().withColumnRenamed("rep", "b")
    found = links(docs, classes, percent, key, text).union(same_id.join(nodes, "b").select("a", "b"))
    labels = store(components(found), "near-labels")
    of = classes.select("h1", "h2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = all_rows.select("doc_id", "n", "h1", "h2").join(of, ["h1", "h2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.expr("case when doc_id is not null then if(n > 0, coalesce(component, doc_id), doc_id) end").alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    return groups(docs, 85).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


@sheltered
def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that are not of the smallest id of their group; their own columns.

    Where ids repeat, rows of an id with different texts are judged apart; of those that repeat an id and an
    empty set one stays."""
    if not docs.groupBy(key).count().where(f"count > 1 and `{key}` is not null").limit(1).count():
        gone = groups(docs, percent, key, text).where("doc_id <> component_id").select(F.col("doc_id").alias("__k")).distinct()
        return docs.join(small(gone, MAX_SENT), F.col(key).cast("long") == F.col("__k"), "left_anti")
    own = F.col(key).cast("long")
    marked = docs.withColumn("__node", F.when(F.col(key).isNotNull(), F.xxhash64(own, F.col(text))))
    named = marked.where("__node is not null")
    ids = named.select("__node", own.alias("__id")).distinct()
    found = groups(named, percent, "__node", text).select(F.col("doc_id").alias("__node"), (F.col("n_shingles") > 0).alias("full"), "component_id").distinct()
    team = found.join(ids, "__node").groupBy("full", F.when(F.col("full"), F.col("component_id")).otherwise(F.col("__id")).alias("team"))
    stay = store(team.agg(F.min(F.struct("__id", "__node")).alias("first")).select(F.col("first.__node").alias("__node")), "near-stay")
    left = named.join(stay, "__node", "left_semi").dropDuplicates(["__node"])
    return left.unionByName(marked.where("__node is null")).select(*[f"`{c}`" for c in docs.columns])
