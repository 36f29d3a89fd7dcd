"""Sharding by extendible hashing (DataFrame operations only).

The directory is indexed by the leading bits of a key's hash. A bucket that holds more bytes than the
limit splits on its next bit, any other stays as it is, until every shard fits.

Hash: the first 60 bits of md5 over the key's text, so that SQL engines agree on it. To find the
splits without a pass for each bit, the rows are first summed into cells of ``depth`` bits, chosen so
that a mean cell holds 1/64 of the limit, and cells are merged to the shallowest prefixes that fit. Cells that
are themselves above the limit and hold more than one hash go through the same step, deeper. ``directory`` lists the slots.

Defined results: null or empty text has 0 bytes; a null key has the hash of ``''``; rows of one key
are never parted, so a single key (or a single long document) above the limit makes a shard of its
own with ``oversize`` true; repeated rows count each time; an empty table gives no rows. Columns of
the input beyond key and text are ignored by ``assign`` and kept by ``shard``, which renames those that clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sheltered, small, store

BITS = 60


def key_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, BITS - depth)


def bits(h: Column, depth: Column) -> Column:
    """The first ``depth`` bits of ``h`` as text, '' for the root."""
    return F.substring(F.lpad(F.conv(h.cast("string"), 10, 2), BITS, "0"), F.lit(1), depth)


#: Bits that one step of the merging of cells covers.
STEP = 4


def _grow(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(p, depth, shard_bytes, shard_rows, stuck): the shallowest fitting prefix, of ``low`` bits at least, of each cell of ``high`` bits.

    A prefix that fits has only fitting ones below it, so cells are merged upwards, STEP bits at a time, as long as what they
    merge to fits; each step has a sixteenth of the nodes of the one before, and most shards end in the first ones.
    """
    fits = (F.col("n_bytes") <= limit) | (F.col("lo") == F.col("hi"))
    nodes, at, ended = cells.select(F.col("p").alias("q"), "n_bytes", "n_rows", "lo", "hi").withColumn("open", fits), high, []
    while True:
        top = max(low, at - STEP)
        up = nodes.select("q", "n_bytes", "n_rows", "lo", "hi", "open", F.explode(F.sequence(F.lit(top), F.lit(at))).alias("depth")).withColumn("r", F.expr(f"shiftrightunsigned(q, {at} - depth)"))
        sums = store(up.groupBy("depth", "r").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("open", fits), "shard-sums")
        best = up.where("open").select("q", "depth", "r").join(sums.where("open").select("depth", "r", "n_bytes", "n_rows"), ["depth", "r"])
        best = best.groupBy("q").agg(F.min(F.struct("depth", "n_bytes", "n_rows")).alias("s"))
        done = best if top == low else best.where(F.col("s.depth") > top)
        ended.append((at, done.select("q", "s.depth", F.col("s.n_bytes").alias("shard_bytes"), F.col("s.n_rows").alias("shard_rows"))))
        nodes = sums.where(F.col("depth") == top).select(F.col("r").alias("q"), "n_bytes", "n_rows", "lo", "hi", "open")
        at = top
        if at == low or not nodes.where("open").limit(1).count():
            break
    found = None
    for depth, done in ended:
        own = cells.select("p", F.expr(f"shiftrightunsigned(p, {high - depth})").alias("q")).join(done, "q").select("p", "depth", "shard_bytes", "shard_rows")
        found = own if found is None else found.union(own)
    return cells.select("p").join(found, "p", "left").select("p", "depth", "shard_bytes", "shard_rows", F.col("depth").isNull().alias("stuck"))


def assign(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, shard, depth, shard_bytes, shard_rows, oversize): the shard of each row.

    ``shard`` is the bucket's bit prefix as text, ``depth`` its length. Only (hash, bytes) move.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    rows = store(rows.withColumn("h", key_hash(F.col("k"))), "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 6)
    parts, left = [], rows
    while True:
        cells = left.groupBy(prefix(F.col("h"), high).alias("p")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        found = store(_grow(cells, low, high, limit), "shard-cells")
        placed = left.withColumn("p", prefix(F.col("h"), high)).join(small(found, 100_000), "p")
        parts.append(placed.where("not stuck").drop("p", "stuck"))
        if high == BITS or not found.where("stuck").limit(1).count():
            break
        left = store(placed.where("stuck").select("k", "n_bytes", "h"), "shard-left")
        low, high = high + 1, min(BITS, high + 6)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select(
        F.col("k").alias(key), "n_bytes", bits(F.col("h"), F.col("depth")).alias("shard"), F.col("depth").cast("int").alias("depth"),
        "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversize"),
    )


@sheltered
def shard(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its shard: all columns, then shard and shard_depth. Columns of the input
    that have these names are kept as input_shard and input_shard_depth."""
    of = assign(docs, limit, key, text).select(F.col(key).alias("__k"), F.col("shard").alias("__shard"), F.col("depth").alias("__depth")).distinct()
    own = docs.withColumnsRenamed({c: f"input_{c}" for c in ("shard", "shard_depth") if c in docs.columns})
    return own.join(of, F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k").withColumnsRenamed({"__shard": "shard", "__depth": "shard_depth"})


def directory(assigned: DataFrame) -> DataFrame:
    """(slot, shard): the directory of the result of ``assign``, a row for each prefix of as many bits as the deepest shard has.

    A shard of fewer bits has several slots; prefixes that no row has point nowhere and are left out.
    """
    shards = assigned.select("shard", "depth").distinct()
    deepest = shards.agg(F.max("depth")).first()[0] or 0
    tails = F.when(F.col("depth") < deepest, F.expr(f"transform(sequence(0L, shiftleft(1L, {deepest} - depth) - 1), i -> lpad(conv(cast(i as string), 10, 2), {deepest} - depth, '0'))")).otherwise(F.array(F.lit("")))
    return shards.select("shard", F.explode(tails).alias("tail")).select(F.concat("shard", "tail").alias("slot"), "shard")


#: Production limit of a shard, in bytes.
LIMIT = 1 << 20

ORACLE = f"""
with r as (
  select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents),
a as (select h, n_bytes, unnest(range(0, {BITS + 1})) as depth from r),
s as (select depth, h >> ({BITS} - depth) as q, sum(n_bytes)::bigint as shard_bytes, count(*)::bigint as shard_rows, min(h) as lo, max(h) as hi
      from a group by 1, 2),
f as (select * from s where shard_bytes <= {LIMIT} or lo = hi),
m as (select r.doc_id, r.n_bytes, r.h, min(f.depth) as depth from r join f on r.h >> ({BITS} - f.depth) = f.q group by 1, 2, 3)
select m.doc_id, m.n_bytes, substr(lpad(bin(m.h), {BITS}, '0'), 1, m.depth::int) as shard, m.depth::int as depth,
       f.shard_bytes, f.shard_rows, f.shard_bytes > {LIMIT} as oversize
from m join f on f.depth = m.depth and f.q = m.h >> ({BITS} - m.depth)
"""
