"""Benchmark decontamination by winnowing (DataFrame operations only).

A word k-gram's hash is a fingerprint where it is the smallest in some window of ``w`` consecutive
k-grams. Two texts that share ``k + w - 1`` words hold the same window of k-grams there, hence the
same fingerprint: with k=5 and w=6 no shared span of 10 words is missed. Fingerprints of training and
benchmark texts are joined; documents with a common one are extended: their whole word sequences are
compared word for word with the benchmark's windows of 10 words.

An item of fewer than 10 words is one window. Such spans are below the guarantee, so for each length
that occurs among short items every n-gram of that length is a fingerprint.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z only. Fingerprints use
hashes of fully lower-cased words, which can add candidates and loses none.

Defined results: null and wordless texts have no words and are never hit; empty tables give no rows
or no hits; rows that repeat a key with the same text each get the same result; items with equal
windows all count. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sheltered, small, store

K, W, SPAN = 5, 6, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmark tables of at most so many rows (fingerprints or windows) are sent to every executor.
MAX_SENT = 200_000


def words(text: Column) -> Column:
    """The words of ``text``, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def word_hashes(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return F.transform(found, lambda x: F.xxhash64(F.lower(x)))


def grams(h: str, n: int) -> Column:
    """The hashes of all n-grams of the column named ``h`` of word hashes."""
    return F.expr(f"if(size({h}) >= {n}, transform(sequence(1, size({h}) - {n} + 1), i -> xxhash64(slice({h}, i, {n}))), array())")


def winnow(g: str, w: int) -> Column:
    """The smallest of each ``w`` consecutive hashes of the column named ``g``, once each; of all, if there are fewer."""
    return F.expr(f"array_distinct(if(size({g}) > {w}, transform(sequence(1, size({g}) - {w} + 1), i -> array_min(slice({g}, i, {w}))), if(size({g}) = 0, array(), array(array_min({g})))))")


def fingerprints(df: DataFrame, text: str, lengths: list[int]) -> DataFrame:
    """``df`` without ``text``, with n_words and fps, the fingerprints as (n, hash) folded to one long."""
    out = df.withColumn("hw", word_hashes(F.col(text))).drop(text)
    out = out.withColumn("g", grams("hw", K)).withColumn("fps", winnow("g", W))
    for n in lengths:
        out = out.withColumn("fps", F.concat("fps", F.transform(grams("hw", n), lambda x, n=n: F.xxhash64(F.lit(n), x))))
    return out.select(*[c for c in df.columns if c != text], F.size("hw").alias("n_words"), "fps")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t, th) of each row; k and th, the hash of its text, tell rows apart that share an id or have none."""
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).withColumn("th", F.xxhash64("t"))


def found_in(d: DataFrame, benchmark: DataFrame, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(k4, th4, n_words, n_hit, items) of each distinct (k, th) of ``d``."""
    b = store(benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(item_text)).alias("ws")).where("size(ws) > 0"), "items")
    n = F.least(F.size("ws"), F.lit(SPAN))
    lengths = sorted(x[0] for x in b.select(n.alias("n")).distinct().collect())
    short = [x for x in lengths if x < SPAN]
    windows = b.withColumn("n", n).select("item", F.expr("explode(transform(sequence(1, size(ws) - n + 1), i -> array_join(slice(ws, i, n), ' ')))").alias("win"))
    windows = store(windows.groupBy("win").agg(F.collect_set("item").alias("items")), "windows")
    long_items = b.where(F.size("ws") >= SPAN).select(F.array_join("ws", " ").alias("t"))
    short_items = b.where(F.size("ws") < SPAN).select(F.array_join("ws", " ").alias("t"))
    marks = fingerprints(long_items, "t", []).select(F.explode("fps").alias("fp"))
    for x in short:
        marks = marks.union(fingerprints(short_items, "t", [x]).where(F.col("n_words") == x).select(F.element_at("fps", -1).alias("fp")))
    marks = store(marks.distinct(), "marks")
    seen = fingerprints(d, "t", short).select("k", "th", "n_words", F.explode_outer("fps").alias("fp"))
    seen = seen.join(small(marks.withColumn("hit", F.lit(1)), MAX_SENT), "fp", "left")
    seen = store(seen.groupBy("k", "th").agg(F.first("n_words").alias("n_words"), F.max("hit").alias("hit")), "seen")
    near = seen.where("hit = 1").select(F.col("k").alias("k2"), F.col("th").alias("th2"))
    found = d.join(small(near, MAX_SENT), F.col("k").eqNullSafe(F.col("k2")) & F.col("th").eqNullSafe(F.col("th2")), "left_semi").select("k", "th", words(F.col("t")).alias("ws"))
    spans = None
    for x in lengths:
        at = found.select("k", "th", F.lit(x).alias("n"), F.expr(f"posexplode(if(size(ws) >= {x}, transform(sequence(1, size(ws) - {x} + 1), i -> array_join(slice(ws, i, {x}), ' ')), array()))").alias("s", "win"))
        spans = at if spans is None else spans.union(at)
    if spans is None:
        out = seen.select("k", "th", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    else:
        inside = spans.join(small(windows, MAX_SENT), "win").groupBy("k", "th").agg(
            F.array_sort(F.collect_set(F.struct("s", "n"))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        covered = "aggregate(at, struct(0 as e, 0L as c), (a, x) -> struct(greatest(a.e, x.s + x.n) as e, a.c + greatest(0, x.s + x.n - greatest(a.e, x.s)) as c)).c"
        inside = inside.select("k", "th", F.expr(covered).alias("n_hit"), "items").withColumnsRenamed({"k": "k3", "th": "th3"})
        out = seen.join(inside, F.col("k").eqNullSafe(F.col("k3")) & F.col("th").eqNullSafe(F.col("th3")), "left").select(
            "k", "th", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumnsRenamed({"k": "k4", "th": "th4"})


def hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, items): words of each row inside benchmark windows, and the items found, sorted as text."""
    d = keyed(docs, key, text)
    out = found_in(d, benchmark, item, item_text)
    return d.select("k", "th").join(out, F.col("k").eqNullSafe(F.col("k4")) & F.col("th").eqNullSafe(F.col("th4"))).select(F.col("k").alias(key), "n_words", "n_hit", "items")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    h = hits(docs, benchmark)
    return h.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@sheltered
def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a word inside a benchmark window; all their columns."""
    bad = found_in(keyed(docs, key, text), benchmark).where("n_hit > 0").select(F.col("k4").alias("__k"), F.col("th4").alias("__th"))
    return docs.join(bad, F.col(key).eqNullSafe(F.col("__k")) & F.xxhash64(F.col(text)).eqNullSafe(F.col("__th")), "left_anti")


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bn as (select item_id, ws, least(len(ws), 10) as n from b where len(ws) > 0),
bs as (select item_id, ws, n, unnest(range(1, len(ws) - n + 2)) as s from bn),
win as (select distinct item_id, n, array_to_string(ws[s:s + n - 1], ' ') as w from bs),
ns as (select distinct n from win),
ds as (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as s from d, ns where len(ws) >= n),
dw as (select doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') as w from ds),
hit as (select doc_id, dw.n, s, item_id from dw join win on dw.w = win.w and dw.n = win.n),
pos as (select distinct doc_id, unnest(range(s, s + n)) as p from hit),
c as (select doc_id, count(*) as n_hit from pos group by 1),
i as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as items from (select distinct doc_id, item_id::varchar as x from hit) group by 1)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join i using (doc_id)
"""
