"""n-gram overlap, novelty and repetition of texts against corpora.

Bags keep repeats, sets do not. Text is pruned to (key, gram) before anything is exploded and the
corpus side is reduced to distinct rows; Catalyst broadcasts that side where its size allows.
"""

from __future__ import annotations

import gzip
import lzma
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .sizes import bounded
from .windows import stored

#: Texts of fewer words are not measured.
LEAST_WORDS = 12


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(X.words(F.col(text))).alias("word")).distinct()


def gram_set(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    return docs.select(X.words(F.col(text)).alias("w")).select(F.explode(X.grams(F.col("w"), n)).alias("gram")).distinct()


def hashed(ws: str, n: int) -> str:
    """SQL of the 64-bit hashes of all n-grams of the stored column ``ws`` of word hashes, repeats kept."""
    parts = ", ".join(f"{ws}[i + {k}]" for k in range(n))
    return f"if(size({ws}) >= {n}, transform(sequence(0, size({ws}) - {n}), i -> xxhash64({parts})), cast(array() as array<bigint>))"


def with_hashes(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """``columns``, w (the words) and h (their hashes) of each text."""
    return docs.select(*columns, X.words(F.col(text)).alias("w")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def known_grams(corpus: DataFrame, sizes: list[int], text: str) -> DataFrame:
    """(n, g): the distinct n-grams, as hashes, of a corpus; broadcast where it is counted to be small."""
    grams = F.array(*[F.struct(F.lit(n).alias("n"), F.expr(hashed("h", n)).alias("gs")) for n in sizes])
    rows = with_hashes(corpus, [], text).select(F.explode(grams).alias("x")).select("x.n", F.explode("x.gs").alias("g"))
    return bounded(rows.distinct())


def overlap(docs: DataFrame, corpus: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_grams, n_found): how many n-grams of each text, repeats counted, occur in the corpus.

    n-grams are compared by 64-bit hashes. Known ones are joined first, so only sums by key are shuffled.
    """
    rows = with_hashes(docs, [key], text).select(key, F.explode_outer(F.expr(hashed("h", n))).alias("g"))
    known = known_grams(corpus, [n], text).select("g", F.lit(1).alias("known"))
    return rows.join(known, "g", "left").groupBy(key).agg(F.count("g").alias("n_grams"), F.count("known").alias("n_found"))


def overlap_totals(docs: DataFrame, corpus: DataFrame, sizes: list[int], text: str = "text") -> DataFrame:
    """(n, n_grams, n_found) over all texts, in one pass for all n.

    A row a word, with those that follow it. A longer n-gram can be known only where the shorter one at its place is, so it
    is hashed and looked up only there.
    """
    sizes = sorted(set(sizes))
    known = known_grams(corpus, sizes, text)
    words = docs.select(X.words(F.col(text)).alias("w")).withColumn("size", F.coalesce(F.size("w"), F.lit(0)))
    ahead = F.arrays_zip(*[(F.col("w") if k == 0 else F.slice("w", k + 1, F.greatest(F.col("size") - k, F.lit(0)))).alias(f"a{k}") for k in range(sizes[-1])])
    rows = words.select("size", F.posexplode_outer(ahead).alias("pos", "x")).select("size", "pos", "x.*")
    for last, n in zip([None, *sizes], sizes):
        here = F.col(f"a{n - 1}").isNotNull() if last is None else F.col(f"a{n - 1}").isNotNull() & F.col(f"k{last}").isNotNull()
        rows = rows.withColumn(f"g{n}", F.when(here, F.xxhash64(*[F.xxhash64(f"a{k}") for k in range(n)])))
        rows = rows.join(known.where(F.col("n") == n).select(F.col("g").alias(f"g{n}"), F.lit(1).alias(f"k{n}")), f"g{n}", "left").drop(f"g{n}")
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    sums = [F.struct(F.lit(n).alias("n"), F.sum(F.when(first, F.greatest(F.col("size") - (n - 1), F.lit(0))).otherwise(0)).alias("n_grams"), F.count(f"k{n}").alias("n_found")) for n in sizes]
    return rows.agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def types(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word, c): each text's distinct words and their counts."""
    return docs.select(F.col(key), F.explode(X.words(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("c"))


def novel(docs: DataFrame, vocabularies: list[DataFrame], key: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """(key, n_types, n_novel): distinct words of at least ``least`` letters, and those in no vocabulary."""
    known = reduce(DataFrame.union, vocabularies).distinct().withColumn("known", F.lit(1))
    own = types(docs, key, text).where(F.length("word") >= least)
    return own.join(known, "word", "left").groupBy(key).agg(F.count("*").alias("n_types"), F.count_if(F.col("known").isNull()).alias("n_novel"))


def novel_leave_one_out(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_types, n_novel): words that occur in no other text of the same corpus.

    Texts give their distinct words, and of a word only the least and the greatest key and their number are kept. Texts that
    share a key are one text.
    """
    own = docs.select(F.col(key).alias("k"), F.array_distinct(X.words(F.col(text))).alias("w"))
    shared = bounded(stored(docs.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("rows")).where("rows > 1").select("k", F.lit(True).alias("shared"))))
    types = own.where("size(w) > 0").select(F.col("k").alias("__k"), "w").join(shared, F.col("__k").eqNullSafe(F.col("k")), "left").select(F.col("__k").alias("k"), "w", "shared")
    single = types.where("shared is null").select("k", F.size("w").cast("long").alias("n_types"))
    several = types.where("shared").select("k", F.explode("w").alias("word")).distinct().groupBy("k").agg(F.count("*").alias("n_types"))
    words = own.select("k", F.explode("w").alias("word")).groupBy("word").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("k").alias("n"), F.count("*").alias("all"))
    novel = words.where("(n = all and a = b) or n = 0").groupBy(F.col("a").alias("__a")).agg(F.count("*").alias("n_novel"))
    return single.union(several).join(novel, F.col("k").eqNullSafe(F.col("__a")), "left").select(F.col("k").alias(key), "n_types", F.coalesce("n_novel", F.lit(0)).alias("n_novel"))


def shape(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, n_words, n_4grams, u_4grams, n_types): sizes of each text's bags and sets."""
    w = docs.select(*keys, X.words(F.col(text)).alias("w"))
    g = w.select(*keys, "w", X.grams(F.col("w"), 4).alias("g"))
    return g.select(*keys, F.size("w").alias("n_words"), F.size("g").alias("n_4grams"), F.size(F.array_distinct("g")).alias("u_4grams"), F.size(F.array_distinct("w")).alias("n_types"))


def describe(docs: DataFrame, corpus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, words, self_repeat, verb3, verb5, novel_words, ttr); NULL measures under LEAST_WORDS words.

    Each text is cut into words once; its 3-grams, 5-grams and distinct words meet the corpus as hashes in one
    map-side join where the corpus is small, and one row a text is shuffled.
    """
    sizes = [3, 5, 1]
    own = with_hashes(docs, [key], text).withColumn("types", F.array_distinct("h")).withColumn("g4", F.expr(hashed("h", 4)))
    own = own.select(key, F.size("h").alias("n"), F.size("types").alias("t"), F.size("g4").alias("n4"), F.size(F.array_distinct("g4")).alias("u4"), "h", F.transform("types", lambda x: F.xxhash64(x)).alias("g1"))
    grams = F.array(*[F.struct(F.lit(n).alias("n"), F.expr("g1" if n == 1 else hashed("h", n)).alias("gs")) for n in sizes])
    rows = own.select(key, "n", "t", "n4", "u4", F.explode(grams).alias("x")).select(key, "n", "t", "n4", "u4", F.col("x.n").alias("size"), F.explode_outer("x.gs").alias("g"))
    known = known_grams(corpus, sizes, text).select(F.col("n").alias("size"), "g", F.lit(1).alias("known"))
    found = [F.count(F.when(F.col("size") == n, F.col("known"))).alias(f"k{n}") for n in sizes]
    out = rows.join(known, ["size", "g"], "left").groupBy(key, "n", "t", "n4", "u4").agg(*found)
    ok = F.col("n") >= LEAST_WORDS
    share = lambda n: F.when(ok, F.col(f"k{n}") / F.greatest(F.col("n") - (n - 1), F.lit(1)))
    return out.select(
        key, F.when(ok, F.col("n")).alias("words"), F.when(ok, 1 - F.col("u4") / F.greatest("n4", F.lit(1))).alias("self_repeat"),
        share(3).alias("verb3"), share(5).alias("verb5"), F.when(ok, (F.col("t") - F.col("k1")) / F.col("t")).alias("novel_words"), F.when(ok, F.col("t") / F.col("n")).alias("ttr"))


def against_rest(slices: DataFrame, keys: list[str], text: str, start: str, chars: int) -> DataFrame:
    """(keys, words, self_repeat, verb3, verb5, novel_words, ttr) of slices of a text, measured against the rest of that text.

    ``slices`` holds a row for each slice: its whole text and the place, from 1, of the first of its ``chars`` characters. The rest is
    what stands before and behind, joined; its words and n-grams may cross the seam. A slice and its rest are both at hand, so
    nothing is exploded, joined or shuffled: the slice's n-grams meet the rest's in a hash set within the row. Measures are NULL
    under LEAST_WORDS words, and of a null text.
    """
    rest = F.concat(F.expr(f"substring(`{text}`, 1, `{start}` - 1)"), F.expr(f"substring(`{text}`, `{start}` + {chars}, length(`{text}`))"))
    cut = slices.select(*keys, X.words(F.expr(f"substring(`{text}`, `{start}`, {chars})")).alias("w"), X.words(rest).alias("r"))
    cut = cut.select(*keys, F.transform("w", lambda x: F.xxhash64(x)).alias("w"), F.transform("r", lambda x: F.xxhash64(x)).alias("r"))
    grams = [F.expr(hashed("w", n)).alias(f"w{n}") for n in (3, 4, 5)]
    cut = cut.select(*keys, "w", F.array_distinct("w").alias("types"), "r", *grams)
    cut = cut.select(*keys, "w", "types", "r", "w3", "w4", "w5", F.array_intersect("types", "r").alias("both"))
    # an n-gram in both needs n words, and shorter n-grams, that are in both: the rest's are hashed only then
    none = F.array().cast("array<bigint>")
    cut = cut.withColumn("m3", F.when(F.size("both") == 0, none).otherwise(F.array_intersect("w3", F.expr(hashed("r", 3)))))
    cut = cut.select(*keys, "w", "types", "w3", "w4", "w5", "m3", F.when(F.size("m3") == 0, none).otherwise(F.array_intersect("w5", F.expr(hashed("r", 5)))).alias("m5"), F.size("both").alias("known"))
    ok, n = F.size("w") >= LEAST_WORDS, F.size("w")
    # bound by a lambda of its own, or the intersection would be made anew for every n-gram
    found = lambda k: F.transform(F.array(F.struct(F.col(f"w{k}").alias("w"), F.col(f"m{k}").alias("m"))), lambda p: F.size(F.filter(p["w"], lambda x: F.array_contains(p["m"], x))))[0]
    bag = lambda k: F.when(F.size(f"m{k}") == 0, 0).when(F.size(F.array_distinct(f"w{k}")) == F.size(f"w{k}"), F.size(f"m{k}")).otherwise(found(k))
    share = lambda k: F.when(ok, bag(k) / F.greatest(F.size(f"w{k}"), F.lit(1)))
    return cut.select(
        *keys, F.when(ok, n).alias("words"), F.when(ok, 1 - F.size(F.array_distinct("w4")) / F.greatest(F.size("w4"), F.lit(1))).alias("self_repeat"),
        share(3).alias("verb3"), share(5).alias("verb5"), F.when(ok, 1 - F.col("known") / F.size("types")).alias("novel_words"), F.when(ok, F.size("types") / n).alias("ttr"))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(X.words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("c"))


def char_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(F.split(F.col(text), "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("c"))


def ladder(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, order0, gzip, xz): nats for each character of a text under ever better models."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text], strict=True):
                n, raw = len(t), t.encode()
                order0 = -sum(c / n * math.log(c / n) for c in Counter(t).values()) + 0.0
                width = max(4096, 1 << len(raw).bit_length())  # a dictionary beyond the text changes nothing but memory
                best = [{"id": lzma.FILTER_LZMA2, "preset": 9 | lzma.PRESET_EXTREME, "dict_size": min(width, 1 << 26)}]
                sizes = [len(gzip.compress(raw, 9)), len(lzma.compress(raw, filters=best))]
                rows.append((k, n, order0, *(8 * s * math.log(2) / n for s in sizes)))
            yield pd.DataFrame(rows, columns=[key, "n_chars", "order0", "gzip", "xz"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(each, f"`{key}` {kind}, n_chars long, order0 double, gzip double, xz double")
