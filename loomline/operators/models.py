"""Language-model operators over relations: n-gram scorers, token selection, BPE.

A model is a table of counts; distributions are rows (ctx, tok, p). Contexts are bounded by the
vocabulary, so selections run in windows over one context each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .sizes import bounded


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(ctx, tok, c): words after two others, these joined by a blank."""
    g = docs.select(X.words(F.col(text)).alias("w")).where("size(w) > 2")
    g = g.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)).alias("ctx"), F.get("w", i + 2).alias("tok")))).alias("g"))
    return g.groupBy("g.ctx", "g.tok").agg(F.count("*").alias("c")).toDF("ctx", "tok", "c")


def bigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(ctx, tok, c): neighbouring words and their counts."""
    g = docs.select(X.words(F.col(text)).alias("w")).select(F.explode(F.when(F.size("w") > 1, F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("ctx"), F.slice("w", F.lit(2), F.size("w") - 1).alias("tok")))).alias("g"))
    return g.groupBy("g.ctx", "g.tok").agg(F.count("*").alias("c")).toDF("ctx", "tok", "c")


def probabilities(counts: DataFrame, add: float = 0.0, vocabulary: Column | int = 0) -> DataFrame:
    """(ctx, tok, p) by relative frequency, with ``add`` for each of ``vocabulary`` words on top."""
    total = counts.groupBy("ctx").agg(F.sum("c").alias("n"))
    return counts.join(total, "ctx").select("ctx", "tok", ((F.col("c") + add) / (F.col("n") + add * vocabulary)).alias("p"))


def fit(docs: DataFrame, add: float, text: str = "text") -> DataFrame:
    """(ctx, tok, c, p): bigrams and their counts, smoothed by ``add`` for each word that follows another.

    How often a word is a context comes from the words alone, so bigrams are counted once and meet one row of their context.
    """
    w = docs.select(X.words(F.col(text)).alias("w")).select(F.size("w").alias("size"), F.posexplode("w").alias("pos", "ctx"))
    words = _stored(w.groupBy("ctx").agg(F.count_if(F.col("pos") < F.col("size") - 1).alias("n"), F.count_if(F.col("pos") > 0).alias("as_tok")))
    known = words.agg(F.count_if(F.col("as_tok") > 0)).first()[0]
    total = bounded(words.where("n > 0").select("ctx", "n"))
    return bigram_counts(docs, text).join(total, "ctx").select("ctx", "tok", "c", ((F.col("c") + add) / (F.col("n") + add * known)).alias("p"))


def top_k(dist: DataFrame, k: int) -> DataFrame:
    return dist.withColumn("r", F.expr("row_number() over (partition by ctx order by p desc, tok)")).where(F.col("r") <= k).drop("r")


def nucleus(dist: DataFrame, top_p: float) -> DataFrame:
    """Tokens before whose mass of likelier ones reaches ``top_p``, renormalised; the likeliest always stays."""
    before = F.expr("coalesce(sum(p) over (partition by ctx order by p desc, tok rows between unbounded preceding and 1 preceding), 0)")
    kept = dist.withColumn("before", before).where(F.col("before") < top_p - 1e-9).drop("before")
    return kept.withColumn("q", F.expr("p / sum(p) over (partition by ctx)"))


def draw(dist: DataFrame, u: Column) -> DataFrame:
    """(ctx, tok): the token at which the cumulated mass passes ``u`` in [0, 1) of its context."""
    cum = dist.withColumn("__u", u).withColumn("cum", F.expr("sum(q) over (partition by ctx order by q desc, tok rows unbounded preceding)"))
    cum = cum.withColumn("last", F.expr("max(cum) over (partition by ctx)"))
    hit = cum.where(F.col("cum") > F.least("__u", F.col("last") * (1 - 1e-12)))
    return hit.groupBy("ctx").agg(F.min(F.struct(F.col("cum"), F.col("tok")))["tok"].alias("tok"))


def product(a: DataFrame, b: DataFrame, w: float, temperature: float = 1.0) -> DataFrame:
    """(ctx, tok, p): weighted product of two experts over the tokens that both know, as a softmax at a temperature."""
    t = max(temperature, 1e-5)
    z = a.select("ctx", "tok", F.col("p").alias("pa")).join(b.select("ctx", "tok", F.col("p").alias("pb")), ["ctx", "tok"])
    z = z.withColumn("z", (w * F.log("pa") + (1 - w) * F.log("pb")) / t)
    z = z.withColumn("e", F.exp(F.col("z") - F.expr("max(z) over (partition by ctx)")))
    return z.select("ctx", "tok", F.expr("e / sum(e) over (partition by ctx)").alias("p"))


def positions(pairs: DataFrame, name: str, text: str) -> DataFrame:
    """(name, pos, tok): words of a text by position."""
    return pairs.select(name, F.posexplode(X.words(F.col(text))).alias("pos", "tok"))


def conditional_nll(pairs: DataFrame, contexts: DataFrame, unigrams: DataFrame, mix: float = 0.25) -> DataFrame:
    """(name, cond, pos, tok, n_char, overlap, nll): each source word under each context.

    ``pairs`` (name, source, summary), ``contexts`` (name, cond, body), one row for each condition; an
    empty body is no context. The scorer gives a share ``mix`` to the words that follow the previous source word in the
    context, as much to the context's words, and the rest to add-one unigrams, so the order of the context counts. A
    share whose part of the context is empty goes to the unigrams. Any other scorer that returns these columns can
    stand in its place.

    Words of the sources stay with their pair: only unigrams that are too many to be broadcast move them, once there and once back. All contexts of
    a pair lie in one row, where they are looked through, as they are short.
    """
    own = pairs.select("name", X.words(F.col("source")).alias("w"), X.words(F.col("summary")).alias("said"))
    src = own.select("name", F.posexplode(F.arrays_zip(F.col("w").alias("tok"), F.concat(F.array(F.lit(None).cast("string")), F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))).alias("prev"))).alias("pos", "x")).select("name", "pos", "x.*").where("tok is not null")
    unigrams = _stored(unigrams)
    total = unigrams.agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    base = src.join(bounded(unigrams.select(F.col("word").alias("tok"), "c")), "tok", "left").join(F.broadcast(total))  # total: one row
    base = base.select("name", "pos", "tok", "prev", ((F.coalesce("c", F.lit(0)) + 1) / (F.col("n") + F.col("v") + 1)).alias("p0"))
    said = own.select("name", F.array_distinct("said").alias("said"))
    given = contexts.select("name", F.struct("cond", X.words(F.col("body")).alias("w")).alias("x")).groupBy("name").agg(F.collect_list("x").alias("xs"))
    rows = base.join(said.join(given, "name"), "name").withColumn("overlap", F.coalesce(F.array_contains("said", F.col("tok")), F.lit(False)))
    rows = rows.select("name", "pos", "tok", "prev", "p0", "overlap", F.explode("xs").alias("x")).select("name", "pos", "tok", "prev", "p0", "overlap", "x.*").withColumn("m", F.size("w"))
    # folds run only over contexts that hold the word
    rows = rows.withColumn("k", F.expr("if(array_contains(w, tok), size(filter(w, x -> x = tok)), 0)"))
    rows = rows.withColumn("m2", F.expr("if(m > 1 and array_contains(w, prev), size(filter(slice(w, 1, m - 1), x -> x = prev)), 0)"))
    rows = rows.withColumn("k2", F.expr("if(m2 > 0 and k > 0, size(filter(sequence(0, m - 2), i -> w[i] = prev and w[i + 1] = tok)), 0)"))
    one = F.when(F.col("m") > 0, mix * F.col("k") / F.col("m")).otherwise(mix * F.col("p0"))
    two = F.when(F.col("m2") > 0, mix * F.col("k2") / F.col("m2")).otherwise(mix * F.col("p0"))
    return rows.select("name", "cond", "pos", "tok", F.length("tok").alias("n_char"), "overlap", (-F.log(one + two + (1 - 2 * mix) * F.col("p0"))).alias("nll"))


def _stored(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder, where the session names one; else kept in memory and on disk, and made anew where an executor is lost."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def selection(dist: DataFrame, temperature: float = 1.0, k: int | None = None, top_p: float = 1.0) -> DataFrame:
    """(ctx, tok, q): a distribution (ctx, tok, p) as it is drawn from, sharpened by the temperature, cut to the k likeliest and to the nucleus."""
    t = max(temperature, 1e-5)
    out = dist.withColumn("e", F.exp((F.log("p") - F.log(F.expr("max(p) over (partition by ctx)"))) / t)).select("ctx", "tok", F.expr("e / sum(e) over (partition by ctx)").alias("p"))
    return nucleus(top_k(out, k) if k else out, top_p).select("ctx", "tok", "q")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) drawn by MD5 of the seed and the parts."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(h, 1, 7), 16, 10).cast("long") / float(1 << 28)


#: Tokens that one level of the recursion draws.
A_LEVEL = 8


def generate(starts: DataFrame, models: list[DataFrame], length: int, seed: int = 0, glue: str = " ", chars: int | None = None) -> DataFrame:
    """(name, step, tok): tokens drawn one after another, by one recursive query, A_LEVEL tokens a level.

    ``starts`` has (name, tok). ``models`` are distributions (ctx, tok, q) from the longest context to the shortest; the context of the n-th before
    last rolls over the last so many tokens, joined by ``glue``. The first model that knows the context gives the
    token; where none does, the text ends, as it does after ``length`` tokens or once it has ``chars`` characters. A
    context is one row of its tokens and their cumulated shares, so a step is a look-up for each text and model. Rows of a
    result above ``spark.sql.cteRecursionRowLimit`` need that limit raised.
    """
    spark, names, joins, draws = starts.sparkSession, [], [], []
    for k, m in enumerate(models):
        at = m.select("ctx", F.struct((-F.col("q")).alias("o"), "tok", F.expr("sum(q) over (partition by ctx order by q desc, tok rows unbounded preceding)").alias("cum")).alias("x"))
        row = at.groupBy("ctx").agg(F.array_sort(F.collect_list("x")).alias("x"))  # a context's tokens, which the selection bounds
        row = _stored(row.select("ctx", F.transform("x", lambda v: v["tok"]).alias("toks"), F.transform("x", lambda v: v["cum"]).alias("cums")))
        names.append(f"loomline_{uuid.uuid4().hex}")
        row.createOrReplaceTempView(names[-1])
        n = len(models) - k
        joins.append(f"left join {names[-1]} m{k} on m{k}.ctx = if(size(g.past) >= {n}, array_join(slice(g.past, -{n}, {n}), :glue), null)")
        draws.append(f"get(m{k}.toks, size(filter(m{k}.cums, c -> c <= least(g.u, element_at(m{k}.cums, -1) * (1 - 1e-12D)))))")
    names.append(f"loomline_{uuid.uuid4().hex}")
    starts.select("name", "tok").createOrReplaceTempView(names[-1])
    u = "cast(conv(substring(md5(cast(concat_ws('|', :seed, cast(name as string), cast(step + 1 as string)) as binary)), 1, 7), 16, 10) as bigint) / 268435456D"
    more = f"step < {length} and n < {chars or 1 << 40}"
    level = f"select name, step, past, n, cast(array() as array<string>) as said, {more} as alive from g where alive"
    for _ in range(A_LEVEL):
        level = f"""select name, step, past, n, said, tok is not null and {more} as alive from (select name, if(tok is null, step, step + 1) as step, if(tok is null, past, slice(concat(past, array(tok)), greatest(1, size(past) + 2 - {len(models)}), {len(models)})) as past,
  if(tok is null, n, n + length(:glue) + length(tok)) as n, if(tok is null, said, concat(said, array(tok))) as said, tok from (select g.name, g.step, g.past, g.n, g.said, if(g.alive, coalesce({", ".join(draws)}), null) as tok from (select *, {u} as u from ({level})) g {" ".join(joins)}))"""
    return spark.sql(f"""
with recursive g max recursion level {length // A_LEVEL + 3} as (
  select name, 0 as step, array(tok) as past, cast(length(tok) as bigint) as n, array(tok) as said, true as alive from {names[-1]} where tok is not null
  union all {level})
select name, step + 1 - size(said) + pos as step, tok from (select name, step, said, posexplode(said) as (pos, tok) from g)""", args={"glue": glue, "seed": str(seed)})


class VocabularyMismatch(ValueError):
    """Two experts do not know the same tokens."""


def same_vocabulary(a: DataFrame, b: DataFrame) -> None:
    """Raises VocabularyMismatch unless both distributions are over the same tokens."""
    x, y = a.select("tok").distinct(), b.select("tok").distinct()
    odd = x.exceptAll(y).union(y.exceptAll(x)).limit(5).collect()
    if odd:
        raise VocabularyMismatch("tokens that one expert lacks: " + ", ".join(repr(r[0]) for r in odd))


def letter_model(docs: DataFrame, alphabet: str, text: str = "text", add: float = 0.1) -> DataFrame:
    """(ctx, tok, p): pairs of neighbouring letters of an alphabet, others left out, with ``add`` on top of each count."""
    spark = docs.sparkSession
    all_pairs = spark.createDataFrame([(x, y) for x in alphabet for y in alphabet], "ctx string, tok string")
    kept = docs.select(F.regexp_replace(F.lower(text), f"[^{alphabet}]+", "").alias("t")).where("length(t) > 1")
    own = kept.select(F.filter(F.split("t", ""), lambda x: x != "").alias("a"))
    pairs = own.select(F.explode(_adjacent("a")).alias("p")).groupBy("p.x", "p.y").agg(F.count("*").alias("c"))
    counts = all_pairs.join(pairs.toDF("ctx", "tok", "c"), ["ctx", "tok"], "left").select("ctx", "tok", F.coalesce("c", F.lit(0)).alias("c"))
    return probabilities(counts, add, len(alphabet))


def byte_symbols(word: Column) -> Column:
    """The UTF-8 bytes of a word, with a blank in front, each as ``<`` two hexadecimal digits ``>``: the alphabet of a byte-level BPE."""
    return F.regexp_replace(F.hex(F.encode(F.concat(F.lit(" "), word), "UTF-8")), "(..)", "<$1>")


#: The special token and the 256 bytes come before the merged symbols.
SPECIAL, FIRST_MERGED = 0, 257


#: Pairs whose counts come to the driver in a round; the least and the most of them for which it learns what merging them changes.
KNOWN, AHEAD = 1000, (12, 200)


def _symbols(s: str) -> Column:
    """The symbols of ``<a><b>...``."""
    return F.split(F.expr(f"substring({s}, 2, length({s}) - 2)"), "><")


def _adjacent(a: str) -> Column:
    """The pairs (x, y) of neighbours in a stored array."""
    return F.when(F.size(a) > 1, F.arrays_zip(F.slice(a, F.lit(1), F.size(a) - 1).alias("x"), F.slice(a, F.lit(2), F.size(a) - 1).alias("y"))).otherwise(F.array().cast("array<struct<x:string,y:string>>"))


def _round(own: DataFrame, ahead: int) -> tuple[dict[tuple[str, str], int], dict[tuple[str, str], dict[tuple[str, str], int]]]:
    """The counts of the KNOWN most frequent pairs, and by how much merging each of the first ``ahead`` alone changes the counts of others."""
    own = own.select("s", "c", _symbols("s").alias("a"))
    pairs = own.select("c", F.explode(_adjacent("a")).alias("p"))
    top = pairs.groupBy("p.x", "p.y").agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "x", "y").limit(KNOWN)
    first = top.orderBy(F.desc("n"), "x", "y").limit(ahead).select("x", "y")
    held = own.select("s", "c", "a", F.explode(F.array_distinct(_adjacent("a"))).alias("p")).select("s", "c", "a", "p.x", "p.y").join(F.broadcast(first), ["x", "y"])  # ``ahead`` rows
    merged = F.expr("replace(s, concat('<', x, '><', y, '>'), concat('<', x, y, '>'))")
    held = held.select("x", "y", "c", "a", merged.alias("t")).select("x", "y", "c", "a", _symbols("t").alias("t"))
    each = held.select("x", "y", "c", F.explode(F.array(F.struct(F.lit(-1).alias("d"), F.col("a").alias("a")), F.struct(F.lit(1).alias("d"), F.col("t").alias("a")))).alias("v")).select("x", "y", (F.col("c") * F.col("v.d")).alias("d"), F.col("v.a").alias("a"))
    change = each.select("x", "y", "d", F.explode(_adjacent("a")).alias("q")).groupBy("x", "y", F.col("q.x").alias("u"), F.col("q.y").alias("v")).agg(F.sum("d").alias("d")).where("d <> 0")
    # a pair that loses matters only where its count is known
    change = change.join(F.broadcast(top.select(F.col("x").alias("u"), F.col("y").alias("v"), "n")), ["u", "v"], "left").where("d > 0 or n is not null").select("x", "y", "u", "v", "d")  # KNOWN rows
    counts, changes = {}, {}
    for r in top.select("x", "y", F.lit(None).cast("string").alias("u"), F.lit(None).cast("string").alias("v"), F.col("n").alias("d")).unionByName(change).collect():  # a few rows for each symbol and pair
        if r["u"] is None:
            counts[r["x"], r["y"]] = r["d"]
        else:
            changes.setdefault((r["x"], r["y"]), {})[r["u"], r["v"]] = r["d"]
    return counts, changes


def _agreed(counts: dict, changes: dict, made: set[str], most: int) -> list[tuple[str, str]]:
    """The next merges of a plain trainer, as many as follow for certain from a round's counts.

    A merge changes the counts of pairs next to it by what is known for it alone. Where a second merge may have changed them
    too, only a bound is left; the round ends before a pair whose bound is the largest, and after one whose own merge has
    unknown consequences, as it was itself touched or is not among the first.
    """
    least = min(counts.values()) if len(counts) >= KNOWN else 0
    n, touched, unsure, out = dict(counts), {}, set(), []
    while len(out) < most:
        best = min((p for p in n if n[p] > 0), key=lambda p: (-n[p], p), default=None)
        # pairs that are not known may come before those with no more than the least count
        if best is None or best in unsure or (least and n[best] <= least and out):
            break
        out.append(best)
        if best in touched or best not in changes:
            break
        a, b = best
        for q, d in changes[best].items():
            if q == best:
                continue
            if q not in n:
                n[q] = least if q[0] in made and q[1] in made else 0
                unsure |= {q} if n[q] else set()  # it may have been there, below the known ones
            if q in touched:
                n[q] = min(n[q], counts.get(q, n[q]) + d) if d < 0 else n[q] + d
                unsure.add(q)
            else:
                n[q] += d
            touched[q] = best
        n[best] = 0
        for other in out[:-1]:  # a pair made by one merge whose neighbour another one takes away
            for p, o in ((best, other), (other, best)):
                unsure |= {q for q in changes[p] if (q[0] == p[0] + p[1] and q[1] == o[0]) or (q[1] == p[0] + p[1] and q[0] == o[1])}
    return out


def train_bpe(word_counts: DataFrame, vocabulary: int) -> list[tuple[str, str]]:
    """The merges of ``trained``."""
    return trained(word_counts, vocabulary)[0]


def trained(word_counts: DataFrame, vocabulary: int, keep: str | None = None) -> tuple[list[tuple[str, str]], DataFrame]:
    """Merges of a byte-level BPE up to a size of vocabulary, those that a trainer finds which counts anew after each merge, and (s, c): the words so merged, with the column ``keep``.

    A round is one Spark job over the distinct words: it counts the pairs and, for the most frequent ones, the differences
    that merging them would make to others. The driver, which sees a bounded number of pairs, takes as many merges as follow
    for certain; all of them are then applied together. Symbols are the hexadecimal digits of their bytes; ties go to the smaller pair.
    """
    kept = [keep] if keep else []
    own = _stored(word_counts.select(*kept, byte_symbols(F.col("word")).alias("s"), "c"))
    found: list[tuple[str, str]] = []
    made, ahead = {f"{b:02X}" for b in range(256)}, AHEAD[0]
    while len(found) < vocabulary - FIRST_MERGED:
        merges = _agreed(*_round(own, ahead), made, vocabulary - FIRST_MERGED - len(found))
        ahead = min(max(3 * len(merges), AHEAD[0]), AHEAD[1])
        if not merges:
            break
        found += merges
        made |= {x + y for x, y in merges}
        s = F.col("s")
        for x, y in merges:
            s = F.replace(s, F.lit(f"<{x}><{y}>"), F.lit(f"<{x}{y}>"))
        before, own = own, _stored(own.select(*kept, s.alias("s"), "c"))
        if before.is_cached:
            own.count()
            before.unpersist()
    return found, own


def _ids(merges: list[tuple[str, str]]) -> dict[str, int]:
    """The id of each symbol: 1 to 256 for the bytes, printed ones first, then the merged symbols in their order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    order = printable + [b for b in range(256) if b not in set(printable)]
    return {f"{b:02X}": i for i, b in enumerate(order, 1)} | {a + b: FIRST_MERGED + i for i, (a, b) in enumerate(merges)}


def encode_bpe(words: DataFrame, merges: list[tuple[str, str]], word: str = "word") -> DataFrame:
    """``words`` with ``ids``: each word, with a blank in front, by the merges in order.

    One expression: a fold over the merges, each of which replaces its two symbols from left to right. The merges travel as one row.
    """
    ids = _ids(merges)
    rules = [(f"<{ids[a]}><{ids[b]}>", f"<{ids[a + b]}>") for a, b in merges]
    table = words.sparkSession.createDataFrame([(rules,)], "__rules array<struct<f:string,t:string>>")
    s = F.concat(F.lit("<"), F.array_join(X.byte_tokens(F.col(word)).cast("array<string>"), "><"), F.lit(">"))
    own = words.withColumn("__s", s).crossJoin(F.broadcast(table))  # one row
    own = own.withColumn("__s", F.aggregate("__rules", F.col("__s"), lambda x, r: F.replace(x, r["f"], r["t"])))
    return own.withColumn("ids", _symbols("__s").cast("array<int>")).drop("__s", "__rules")


def encode_trained(own: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """``own`` of ``trained`` with ``ids`` for ``s``: the words that a model was trained on are merged already."""
    by_byte: list[dict[str, int]] = [{} for _ in range(256)]  # a look-up in a map reads it through, so there is one for each first byte
    for symbol, i in _ids(merges).items():
        by_byte[int(symbol[:2], 16)][symbol] = i
    table = own.sparkSession.createDataFrame([(by_byte,)], "__ids array<map<string,int>>")
    at = lambda x: F.conv(F.substring(x, 1, 2), 16, 10).cast("int")
    return own.crossJoin(F.broadcast(table)).withColumn("ids", F.transform(_symbols("s"), lambda x: F.element_at(F.get("__ids", at(x)), x))).drop("s", "__ids")  # one row


def encode_documents(docs: DataFrame, merges: list[tuple[str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, ids): whole texts, lower-cased words only. Each distinct word is encoded once and joined back by its hash and itself."""
    at = docs.select(F.col(key).alias("k"), F.posexplode_outer(X.words(F.col(text))).alias("pos", "word"))
    coded = encode_bpe(at.where("word is not null").select("word").distinct(), merges)
    rows = at.join(coded, "word", "left").groupBy("k").agg(F.count("word").alias("n_words"), F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", "ids")))).alias("x"))
    return rows.select(F.col("k").alias(key), "n_words", F.flatten(F.transform("x", lambda p: p["ids"])).alias("ids"))


def coverage(docs: DataFrame, merges: list[tuple[str, str]], sizes: list[int], group: str, text: str = "text") -> DataFrame:
    """(group, vocabulary, n_words, n_chars, n_tokens): what the first merges of each size of vocabulary make of a group's words.

    Words are counted by group first, so each distinct word is encoded once for each size and only counts are joined.
    """
    counts = docs.select(F.col(group), F.explode(X.words(F.col(text))).alias("word")).groupBy(group, "word").agg(F.count("*").alias("c"))
    counts = _stored(counts)
    words, out = counts.select("word").distinct(), None
    for size in sizes:
        coded = encode_bpe(words, merges[: max(0, size - FIRST_MERGED)]).select("word", F.lit(size).alias("vocabulary"), F.size("ids").alias("n"))
        out = coded if out is None else out.unionByName(coded)
    return counts.join(out, "word").groupBy(group, "vocabulary").agg(F.sum("c").alias("n_words"), F.sum(F.col("c") * (F.length("word") + 1)).alias("n_chars"), F.sum(F.col("c") * F.col("n")).alias("n_tokens"))
