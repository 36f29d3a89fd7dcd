"""Mixing sources to target weights by hierarchical budgeting.

A tree has a level for each column (domain, language, source). The root's budget of tokens goes down
level by level: siblings share their parent's budget in proportion to their weights, none gets more
than its subtree holds (its tokens times ``max_epochs``), and what one cannot use its siblings get.
A parent's capacity is that of all its leaves, so a shortage goes to siblings first and passes to the
parent's own siblings only when the whole subtree is used up.

A leaf with N tokens and a target of T gives T div N whole epochs of its documents and, from the next
epoch, a prefix: documents in the order of a hash of (seed, epoch, doc_id), as long as their tokens
together do not pass T mod N. The prefix is found in two steps, sums of hash cells of a leaf and
then the rows of the one cell that the prefix ends in; cells hold some CELL_ROWS rows, so a leaf that holds a third of all
rows is never sorted in one task. Only the leaf table is broadcast, and only if it is small.

Tokens are runs of characters other than blanks. Defined results: null text has no tokens; a null
level value is ''; a leaf without tokens gives no rows; a weight of 0 takes a branch out; rows that
repeat an id share its hash and follow one another by text; an empty table gives no rows. Columns
that are named like the ones used here are kept as they are.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sheltered, small, store

#: Rows of a leaf in a hash cell, about.
CELL_ROWS = 10_000
MAX_LEAVES = 100_000
Weights = Mapping[tuple[str, ...], int]


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_hash(seed: int, epoch: Column, key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long")


def targets(leaves: DataFrame, depth: int, weights: Weights, budget: int, max_epochs: int) -> DataFrame:
    """``leaves`` (l1..l<depth>, tokens) with the target of each, in tokens."""
    spark = leaves.sparkSession
    out, names = leaves.withColumn("cap", F.col("tokens") * max_epochs).withColumn("b0", F.lit(budget).cast("long")), [f"l{i}" for i in range(1, depth + 1)]
    for i in range(1, depth + 1):
        path, parent = names[:i], names[: i - 1]
        nodes = out.groupBy(*path, f"b{i - 1}").agg(F.sum("cap").alias("c"))
        given = [(*p, w) for p, w in weights.items() if len(p) == i]
        if given:
            table = spark.createDataFrame(given, ", ".join(f"`{n}` string" for n in path) + ", w int")
            nodes = nodes.join(small(table, MAX_LEAVES), path, "left").withColumn("w", F.coalesce("w", F.lit(1)))
        else:
            nodes = nodes.withColumn("w", F.lit(1))
        part = ", ".join(parent) or "1"
        rank = f"partition by {part} order by c / w, {path[-1]}"
        nodes = nodes.where("w > 0 and c > 0").selectExpr(
            *path, f"b{i - 1} as b", "c", "w",
            f"coalesce(sum(c) over ({rank} rows between unbounded preceding and 1 preceding), 0) as s",
            f"sum(w) over ({rank} rows between current row and unbounded following) as rest")
        nodes = nodes.selectExpr("*", "if((b - s) / rest < c / w, (b - s) / rest, null) as rate")
        nodes = nodes.selectExpr(*path, f"if(rate is null, c, cast(floor(w * first(rate, true) over ({rank} rows between unbounded preceding and unbounded following)) as long)) as b{i}")
        out = out.join(nodes, path)
    return out.select(*names, "tokens", F.col(f"b{depth}").alias("target"))


def select(docs: DataFrame, levels: list[Column], weights: Weights, budget: int | float, max_epochs: int = 2, seed: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(__key, __text_hash, __l1.., n_tokens, target, epoch): a row for each time that a document is taken.

    A budget of type float is that share of all tokens.
    """
    names = [f"l{i}" for i in range(1, len(levels) + 1)]
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(levels, names, strict=True)], n_tokens(F.col(text)).alias("n"))
    rows = store(rows, "mix-rows")
    leaves = store(rows.groupBy(*names).agg(F.sum("n").alias("tokens"), F.count("*").alias("rows")), "mix-leaves")
    if isinstance(budget, float):
        budget = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * budget)
    plan = store(targets(leaves.drop("rows"), len(names), weights, budget, max_epochs).where("target > 0"), "mix-plan")
    plan = plan.join(leaves.select(*names, "rows"), names).selectExpr(*names, "target", "target div tokens as full", "target % tokens as part", f"1 + rows div {CELL_ROWS} as cells")
    own = rows.join(small(plan, MAX_LEAVES), names)
    whole = own.where("full > 0").withColumn("epoch", F.explode(F.expr("sequence(1, full)")))
    some = own.where("part > 0").withColumn("epoch", F.col("full") + 1)
    some = some.withColumn("u", order_hash(seed, F.col("epoch"), F.col("k"))).withColumn("cell", F.expr(f"u * cells div {1 << 32}"))
    cells = some.groupBy(*names, "cell", "part").agg(F.sum("n").alias("s"))
    before = f"sum(s) over (partition by {', '.join(names)} order by cell)"
    cells = store(cells.selectExpr(*names, "cell", f"{before} - s as base", f"{before} <= part as inside", f"{before} - s < part as begun").where("begun"), "mix-cells")
    placed = some.join(small(cells, MAX_LEAVES), [*names, "cell"])
    edge = placed.where("not inside").withColumn("cum", F.expr(f"base + sum(n) over (partition by {', '.join(names)}, cell order by u, k, th rows unbounded preceding)")).where("cum <= part")
    columns = ["k", "th", *names, "n", "target", "epoch"]
    return whole.select(columns).unionByName(placed.where("inside").select(columns)).unionByName(edge.select(columns))


#: The tree of the documents table. Fixed values of the production mix.
DOMAIN = "case when source rlike '[0-5]$' then 'web' when source rlike '[6-8]$' then 'reference' else 'forum' end"
WEIGHTS: dict[tuple[str, ...], int] = {
    ("web",): 3, ("reference",): 2, ("forum",): 1,
    **{(d, x): w for d in ("web", "reference", "forum") for x, w in (("en", 4), ("de", 2), ("fr", 2), ("es", 1))},
}
SEED, MAX_EPOCHS, SHARE = 17, 2, 0.5


def document_levels() -> list[Column]:
    return [F.expr(DOMAIN), F.col("lang"), F.col("source")]


def report(docs: DataFrame) -> DataFrame:
    return select(docs, document_levels(), WEIGHTS, SHARE, MAX_EPOCHS, SEED).select(
        F.col("k").alias("doc_id"), F.col("l1").alias("domain"), F.col("l2").alias("lang"), F.col("l3").alias("source"),
        F.col("n").alias("n_tokens"), F.col("target").alias("leaf_target"), F.col("epoch").cast("int").alias("epoch"))


@sheltered
def mix(docs: DataFrame, levels: list[Column], weights: Weights, budget: int | float, max_epochs: int = 2, seed: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the mix takes, a row once for each epoch; their own columns.

    Of rows that repeat id and text, as many stay in an epoch as the mix takes."""
    taken = select(docs, levels, weights, budget, max_epochs, seed, key, text)
    per = taken.groupBy(F.col("k").alias("__k"), F.col("th").alias("__th"), "epoch").agg(F.count("*").alias("c")).groupBy("__k", "__th").agg(F.collect_list("c").alias("__cs"))
    joined = docs.join(per, F.col(key).eqNullSafe(F.col("__k")) & F.xxhash64(text).eqNullSafe(F.col("__th")))
    if docs.groupBy(key, F.xxhash64(text)).count().where("count > 1").limit(1).count():
        joined = joined.withColumn("__nth", F.expr("row_number() over (partition by __k, __th order by __th)"))
    else:
        joined = joined.withColumn("__nth", F.lit(1))
    return joined.withColumn("__c", F.explode(F.expr("filter(__cs, c -> c >= __nth)"))).drop("__k", "__th", "__cs", "__nth", "__c")


def _oracle() -> str:
    ctes, names = [], ["l1", "l2", "l3"]
    weight = {
        1: "case l1 when 'web' then 3 when 'reference' then 2 when 'forum' then 1 else 1 end",
        2: "case l2 when 'en' then 4 when 'de' then 2 when 'fr' then 2 when 'es' then 1 else 1 end",
        3: "1",
    }
    for i in (1, 2, 3):
        path = ", ".join(names[:i])
        parent = ", ".join(names[: i - 1]) or "1"
        rank = f"partition by {parent} order by c / w, {names[i - 1]}"
        join = f"cross join (select floor(sum(tokens) * {SHARE})::bigint as b from leaves) x" if i == 1 else f"join (select {parent}, got as b from f{i - 1}) x using ({parent})"
        ctes.append(f"n{i} as (select {path}, (sum(tokens) * {MAX_EPOCHS})::bigint as c, {weight[i]} as w from leaves group by {path} having sum(tokens) > 0)")
        ctes.append(f"s{i} as (select {path}, b, c, w, coalesce(sum(c) over ({rank} rows between unbounded preceding and 1 preceding), 0) as s, sum(w) over ({rank} rows between current row and unbounded following) as rest from n{i} {join})")
        ctes.append(f"r{i} as (select *, case when (b - s)::double / rest < c::double / w then (b - s)::double / rest end as rate from s{i})")
        ctes.append(f"f{i} as (select {path}, case when rate is null then c else floor(w * first_value(rate ignore nulls) over ({rank} rows between unbounded preceding and unbounded following))::bigint end as got from r{i})")
    return f"""
with docs as (
  select doc_id, {DOMAIN.replace("source rlike '[0-5]$'", "regexp_matches(source, '[0-5]$')").replace("source rlike '[6-8]$'", "regexp_matches(source, '[6-8]$')")} as l1, coalesce(lang, '') as l2, coalesce(source, '') as l3,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n from documents),
leaves as (select l1, l2, l3, sum(n)::bigint as tokens from docs group by 1, 2, 3),
{", ".join(ctes)},
plan as (select l1, l2, l3, got as target, got // tokens as full_, got % tokens as part from f3 join leaves using (l1, l2, l3) where got > 0),
own as (select * from docs join plan using (l1, l2, l3)),
whole as (select doc_id, l1, l2, l3, n, target, unnest(range(1, full_ + 1)) as epoch from own where full_ > 0),
opened as (select *, full_ + 1 as epoch, ('0x' || substr(md5('{SEED}|' || (full_ + 1)::varchar || '|' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as u from own where part > 0),
cum as (select *, sum(n) over (partition by l1, l2, l3 order by u, doc_id rows unbounded preceding) as cum from opened)
select doc_id, l1 as domain, l2 as lang, l3 as source, n as n_tokens, target as leaf_target, epoch::int as epoch from whole
union all select doc_id, l1, l2, l3, n, target, epoch::int from cum where cum <= part
"""


ORACLE = _oracle()
