"""(source, summary) pairs: filters, donors, conversations and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import bounded
from .windows import numbered, stored


def default_budget(pairs: DataFrame, summary: Column) -> DataFrame:
    """One row (budget): the size in words of the shortest summary that is not empty."""
    return pairs.where(F.length(summary) > 0).agg(F.min(F.size(F.split(summary, " "))).alias("budget"))


def judge(pairs: DataFrame, source: Column, summary: Column, least_source: int, budget: int | None = None) -> DataFrame:
    """``pairs`` with ``reason``: why a pair is not scored, NULL if it is. Without a budget it is that of the shortest summary."""
    own = pairs.withColumn("__budget", F.lit(budget)) if budget is not None else pairs.join(F.broadcast(default_budget(pairs, summary).withColumnRenamed("budget", "__budget")))  # one row
    reason = (
        F.when(F.coalesce(F.length(source), F.lit(0)) == 0, "no source").when(F.coalesce(F.length(summary), F.lit(0)) == 0, "no summary")
        .when(F.size(F.split(source, " ")) < least_source, "short source").when(F.size(F.split(summary, " ")) < F.col("__budget"), "short summary"))
    return own.withColumn("reason", reason).drop("__budget")


def donors(pairs: DataFrame, name: str, group: str, k: int, seed: int) -> DataFrame:
    """(name, donor, nth): k other pairs of other groups for each pair, drawn by hash from all of them; all there are, if fewer.

    All pairs stand in one ring, group by group and by hash within a group. The m places beyond a pair's own group are one stretch
    of it; its donors are spread evenly over that stretch from a drawn place on, so each is found by its place in an equi-join:
    nothing is crossed, no group runs out of donors and none is read through. Places are numbered by ranges, so the ring is
    never in one task; of groups only their sizes are joined. Pairs under the budget must have been left out before, as donors must not be shorter.
    """
    drawn = lambda salt, n: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}{salt}"), F.col(name).cast("string")).cast("binary")), 1, n), 16, 10).cast("long")
    own = pairs.select(F.lit(0).alias("ring"), F.struct(F.col(group).alias("g"), drawn("", 7).alias("h"), F.col(name).alias("name")).alias("o"), drawn("p", 15).alias("p"))
    own = stored(numbered(own, "ring", "o").select("o.g", "o.name", "p", "i"))
    groups = own.groupBy(F.col("g").alias("__g")).agg(F.count("*").alias("s"), F.min("i").alias("first"))
    n = own.count()
    wanted = own.join(bounded(stored(groups)), F.col("g").eqNullSafe(F.col("__g"))).withColumn("m", n - F.col("s")).where("m > 0")
    wanted = wanted.withColumn("nth", F.explode(F.expr(f"sequence(0, cast(least({k}, m) as int) - 1)")))
    wanted = wanted.select("name", "nth", F.expr(f"(first + s + (p + nth * (m div least({k}, m))) % m) % {n}").alias("i"))
    return wanted.join(own.select("i", F.col("name").alias("donor")), "i").select("name", "donor", "nth")


def shuffled(words: Column, *seeds: Column) -> Column:
    """The words in an order drawn by MD5 of the seeds and the position."""
    tagged = F.transform(words, lambda x, i: F.concat(F.md5(F.concat_ws("|", *seeds, i.cast("string")).cast("binary")), F.lit("|"), x))
    return F.transform(F.array_sort(tagged), lambda x: F.substring(x, F.lit(34), F.length(x)))


def first_by_role(messages: DataFrame, conv: str, turn: str, role: str, text: str, roles: list[str]) -> DataFrame:
    """(conv, first_<role>...): the first message of each role."""
    return messages.groupBy(conv).agg(*[F.min_by(F.when(F.col(role) == r, F.col(text)), F.when(F.col(role) == r, F.col(turn))).alias(f"first_{r}") for r in roles])


def mask_and_pack(prompt: Column, target: Column, most: int, pad: int = 0) -> dict[str, Column]:
    """Fixed-length ids and labels: the prompt's labels are -100, what passes ``most`` is cut, the rest padded."""
    ids = F.slice(F.concat(prompt, target), 1, most)
    labels = F.slice(F.concat(F.array_repeat(F.lit(-100), F.size(prompt)), target), 1, most)
    short = F.greatest(F.lit(most) - F.size(ids), F.lit(0))
    return {
        "input_ids": F.concat(ids, F.array_repeat(F.lit(pad), short)), "labels": F.concat(labels, F.array_repeat(F.lit(-100), short)),
        "attention": F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), short))}


def shrink_to_fit(n_source: Column, n_rest: Column, most: int, least: int = 500) -> Column:
    """Length to cut a source to: nine tenths again and again while the whole is above ``most`` and it is above ``least``."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(200)), n_source.cast("long"), lambda a, _: F.when((a + n_rest > most) & (a > least), F.floor(a * 0.9)).otherwise(a))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], value: str, overwrite: bool) -> DataFrame:
    """Old and new rows by key; of a key in both, the new value if ``overwrite``, else the old."""
    a, b = old.select(*keys, F.col(value).alias("__o")), new.select(*keys, F.col(value).alias("__n"))
    first, second = ("__n", "__o") if overwrite else ("__o", "__n")
    return a.join(b, keys, "full").select(*keys, F.coalesce(first, second).alias(value))
