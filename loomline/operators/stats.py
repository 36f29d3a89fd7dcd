"""Statistics of scored pairs and of replicated experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A between-side difference needs so many distinct trainings on each side.
MIN_TRAININGS = 3
PARTS, CONDITIONS = ("all", "overlap", "novel"), ("own", "foreign", "shuffled")


def sd(v: str | Column) -> Column:
    """Sample deviation; 0 for one value, NULL for none."""
    return F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0)))


def sem(v: str | Column) -> Column:
    return F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v) / F.sqrt(F.count(v)), F.lit(0.0)))


def above(v: Column) -> Column:
    """Whether a difference of sums of doubles is positive beyond what the order of summation makes of a zero."""
    return F.round(v, 12) > 0


def upper_median(v: str) -> Column:
    """The element n div 2 of the sorted values: the upper of the two in the middle. Kept as counts of values."""
    return F.expr(f"percentile_disc(0.5) within group (order by `{v}` desc)")


def low_decile(v: str) -> Column:
    """The element n div 10 of the sorted values."""
    return F.expr(f"percentile_disc(0.9) within group (order by `{v}` desc)")


def subset_stats(tokens: DataFrame, keys: list[str], nll: str = "nll", chars: str = "n_char", overlap: str = "overlap") -> DataFrame:
    """(keys, part, n_tok, n_char, nats, npt, npc): over all tokens, those in the summary, and the others; NULL ratios where a part is empty."""
    inside = {"all": F.lit(True), "overlap": F.col(overlap), "novel": ~F.col(overlap)}
    sums = [F.struct(F.lit(p).alias("part"), F.count_if(inside[p]).alias("n_tok"), F.coalesce(F.sum(F.when(inside[p], F.col(chars))), F.lit(0)).alias("n_char"), F.sum(F.when(inside[p], F.col(nll))).alias("nats")) for p in PARTS]
    out = tokens.groupBy(*keys).agg(F.array(*sums).alias("x")).select(*keys, F.explode("x").alias("x")).select(*keys, "x.*")
    return out.select(
        *keys, "part", "n_tok", "n_char", F.coalesce("nats", F.lit(0.0)).alias("nats"),
        F.when(F.col("n_tok") > 0, F.col("nats") / F.col("n_tok")).alias("npt"), F.when(F.col("n_char") > 0, F.col("nats") / F.col("n_char")).alias("npc"))


def over_donors(stats: DataFrame, prefix: str = "foreign") -> DataFrame:
    """``stats`` with the conditions foreign0, foreign1, ... of a pair replaced by one, the mean of each statistic over them."""
    cond = F.when(F.col("cond").startswith(prefix), F.lit(prefix)).otherwise(F.col("cond")).alias("cond")
    return stats.groupBy("name", cond, "part").agg(*[F.avg(c).alias(c) for c in ("n_tok", "n_char", "nats", "npt", "npc")])


def deltas(stats: DataFrame, key: str = "name") -> DataFrame:
    """(key, <cond>_<part>, signal_<part>): NLL without context minus NLL with each; NULL where either is missing."""
    names = [f"{c}_{p}" for c in ("none", *CONDITIONS) for p in PARTS]
    wide = stats.withColumn("cell", F.concat_ws("_", "cond", "part")).groupBy(key).pivot("cell", names).agg(F.first("npc"))
    out = {f"{c}_{p}": F.col(f"none_{p}") - F.col(f"{c}_{p}") for c in CONDITIONS for p in PARTS}
    first = wide.select(key, *[v.alias(k) for k, v in out.items()])
    return first.select("*", *[(F.col(f"own_{p}") - F.col(f"foreign_{p}")).alias(f"signal_{p}") for p in PARTS])


def shared_windows(scores: DataFrame) -> DataFrame:
    """Windows that every set scored: inner join on the key over all sets."""
    n = scores.agg(F.countDistinct("side", "variant").alias("n_sets"))
    return scores.groupBy("window").agg(F.countDistinct("side", "variant").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n_sets")).select("window")  # one row


def training_spread(scores: DataFrame) -> DataFrame:
    """(side, n_runs, mean, sd, sem_train): spread of the replicates' means."""
    runs = scores.groupBy("side", "variant").agg(F.avg("v").alias("m"))
    return runs.groupBy("side").agg(F.count("*").alias("n_runs"), F.avg("m").alias("mean"), sd("m").alias("sd"), sem("m").alias("sem_train"))


def gate(sets: DataFrame, provenance: DataFrame) -> DataFrame:
    """(side, n_sets, n_trainings, n_untraceable, n_no_draw, ok, reason): closed unless all is known.

    ``sets`` (side, variant); ``provenance`` (variant, training), training NULL for one without a draw.
    """
    known = provenance.select("variant", "training", F.lit(True).alias("known"))
    c = sets.distinct().join(known, "variant", "left").groupBy("side").agg(
        F.count("*").alias("n_sets"), F.countDistinct("training").alias("n_trainings"), F.count_if(F.col("known").isNull()).alias("n_untraceable"),
        F.count_if(F.col("known") & F.col("training").isNull()).alias("n_no_draw"))
    reason = (
        F.when(F.col("n_untraceable") > 0, "untraceable").when((F.col("n_no_draw") > 0) & (F.col("n_trainings") == 0), "exempt")
        .when(F.col("n_no_draw") > 0, "mixed").when(F.col("n_trainings") < MIN_TRAININGS, "too few").otherwise("replicated"))
    return c.withColumn("reason", reason).withColumn("ok", F.col("reason").isin("exempt", "replicated"))


def paired_delta(scores: DataFrame, a: str, b: str) -> DataFrame:
    """One row: family mean of side b minus side a over shared windows, with the window and training errors in one bar."""
    own = scores.where(F.col("side").isin(a, b))
    own = own.join(shared_windows(own), "window", "left_semi")
    family = own.groupBy("window").agg(F.avg(F.when(F.col("side") == a, F.col("v"))).alias("va"), F.avg(F.when(F.col("side") == b, F.col("v"))).alias("vb"))
    d = family.select((F.col("vb") - F.col("va")).alias("d")).agg(F.count("*").alias("n_windows"), F.avg("d").alias("delta"), sem("d").alias("sem_win"), F.count_if(F.col("d") > 0).alias("n_positive"))
    t = training_spread(own).agg(F.max(F.when(F.col("side") == a, F.col("sem_train"))).alias("sem_a"), F.max(F.when(F.col("side") == b, F.col("sem_train"))).alias("sem_b"))
    return d.join(F.broadcast(t)).withColumn("bar", F.sqrt(F.col("sem_win") * F.col("sem_win") + F.col("sem_a") * F.col("sem_a") + F.col("sem_b") * F.col("sem_b")))  # one row each


def pairings(scores: DataFrame, a: str, b: str) -> DataFrame:
    """(variant_a, variant_b, delta): mean difference of every replicate of b with every one of a, over shared windows."""
    own = scores.where(F.col("side").isin(a, b))
    own = own.join(shared_windows(own), "window", "left_semi")
    x = own.where(F.col("side") == a).select("window", F.col("variant").alias("variant_a"), F.col("v").alias("va"))
    y = own.where(F.col("side") == b).select("window", F.col("variant").alias("variant_b"), F.col("v").alias("vb"))
    return x.join(y, "window").groupBy("variant_a", "variant_b").agg(F.avg(F.col("vb") - F.col("va")).alias("delta"))
