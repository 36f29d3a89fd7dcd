"""Queries of statistics over scored sets; lineitem stands for scores: side = return flag, variant = flag and line, window = month, of which each side has its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats as S
from .catalog import query, table

SCORES = "(select l_returnflag as side, l_returnflag || l_linenumber as variant, strftime(l_shipdate, '%Y-%m') as window_, avg(l_extendedprice / 1000 - l_quantity) as v from lineitem group by 1, 2, 3)"


def scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("side"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("variant"), F.date_format("l_shipdate", "yyyy-MM").alias("window")).agg(F.avg(F.col("l_extendedprice") / 1000 - F.col("l_quantity")).alias("v"))


_sh = f"s as {SCORES}, sh as (select window_ from s group by 1 having count(distinct variant) = (select count(distinct variant) from s)), o as (select s.* from s join sh using (window_))"
#: The same for the sides A and R alone.
_ar = _sh.replace(f"s as {SCORES}", f"s as (select * from {SCORES} where side in ('A', 'R'))")


@query(f'with {_sh} select window_ as "window" from sh')
def shared_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.shared_windows(scores(spark, d))


@query(f"with {_sh} select variant, count(*)::bigint as n_dropped from s where window_ not in (select window_ from sh) group by 1")
def dropped_windows(spark: SparkSession, d: str) -> DataFrame:
    own = scores(spark, d)
    return own.join(S.shared_windows(own), "window", "left_anti").groupBy("variant").agg(F.count("*").alias("n_dropped"))


@query(f'with {_sh} select side, window_ as "window", round(avg(v), 4) as v from s group by 1, 2')
def family_mean(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).groupBy("side", "window").agg(F.round(F.avg("v"), 4).alias("v"))


@query(f"with {_sh} select variant, count(*)::bigint as n, round(avg(v), 6) as mean, round(stddev_samp(v) / sqrt(count(*)), 6) as sem, round(avg(v) / (stddev_samp(v) / sqrt(count(*))), 4) as ratio from s group by 1")
def mean_sem(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(S.sem("v"), 6).alias("sem"), F.round(F.avg("v") / F.nullif(S.sem("v"), F.lit(0.0)), 4).alias("ratio"))


@query(f"with {_sh} select variant, count_if(v > 0)::bigint as n_positive, count(*)::bigint as n from s group by 1")
def sign_test(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).groupBy("variant").agg(F.count_if(F.col("v") > 0).alias("n_positive"), F.count("v").alias("n"))


_spread = "t as (select side, variant, avg(v) as m from o group by 1, 2), tr as (select side, count(*) as n_runs, avg(m) as mean, coalesce(stddev_samp(m), 0) as sd, coalesce(stddev_samp(m) / sqrt(count(*)), 0) as sem_train from t group by 1)"


@query(f"with {_sh}, {_spread} select side, n_runs::bigint as n_runs, round(mean, 6) as mean, round(sd, 6) as sd, round(sem_train, 6) as sem_train from tr")
def training_spread(spark: SparkSession, d: str) -> DataFrame:
    own = scores(spark, d)
    own = own.join(S.shared_windows(own), "window", "left_semi")
    return S.training_spread(own).select("side", "n_runs", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "sem_train")])


@query(f"""with {_ar}, {_spread}, f as (select window_, avg(v) filter (side = 'A') as va, avg(v) filter (side = 'R') as vb from o group by 1), d as (select vb - va as d from f),
e as (select count(*) as n_windows, avg(d) as delta, coalesce(stddev_samp(d) / sqrt(count(*)), 0) as sem_win, count_if(d > 0) as n_positive from d),
b as (select max(sem_train) filter (side = 'A') as sa, max(sem_train) filter (side = 'R') as sb from tr)
select n_windows::bigint as n_windows, round(delta, 6) as delta, round(sem_win, 6) as sem_win, n_positive::bigint as n_positive, round(sa, 6) as sem_a, round(sb, 6) as sem_b, round(sqrt(sem_win * sem_win + sa * sa + sb * sb), 6) as bar from e, b""")
def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    return S.paired_delta(scores(spark, d), "A", "R").select("n_windows", F.round("delta", 6).alias("delta"), F.round("sem_win", 6).alias("sem_win"), "n_positive", F.round("sem_a", 6).alias("sem_a"), F.round("sem_b", 6).alias("sem_b"), F.round("bar", 6).alias("bar"))


@query(f"with {_ar} select a.variant as variant_a, b.variant as variant_b, round(avg(b.v - a.v), 6) as delta from o a join o b using (window_) where a.side = 'A' and b.side = 'R' group by 1, 2")
def pairings_cross(spark: SparkSession, d: str) -> DataFrame:
    return S.pairings(scores(spark, d), "A", "R").select("variant_a", "variant_b", F.round("delta", 6).alias("delta"))


_sets = "(select distinct s_nationkey as side, s_suppkey as variant from supplier)"
#: A supplier in debt stands for a set of unknown origin, one of little balance for one without a training draw.
_prov = "(select s_suppkey as variant, case when s_acctbal >= 1500 then s_name end as training from supplier where s_acctbal >= 0)"


@query(f"""with c as (select side, count(*)::bigint as n_sets, count(distinct training)::bigint as n_trainings, count_if(p.variant is null)::bigint as n_untraceable, count_if(p.variant is not null and training is null)::bigint as n_no_draw from {_sets} s left join {_prov} p on s.variant = p.variant group by 1),
r as (select *, case when n_untraceable > 0 then 'untraceable' when n_no_draw > 0 and n_trainings = 0 then 'exempt' when n_no_draw > 0 then 'mixed' when n_trainings < 3 then 'too few' else 'replicated' end as reason from c)
select *, reason in ('exempt', 'replicated') as ok from r""")
def replication_gate(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "supplier")
    known = own.where("s_acctbal >= 0").select(F.col("s_suppkey").alias("variant"), F.when(F.col("s_acctbal") >= 1500, F.col("s_name")).alias("training"))
    return S.gate(own.select(F.col("s_nationkey").alias("side"), F.col("s_suppkey").alias("variant")), known)


@query("select l_returnflag, array_to_string(list_sort(list(distinct l_linenumber)), ',') as budgets, count(distinct l_linenumber) > 1 as differ from lineitem group by 1")
def budgets_warning(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.array_sort(F.collect_set("l_linenumber")).alias("b"))
    return own.select("l_returnflag", F.array_join(F.col("b").cast("array<string>"), ",").alias("budgets"), (F.size("b") > 1).alias("differ"))


_loss = "(select l_orderkey as run, l_linenumber as iter, l_discount as val, l_quantity as k from lineitem)"


@query(f"select run, round(sum(val * k) / sum(k), 9) as loss from {_loss} group by 1")
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 9).alias("loss"))


@query("select l_orderkey as run, min(l_discount) as best, max(struct_pack(i := l_linenumber, v := l_discount)).v as final, min(struct_pack(v := l_discount, i := l_linenumber)).i as best_iter, case when max(struct_pack(i := l_linenumber, v := l_discount)).v > min(l_discount) then 'overfit' else 'best' end as verdict from lineitem group by 1")
def best_final_verdict(spark: SparkSession, d: str) -> DataFrame:
    last = F.max(F.struct("l_linenumber", "l_discount"))["l_discount"]
    first = F.min(F.struct("l_discount", "l_linenumber"))["l_linenumber"]
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(
        F.min("l_discount").alias("best"), last.alias("final"), first.alias("best_iter"), F.when(last > F.min("l_discount"), "overfit").otherwise("best").alias("verdict"))


@query("select l_orderkey, l_linenumber, round(exp(l_discount), 9) as perplexity from lineitem")
def perplexity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.exp("l_discount"), 9).alias("perplexity"))
