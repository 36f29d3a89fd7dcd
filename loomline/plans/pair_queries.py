"""Queries over (source, summary) pairs: handoffs, donors, training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ngrams as N
from ..operators import pair_sets as PS
from ..operators import pairs as P
from .log_queries import LOG, SESSIONS, log, session_pairs
from .catalog import WORDS, query, table

CONV = "(select conv_id, string_agg(text, ' ' order by turn) filter (role = 'assistant') as source, arg_min(text, turn) filter (role = 'user') as summary, count(*)::bigint as n from conversations group by 1)"


def conversations(spark: SparkSession, d: str) -> DataFrame:
    at = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text"))))
    own = table(spark, d, "conversations").groupBy("conv_id").agg(at.alias("a"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("u"), F.count_if(F.col("role") == "user").alias("nu"), F.count("*").alias("n"))
    return own.select("conv_id", F.when(F.size("a") > 0, F.array_join(F.transform("a", lambda x: x["text"]), " ")).alias("source"), F.when(F.col("nu") > 0, F.col("u")).alias("summary"), "n")


@query("select conv_id, turn, role, length(text)::bigint as n_chars from conversations where trim(text) <> ''")
def conversations_scan(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("line"))
    r = F.from_json("line", "conv_id bigint, turn bigint, role string, text string").alias("r")
    return lines.select(r).select("r.*").where("trim(text) <> ''").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


_judge = "case when coalesce(length(source), 0) = 0 then 'no source' when coalesce(length(summary), 0) = 0 then 'no summary' when len(string_split(source, ' ')) < 64 then 'short source' when len(string_split(summary, ' ')) < 16 then 'short summary' end"


def judged(spark: SparkSession, d: str) -> DataFrame:
    return P.judge(conversations(spark, d), F.col("source"), F.col("summary"), 64, 16)


@query(f"select conv_id, {_judge} as reason from {CONV} where {_judge} is not null")
def pair_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).where("reason is not null").select("conv_id", "reason")


@query(f"""with bd as (select min(len(string_split(summary, ' '))) as b from {CONV} where length(summary) > 0)
select conv_id, source, array_to_string(string_split(summary, ' ')[1:b], ' ') as summary from {CONV}, bd where coalesce(length(source), 0) > 0 and coalesce(length(summary), 0) > 0 and len(string_split(source, ' ')) >= 64 and len(string_split(summary, ' ')) >= b""")
def pair_budget_filter(spark: SparkSession, d: str) -> DataFrame:
    """Pairs cut to the default budget, which is that of the shortest summary; pairs under it go and none is padded."""
    own = conversations(spark, d)
    budget = P.default_budget(own, F.col("summary"))
    kept = P.judge(own, F.col("source"), F.col("summary"), 64).where("reason is null").join(F.broadcast(budget))  # one row
    return kept.select("conv_id", "source", F.array_join(F.expr("slice(split(summary, ' '), 1, budget)"), " ").alias("summary"))


@query(f"select conv_id from {CONV} where coalesce(length(source), 0) > 0 and coalesce(length(summary), 0) > 0")
def nonempty_pairs(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).where("coalesce(length(source), 0) > 0 and coalesce(length(summary), 0) > 0").select("conv_id")


@query("select doc_id, substr(text, 1, 600) as by_chars, array_to_string(string_split(text, ' ')[1:157], ' ') as by_tokens from documents")
def truncate_budget(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 600).alias("by_chars"), F.array_join(F.slice(F.split("text", " "), 1, 157), " ").alias("by_tokens"))


@query("select doc_id, source from documents where starts_with(source, 'src1')")
def prefix_subset(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("source").startswith("src1")).select("doc_id", "source")


@query(f"select win, strftime(ts, '%Y-%m-%d') as day, case when tag in ('purchase', 'signup') then 'commit' else 'content' end as axis, count(*)::bigint as n_lines from {LOG} group by 1, 2, 3")
def axis_split(spark: SparkSession, d: str) -> DataFrame:
    axis = F.when(F.col("tag").isin("purchase", "signup"), "commit").otherwise("content").alias("axis")
    return log(spark, d).groupBy("win", F.date_format("ts", "yyyy-MM-dd").alias("day"), axis).agg(F.count("*").alias("n_lines"))


@query("select doc_id, case when quality is not distinct from 1 then 'val' else 'train' end as split from documents left join labels using (doc_id)")
def frozen_split(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return own.select("doc_id", F.when(F.col("quality").eqNullSafe(1), "val").otherwise("train").alias("split"))


@query(f"select seq, trim(case when starts_with('U: ' || body, 'U:') then substr('U: ' || body, 3) else body end, ' ' || chr(10) || chr(9)) as rest from {LOG}")
def strip_prefix(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).select("seq", X.strip_tag_prefix(F.concat(F.lit("[error] U: "), "body"), F.lit("u")).alias("rest"))


_latest = f"(select win, arg_max(body, seq) as summary, max(seq) as seq, arg_max(ts, seq) as ts from {LOG} where tag = 'error' group by 1)"
_files = "(select 'u' || c_custkey as win, c_name as body, c_mktsegment as tier from customer)"


def _handoff(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    latest = log(spark, d).where("tag = 'error'").groupBy("win").agg(F.max_by("body", "seq").alias("summary"), F.max("seq").alias("seq"), F.max_by("ts", "seq").alias("ts"))
    files = table(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("win"), F.col("c_name").alias("body"), F.col("c_mktsegment").alias("tier"))
    return latest, files


@query(f"select f.win, f.tier, f.body as source, l.summary, l.seq, l.ts from {_files} f join {_latest} l using (win)")
def latest_handoff_join(spark: SparkSession, d: str) -> DataFrame:
    latest, files = _handoff(spark, d)
    return files.join(latest, "win").select("win", "tier", F.col("body").alias("source"), "summary", "seq", "ts")


@query(f"select f.win from {_files} f where not exists (select 1 from {_latest} l where l.win = f.win)")
def handoff_unmatched(spark: SparkSession, d: str) -> DataFrame:
    latest, files = _handoff(spark, d)
    return files.join(latest, "win", "left_anti").select("win")


@query(f"""with {SESSIONS}, u as (select 'session' as pair_set, win || '#' || seq as name, win as grp, source, summary from s
 union all select 'handoff', f.win, f.tier, f.body, l.summary from {_files} f join {_latest} l using (win)
 union all select 'conversation', conv_id::varchar, (conv_id % 10)::varchar, source, summary from {CONV})
select pair_set, name, grp, length(source)::int as n_source, length(summary)::int as n_summary, {_judge} as reason from u""")
def pair_sets(spark: SparkSession, d: str) -> DataFrame:
    """All pair sets through the one table function that gives each by its name."""
    text = lambda c: F.col(c).cast("string")
    sets = {
        "session": session_pairs(spark, d).select(F.concat_ws("#", "win", text("seq")).alias("name"), F.col("win").alias("grp"), "source", "summary"),
        "handoff": latest_handoff_join(spark, d).select(F.col("win").alias("name"), F.col("tier").alias("grp"), "source", "summary"),
        "conversation": conversations(spark, d).select(text("conv_id").alias("name"), (F.col("conv_id") % 10).cast("string").alias("grp"), "source", "summary")}
    PS.register(spark, sets)
    return spark.sql("select pair_set, name, grp, length(source) as n_source, length(summary) as n_summary, reason from pairs(null, 64, 16)")


def donor_sql(src: str, name: str, group: str, seed: int, k: int) -> str:
    """CTEs that end in dn (name, donor, nth)."""
    h = lambda salt, n: f"('0x' || substr(md5('{seed}{salt}|' || {name}), 1, {n}))::bigint"
    return f"""rg as (select name, g, p, row_number() over (order by g, h, name) - 1 as i, count(*) over () as n, count(*) over (partition by g) as s from (select {name} as name, {group} as g, {h('', 7)} as h, {h('p', 15)} as p from {src})),
fr as (select *, min(i) over (partition by g) as first, n - s as m from rg),
dn as (select a.name, c.name as donor, nth::int as nth from fr a, range({k}) r(nth), fr c where nth < a.m and c.i = (a.first + a.s + (a.p + nth * (a.m // least({k}, a.m))) % a.m) % a.n)"""


@query(f"with {donor_sql('supplier', 's_suppkey', 's_nationkey', 7, 3)} select name, donor, nth from dn")
def foreign_donors(spark: SparkSession, d: str) -> DataFrame:
    return P.donors(table(spark, d, "supplier"), "s_suppkey", "s_nationkey", 3, 7)


@query("select c_custkey, case when o.n is null then 'missing' else 'covered' end as state, coalesce(o.n, 0)::bigint as n from customer left join (select o_custkey, count(*) as n from orders group by 1) o on o_custkey = c_custkey")
def fold_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Customers and their orders; some have none."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.when(F.col("n").isNull(), "missing").otherwise("covered").alias("state"), F.coalesce("n", F.lit(0)).alias("n"))


@query("select o_orderkey as k, v as variant, case when v = 'b' and o_orderstatus = 'F' then 'new' when v = 'a' or o_orderstatus = 'O' then o_orderstatus end as text from orders, (values ('a'), ('b')) t(v) where v = 'a' or o_orderstatus in ('F', 'O')")
def upsert_variant(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("text"))
    old = rows.withColumn("variant", F.lit("a")).unionByName(rows.where("text = 'O'").withColumn("variant", F.lit("b")))
    new = rows.where("text = 'F'").select("k", F.lit("b").alias("variant"), F.lit("new").alias("text"))
    return P.upsert(old, new, ["k", "variant"], "text", True)


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def todo_antijoin(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, d, "orders").join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query(f"select conv_id, round(length(source)::double / greatest(length(summary), 1), 9) as ratio from {CONV} where source is not null and summary is not null")
def compression_ratio(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).where("source is not null and summary is not null").select("conv_id", F.round(F.length("source") / F.greatest(F.length("summary"), F.lit(1)), 9).alias("ratio"))


@query("select conv_id, arg_min(text, turn) filter (role = 'user') as first_user, arg_min(text, turn) filter (role = 'assistant') as first_assistant from conversations group by 1")
def first_by_role(spark: SparkSession, d: str) -> DataFrame:
    return P.first_by_role(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", ["user", "assistant"])


@query("select conv_id, turn, 'User: ' || text || chr(10) || chr(10) || 'Assistant:' as prompt from conversations where role = 'user'")
def chat_prompt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", X.chat_prompt(F.col("text")).alias("prompt"))


_ids = "list_transform(regexp_extract_all({0}, '[^ \\n]+'), lambda w: length(w)::int)"


@query(f"""with p as (select conv_id, {_ids.format("summary")} as p, {_ids.format("source")} as t from {CONV} where source is not null and summary is not null), c as (select conv_id, (p || t)[1:64] as ids, (list_transform(p, lambda x: -100) || t)[1:64] as labels from p)
select conv_id, array_to_string(ids || list_transform(range(64 - len(ids)), lambda x: 0), ',') as input_ids, array_to_string(labels || list_transform(range(64 - len(ids)), lambda x: -100), ',') as labels, len(ids)::bigint as n from c""")
def mask_and_pack(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda c: F.transform(F.regexp_extract_all(c, F.lit("[^ \\n]+"), F.lit(0)), F.length)  # noqa: E731  word lengths stand for ids
    own = conversations(spark, d).where("source is not null and summary is not null").select("conv_id", ids("summary").alias("p"), ids("source").alias("t"))
    made = P.mask_and_pack(F.col("p"), F.col("t"), 64)
    join = lambda c: F.array_join(c.cast("array<string>"), ",")
    return own.select("conv_id", join(made["input_ids"]).alias("input_ids"), join(made["labels"]).alias("labels"), F.least(F.size("p") + F.size("t"), F.lit(64)).cast("long").alias("n"))


@query("select doc_id, case when text is not null then list_reduce(list_prepend(length(text), range(200)), lambda a, x: case when a + 200 > 1024 and a > 500 then floor(a * 0.9)::bigint else a end) end::bigint as n_chars from documents")
def shrink_to_fit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", P.shrink_to_fit(F.length("text"), F.lit(200), 1024).alias("n_chars"))


@query("select doc_id, lang, row_number() over (partition by lang, source order by md5('11|' || doc_id), doc_id)::int as draw from documents")
def seeded_draw(spark: SparkSession, d: str) -> DataFrame:
    h = F.md5(F.concat(F.lit("11|"), F.col("doc_id").cast("string")).cast("binary"))
    return table(spark, d, "documents").withColumn("h", h).select("doc_id", "lang", F.expr("row_number() over (partition by lang, source order by h, doc_id)").alias("draw"))


def shuffle_sql(words: str, *seeds: str) -> str:
    seed = " || '|' || ".join(seeds)
    return f"list_transform(list_sort(list_transform({words}, lambda x, i: md5({seed} || '|' || (i - 1)) || '|' || x)), lambda x: substr(x, 34))"


@query(f"select doc_id, array_to_string({shuffle_sql("string_split(text, ' ')", "'3'", 'doc_id')}, ' ') as shuffled from documents")
def shuffle_control(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(P.shuffled(F.split("text", " "), F.lit("3"), F.col("doc_id").cast("string")), " ").alias("shuffled"))


@query("with l as (select source, max(doc_id) as last from documents group by 1) select source, arg_min(doc_id, md5('5|' || doc_id)) as pick from documents join l using (source) where doc_id <> last group by 1")
def pick_not_last(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").groupBy("source").agg(F.max("doc_id").alias("last"))
    rest = table(spark, d, "documents").select("doc_id", "source").join(own, "source").where("doc_id <> last")
    return rest.groupBy("source").agg(F.min_by("doc_id", F.md5(F.concat(F.lit("5|"), F.col("doc_id").cast("string")).cast("binary"))).alias("pick"))


_start = "(1 + ('0x' || substr(md5('9|' || doc_id || '|' || k), 1, 7))::bigint % greatest(1, length(text) - 900))::int"


def _slices(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, k, text, start): eight slices, the least number of samples, of 900 characters of each text, at drawn places."""
    k = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("9"), F.col("doc_id").cast("string"), F.col("k").cast("string")).cast("binary")), 1, 7), 16, 10).cast("long")
    return table(spark, d, "documents").select("doc_id", "text", k).withColumn("u", u).withColumn("start", F.expr("cast(1 + u % greatest(1, length(text) - 900) as int)")).drop("u")


@query(f"select doc_id, k::int as k, substr(text, {_start}, 900) as slice from documents, range(8) r(k)")
def book_slices(spark: SparkSession, d: str) -> DataFrame:
    return _slices(spark, d).select("doc_id", "k", F.expr("substring(text, start, 900)").alias("slice"))


_lead = "lead(x, {0}) over o"
_met = "(select doc_id, k, count({1}{0}) as f from y semi join (select doc_id, k, {0} from y where side = 'r') using (doc_id, k, {0}) where side = 'w' group by 1, 2)"
_from_12 = "case when n >= 12 then round({0}, 9) end as {1}"


@query(f"""with s as (select doc_id, k::int as k, text, {_start} as i from documents, range(8) r(k)),
c as (select doc_id, k, {WORDS.format('substr(text, i, 900)')} as w, {WORDS.format('substr(text, 1, i - 1) || substr(text, i + 900)')} as r from s),
x as (select doc_id, k, 'w' as side, unnest(w) as x, unnest(range(len(w))) as p from c union all select doc_id, k, 'r', unnest(r), unnest(range(len(r))) from c),
y as (select doc_id, k, side, x, x || ' ' || {_lead.format(1)} || ' ' || {_lead.format(2)} as g3, g3 || ' ' || {_lead.format(3)} as g4, g4 || ' ' || {_lead.format(4)} as g5 from x window o as (partition by doc_id, k, side order by p)),
a as (select doc_id, k, count(*) as n, count(distinct x) as t, count(g3) as n3, count(g4) as n4, count(g5) as n5, count(distinct g4) as u4 from y where side = 'w' group by 1, 2)
select c.doc_id, c.k, case when n >= 12 then n::int end as words, {_from_12.format('1 - u4::double / greatest(n4, 1)', 'self_repeat')}, {_from_12.format('coalesce(m3.f, 0)::double / greatest(n3, 1)', 'verb3')},
 {_from_12.format('coalesce(m5.f, 0)::double / greatest(n5, 1)', 'verb5')}, {_from_12.format('1 - coalesce(m1.f, 0)::double / t', 'novel_words')}, {_from_12.format('t::double / n', 'ttr')}
from c left join a using (doc_id, k) left join {_met.format('g3', '')} m3 using (doc_id, k) left join {_met.format('g5', '')} m5 using (doc_id, k) left join {_met.format('x', 'distinct ')} m1 using (doc_id, k)""")
def slices_against_rest(spark: SparkSession, d: str) -> DataFrame:
    """Eight slices of each text, each measured against what is left of its text."""
    m = N.against_rest(_slices(spark, d), ["doc_id", "k"], "text", "start", 900)
    return m.select("doc_id", "k", "words", *[F.round(c, 9).alias(c) for c in ("self_repeat", "verb3", "verb5", "novel_words", "ttr")])
