"""Queries of model operators: distributions of word bigrams, NLL under contexts, generation, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import models as M
from ..operators import ngrams as N
from ..operators import pairs as P
from ..operators import stats as S
from .pair_queries import CONV, conversations, donor_sql, shuffle_sql
from .catalog import WORDS, query, table



def counts_sql(t: str) -> str:
    return f"select w[i] as ctx, w[i + 1] as tok, count(*) as c from (select w, unnest(range(1, len(w))) as i from (select {WORDS.format('text')} as w from {t})) group by 1, 2"


BENCH = f"(select ctx, tok, c::double / sum(c) over (partition by ctx) as p from ({counts_sql('benchmark')}))"
CHAT = f"(select ctx, tok, c::double / sum(c) over (partition by ctx) as p from ({counts_sql('conversations')}))"


def bench(spark: SparkSession, d: str) -> DataFrame:
    return M.probabilities(M.bigram_counts(table(spark, d, "benchmark")))


def chat(spark: SparkSession, d: str) -> DataFrame:
    return M.probabilities(M.bigram_counts(table(spark, d, "conversations")))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if c in cols else c for c in df.columns])


@query(f"with c as ({counts_sql('documents')}), v as (select count(distinct tok) as v from c) select ctx, tok, c::bigint as c, round((c + 0.1) / (sum(c) over (partition by ctx) + 0.1 * v), 9) as p from c, v")
def ngram_lm_fit(spark: SparkSession, d: str) -> DataFrame:
    """Bigrams smoothed by a tenth of a count for each known word."""
    return rounded(M.fit(table(spark, d, "documents"), 0.1), "p")


@query(f"with r as (select *, row_number() over (partition by ctx order by p desc, tok) as r from {BENCH}) select ctx, tok, round(p, 9) as p from r where r <= 5")
def top_k_filter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.top_k(bench(spark, d), 5), "p")


_counts = f"c as ({counts_sql('benchmark')}), b as (select *, sum(c) over (partition by ctx) as n, coalesce(sum(c) over (partition by ctx order by c desc, tok rows between unbounded preceding and 1 preceding), 0) as before from c), k as (select * from b where before / n::double < 0.9 - 1e-9), q as (select ctx, tok, c::double / n as p, c::double / sum(c) over (partition by ctx) as q from k)"


@query(f"with {_counts} select ctx, tok, round(p, 9) as p, round(q, 9) as q from q")
def top_p_nucleus(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.nucleus(bench(spark, d), 0.9), "p", "q")


@query(f"with {_counts}, u as (select *, ('0x' || substr(md5('5|' || ctx), 1, 7))::bigint / 268435456.0::double as u, sum(q) over (partition by ctx order by q desc, tok rows unbounded preceding) as cum from q), h as (select *, max(cum) over (partition by ctx) as last from u) select ctx, arg_min(tok, cum) as tok from h where cum > least(u, last * (1 - 1e-12)) group by 1")
def multinomial_inverse_cdf(spark: SparkSession, d: str) -> DataFrame:
    u = F.conv(F.substring(F.md5(F.concat(F.lit("5|"), "ctx").cast("binary")), 1, 7), 16, 10).cast("long") / 268435456.0
    return M.draw(M.nucleus(bench(spark, d), 0.9), u)


@query(f"with z as (select a.ctx, a.tok, 0.7 * ln(a.p) + 0.3 * ln(b.p) as z from {BENCH} a join {CHAT} b using (ctx, tok)), e as (select *, exp(z - max(z) over (partition by ctx)) as e from z) select ctx, tok, round(e / sum(e) over (partition by ctx), 9) as p from e")
def product_of_experts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.product(bench(spark, d), chat(spark, d), 0.7), "p")


_uni = f"u as (select w as tok, count(*) as c from (select unnest({WORDS.format('text')}) as w from conversations) group by 1), t as (select sum(c) as n, count(*) as v from u)"
#: Words of each summary that are given, and summaries of others that are tried for each pair.
BUDGET, DONORS = 8, 3
_src = f"pr as (select conv_id as name, source, array_to_string(string_split(summary, ' ')[1:{BUDGET}], ' ') as summary from {CONV} where source is not null and summary is not null and len(string_split(summary, ' ')) >= {BUDGET}), s as (select name, tok, pos, lag(tok) over (partition by name order by pos) as prev from (select name, unnest({WORDS.format('source')}) as tok, generate_subscripts({WORDS.format('source')}, 1) - 1 as pos from pr))"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    own = conversations(spark, d).where("source is not null and summary is not null").where(F.size(F.split("summary", " ")) >= BUDGET)
    return own.select(F.col("conv_id").alias("name"), "source", F.array_join(F.slice(F.split("summary", " "), 1, BUDGET), " ").alias("summary"))


def _nll(spark: SparkSession, d: str, *conds: str) -> DataFrame:
    """Each pair without context, with its own summary, with those of DONORS other pairs, and with its own shuffled; with those of ``conds`` alone, if any."""
    pairs, conds = _pairs(spark, d), conds or ("none", "own", "shuffled", "foreign")
    mixed = P.shuffled(F.split("summary", " "), F.lit("3"), F.col("name").cast("string"))
    bodies = {"none": F.lit(""), "own": F.col("summary"), "shuffled": F.array_join(mixed, " ")}
    given = pairs.select("name", F.explode(F.array(*[F.struct(F.lit(c).alias("cond"), b.alias("body")) for c, b in bodies.items() if c in conds])).alias("x")).select("name", "x.*") if set(conds) & set(bodies) else None
    if "foreign" in conds:
        donors = P.donors(pairs, "name", "name", DONORS, 7).join(pairs.select(F.col("name").alias("donor"), F.col("summary").alias("body")), "donor")
        donors = donors.select("name", F.concat(F.lit("foreign"), F.col("nth").cast("string")).alias("cond"), "body")
        given = donors if given is None else given.union(donors)
    return M.conditional_nll(pairs, given, N.word_counts(table(spark, d, "conversations")))


_nll_sql = f"""{_uni}, {_src}, own as (select distinct name, unnest({WORDS.format('summary')}) as tok, true as ov from pr), {donor_sql('pr', 'name', 'name', 7, DONORS)},
gv as (select name, 'none' as cond, '' as body from pr union all select name, 'own', summary from pr union all select dn.name, 'foreign' || nth, pr.summary from dn join pr on pr.name = donor
 union all select name, 'shuffled', array_to_string({shuffle_sql("string_split(summary, ' ')", "'3'", 'name')}, ' ') from pr),
gw as (select name, cond, {WORDS.format('body')} as w from gv), k as (select name, cond, tok, count(*) as k from (select name, cond, unnest(w) as tok from gw) group by 1, 2, 3),
fl as (select name, cond, w[i] as prev, w[i + 1] as tok from (select name, cond, w, unnest(range(1, len(w))) as i from gw)), k2 as (select name, cond, prev, tok, count(*) as k2 from fl group by 1, 2, 3, 4), m2 as (select name, cond, prev, count(*) as m2 from fl group by 1, 2, 3),
x as (select s.name, gw.cond, s.pos, s.tok, length(s.tok) as n_char, coalesce(ov, false) as overlap, (coalesce(u.c, 0) + 1)::double / (t.n + v + 1) as p0, len(w) as m, coalesce(k.k, 0) as k, coalesce(m2.m2, 0) as m2, coalesce(k2.k2, 0) as k2
 from s cross join t left join u on u.tok = s.tok left join own on own.name = s.name and own.tok = s.tok join gw on gw.name = s.name left join k on k.name = s.name and k.cond = gw.cond and k.tok = s.tok
 left join m2 on m2.name = s.name and m2.cond = gw.cond and m2.prev = s.prev left join k2 on k2.name = s.name and k2.cond = gw.cond and k2.prev = s.prev and k2.tok = s.tok),
y as (select name, cond, pos, tok, n_char, overlap, -ln(case when m > 0 then 0.25 * k / m else 0.25 * p0 end + case when m2 > 0 then 0.25 * k2 / m2 else 0.25 * p0 end + 0.5 * p0) as nll from x)"""


@query(f"with {_nll_sql} select name, cond, pos::int as pos, tok, round(nll, 6) as nll from y where cond = 'none'")
def token_nll(spark: SparkSession, d: str) -> DataFrame:
    return _nll(spark, d, "none").select("name", "cond", "pos", "tok", F.round("nll", 6).alias("nll"))


@query(f"with {_nll_sql} select name, cond, overlap, count(*)::bigint as n from y group by 1, 2, 3")
def overlap_novel_partition(spark: SparkSession, d: str) -> DataFrame:
    return _nll(spark, d).groupBy("name", "cond", "overlap").agg(F.count("*").alias("n"))


@query(f"""with {_nll_sql}, q as (select name, pos, tok from y where cond = 'own'), ov as (select name, pos from q where tok in (select tok from own where own.name = q.name)), nv as (select name, pos from q where tok not in (select tok from own where own.name = q.name)),
n as (select name, count(*) as n from q group by 1), a as (select name, count(*) as a from ov group by 1), b as (select name, count(*) as b from nv group by 1)
select name, n::bigint as n, coalesce(a, 0)::bigint as n_overlap, coalesce(b, 0)::bigint as n_novel, 0::bigint as n_both, coalesce(a, 0) + coalesce(b, 0) = n as whole from n left join a using (name) left join b using (name)""")
def partition_gate(spark: SparkSession, d: str) -> DataFrame:
    """The scored parts against places found by a semi-join and an anti-join on the summary's words: disjoint, and all together."""
    pairs = _pairs(spark, d)
    said = pairs.select("name", F.explode(F.array_distinct(X.words(F.col("summary")))).alias("tok"))
    scored = _nll(spark, d, "own").select("name", "pos", "tok", "overlap")
    inside = scored.join(said, ["name", "tok"], "left_semi").select("name", "pos", F.lit(1).alias("a"))
    beyond = scored.join(said, ["name", "tok"], "left_anti").select("name", "pos", F.lit(1).alias("b"))
    rows = scored.join(inside, ["name", "pos"], "left").join(beyond, ["name", "pos"], "left")
    count = lambda c: F.count_if(F.expr(c))
    out = rows.groupBy("name").agg(F.count("*").alias("n"), count("overlap and a = 1").alias("n_overlap"), count("not overlap and b = 1").alias("n_novel"), count("a = 1 and b = 1").alias("n_both"))
    return out.withColumn("whole", (F.col("n_overlap") + F.col("n_novel") == F.col("n")) & (F.col("n_both") == 0))


_stats = f"{_nll_sql}, pt as (select y.*, unnest(['all', case when overlap then 'overlap' else 'novel' end]) as part from y), sb as (select name, cond, part, count(*) as n_tok, sum(n_char) as n_char, sum(nll) as nats from pt group by 1, 2, 3), wh as (select distinct name, cond, unnest(['all', 'overlap', 'novel']) as part from y), st as (select name, cond, part, coalesce(n_tok, 0)::bigint as n_tok, coalesce(n_char, 0)::bigint as n_char, coalesce(nats, 0) as nats, nats / n_tok as npt, case when n_char > 0 then nats / n_char end as npc from wh left join sb using (name, cond, part)), fm as (select name, case when cond like 'foreign%' then 'foreign' else cond end as cond, part, avg(n_tok) as n_tok, avg(n_char) as n_char, avg(nats) as nats, avg(npt) as npt, avg(npc) as npc from st group by 1, 2, 3)"


@query(f"with {_stats} select name, cond, part, n_tok, n_char, round(nats, 5) as nats, round(npt, 6) as npt, round(npc, 6) as npc from st")
def nll_subset_stats(spark: SparkSession, d: str) -> DataFrame:
    s = S.subset_stats(_nll(spark, d), ["name", "cond"])
    return s.select("name", "cond", "part", "n_tok", "n_char", F.round("nats", 5).alias("nats"), F.round("npt", 6).alias("npt"), F.round("npc", 6).alias("npc"))


@query(f"with {_stats} select name, cond, part, round(n_tok, 6) as n_tok, round(nats, 5) as nats, round(npc, 6) as npc from fm where cond = 'foreign'")
def foreign_mean(spark: SparkSession, d: str) -> DataFrame:
    """Every statistic of a pair under others' summaries, as the mean over its donors."""
    out = S.over_donors(S.subset_stats(_nll(spark, d, "foreign"), ["name", "cond"]))
    return out.select("name", "cond", "part", F.round("n_tok", 6).alias("n_tok"), F.round("nats", 5).alias("nats"), F.round("npc", 6).alias("npc"))


_deltas = f"{_stats}, dl as (select name, " + ", ".join(f"max(npc) filter (cond = 'none' and part = '{p}') - max(npc) filter (cond = '{c}' and part = '{p}') as {c}_{p}" for c in ("own", "foreign", "shuffled") for p in ("all", "overlap", "novel")) + " from fm group by 1), dd as (select *, " + ", ".join(f"own_{p} - foreign_{p} as signal_{p}" for p in ("all", "overlap", "novel")) + " from dl)"
_cells = [f"{c}_{p}" for c in ("own", "foreign", "shuffled", "signal") for p in ("all", "overlap", "novel")]


def _delta(spark: SparkSession, d: str) -> DataFrame:
    return S.deltas(S.over_donors(S.subset_stats(_nll(spark, d), ["name", "cond"])))


@query(f"with {_deltas} select name, " + ", ".join(f"round({c}, 5) + 0.0 as {c}" for c in _cells) + " from dd")
def context_deltas(spark: SparkSession, d: str) -> DataFrame:
    return _delta(spark, d).select("name", *[(F.round(c, 5) + 0.0).alias(c) for c in _cells])


@query(" union all ".join(f"(with {_deltas} select '{c}' as cell, round(avg({c}), 6) as mean, round(case when count({c}) > 0 then coalesce(stddev_samp({c}), 0) end, 6) as sd, count({c})::bigint as n from dd)" for c in ("own_all", "signal_all", "signal_novel")))
def condition_aggregate(spark: SparkSession, d: str) -> DataFrame:
    cells = ("own_all", "signal_all", "signal_novel")
    long = _delta(spark, d).select(F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.col(c).alias("v")) for c in cells])).alias("x")).select("x.*")
    return long.groupBy("cell").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(S.sd("v"), 6).alias("sd"), F.count("v").alias("n"))


@query(f"with {_deltas}, a as (select dd.*, case when name % 3 = 0 then 'a' when name % 3 = 1 then 'b' end as axis from dd) select coalesce(axis, '?') as axis, round(avg(signal_all), 6) as mean, count_if(signal_all > 0)::bigint as n_positive, count(signal_all)::bigint as n from a group by 1")
def condition_by_axis(spark: SparkSession, d: str) -> DataFrame:
    axis = F.coalesce(F.when(F.col("name") % 3 == 0, "a").when(F.col("name") % 3 == 1, "b"), F.lit("?"))
    return _delta(spark, d).groupBy(axis.alias("axis")).agg(F.round(F.avg("signal_all"), 6).alias("mean"), F.count_if(S.above(F.col("signal_all"))).alias("n_positive"), F.count("signal_all").alias("n"))


#: Characters of a sample, and how the next word is chosen: temperature, likeliest words, nucleus.
SAMPLE, HEAT, LIKELIEST, NUCLEUS = 900, 0.85, 40, 0.95


def rows_sql(counts: str, heat: float, likeliest: int, top_p: float) -> str:
    """A context's tokens and their cumulated shares, from counts or weights (ctx, tok, c)."""
    return f"""(select ctx, list(tok order by q desc, tok) as toks, list(cum order by q desc, tok) as cums from (select ctx, tok, q, sum(q) over (partition by ctx order by q desc, tok rows unbounded preceding) as cum from (select ctx, tok, p / sum(p) over (partition by ctx) as q from
 (select *, coalesce(sum(p) over (partition by ctx order by p desc, tok rows between unbounded preceding and 1 preceding), 0) as before from (select * from (select ctx, tok, e / sum(e) over (partition by ctx) as p from (select ctx, tok, exp((ln(p) - ln(max(p) over (partition by ctx))) / {heat}) as e from
 (select ctx, tok, c::double / sum(c) over (partition by ctx) as p from ({counts})))) qualify row_number() over (partition by ctx order by p desc, tok) <= {likeliest})) where before < {top_p} - 1e-9)) group by ctx)"""


def generate_sql(models: list[str], start: str, seed: int, glue: str, length: int, chars: int) -> str:
    """CTEs that end in g (name, step, tok)."""
    n = len(models)
    draw = lambda k: f"m{k}.toks[len(list_filter(m{k}.cums, lambda c: c <= least(x.u, m{k}.cums[-1] * (1 - 1e-12)))) + 1]"
    joins = " ".join(f"left join m{k} on m{k}.ctx = case when len(x.past) >= {n - k} then array_to_string(x.past[-{n - k}:], '{glue}') end" for k in range(n))
    tables = ", ".join(f"m{k} as materialized (select * from {m})" for k, m in enumerate(models))
    u = f"('0x' || substr(md5('{seed}|' || name || '|' || (step + 1)), 1, 7))::bigint / 268435456.0::double as u"
    return f"""recursive {tables}, g as (select name, 0 as step, tok, [tok] as past, length(tok) as n from ({start}) union all
 select name, step + 1, tok, list_append(past, tok)[-{n}:], n + {len(glue)} + length(tok) from (select x.name, x.step, x.past, x.n, coalesce({", ".join(draw(k) for k in range(n))}) as tok from (select *, {u} from g where step < {length} and n < {chars}) x {joins}) where tok is not null)"""


_tri = f"select w[i] || ' ' || w[i + 1] as ctx, w[i + 2] as tok, count(*) as c from (select w, unnest(range(1, len(w) - 1)) as i from (select {WORDS.format('text')} as w from benchmark)) group by 1, 2"
FIRST_WORD = "select item_id as name, regexp_extract(lower(text), '[a-z'']+') as tok from benchmark"
_said = "select name, count(*)::bigint as n_tokens, string_agg(tok, '{0}' order by step) as text from g group by name"


def _texts(rows: DataFrame, glue: str) -> DataFrame:
    at = F.array_sort(F.collect_list(F.struct("step", "tok")))  # as many as the length of a sample allows
    return rows.groupBy("name").agg(F.count("*").alias("n_tokens"), F.array_join(F.transform(at, lambda x: x["tok"]), glue).alias("text"))


@query(f"with {generate_sql([rows_sql(m, HEAT, LIKELIEST, NUCLEUS) for m in (_tri, counts_sql('benchmark'))], FIRST_WORD, 0, ' ', SAMPLE, SAMPLE)} {_said.format(' ')}")
def generate_words(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 900 characters for each benchmark item, from its first word, two words of context rolling along."""
    items = table(spark, d, "benchmark")
    starts = items.select(F.col("item_id").alias("name"), F.regexp_extract(F.lower("text"), "[a-z']+", 0).alias("tok"))
    draw = lambda counts: M.selection(M.probabilities(counts), HEAT, LIKELIEST, NUCLEUS)
    return _texts(M.generate(starts, [draw(M.trigram_counts(items)), draw(M.bigram_counts(items))], SAMPLE, 0, " ", SAMPLE), " ")


ALPHABET = "abcdefghijklmnopqrstuvwxyz "
#: Letters of a sample of the product of two experts.
LETTERS = 120


def letters_sql(t: str) -> str:
    """Smoothed shares of pairs of neighbouring letters."""
    return f"""(select ctx, tok, (c + 0.1) / (sum(c) over (partition by ctx) + 0.1 * {len(ALPHABET)}) as p from (select x.l as ctx, y.l as tok, coalesce(c, 0) as c from a x cross join a y
 left join (select t[i] as ctx, t[i + 1] as tok, count(*) as c from (select t, unnest(range(1, len(t))) as i from (select string_split(regexp_replace(lower(text), '[^{ALPHABET}]+', '', 'g'), '') as t from {t})) group by 1, 2) z on z.ctx = x.l and z.tok = y.l))"""


_product = f"""select ctx, tok, exp(z - max(z) over (partition by ctx)) as c from (select ctx, tok, (0.5 * ln(a.p) + 0.5 * ln(b.p)) / 0.85 as z from pa a join pb b using (ctx, tok))"""
_experts = f"recursive a as (select unnest(string_split('{ALPHABET}', '')) as l), pa as materialized {letters_sql('documents')}, pb as materialized {letters_sql('conversations')},"
_letters = generate_sql([rows_sql(_product, 1.0, 99, NUCLEUS)], "select item_id as name, regexp_extract(lower(text), '[a-z]') as tok from benchmark", 1, "", LETTERS, 1 << 40)


@query(f"with {_letters.replace('recursive', _experts, 1)} {_said.format('')}")
def product_generate(spark: SparkSession, d: str) -> DataFrame:
    """Letters drawn from the product of two experts, fitted on documents and on conversations, that must know the same letters."""
    a, b = (M.letter_model(table(spark, d, t), ALPHABET) for t in ("documents", "conversations"))
    M.same_vocabulary(a, b)
    starts = table(spark, d, "benchmark").select(F.col("item_id").alias("name"), F.regexp_extract(F.lower("text"), "[a-z]", 0).alias("tok"))
    return _texts(M.generate(starts, [M.selection(M.product(a, b, 0.5, HEAT), 1.0, None, NUCLEUS)], LETTERS, 1, ""), "")


#: A vocabulary of the special token, 256 bytes and 255 merged symbols.
VOCABULARY = 512


def _merges(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    return M.train_bpe(N.word_counts(table(spark, d, "documents")), VOCABULARY)


@query()
def bpe_train(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(_merges(spark, d), M.FIRST_MERGED)], "id int, a string, b string")


@query()
def bpe_encode(spark: SparkSession, d: str) -> DataFrame:
    merges, own = M.trained(N.word_counts(table(spark, d, "documents")), VOCABULARY, "word")
    return M.encode_trained(own, merges).select("word", "c", "ids")


@query()
def bpe_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, and characters a token, of each language's words under bytes alone, half and all of the merges."""
    out = M.coverage(table(spark, d, "documents"), _merges(spark, d), [M.FIRST_MERGED, (M.FIRST_MERGED + VOCABULARY) // 2, VOCABULARY], "lang")
    return out.withColumn("chars_a_token", F.round(F.col("n_chars") / F.col("n_tokens"), 6))
