"""Queries over logs and windows, on the tables events (a log: one board per user) and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import windows as W
from .catalog import query, table


def log(spark: SparkSession, d: str) -> DataFrame:
    """events as a log: (seq, ts, win, tag, body)."""
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.date_trunc("second", "ts").alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("win"), F.col("event_type").alias("tag"), F.col("props").alias("body"))


LOG = "(select event_id as seq, date_trunc('second', ts) as ts, 'u' || user_id as win, event_type as tag, props as body from events)"


def rendered(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("  "), "win", F.lit("@host1  ::  ["), "tag", F.lit("] "), "body")
    return log(spark, d).select("seq", "win", line.alias("line"))


@query(f"""with r as (select seq, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '  ' || win || '@host1  ::  [' || tag || '] ' || body as line from {LOG})
select seq, strptime(regexp_extract(line, '^(\\S+)\\s', 1), '%Y-%m-%dT%H:%M:%SZ') as ts, regexp_extract(line, '^\\S+\\s+(\\S+?)@', 1) as win, regexp_extract(line, '@(\\S+)\\s+::', 1) as host,
 regexp_extract(line, '::\\s+\\[([a-z0-9-]+)\\]', 1) as tag, regexp_extract(line, '::\\s+(.*)$', 1) as body from r""")
def parse_log(spark: SparkSession, d: str) -> DataFrame:
    return rendered(spark, d).select("seq", *[c.alias(n) for n, c in W.parse_line(F.col("line")).items()])


@query(f"""with a as (select *, 0 as file_rank from {LOG} where seq % 3 <> 2 union all select *, 1 as file_rank from {LOG} where seq % 3 <> 0),
r as (select *, row_number() over (partition by ts, win order by file_rank, seq) as n from a) select seq, ts, win, tag, body, file_rank::int as file_rank from r where n = 1""")
def union_log(spark: SparkSession, d: str) -> DataFrame:
    own = log(spark, d)
    return W.union_logs([own.where("seq % 3 <> 2"), own.where("seq % 3 <> 0")], ["ts", "win"], "seq")


@query(f"select ts, win, count(*)::bigint as n_rows, min(seq)::bigint as kept from {LOG} group by 1, 2")
def union_dedupe(spark: SparkSession, d: str) -> DataFrame:
    own = log(spark, d)
    n = own.groupBy("ts", "win").agg(F.count("*").alias("n_rows"))
    return W.union_logs([own], ["ts", "win"], "seq").select("ts", "win", F.col("seq").alias("kept")).join(n, ["ts", "win"]).select("ts", "win", "n_rows", "kept")


_lines = "select conv_id, turn * 100000 + i as seq, line, i = 1 as header from (select conv_id, turn, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from conversations)"


@query("select conv_id, turn * 100000 + 1 as first_seq, text as body from conversations")
def fold_continuations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    rows = c.select("conv_id", (F.col("turn") * 100000 + F.col("i") + 1).alias("seq"), "line", (F.col("i") == 0).alias("h"))
    return W.fold(rows, F.col("h"), "conv_id", "seq", "line").select("conv_id", "first_seq", "body")


@query(f"select win, arg_max(seq, seq) as seq, arg_max(body, seq) as body, arg_max(tag, seq) as tag from {LOG} group by 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy("win").agg(F.max("seq").alias("seq"), F.max_by("body", "seq").alias("body"), F.max_by("tag", "seq").alias("tag"))


SESSIONS = f"""h as (select *, coalesce(lag(ts) over (partition by win order by ts, seq), ts - interval 48 hours) as lo from {LOG} where tag = 'error'),
p as (select h.win, h.seq, h.ts, h.body as summary, t.ts as tt, t.seq as tseq, t.body from h join {LOG} t on t.win = h.win and t.tag <> 'error' and t.ts > lo and (t.ts < h.ts or (t.ts = h.ts and t.seq < h.seq))),
s as (select win, seq, ts, summary, count(*)::bigint as n_src_lines, string_agg(body, chr(10) order by tt, tseq) as source from p group by 1, 2, 3, 4 having count(*) >= 3)"""


@query(f"with {SESSIONS} select win, seq, ts, summary, n_src_lines, source from s")
def session_pairs(spark: SparkSession, d: str) -> DataFrame:
    return W.sessions(log(spark, d), "error")


_greedy = """with recursive r as (select {board} as board, {seq} as seq, length({line}) + 1 as n, {blocked} as b, row_number() over (partition by {board} order by {seq}) as i from {src}),
g as (select board, i, seq, n, b, case when b then 0 else 1 end as cnt, case when b then 0 else n end as size, case when b then 0 else 1 end as w from r where i = 1
 union all select r.board, r.i, r.seq, r.n, r.b,
  case when r.b then 0 when g.b or g.size >= {chars} or g.cnt >= {most} then 1 else g.cnt + 1 end,
  case when r.b then 0 when g.b or g.size >= {chars} or g.cnt >= {most} then r.n else g.size + r.n end,
  g.w + case when not r.b and (g.b or g.size >= {chars} or g.cnt >= {most} or g.w = 0) then 1 else 0 end
 from g join r on r.board = g.board and r.i = g.i + 1),
k as (select board, w, min(seq) as first_seq, count(*)::bigint as n_lines, sum(n)::bigint as n_chars from g where not b group by 1, 2),
o as (select * from k where n_lines >= {ll} and n_chars >= {lc})
select board as {board}, (row_number() over (partition by board order by w) - 1)::bigint as k, first_seq, n_lines, n_chars from o"""


SPOKEN = "(win || ': ' || body)"


def spoken(own: DataFrame) -> DataFrame:
    """A log with ``line``: each entry as it stands in a window."""
    return own.withColumn("line", F.concat("win", F.lit(": "), "body"))


@query(_greedy.format(board="win", seq="seq", line=SPOKEN, blocked="tag = 'error'", src=LOG, chars=200, most=22, ll=4, lc=60))
def greedy_windows(spark: SparkSession, d: str) -> DataFrame:
    return W.greedy_windows(spoken(log(spark, d)).withColumn("b", F.col("tag") == "error"), "win", "seq", "line", "b", 200, 22, 4, 60)


#: Windows are cut from the last so many rows of a board, or of the whole log.
TAIL = W.TAIL
_strided = f"""tl as (select win, seq, {SPOKEN} as body from (select *, row_number() over (partition by win order by seq desc) as r from {LOG}) where r <= {TAIL}),
o as (select win, seq, body, row_number() over (partition by win order by seq) - 1 as i, count(*) over (partition by win) // 8 as step from tl),
e as (select o.*, k from o, range(8) t(k) where i >= k * step),
c as (select *, coalesce(sum(length(body) + 1) over (partition by win, k order by i rows between unbounded preceding and 1 preceding), 0) as before from e),
w as (select win, k, seq, body from c where before < 4200 and i - k * step < 22)"""


@query(f"with {_strided} select win, k, seq, body from w")
def strided_windows(spark: SparkSession, d: str) -> DataFrame:
    return strided(log(spark, d))


def strided(own: DataFrame) -> DataFrame:
    return W.strided_windows(spoken(own), "win", "seq", "line", tail=TAIL).withColumnRenamed("line", "body")


@query(f"with {_strided}, s as (select win, min(ts) as lo, max(ts) as hi from w join {LOG} l using (win, seq) where k % 3 = 0 group by win, k) select l.seq, l.win, l.ts from {LOG} l where not exists (select 1 from s where s.win = l.win and l.ts between s.lo and s.hi)")
def holdout_spans_antijoin(spark: SparkSession, d: str) -> DataFrame:
    own = log(spark, d)
    spans = strided(own).where("k % 3 = 0").join(own.select("win", "seq", "ts"), ["win", "seq"]).groupBy("win", "k").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return W.outside(own, spans, ["win"], "ts", "lo", "hi").select("seq", "win", "ts")


_tail = f"""tl as (select * from (select ts, seq, {SPOKEN} as line from {LOG}) order by ts desc, seq desc limit {TAIL}),
o as (select *, row_number() over (order by ts, seq) - 1 as i, count(*) over () // 8 as step from tl), e as (select o.*, k from o, range(8) t(k) where i >= k * step),
c as (select *, coalesce(sum(length(line) + 1) over (partition by k order by i rows between unbounded preceding and 1 preceding), 0) as before from e),
w as (select k, ts, seq, line from c where before < {W.CHARS} and i - k * step < {W.LINES}), sp as (select k, min(ts) as lo, max(ts) as hi from w group by k)"""


@query(f"with {_tail} select k, ts, seq, line from w")
def log_tail_windows(spark: SparkSession, d: str) -> DataFrame:
    """Eight windows spread over the last rows of the whole log."""
    return W.tail_windows(spoken(log(spark, d)), ["ts", "seq"], "line")


def _test_spans(spark: SparkSession, d: str) -> DataFrame:
    return log_tail_windows(spark, d).groupBy("k").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))


@query(f"with {_tail} select l.seq, l.win, l.ts from {LOG} l where not exists (select 1 from sp where l.ts between sp.lo and sp.hi)")
def log_spans_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Rows of any board outside the spans of all windows: a span of one board keeps rows of every board out."""
    return W.outside(log(spark, d), _test_spans(spark, d), [], "ts", "lo", "hi").select("seq", "win", "ts")


@query(f"with {_tail} select l.seq, l.win, exists (select 1 from sp where l.ts between sp.lo and sp.hi) as blocked from {LOG} l")
def log_blocked_rows(spark: SparkSession, d: str) -> DataFrame:
    return W.blocked(log(spark, d), _test_spans(spark, d), [], "ts", "lo", "hi", True).select("seq", "win", "blocked")


_wtext = f"{_strided}, t as (select win || '/' || k as wid, win, k, string_agg(body, chr(10) order by seq) as text, count(*) as n, min(seq) as s from w group by win, k)"


def _window_texts(spark: SparkSession, d: str) -> DataFrame:
    w = strided(log(spark, d))
    at = F.array_sort(F.collect_list(F.struct("seq", "body")))
    return w.groupBy("win", "k").agg(F.array_join(F.transform(at, lambda x: x["body"]), "\n").alias("text")).withColumn("wid", F.concat_ws("/", "win", F.col("k").cast("string")))


@query(f"""with {_wtext}, x as (select wid, string_split(text, chr(10)) as want from t), l as (select win as board, {SPOKEN} as body, row_number() over (partition by win order by seq) - 1 as i from {LOG}),
cand as (select wid, board, i, want from x join l on want[1] = body), st as (select wid, board, i, len(want) as n, unnest(want) as w, generate_subscripts(want, 1) - 1 as o from cand),
hit as (select st.wid, st.board, st.i, n from st join l on l.board = st.board and l.i = st.i + o and l.body = w),
f as (select wid, board, i, n, count(*) as m from hit group by 1, 2, 3, 4 having count(*) = n), r as (select *, row_number() over (partition by wid order by board, i) as k from f)
select wid, board as win, i, i + n as j from r where k = 1""")
def locate_window(spark: SparkSession, d: str) -> DataFrame:
    return W.locate(_window_texts(spark, d), spoken(log(spark, d)), "win", "seq", "line", "wid", "text").withColumn("j", F.col("j").cast("long"))


@query(_greedy.format(board="win", seq="seq", line=SPOKEN, blocked="b", src=f"(with {_strided}, lr as (select *, row_number() over (partition by win order by seq) - 1 as nr from {LOG}), sp as (select w.win, k, min(nr) as lo, max(nr) + 1 as hi from w join lr using (win, seq) where k < 2 group by 1, 2) select lr.*, exists (select 1 from sp where sp.win = lr.win and lr.nr >= sp.lo and lr.nr < sp.hi) as b from lr)", chars=4200, most=22, ll=3, lc=30))
def recut_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows cut from what the rows of two frozen ones leave: spans of row numbers block."""
    own = spoken(log(spark, d)).withColumn("at", F.expr("row_number() over (partition by win order by seq) - 1"))
    spans = strided(log(spark, d)).where("k < 2").join(own.select("win", "seq", "at"), ["win", "seq"]).groupBy("win", "k").agg(F.min("at").alias("lo"), (F.max("at") + 1).alias("hi"))
    return W.greedy_windows(W.blocked(own, spans, ["win"], "at", "lo", "hi"), "win", "seq", "line", "blocked", 4200, 22, 3, 30)


@query(_greedy.format(board="log", seq="seq", line="line", blocked="b", src=f"(with recursive {_tail} select 0 as log, row_number() over (order by ts, seq) as seq, line, b from (select ts, seq, {SPOKEN} as line, exists (select 1 from sp where l.ts between sp.lo and sp.hi) as b from {LOG} l))", chars=W.CHARS, most=W.LINES, ll=W.LEAST_LINES, lc=300).replace("board as log, ", ""))
def log_recut_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows cut one after another from the whole log, all boards in one order, around the spans of the test windows; first_seq is a row number."""
    rows = W.blocked(spoken(log(spark, d)), _test_spans(spark, d), [], "ts", "lo", "hi", True)
    own = W.numbered(rows.select(F.lit(0).alias("log"), F.struct("ts", "seq").alias("o"), "line", "blocked"), "log", "o").withColumn("at", F.col("i") + 1).drop("i")
    return W.greedy_windows(own, "log", "at", "line", "blocked", least_chars=300).drop("log")


_runs = "select {k}, unnest(case when len(l) >= {n} then list_transform(range(1, len(l) - {n} + 2), lambda i: array_to_string(l[i:i + {n} - 1], chr(10))) else [] end) as run from (select {k}, string_split(text, chr(10)) as l from {t})"


@query(f"""with {_wtext}, cl as (select * from t where k < 2), cd as (select * from t where k >= 2), r as (select distinct run from ({_runs.format(k='wid', n=4, t='cl')})),
h as (select wid, count(*) as n from ({_runs.format(k='wid', n=4, t='cd')}) join r using (run) group by 1) select wid, coalesce(h.n, 0)::bigint as n_reruns, coalesce(h.n, 0) > 0 as dropped from cd left join h using (wid)""")
def leakage_audit(spark: SparkSession, d: str) -> DataFrame:
    """Candidate windows that repeat a run of four lines of a frozen one are dropped."""
    texts = _window_texts(spark, d)
    return W.reruns(texts.where("k >= 2"), texts.where("k < 2"), "wid", "text").withColumn("dropped", F.col("n_reruns") > 0)


@query("with l as (select distinct unnest(string_split(text, chr(10))) as line from documents) select line, item_id from l join benchmark b on contains(b.text, line) where line <> ''")
def recurring_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return W.recurring(lines, table(spark, d, "benchmark"), "line", "item_id", "text")


@query("with c as (select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as text from conversations group by 1) select conv_id, len(list_distinct(list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, ':')), lambda x: string_split(x, ':')[1])))::bigint as n_voices from c")
def distinct_voices(spark: SparkSession, d: str) -> DataFrame:
    at = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("x"))))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(at, lambda v: v["x"]), "\n").alias("text"))
    return c.select("conv_id", W.voices(F.col("text")).cast("long").alias("n_voices"))


@query(f"with {_wtext}, m as (select win, n, length(text) as c from t) select win, count(*)::bigint as n, median(n)::double as med_lines, list_sort(list(n))[(count(*) // 10 + 1)::int]::bigint as p10_lines, median(c)::double as med_chars from m group by 1")
def window_shape(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.stats import low_decile

    m = _window_texts(spark, d).select("win", F.size(F.split("text", "\n")).cast("long").alias("n"), F.length("text").alias("c"))
    return m.groupBy("win").agg(F.count("*").alias("n"), F.median("n").alias("med_lines"), low_decile("n").cast("long").alias("p10_lines"), F.median("c").alias("med_chars"))


@query("with p as (select doc_id, lang, i, p from (select doc_id, lang, unnest(string_split(text, chr(10))) as p, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents)), c as (select *, coalesce(sum(length(p) + 2) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as before from p) select doc_id, i::int as i, p as line from c where before < 1000")
def quota_prefix(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return W.quota_prefix(p, "doc_id", "i", F.length("line") + 2, 1000).select("doc_id", "i", "line")


@query("with w as (select doc_id, string_split(text, ' ') as w from documents), s as (select *, least(4, greatest(1, len(w) // 32)) as n from w) select doc_id, list_transform(case when len(w) <= 32 then [w] when n = 1 then [w[1:32]] else list_transform(range(0, n), lambda i: w[round_even(i * (len(w) - 32) / greatest(n - 1, 1)::double, 0)::int + 1 : round_even(i * (len(w) - 32) / greatest(n - 1, 1)::double, 0)::int + 32]) end, lambda c: array_to_string(c, ' ')).array_to_string('|') as chunks from s")
def even_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = X.even_chunks(F.col("w"), 32, 4)
    return table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w")).select("doc_id", F.array_join(F.transform(c, lambda x: F.array_join(x, " ")), "|").alias("chunks"))


@query("with w as (select doc_id, regexp_extract_all(lower(text), '[a-z'']+') as w from documents) select doc_id, greatest(len(w) - 2, 0)::bigint as n_grams, case when len(w) >= 3 then w[1] || ' ' || w[2] || ' ' || w[3] end as first_gram, case when len(w) >= 3 then w[-3] || ' ' || w[-2] || ' ' || w[-1] end as last_gram from w")
def ngram_bag(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("g")
    w = table(spark, d, "documents").select("doc_id", X.words(F.col("text")).alias("w")).select("doc_id", X.grams(F.col("w"), 3).alias("g"))
    return w.select("doc_id", F.size(g).cast("long").alias("n_grams"), F.try_element_at(g, F.lit(1)).alias("first_gram"), F.try_element_at(g, F.lit(-1)).alias("last_gram"))


@query("with l as (select doc_id, string_split(text, chr(10)) as l from documents) select doc_id, len(list_distinct(l))::bigint as n_lines, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10)) as text from l")
def ordered_dedupe(spark: SparkSession, d: str) -> DataFrame:
    lines = F.array_distinct(F.split("text", "\n"))
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.array_join(lines, "\n").alias("text"))


@query(f"with r as (select *, row_number() over (partition by win order by seq) as i, count(*) over (partition by win) as n from {LOG}) select win, seq, case when i <= (95 * n) // 100 then 'train' else 'val' end as split from r")
def contiguous_split(spark: SparkSession, d: str) -> DataFrame:
    r = log(spark, d).selectExpr("win", "seq", "row_number() over (partition by win order by seq) as i", "count(*) over (partition by win) as n")
    return r.select("win", "seq", F.when(F.expr("i <= (95 * n) div 100"), "train").otherwise("val").alias("split"))


@query("with w as (select doc_id, string_split(text, ' ') as w from documents) select doc_id, len(w) > 127 as slid, array_to_string(case when len(w) > 127 then w[-127:] else w end, ' ') as context from w")
def context_slid(spark: SparkSession, d: str) -> DataFrame:
    w, last = F.split("text", " "), 127
    return table(spark, d, "documents").select("doc_id", (F.size(w) > last).alias("slid"), F.array_join(F.when(F.size(w) > last, F.slice(w, -last, last)).otherwise(w), " ").alias("context"))


@query(f"select seq, ts, win from {LOG}")
def board_order(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).select("seq", "ts", "win").orderBy("ts", "win", "seq")


@query(f"select win, seq, row_number() over (partition by win order by ts, seq)::int as pos from {LOG}")
def stable_order(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).selectExpr("win", "seq", "row_number() over (partition by win order by ts, seq) as pos")


@query(f"select seq, ts, win from {LOG} order by seq limit 97")
def take_first_n(spark: SparkSession, d: str) -> DataFrame:
    return W.take_first(log(spark, d).select("seq", "ts", "win"), ["seq"], 97)


@query(f"with d as (select distinct strftime(ts, '%Y-%m-%d') as day from {LOG}), r as (select day from d order by day desc limit 8) select l.seq, l.win, r.day from {LOG} l join r on strftime(l.ts, '%Y-%m-%d') = r.day")
def last_n_days(spark: SparkSession, d: str) -> DataFrame:
    own = log(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    days = own.select("day").distinct().orderBy(F.desc("day")).limit(8)
    return own.join(F.broadcast(days), "day").select("seq", "win", "day")  # eight rows


@query(f"select seq, win, strftime(ts, '%m%dT%H%M') as stamp, round(epoch(ts - lag(ts) over (partition by win order by ts, seq)) / 3600.0, 6) as gap_h from {LOG}")
def age_gap(spark: SparkSession, d: str) -> DataFrame:
    gap = F.expr("(unix_timestamp(ts) - unix_timestamp(lag(ts) over (partition by win order by ts, seq))) / 3600")
    return log(spark, d).select("seq", "win", F.date_format("ts", "MMdd'T'HHmm").alias("stamp"), F.round(gap, 6).alias("gap_h"))


@query("select tag, count(*)::bigint as n from " + LOG + " group by 1")
def tier_histogram(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


@query(f"with g as (select win, epoch(ts - lag(ts) over (partition by win order by ts, seq))::bigint as gap from {LOG}) select win, list_sort(list(gap) filter (gap is not null))[(count(gap) // 2 + 1)::int]::bigint as upper_median, min(gap)::bigint as least, max(gap)::bigint as most from g group by 1")
def upper_median_gap(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.stats import upper_median

    g = log(spark, d).select("win", F.expr("unix_timestamp(ts) - unix_timestamp(lag(ts) over (partition by win order by ts, seq))").alias("gap"))
    return g.groupBy("win").agg(upper_median("gap").cast("long").alias("upper_median"), F.min("gap").alias("least"), F.max("gap").alias("most"))
