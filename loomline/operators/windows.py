"""Logs, entries, and windows over them.

A log is a table with an explicit order; every operator that needs order works within a board (or key),
so no sort or running sum ever spans the whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import bounded

#: The header of a log entry, and its tag.
HEADER = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ)\s+(\S+?)@(\S+)\s+::\s+(.*)$"
TAG = r"^\[([a-z0-9-]+)\]\s*"
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ssX"
CHARS, LINES, LEAST_LINES, LEAST_CHARS, TAIL = 4200, 22, 4, 1800, 2500


def parse_line(line: Column) -> dict[str, Column]:
    """Fields of a header line; NULL time for a line that is none."""
    body = F.regexp_extract(line, HEADER, 4)
    return {
        "ts": F.try_to_timestamp(F.when(line.rlike(HEADER), F.regexp_extract(line, HEADER, 1)), F.lit(TIME_FORMAT)),
        "win": F.regexp_extract(line, HEADER, 2), "host": F.regexp_extract(line, HEADER, 3), "tag": F.regexp_extract(body, TAG, 1), "body": body,
    }


def fold(lines: DataFrame, is_header: Column, board: str, seq: str, line: str) -> DataFrame:
    """(board, entry, first_seq, body): lines without header join the entry before them; those before the first header go."""
    marked = lines.select(F.col(board), F.col(seq), F.col(line), is_header.cast("int").alias("__h"))
    marked = marked.withColumn("entry", F.expr(f"sum(__h) over (partition by `{board}` order by `{seq}`)")).where("entry > 0")
    at = F.array_sort(F.collect_list(F.struct(seq, line)))
    return marked.groupBy(board, "entry").agg(F.min(seq).alias("first_seq"), F.array_join(F.transform(at, lambda x: x[line]), "\n").alias("body"))


def take_first(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in an order; ValueError where there are fewer."""
    out = rows.orderBy(*order).limit(n)
    if out.count() < n:
        raise ValueError(f"fewer than {n} rows")
    return out


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in the SQL order."""
    return rows.withColumn("__r", F.expr(f"row_number() over (partition by {', '.join(keys)} order by {order})")).where("__r = 1").drop("__r")


def union_logs(files: list[DataFrame], keys: list[str], seq: str) -> DataFrame:
    """Entries of several files; of entries with one key that of the earliest file stays. Folding comes before."""
    ranked = [f.withColumn("file_rank", F.lit(i)) for i, f in enumerate(files)]
    out = ranked[0]
    for f in ranked[1:]:
        out = out.unionByName(f)
    return first_of(out, keys, f"file_rank, {seq}")


def sessions(log: DataFrame, handoff: str, lookback_h: int = 48, least: int = 3) -> DataFrame:
    """(win, seq, ts, n_src_lines, source, summary): for each handoff the window's own lines since the one before.

    The first handoff of a window looks back ``lookback_h`` hours; lines come before the handoff in the
    order (ts, seq).
    """
    order = "partition by win order by ts, seq"
    own = log.withColumn("__h", F.when(F.col("tag") == handoff, F.struct("ts", "seq", F.col("body").alias("summary"))))
    # each line belongs to the next handoff alone: the last one seen when the window's log is read backwards
    own = own.withColumn("__next", F.expr("last(__h, true) over (partition by win order by ts desc, seq desc rows between unbounded preceding and 1 preceding)"))
    own = own.withColumn("__lo", F.expr(f"last(__h.ts, true) over ({order} rows between unbounded preceding and 1 preceding)"))
    lines = own.where(F.col("__h").isNull() & F.col("__next").isNotNull() & (F.col("ts") > F.coalesce("__lo", F.col("__next.ts") - F.expr(f"interval {lookback_h} hours"))))
    at = F.array_sort(F.collect_list(F.struct("t", "s", "body")))
    out = lines.select("win", F.col("__next.seq").alias("seq"), F.col("__next.ts").alias("ts"), F.col("__next.summary").alias("summary"), F.col("ts").alias("t"), F.col("seq").alias("s"), "body")
    out = out.groupBy("win", "seq", "ts", "summary").agg(F.count("*").alias("n_src_lines"), F.array_join(F.transform(at, lambda x: x["body"]), "\n").alias("source"))
    return out.where(F.col("n_src_lines") >= least)


def quota_prefix(rows: DataFrame, key: str, seq: str, size: Column, quota: Column | int) -> DataFrame:
    """Rows of each key, in order, until their sizes reach the quota; the row that reaches it included."""
    own = rows.withColumn("__n", size)
    before = F.expr(f"coalesce(sum(__n) over (partition by `{key}` order by `{seq}` rows between unbounded preceding and 1 preceding), 0)")
    return own.withColumn("__before", before).where(F.col("__before") < quota).drop("__n", "__before")


#: Lines of a block that windows are cut in.
BLOCK = 2048


def stored(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder, where the session names one; else kept in memory and on disk, and made anew where an executor is lost."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def numbered(rows: DataFrame, board: str, seq: str) -> DataFrame:
    """``rows`` with ``i``, their place in the board's order from 0, found without sorting a board in one task.

    Rows are dealt by ranges of (board, seq); a row's place is the number of rows of its board in the ranges before, and its place in its own.
    """
    dealt = stored(rows.repartitionByRange(board, seq).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy(F.col(board).alias("__b"), F.col("__range").alias("__r")).agg(F.count("*").alias("__n"))
    before = sizes.select("__b", "__r", F.expr("sum(__n) over (partition by __b order by __r) - __n").alias("__before"))
    own = dealt.withColumn("__at", F.expr(f"row_number() over (partition by `{board}`, __range order by `{seq}`) - 1"))
    return own.join(before, F.col(board).eqNullSafe(F.col("__b")) & (F.col("__range") == F.col("__r"))).withColumn("i", F.col("__before") + F.col("__at")).drop("__b", "__r", "__n", "__range", "__at", "__before")


def _entries(blocks: DataFrame, most: int, length: int) -> DataFrame:
    """(b, block, entry): the first line of each block where a window starts.

    A window has at most ``most`` lines, so it reaches no further than that many lines into the next block: a block is a map
    from its possible first starts to those of the next one. The maps of a board's blocks are composed by doubling, each with
    that of 1, 2, 4, ... blocks before, until they lead there from the board's first line.
    """
    jump = f"aggregate(w, transform(sequence(0, {most - 1}), e -> block * {length} + e), (acc, x) -> transform(acc, p -> if(p = x.i, x.i + greatest(x.cnt, 1), p)))"
    maps = stored(blocks.where("more").select("b", "block", F.expr(f"transform({jump}, p -> cast(p - (block + 1) * {length} as int))").alias("to")))
    last = maps.agg(F.max("block")).first()[0]
    reach = 1
    while last is not None and reach <= last:
        before = maps.select(F.col("b").alias("__b"), (F.col("block") + reach).alias("__block"), F.col("to").alias("__to"))
        joined = maps.join(before, F.col("b").eqNullSafe(F.col("__b")) & (F.col("block") == F.col("__block")), "left")
        maps = stored(joined.select("b", "block", F.expr("if(__to is null, to, transform(__to, p -> to[p]))").alias("to")))
        reach *= 2
    first = blocks.where("block = 0").select("b", "block", F.lit(0).cast("long").alias("entry"))
    return first.unionByName(maps.select("b", (F.col("block") + 1).alias("block"), F.expr(f"(block + 1) * {length} + to[0]").alias("entry")))


def greedy_windows(lines: DataFrame, board: str, seq: str, line: str, blocked: str, chars: int = CHARS, most: int = LINES, least_lines: int = LEAST_LINES, least_chars: int = LEAST_CHARS, length: int = BLOCK) -> DataFrame:
    """(board, k, first_seq, n_lines, n_chars): disjoint windows cut one after another within each board.

    A window takes lines while it is under ``chars`` and ``most``, and ends before a blocked one; short windows are dropped
    but their lines stay used. Boards are cut into blocks of ``length`` lines, with the next ``most`` lines along, and only
    lengths travel. In a block each line gets the window that would start there; where the first one starts follows from
    the blocks before (``_entries``), and a fold over the block then finds the windows. No board is in one task.
    """
    if not 0 < most <= length:
        raise ValueError("a block must hold a window")
    kind = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    rows = lines.select(F.col(board).alias("b"), F.col(seq).alias("seq"), (F.length(line) + 1).cast("long").alias("n"), F.col(blocked).alias("no"))
    own = F.expr(f"i div {length}")
    both = F.when((own > 0) & (F.col("i") % length < most), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = numbered(rows, "b", "seq").withColumn("block", F.explode(both))
    blocks = dealt.groupBy("b", "block").agg(F.array_sort(F.collect_list(F.struct("i", "seq", "n", "no"))).alias("rows"))  # at most ``length`` and ``most``
    window = f"aggregate(slice(rows, p, {most}), named_struct('cnt', 0L, 'size', 0L, 'open', true), (s, x) -> if(s.open and not x.no and s.size < {chars}, named_struct('cnt', s.cnt + 1L, 'size', s.size + x.n, 'open', true), named_struct('cnt', s.cnt, 'size', s.size, 'open', false)))"
    each = f"transform(sequence(1, least(size(rows), {length})), p -> struct(rows[p - 1].i as i, rows[p - 1].seq as seq, {window} as w))"
    blocks = stored(blocks.select("b", "block", F.expr(f"size(rows) > {length}").alias("more"), F.expr(f"transform({each}, x -> struct(x.i as i, x.seq as seq, x.w.cnt as cnt, x.w.size as size))").alias("w")))
    cut = f"""aggregate(w, named_struct('at', entry, 'found', cast(array() as array<struct<seq:{kind[seq]},cnt:bigint,size:bigint>>)),
      (s, x) -> if(x.i = s.at, named_struct('at', x.i + greatest(x.cnt, 1L), 'found', if(x.cnt >= {least_lines} and x.size >= {least_chars}, concat(s.found, array(named_struct('seq', x.seq, 'cnt', x.cnt, 'size', x.size))), s.found)), s)).found"""
    entry = _entries(blocks, most, length).toDF("__b", "__block", "entry")
    found = blocks.join(entry, F.col("b").eqNullSafe(F.col("__b")) & (F.col("block") == F.col("__block"))).select("b", "block", F.expr(cut).alias("found"))
    found = found.withColumn("before", F.expr("sum(size(found)) over (partition by b order by block) - size(found)"))
    return found.select(F.col("b").alias(board), "before", F.posexplode("found").alias("nth", "x")).select(board, (F.col("before") + F.col("nth")).cast("long").alias("k"), F.col("x.seq").alias("first_seq"), F.col("x.cnt").alias("n_lines"), F.col("x.size").alias("n_chars"))


def strided_windows(lines: DataFrame, board: str, seq: str, line: str, n: int = 8, chars: int = CHARS, most: int = LINES, tail: int = TAIL) -> DataFrame:
    """(board, k, seq, line): window k starts at row k * (rows div n) of the last ``tail`` rows of its board; windows may overlap."""
    last = lines.select(F.col(board), F.col(seq), F.col(line)).withColumn("__r", F.expr(f"row_number() over (partition by `{board}` order by `{seq}` desc)")).where(F.col("__r") <= tail).drop("__r")
    own = last.withColumn("i", F.expr(f"row_number() over (partition by `{board}` order by `{seq}`) - 1"))
    own = own.withColumn("step", F.expr(f"count(*) over (partition by `{board}`) div {n}"))
    # a row can belong only to windows that start at most ``most`` rows before it
    low = F.expr(f"greatest(0L, if(step = 0, 0L, (i - {most - 1} + step - 1) div step))")
    high = F.expr(f"if(step = 0, {n - 1}L, least({n - 1}L, i div step))")
    rows = own.withColumn("lo", low).withColumn("hi", high).where("lo <= hi").withColumn("k", F.explode(F.sequence("lo", "hi"))).where("i >= k * step")
    before = F.expr(f"coalesce(sum(length(`{line}`) + 1) over (partition by `{board}`, k order by i rows between unbounded preceding and 1 preceding), 0)")
    return rows.withColumn("before", before).where(f"before < {chars} and i - k * step < {most}").select(board, "k", seq, line)


def tail_windows(lines: DataFrame, order: list[str], line: str, n: int = 8, chars: int = CHARS, most: int = LINES, tail: int = TAIL) -> DataFrame:
    """(k, order, line): windows as ``strided_windows`` cuts them, over the last ``tail`` rows of the whole log in its order."""
    last = lines.select(*order, line).orderBy(*[F.desc(c) for c in order]).limit(tail)  # so many rows and no more
    own = last.select(F.lit(0).alias("__log"), F.struct(*order).alias("__o"), line)
    return strided_windows(own, "__log", "__o", line, n, chars, most, tail).select("k", "__o.*", line)


#: Lines of a window that are looked up together.
HEAD = 4


def locate(windows: DataFrame, lines: DataFrame, board: str, seq: str, line: str, wid: str, text: str) -> DataFrame:
    """(wid, board, i, j): where a window's lines stand as a run of a board's lines (first place), i inclusive, j exclusive.

    A join on a hash of the first lines together, up to HEAD, finds candidates; the whole run is compared after.
    """
    w = windows.select(F.col(wid), F.split(text, "\n").alias("want")).withColumn("n", F.size("want"))
    w = w.withColumn("m", F.least("n", F.lit(HEAD))).withColumn("head", F.xxhash64(F.slice("want", F.lit(1), F.col("m"))))
    over = f"over (partition by `{board}` order by `{seq}`)"
    own = lines.select(F.col(board), F.col(seq), F.col(line)).withColumn("i", F.expr(f"row_number() {over} - 1"))
    ahead = own.select(board, "i", F.expr(f"collect_list(`{line}`) over (partition by `{board}` order by `{seq}` rows between current row and {HEAD - 1} following)").alias("next"))
    heads = ahead.select(board, "i", F.explode(F.transform(F.sequence(F.lit(1), F.size("next")), lambda m: F.struct(m.alias("m"), F.xxhash64(F.slice("next", F.lit(1), m)).alias("head")))).alias("x")).select(board, "i", "x.*")
    cand = w.join(heads, ["m", "head"]).select(wid, board, "i", "want", "n")
    steps = cand.select(wid, board, "i", "n", F.posexplode("want").alias("o", "w")).withColumn("at", F.col("i") + F.col("o"))
    hit = steps.join(
        own.selectExpr(f"`{board}` as __b", "i as __i", f"`{line}` as __l"), F.expr(f"`{board}` = __b and at = __i and w = __l"))
    whole = hit.groupBy(wid, board, "i", "n").agg(F.count("*").alias("m")).where("m = n")
    return first_of(whole, [f"`{wid}`"], f"`{board}`, i").select(wid, board, "i", (F.col("i") + F.col("n")).alias("j"))


def _long(c: Column, kind: str) -> Column:
    return F.unix_micros(c) if kind.startswith("timestamp") else c.cast("long")


def _kind(df: DataFrame, column: str) -> str:
    return next(f.dataType.simpleString() for f in df.schema.fields if f.name == column)


def binned_spans(spans: DataFrame, keys: list[str], lo: str, hi: str, closed: bool) -> tuple[DataFrame, int]:
    """(keys, __bin, __lo, __hi) and the width of a bin: spans cut at the edges of bins, half-open and disjoint within a bin.

    A bin is as wide as the spans are on average, so there are at most three rows for each span. Spans of one key are merged
    bin by bin and never all in one task. Times become microseconds.
    """
    own = spans.select(*keys, _long(F.col(lo), _kind(spans, lo)).alias("__lo"), (_long(F.col(hi), _kind(spans, hi)) + int(closed)).alias("__hi")).where("__lo < __hi")
    n, total = own.agg(F.count("*"), F.sum(F.col("__hi").cast("double") - F.col("__lo"))).first()
    width = max(1, int(-(-total // n))) if n else 1
    bin_of = lambda c: f"({c} - pmod({c}, {width}L)) div {width}L"
    cut = own.withColumn("__bin", F.explode(F.expr(f"sequence({bin_of('__lo')}, {bin_of('(__hi - 1)')})")))
    cut = cut.select(*keys, "__bin", F.expr(f"greatest(__lo, __bin * {width}L)").alias("__lo"), F.expr(f"least(__hi, (__bin + 1) * {width}L)").alias("__hi"))
    return merged_spans(cut, [*keys, "__bin"], "__lo", "__hi"), width


def _met(rows: DataFrame, spans: DataFrame, keys: list[str], at: str, lo: str, hi: str, closed: bool, how: str) -> DataFrame:
    """``rows`` joined with the spans that hold them, at most one each: an equi-join on keys and bin with the range as residual."""
    binned, width = binned_spans(spans, keys, lo, hi, closed)
    s = bounded(stored(binned)).withColumnsRenamed({k: f"__{k}" for k in keys})
    placed = rows.withColumn("__at", _long(F.col(at), _kind(rows, at))).withColumn("__of", F.expr(f"(__at - pmod(__at, {width}L)) div {width}L"))
    cond = " and ".join([*(f"`{k}` = `__{k}`" for k in keys), "__of = __bin", "__at >= __lo", "__at < __hi"])
    return placed.join(s, F.expr(cond), how).drop("__at", "__of")


def outside(rows: DataFrame, spans: DataFrame, keys: list[str], at: str, lo: str, hi: str) -> DataFrame:
    """Rows whose ``at`` lies in no closed span of the same keys, or of all spans without keys."""
    return _met(rows, spans, keys, at, lo, hi, True, "left_anti")


def merged_spans(spans: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """(keys, lo, hi): the disjoint unions of half-open spans."""
    part = ", ".join(f"`{k}`" for k in keys)
    reach = f"max(`{hi}`) over (partition by {part} order by `{lo}`, `{hi}` rows between unbounded preceding and 1 preceding)"
    own = spans.select(*keys, lo, hi).withColumn("__new", F.expr(f"cast(coalesce(`{lo}` > {reach}, true) as int)"))
    own = own.withColumn("__g", F.expr(f"sum(__new) over (partition by {part} order by `{lo}`, `{hi}` rows unbounded preceding)"))
    return own.groupBy(*keys, "__g").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__g")


def blocked(rows: DataFrame, spans: DataFrame, keys: list[str], at: str, lo: str, hi: str, closed: bool = False) -> DataFrame:
    """``rows`` with ``blocked``: whether ``at`` lies in a span of the same keys, half-open unless ``closed``."""
    return _met(rows, spans, keys, at, lo, hi, closed, "left").withColumn("blocked", F.col("__lo").isNotNull()).drop(*[f"__{k}" for k in keys], "__bin", "__lo", "__hi")


def reruns(candidates: DataFrame, claimed: DataFrame, key: str, text: str, n: int = 4) -> DataFrame:
    """(key, n_reruns): of each candidate how many of its runs of n lines are in a claimed text; 0 is kept, others are dropped."""
    known = line_runs(claimed, key, text, n).select(F.xxhash64("run").alias("h"), "run").distinct().withColumn("known", F.lit(1))
    own = line_runs(candidates, key, text, n).withColumn("h", F.xxhash64("run"))
    found = own.join(known, ["h", "run"]).groupBy(key).agg(F.count("*").alias("n"))
    return candidates.select(key).join(found, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n_reruns"))


def line_runs(texts: DataFrame, key: str, text: str, n: int = 4) -> DataFrame:
    """(key, run): runs of n lines, repeats kept."""
    lines = F.col("__l")
    return texts.select(F.col(key), F.split(text, "\n").alias("__l")).select(key, F.explode(F.when(F.size(lines) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(lines) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(lines, i, n), "\n")))).alias("run"))


#: Lengths of the stretches that lines are looked up by: the longest that a line has.
STRETCHES = (8, 4, 2, 1)


def recurring(lines: DataFrame, texts: DataFrame, line: str, key: str, text: str) -> DataFrame:
    """(line, key): lines that are substrings of texts, whose keys are distinct.

    A line is looked up by one stretch of 8 characters, or 4, 2 or 1 where it is shorter: of all its stretches the one that
    stands in the fewest texts, and not at all if one of them stands in none. So common stretches are met only by lines that
    have no rarer one. Lines whose first, last or middle stretch stands in no text go before any line is cut or moved.
    Stretches travel as hashes, without the texts; what a line meets is compared in full at the end.
    """
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    stretches = F.explode(F.expr("array_distinct(transform(sequence(0, size(a) - n), i -> xxhash64(slice(a, i + 1, n))))")).alias("g")
    longest = lambda size: F.expr("case " + " ".join(f"when {size} >= {n} then {n}" for n in STRETCHES) + " end")
    t = texts.select(F.col(key).alias("k"), F.col(text).alias("t"))
    cut = t.select("k", letters("t").alias("a"), F.explode(F.array(*map(F.lit, STRETCHES))).alias("n")).where("size(a) >= n").select("k", "n", stretches)
    often = bounded(stored(cut.groupBy("n", "g").agg(F.count("*").alias("c"))))
    own = lines.select(F.col(line).alias("l")).where("l <> ''").withColumn("n", longest("length(l)"))
    for start in ("1", "length(l) - n + 1", "(length(l) - n) div 2 + 1"):
        own = own.withColumn("g", F.xxhash64(letters(F.expr(f"substring(l, cast({start} as int), n)")))).join(often.select("n", "g"), ["n", "g"], "left_semi").drop("g")
    own = own.distinct().select("l", "n", letters("l").alias("a")).select("l", "n", stretches)
    rare = own.join(often, ["n", "g"], "left").groupBy("l", "n").agg(F.min(F.struct("c", "g")).alias("best"), F.count("c").alias("found"), F.count("*").alias("all"))
    met = rare.where("found = all").select("l", "n", F.col("best.g").alias("g")).join(cut, ["n", "g"]).select("l", "k")
    return met.join(t, "k").where(F.contains("t", F.col("l"))).select(F.col("l").alias(line), F.col("k").alias(key))


def voices(text: Column) -> Column:
    """The number of distinct speakers ``name:`` of a window."""
    return F.size(F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.element_at(F.split(x, ":"), 1))))

