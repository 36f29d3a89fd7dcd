"""Windows, gates and streams on hand-made rows."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomline.operators import stats as S
from loomline.operators import windows as W
from loomline.sources import sinks
from loomline.sources import text as T
from loomline.streaming import logs


def windows(spark, lines, blocked, *limits):
    df = spark.createDataFrame([("b", i, x, i in blocked) for i, x in enumerate(lines)], "board string, seq long, line string, blocked boolean")
    return [(r.k, r.first_seq, r.n_lines, r.n_chars) for r in W.greedy_windows(df, "board", "seq", "line", "blocked", *limits).orderBy("k").collect()]


def test_greedy_windows_by_hand(spark):
    nine = ["x" * 9] * 12  # ten characters each with the line end
    assert windows(spark, nine, set(), 30, 22, 1, 1) == [(0, 0, 3, 30), (1, 3, 3, 30), (2, 6, 3, 30), (3, 9, 3, 30)]
    assert windows(spark, nine, set(), 1000, 5, 1, 1) == [(0, 0, 5, 50), (1, 5, 5, 50), (2, 10, 2, 20)]
    assert windows(spark, nine, {4, 5}, 30, 22, 1, 1) == [(0, 0, 3, 30), (1, 3, 1, 10), (2, 6, 3, 30), (3, 9, 3, 30)]
    assert windows(spark, nine, {4, 5}, 30, 22, 2, 1) == [(0, 0, 3, 30), (1, 6, 3, 30), (2, 9, 3, 30)]  # too few lines, but used up
    assert windows(spark, ["x" * 99, "y"], set(), 30, 22, 1, 1) == [(0, 0, 1, 100), (1, 1, 1, 2)]
    assert windows(spark, nine, set(range(12)), 30, 22, 1, 1) == []


@pytest.mark.parametrize("limits", [(60, 5, 1, 1), (20, 22, 1, 1), (1000, 3, 1, 1)])
def test_greedy_windows_use_each_free_line_once_and_are_full(spark, limits):
    lines, blocked = ["x" * (1 + (i * 7) % 23) for i in range(60)], set(range(5, 60, 17))
    got = windows(spark, lines, blocked, *limits)
    assert sorted(i for _, first, n, _ in got for i in range(first, first + n)) == [i for i in range(60) if i not in blocked]
    for _, first, n, size in got:
        assert size == sum(len(x) + 1 for x in lines[first : first + n]) and n <= limits[1]
        assert size - len(lines[first + n - 1]) - 1 < limits[0]  # the last line was still wanted
        assert size >= limits[0] or n == limits[1] or first + n == 60 or first + n in blocked


def test_windows_of_many_blocks_are_those_of_one(spark):
    """Blocks of a few lines, so that starts come through the doubled maps, against the same board in one block."""
    lines = [(b, i, "x" * ((i * 11 + len(b)) % 37), (i * 7) % 41 == 3 or 50 < i < 75) for b, n in (("a", 300), ("bb", 5), ("ccc", 64)) for i in range(n)] + [(None, i, "y" * 30, False) for i in range(40)]
    df = spark.createDataFrame(lines, "board string, seq long, line string, no boolean").repartition(5)
    for limits in ((60, 5, 1, 1), (90, 7, 2, 40), (10, 1, 1, 1)):
        got = [sorted(map(str, W.greedy_windows(df, "board", "seq", "line", "no", *limits, length=n).collect())) for n in (7, 1000)]
        assert got[0] == got[1] and len(got[0]) > 20
    with pytest.raises(ValueError):
        W.greedy_windows(df, "board", "seq", "line", "no", 60, 22, length=7)


def test_places_in_a_board(spark):
    rows = [(b, i * 3) for b, n in (("a", 500), ("b", 1), (None, 30)) for i in range(n)]
    got = W.numbered(spark.createDataFrame(rows, "board string, seq long").repartition(6), "board", "seq").collect()
    assert sorted((r.board or "", r.seq, r.i) for r in got) == sorted((b or "", s, s // 3) for b, s in rows)


@pytest.mark.parametrize("closed", [False, True])
def test_spans_of_all_boards(spark, closed):
    at = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    rows = [("abc"[i % 3], at(i - 200)) for i in range(500)] + [("a", None)]
    spans = [("a", at(3), at(40)), ("b", at(20), at(21)), ("c", at(-150), at(-150)), ("a", at(100), at(290)), ("b", at(120), at(130)), ("c", at(290), at(291)), ("a", None, at(5)), ("b", at(50), at(45))]
    df, sp = spark.createDataFrame(rows, "win string, ts timestamp"), spark.createDataFrame(spans, "win string, lo timestamp, hi timestamp")
    inside = lambda t, lo, hi: None not in (t, lo, hi) and lo <= t and (t <= hi if closed else t < hi)
    for keys in ([], ["win"]):
        want = {(w, t): any(inside(t, lo, hi) and (w == v or not keys) for v, lo, hi in spans) for w, t in rows}
        got = W.blocked(df, sp, keys, "ts", "lo", "hi", closed).collect()
        assert len(got) == len(rows) and {(r.win, r.ts): r.blocked for r in got} == want
        if closed:
            assert {(r.win, r.ts) for r in W.outside(df, sp, keys, "ts", "lo", "hi").collect()} == {k for k, hit in want.items() if not hit}
    assert W.outside(df, sp.where("false"), [], "ts", "lo", "hi").count() == len(rows)


def test_tail_windows_span_boards(spark):
    rows = [(i // 2, i, f"w{i % 3}: " + "x" * (i % 5)) for i in range(100)]
    got = {}
    for r in W.tail_windows(spark.createDataFrame(rows, "ts long, seq long, line string"), ["ts", "seq"], "line", n=4, chars=40, most=6, tail=50).orderBy("k", "seq").collect():
        got.setdefault(r.k, []).append(r.seq)
    want = {}
    for k in range(4):
        i = 50 + k * 12
        size = 0
        while i < 100 and size < 40 and len(want.get(k, [])) < 6:
            want.setdefault(k, []).append(i)
            size += len(rows[i][2]) + 1
            i += 1
    assert got == want


def test_blocked_rows_and_reruns(spark):
    rows = spark.createDataFrame([("b", i) for i in range(12)] + [("c", 1)], "board string, i long")
    spans = spark.createDataFrame([("b", 1, 3), ("b", 2, 5), ("b", 5, 6), ("b", 9, 10)], "board string, lo long, hi long")
    got = W.blocked(rows, spans, ["board"], "i", "lo", "hi").collect()
    assert len(got) == 13 and {(r.board, r.i) for r in got if r.blocked} == {("b", i) for i in (1, 2, 3, 4, 5, 9)}
    texts = lambda rows: spark.createDataFrame(rows, "k string, t string")
    seen = texts([("e", "1\n2\n3\n4\n5")])
    own = texts([("run", "0\n2\n3\n4\n5\n1\n2\n3\n4"), ("lines", "1\n2\n3\nx\n4\n5"), ("short", "2\n3")])
    assert {r.k: r.n_reruns for r in W.reruns(own, seen, "k", "t").collect()} == {"run": 2, "lines": 0, "short": 0}


def test_sessions_take_each_line_to_the_next_handoff(spark):
    at = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    log = [("w", 1, at(0), "x", "old"), ("w", 2, at(60), "x", "a"), ("w", 3, at(61), "x", "b"), ("w", 4, at(61), "h", "first"), ("w", 5, at(61), "x", "same time"), ("w", 6, at(200), "x", "c"), ("w", 7, at(201), "h", "second"), ("w", 8, at(202), "x", "after"), ("v", 9, at(61), "x", "other")]
    got = W.sessions(spark.createDataFrame(log, "win string, seq long, ts timestamp, tag string, body string"), "h", 48, 1).orderBy("seq").collect()
    assert [(r.win, r.summary, r.n_src_lines, r.source) for r in got] == [("w", "first", 2, "a\nb"), ("w", "second", 1, "c")]


def test_locate_and_recurring(spark):
    lines = spark.createDataFrame([("b", i, x) for i, x in enumerate(["a", "a", "b", "a", "a", "c", "d"])], "board string, seq long, line string")
    wanted = spark.createDataFrame([("one", "a\na\nc"), ("two", "a"), ("long", "a\na\nb\na\na\nc"), ("none", "a\nc\nd\ne")], "wid string, text string")
    assert {(r.wid, r.i, r.j) for r in W.locate(wanted, lines, "board", "seq", "line", "wid", "text").collect()} == {("one", 3, 6), ("two", 0, 1), ("long", 0, 6)}
    own = ["a", "ab", "lo wor", "hello world", "world of men", "world of", "xyz", "", "longer token"]
    texts = {"t": "hello world of men a", "u": "a longer tokens list"}
    got = W.recurring(spark.createDataFrame([(x,) for x in own], "l string"), spark.createDataFrame(list(texts.items()), "k string, t string"), "l", "k", "t")
    assert {(r.l, r.k) for r in got.collect()} == {(x, k) for x in own for k, t in texts.items() if x and x in t}


def test_lines_meet_texts_by_their_rarest_stretch(spark):
    texts = [(i, f"the same beginning of the text, then word{i} and the same end of the text") for i in range(300)]
    lines = ["the text, then word7 and", "then word299 and the same", "the text, then nothing", "word1", "d11 ", "the same beginning", "é", "x"]
    tdf, ldf = spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame([(x,) for x in lines], "l string")
    got = W.recurring(ldf, tdf, "l", "k", "t")
    assert {(r.l, r.k) for r in got.collect()} == {(x, k) for x in lines for k, t in texts if x in t}


def test_medians_and_first_rows(spark):
    for n in range(1, 23):
        v = [(i * 7) % 11 for i in range(n)]
        r = spark.createDataFrame([(x,) for x in v], "v int").agg(S.upper_median("v").alias("m"), S.low_decile("v").alias("d")).first()
        assert (r.m, r.d) == (sorted(v)[n // 2], sorted(v)[n // 10])
    with pytest.raises(ValueError):
        W.take_first(spark.range(3), ["id"], 4)


def test_fold_drops_what_comes_before_the_first_header(spark):
    df = spark.createDataFrame([("b", i, x) for i, x in enumerate(["lost", "H1", "more", "H2", "a", "b"])], "board string, seq long, line string")
    got = W.fold(df, F.col("line").startswith("H"), "board", "seq", "line").orderBy("entry").collect()
    assert [r.body for r in got] == ["H1\nmore", "H2\na\nb"]


def test_gate_is_closed_unless_known(spark):
    sets = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("b", "x"), ("b", "?"), ("c", "m"), ("d", "x"), ("d", "m")], "side string, variant string")
    prov = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3"), ("m", None)], "variant string, training string")
    got = {r.side: (r.ok, r.reason) for r in S.gate(sets, prov).collect()}
    assert got == {"a": (True, "replicated"), "b": (False, "untraceable"), "c": (True, "exempt"), "d": (False, "mixed")}


def test_single_value_has_deviation_zero(spark):
    r = spark.createDataFrame([(1.0,)], "v double").agg(S.sd("v").alias("sd"), S.sem("v").alias("sem"), S.upper_median("v").alias("m")).first()
    assert (r.sd, r.sem, r.m) == (0.0, 0.0, 1.0)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "c__slug.txt").write_bytes(b"# words=12 ttr=0.5\n" + T.RULE.encode() + b"\nbody\r\nmore")
    r = T.read_samples(spark, str(tmp_path / "*.txt"), ["words", "ttr", "none"]).first()
    assert (r.config, r.slug, r.words, r.ttr, r.none, r.body) == ("c", "slug", 12.0, 0.5, None, "body\nmore")
    with pytest.raises(T.MissingInput):
        T.read_documents(spark, str(tmp_path / "nothing"))
    (tmp_path / "a.json").write_text('[{"x": 1}]')
    (tmp_path / "b.json").write_text('{"records": [{"x": 2}]}')
    assert sorted(r.x for r in T.read_records(spark, str(tmp_path / "?.json"), "struct<x:int>").collect()) == [1, 2]
    assert T.snapshot_or_live(spark, str(tmp_path / "snap"), lambda: spark.range(3)).count() == 3
    assert T.snapshot_or_live(spark, str(tmp_path / "snap"), lambda: spark.range(9)).count() == 3
    assert sinks.format_table([{"a": 0.12345, "b": None}], ["a", "b"]).splitlines()[-1] == "| 0.123 |  |"


def test_log_reader_keeps_the_order_of_large_files(spark, tmp_path):
    for name, n in (("1.log", 400), ("2.log", 5)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = T.read_log_lines(spark, [str(tmp_path / x) for x in ("2.log", "missing.log", "1.log")]).orderBy("file_rank", "seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.line for r in got] == [f"2.log {i}" for i in range(5)] + [f"1.log {i}" for i in range(400)]


def test_outside_programs_and_settings(spark, monkeypatch):
    log = spark.createDataFrame([(dt.datetime(2026, 1, d), i, f"line {i}") for i, d in enumerate([1, 2, 1])], "ts timestamp, seq long, line string")
    days = T.day_slices(log, "ts", "seq", "line")
    assert {r.day: r.output for r in T.external(days, "day", "text", T.program(["wc", "-l"])).collect()} == {"2026-01-01": "1", "2026-01-02": "0"}
    late = T.external(days, "day", "text", T.program(["sleep", "5"], 0.2)).collect()
    assert all(r.output is None and "timed out" in r.failed for r in late)
    assert T.setting(spark, "loomline.none", "LOOMLINE_NONE", "d") == "d"
    monkeypatch.setenv("LOOMLINE_NONE", "e")
    assert T.setting(spark, "loomline.none", "LOOMLINE_NONE", "d") == "e"


def test_sinks_write_what_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", "é 1"), ("b", "two")], "k string, value string")
    sinks.write_text(df, str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["two", "é 1"]
    sinks.write_json(df, str(tmp_path / "j"))
    assert sorted((r.k, r.value) for r in T.read_json(spark, str(tmp_path / "j"), "k string, value string", lines=True).collect()) == [("a", "é 1"), ("b", "two")]
    sinks.write_samples(df.withColumn("h", F.lit("words=1")), str(tmp_path / "s"), ["k"], "h", "value")
    assert spark.read.text(str(tmp_path / "s" / "k=a"), wholetext=True).first().value == "# words=1\n" + T.RULE + "\né 1\n"
    prov = "variant string, training string, written string"
    made = sinks.record_provenance(spark.createDataFrame([("v", "t1", "1"), ("w", "t2", "1")], prov), spark.createDataFrame([("v", "t3", "2")], prov))
    assert {(r.variant, r.training) for r in made.collect()} == {("v", "t3"), ("w", "t2")}
    assert {r.note: r.n for r in sinks.quality_notes(df, {"short": "length(value) < 4", "none": "k = 'z'"}).collect()} == {"short": 2, "none": 0}


def test_upsert_replaces_one_variant_and_reruns(spark, tmp_path):
    rows = lambda v, n: spark.createDataFrame([(v, i, f"{v}{i}") for i in range(n)], "variant string, k long, text string")
    path = str(tmp_path / "folds")
    sinks.upsert_variants(rows("a", 3).unionByName(rows("b", 2)), path, "t1", "2026-01-01")
    for _ in range(2):  # the second run changes nothing
        sinks.upsert_variants(rows("b", 5), path, "t2", "2026-01-02")
    got = sinks.read_variants(spark, path).collect()
    assert Counter((r.variant, r.training, r.written) for r in got) == {("a", "t1", "2026-01-01"): 3, ("b", "t2", "2026-01-02"): 5}
    assert spark.read.parquet(path + "/provenance").count() == 3


def test_stream_of_lines_and_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("2026-01-01T00:10:00Z  w1@h  ::  [go] one\nno header\n2026-01-01T00:20:00Z  w1@h  ::  [go] two\n2026-01-01T05:00:00Z  w2@h  ::  [stop] three\n")
    got = logs.counts(logs.entries(logs.read_lines(spark, str(tmp_path / "in"))), "tag")
    q = got.writeStream.outputMode("complete").format("memory").queryName("tags").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.tag, r.n) for r in spark.table("tags").collect()} == {("go", 2), ("stop", 1)}


def test_stream_drops_repeats(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType, TimestampType

    schema = StructType([StructField("ts", TimestampType()), StructField("win", StringType())])
    rows = [(dt.datetime(2026, 1, 1, 0, i % 3), "w") for i in range(6)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "log"))
    q = logs.deduped(logs.read_entries(spark, str(tmp_path / "log"), schema), ["ts", "win"]).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 3
