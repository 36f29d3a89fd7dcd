"""Streams with state against the batch operators on the same rows, which arrive out of order and in several batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import windows as W
from loomline.streaming import state

START = dt.datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def rocks(spark):
    names = {"spark.sql.streaming.stateStore.providerClass": state.PROVIDER, "spark.sql.shuffle.partitions": "2"}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def streamed(spark, make, schema, batches, tmp_path, name):
    """All that ``make`` returns for a stream that gets one batch after another."""
    (tmp_path / "in").mkdir()
    q = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"out{k}"))
            part = next((tmp_path / f"out{k}").glob("part-*"))
            part.rename(tmp_path / "in" / f"{k}.json")
            q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_sessions_are_those_of_the_batch(rocks, tmp_path):
    rng = random.Random(2)
    rows = [(f"w{rng.randint(0, 2)}", i, START + dt.timedelta(minutes=7 * i), "done" if rng.random() < 0.12 else "x", f"line {i}") for i in range(160)]
    rows += [("w0", 900 + i, START + dt.timedelta(minutes=350), "done" if i == 2 else "x", f"tie {i}") for i in range(5)]
    schema = "win string, seq long, ts timestamp, tag string, body string"
    end = [("end", 9999, START + dt.timedelta(days=30), "x", "end")]
    late = sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=rng.randint(0, 50)))  # no row is later than the watermark
    got = streamed(rocks, lambda s: state.sessions(s, "done", 3, 2), schema, [late[i : i + 45] for i in range(0, len(late), 45)] + [end], tmp_path, "sessions")
    want = W.sessions(rocks.createDataFrame(rows, schema), "done", 3, 2)
    plain = lambda df: sorted(map(tuple, df.select("win", "seq", "ts", "n_src_lines", "source", "summary").collect()))
    assert plain(got) == plain(want) and want.count() > 8


def test_entries_are_those_of_the_batch(rocks, tmp_path):
    rng = random.Random(3)
    rows = [(f"b{i % 2}", i, START + dt.timedelta(seconds=40 * (i // 3)), ("H " if rng.random() < 0.3 else "more ") + str(i)) for i in range(120)]
    schema = "board string, seq long, at timestamp, line string"
    end = [(b, 9998, START + dt.timedelta(days=1), "H end") for b in ("b0", "b1")], [("end", 9999, START + dt.timedelta(days=9), "H end")]
    late = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rng.randint(0, 3000)))
    got = streamed(rocks, lambda s: state.folded(s, F.col("line").startswith("H"), "board", "seq", "at", "line"), schema, [late[:50], late[50:], *end], tmp_path, "folded")
    want = W.fold(rocks.createDataFrame(rows, schema), F.col("line").startswith("H"), "board", "seq", "line")
    plain = lambda df: sorted(map(tuple, df.select("board", "first_seq", "body").collect()))
    assert plain(got) == plain(want) and want.count() > 20
