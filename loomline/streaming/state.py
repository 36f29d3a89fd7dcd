"""Log streams with state: entries folded from lines, and sessions, as lines arrive.

Rows wait in the state of their board until the watermark has passed them; then their order is known and they are
handled as the batch operators do. What the batch returns for the same rows is therefore returned here too, late rows
within the watermark included, only in pieces. State is kept by Spark's RocksDB provider, which the session must name
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """Keeps rows until the watermark passes them, and hands them on in order.

    ``row`` is the schema of a row in the state, its first column the time in microseconds; ``order`` the columns it is sorted by.
    ``carried`` is the schema of what one hand-over leaves for the next.
    """

    row, carried, order = "", "", ("t",)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [c.split()[0] for c in self.row.split(", ")]
        self.waiting, self.left = handle.getListState("waiting", self.row), handle.getValueState("left", self.carried)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = None
        for part in rows:
            if len(part):
                self.waiting.appendList([tuple(None if pd.isna(x) else x for x in r) for r in part[self.names].itertuples(index=False)])
                last = max(last or 0, int(part["t"].max()))
        if last is not None:
            self.handle.registerTimer(last // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pd.DataFrame(list(self.waiting.get()), columns=self.names)
        done = rows["t"] <= passed
        state = self.left.get() if self.left.exists() else None
        out, state, again = self.settle(key, rows[done].sort_values(list(self.order), kind="stable"), state, passed)
        keep = [tuple(r) for r in rows[~done].itertuples(index=False)] + again
        if keep:
            self.waiting.put(keep)
        else:
            self.waiting.clear()
        if state is not None:
            self.left.update(state)
        if len(out):
            yield out

    def settle(self, key: Any, rows: pd.DataFrame, state: tuple | None, passed: int) -> tuple[pd.DataFrame, tuple | None, list[tuple]]:
        """What is returned for rows whose order is final, what is carried on, and rows that go on waiting."""
        raise NotImplementedError


class Sessions(Ordered):
    row, carried, order = "t bigint, seq bigint, h boolean, body string", "t bigint", ("t", "seq")

    def __init__(self, lookback: int, least: int):
        self.lookback, self.least = lookback, least

    def settle(self, key: Any, rows: pd.DataFrame, state: tuple | None, passed: int) -> tuple[pd.DataFrame, tuple | None, list[tuple]]:
        before, pending, out = None if state is None else state[0], [], []
        for r in rows.itertuples(index=False):
            if not r.h:
                pending.append(r)
                continue
            least = r.t - self.lookback if before is None else before
            source = [p.body for p in pending if p.t > least]
            if len(source) >= self.least:
                out.append((key[0], r.seq, r.t, len(source), "\n".join(x for x in source if x is not None), r.body))
            before, pending = r.t, []
        if before is None:  # a first handoff that is still to come looks back no further
            pending = [p for p in pending if p.t > passed - self.lookback]
        return pd.DataFrame(out, columns=["win", "seq", "t", "n_src_lines", "source", "summary"]), None if before is None else (before,), [tuple(p) for p in pending]


class Entries(Ordered):
    row, carried, order = "t bigint, seq bigint, h boolean, line string", "first_seq bigint, body string", ("seq",)

    def settle(self, key: Any, rows: pd.DataFrame, state: tuple | None, passed: int) -> tuple[pd.DataFrame, tuple | None, list[tuple]]:
        entry, out = None if state is None else [state[0], [state[1]]], []
        for r in rows.itertuples(index=False):
            if r.h:
                if entry:
                    out.append((key[0], entry[0], "\n".join(entry[1])))
                entry = [r.seq, [r.line]]
            elif entry:  # lines before the first header go
                entry[1].append(r.line)
        return pd.DataFrame(out, columns=["board", "first_seq", "body"]), (entry[0], "\n".join(entry[1])) if entry else None, []


def _run(rows: DataFrame, key: str, processor: Ordered, schema: str) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def sessions(log: DataFrame, handoff: str, lookback_h: int = 48, least: int = 3, late: str = "1 hour") -> DataFrame:
    """``operators.windows.sessions`` over a stream (win, seq, ts, tag, body): a session is returned once the watermark has passed its handoff."""
    own = log.withWatermark("ts", late).select("win", "ts", F.unix_micros("ts").alias("t"), F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("tag") == handoff, F.lit(False)).alias("h"), "body")
    out = _run(own, "win", Sessions(lookback_h * 3_600_000_000, least), "win string, seq long, t long, n_src_lines long, source string, summary string")
    return out.select("win", "seq", F.timestamp_micros("t").alias("ts"), "n_src_lines", "source", "summary")


def folded(lines: DataFrame, is_header: Column, board: str, seq: str, at: str, line: str, late: str = "1 hour") -> DataFrame:
    """``operators.windows.fold`` over a stream (board, seq, at, line), in which ``at`` never falls as seq grows: (board, first_seq, body) of each entry once the next header of its board has come and the watermark has passed that."""
    own = lines.withWatermark(at, late).select(F.col(board).alias("board"), F.col(at).alias("at"), F.unix_micros(at).alias("t"), F.col(seq).cast("long").alias("seq"), is_header.alias("h"), F.col(line).alias("line"))
    return _run(own, "board", Entries(), "board string, first_seq long, body string")
