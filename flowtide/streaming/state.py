"""Streaming operators with state of their own: sessions of an interval log, block requests per source.

Both keep a few numbers per key, hold rows no longer than the watermark asks for,
and emit each result once: a restart continues from the checkpointed state.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HELD = T.StructType([T.StructField("held", T.BinaryType())])


def _micros(t) -> int | None:
    return None if t is None or pd.isna(t) else pd.Timestamp(t).value // 1000


class _Sessions:
    """Rows in start order, each with the number of its session, once the session is closed.

    State per key: number and last end of the running session, its rows, and the
    rows whose turn has not come yet.
    """

    def __init__(self, columns: list[str], tie: str, gap_us: int):
        self.start, self.end, self.tie = columns.index("start_ts"), columns.index("end_ts"), columns.index(tie)
        self.columns, self.gap = columns, gap_us

    def __call__(self, key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, last, begun, rows, waiting = pickle.loads(state.get[0]) if state.exists else (0, None, False, [], [])
        for f in frames:
            waiting += [tuple(r) for r in f[self.columns].itertuples(index=False, name=None)]
        mark = state.getCurrentWatermarkMs() * 1000
        ripe = sorted((r for r in waiting if _micros(r[self.start]) < mark), key=lambda r: (_micros(r[self.start]), r[self.tie]))
        waiting = [r for r in waiting if _micros(r[self.start]) >= mark]
        closed = []
        for r in ripe:
            if begun and last is not None and _micros(r[self.start]) - last > self.gap:
                closed, rows, number = closed + rows, [], number + 1
            rows.append((*r, number))
            begun, last = True, _micros(r[self.end])
        if rows and last is not None and mark - last > self.gap:  # whatever comes now opens a new one
            closed, rows = closed + rows, []
        state.update((pickle.dumps((number, last, begun, rows, waiting)),))
        wake = [_micros(r[self.start]) // 1000 + 1 for r in waiting]
        if rows and last is not None:
            wake.append((last + self.gap) // 1000 + 1)
        if wake:
            state.setTimeoutTimestamp(max(min(wake), mark // 1000 + 1))
        if closed:
            yield pd.DataFrame(closed, columns=[*self.columns, "session_id"])


def stream_sessionize(log: DataFrame, gap_seconds: float = 60.0, tie: str = "log_id", delay: str = "10 minutes",
                      by: list[str] | None = None) -> DataFrame:
    """Streaming twin of ``sessionize``: rows of closed sessions with ``session_id``.

    A row waits until the watermark has passed its start, so rows may arrive in
    any order within ``delay``; later ones are dropped and counted by the query's
    progress.  A session is closed once the watermark is more than
    ``gap_seconds`` past its last row's end; one whose last row has no end waits
    for the next row, which then belongs to it.  Numbers run from 0 per key.
    ``by`` names the keys (a sensor, a source); without it the log is one order,
    as in the batch operator, and one key.
    """
    timed = log.withColumn("start_ts", F.col("start_ts").cast("timestamp")).withColumn("end_ts", F.col("end_ts").cast("timestamp"))
    timed = timed.where("start_ts IS NOT NULL").withWatermark("start_ts", delay)
    out = T.StructType([*timed.schema.fields, T.StructField("session_id", T.LongType())])
    step = _Sessions(timed.columns, tie, round(gap_seconds * 1e6))
    if not by:
        timed, by = timed.withColumn("_log", F.lit(0)), ["_log"]

    def run(key, frames, state):
        yield from step(key, frames, state)

    return timed.groupBy(*by).applyInPandasWithState(run, out, HELD, "append", GroupStateTimeout.EventTimeTimeout)


BLOCKS = "action string, src_ip string, first_seen timestamp, last_seen timestamp, n_alerts long, predicted_class string"
_BLOCK_STATE = "first_us long, first_flow long, last_us long, n_alerts long, predicted_class string"


class _Blocks:
    """A 'block' row when a source's first alert comes, a 'release' row with all its alerts when it has been quiet."""

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    @staticmethod
    def row(action, source, held):
        first, _, last, n, name = held
        return pd.DataFrame([(action, source, pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"), n, name)],
                            columns=["action", "src_ip", "first_seen", "last_seen", "n_alerts", "predicted_class"])

    def __call__(self, key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield self.row("release", key[0], held)
            return
        held = state.get if state.exists else None
        if held is not None and state.getCurrentWatermarkMs() * 1000 > held[2] + self.ttl:  # due, and back in the same batch
            yield self.row("release", key[0], held)
            held = None
        before = held
        for f in frames:
            if not len(f):
                continue
            f = f.sort_values(["ts", "flow_id"])
            head = f.iloc[0]
            new = (_micros(head["ts"]), int(head["flow_id"]), _micros(f["ts"].iloc[-1]), len(f), head["predicted_class"])
            if held is None:
                held = new
            else:
                first = min(held, new, key=lambda x: x[:2])
                held = (first[0], first[1], max(held[2], new[2]), held[3] + new[3], first[4])
        if held is None:
            return
        state.update(held)
        state.setTimeoutTimestamp(max((held[2] + self.ttl) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if before is None:
            yield self.row("block", key[0], held)


def stream_blocks(alert_rows: DataFrame, ttl_seconds: float = 3600.0, delay: str = "10 minutes") -> DataFrame:
    """Block requests from an alert stream, one per hostile source while it stays hostile.

    The first alert of a source emits action ``block``; further alerts are merged
    into its state and emit nothing.  Once the watermark is ``ttl_seconds`` past
    the last alert the state goes and ``release`` carries first and last alert,
    their number and the class of the first.  State is one row per blocked source.
    A source that comes back later is blocked anew.
    """
    # an alert without id comes after its equals in time
    rows = alert_rows.select(F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("flow_id").cast("long"), F.lit(2**62)).alias("flow_id"),
                             "src_ip", "predicted_class").where("ts IS NOT NULL").withWatermark("ts", delay)
    step = _Blocks(round(ttl_seconds * 1e6))

    def run(key, frames, state):
        yield from step(key, frames, state)

    return rows.groupBy("src_ip").applyInPandasWithState(run, BLOCKS, _BLOCK_STATE, "append", GroupStateTimeout.EventTimeTimeout)
