"""What streaming queries report about themselves, kept as a table.

Every micro-batch of every query started inside ``watch`` leaves one row: rows
read, time taken, rows behind the watermark, state kept.  Latency, rates and late
rows of a run come from these rows, not from a clock around the call.
"""

from __future__ import annotations

import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = ("query_id string, run_id string, name string, batch_id long, started string, input_rows long, busy_ms long, "
          "late_rows long, state_rows long, state_bytes long, watermark string")
# Rows kept in memory before they are written.
HELD_ROWS = 500


class ProgressLog(StreamingQueryListener):
    """Collects progress of all queries of the session and appends it to a Parquet table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._lock = threading.Lock()
        self._rows: list[tuple] = []
        self._open: set[str] = set()
        self._over = threading.Condition(self._lock)

    def onQueryStarted(self, event):
        with self._lock:
            self._open.add(str(event.runId))

    def onQueryProgress(self, event):
        p = event.progress
        states = p.stateOperators or []
        row = (str(p.id), str(p.runId), p.name, p.batchId, p.timestamp, p.numInputRows, p.batchDuration,
               sum(s.numRowsDroppedByWatermark for s in states), sum(s.numRowsTotal for s in states),
               sum(s.memoryUsedBytes for s in states), (p.eventTime or {}).get("watermark"))
        with self._lock:
            self._rows.append(row)
            full = len(self._rows) >= HELD_ROWS
        if full:
            self.flush()

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        with self._lock:
            self._open.discard(str(event.runId))
            self._over.notify_all()

    def wait(self, seconds: float = 30.0) -> None:
        """Until the end of every query seen so far has been reported."""
        with self._lock:
            self._over.wait_for(lambda: not self._open, seconds)

    def flush(self) -> None:
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


@contextmanager
def watch(spark: SparkSession, path: str):
    """Keep the progress of the queries that start inside, as a table at ``path``."""
    log = ProgressLog(spark, path)
    spark.streams.addListener(log)
    try:
        yield log
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        log.wait()
    finally:
        spark.streams.removeListener(log)
        log.flush()


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per micro-batch; a batch that was tried again counts once."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    last = rows.groupBy("query_id", "batch_id").agg(F.max_by(F.struct(*rows.columns), "started").alias("r"))
    return last.select("r.*")


def stream_rates(progress: DataFrame) -> DataFrame:
    """Per query: batches, rows, late rows, busy time, mean time per row and rows per second."""
    sums = progress.groupBy("query_id").agg(
        F.max("name").alias("name"), F.count_if(F.col("input_rows") > 0).alias("batches"), F.sum("input_rows").alias("input_rows"),
        F.sum("late_rows").alias("late_rows"), F.sum("busy_ms").alias("busy_ms"), F.max("state_rows").alias("peak_state_rows"))
    seen = (F.col("input_rows") > 0) & (F.col("busy_ms") > 0)
    return sums.withColumns({
        "avg_latency_us": F.when(seen, F.round(F.col("busy_ms") * 1000.0 / F.col("input_rows"), 2)),
        "throughput_fps": F.when(seen, F.round(F.col("input_rows") * 1000.0 / F.col("busy_ms"), 2))})
