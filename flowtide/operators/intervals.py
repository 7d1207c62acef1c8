"""Attack-interval logs: sessions, clock alignment, interval labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowtide import schema as S
from flowtide.functions import micros
from flowtide.operators.ordering import BLOCK, block_window, carry_last, carry_sum, ordered_blocks
from flowtide.session import BROADCAST_ROWS, cut

# A broadcast probe looks at no more than this many segments per time bucket.
MAX_SEGMENTS_PER_BUCKET = 64


def session_gap(log: DataFrame, tie: str = "log_id") -> DataFrame:
    """``gap_sec``: seconds from the previous row's end to this row's start, by start order.

    Null where the previous row has no end, however the log is split into blocks.
    """
    return _gaps(log, tie).drop(BLOCK)


def _gaps(log: DataFrame, tie: str) -> DataFrame:
    keys = ["start_ts", tie]
    blocks = ordered_blocks(log, keys)
    w = block_window(keys)
    ends = blocks.withColumns({"_pos": F.row_number().over(w), "_prev": F.lag("end_ts").over(w)})
    carry = carry_last(blocks, keys, F.struct("end_ts"), "_carry")  # a struct carries a null end too
    prev = F.when(F.col("_pos") == 1, F.col("_carry.end_ts")).otherwise(F.col("_prev"))
    return (ends.join(F.broadcast(carry), BLOCK)  # one row per block
            .withColumn("gap_sec", (micros("start_ts") - micros(prev)) / 1e6)
            .drop("_pos", "_prev", "_carry"))


def sessionize(log: DataFrame, gap_seconds: float = 60.0, tie: str = "log_id") -> DataFrame:
    """``session_id``: running number of gaps longer than ``gap_seconds``, from 0.

    A row after one without an end has no gap and stays in the session.
    """
    keys = ["start_ts", tie]
    gaps = _gaps(log, tie)
    opens = F.coalesce((F.col("gap_sec") > gap_seconds).cast("bigint"), F.lit(0).cast("bigint"))
    w = block_window(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = gaps.withColumn("_within", F.sum(opens).over(w))
    carry = carry_sum(gaps, opens, "_before")
    return (within.join(F.broadcast(carry), BLOCK)  # one row per block
            .withColumn("session_id", F.col("_within") + F.col("_before"))
            .drop("_within", "_before", BLOCK))


def pick_session(sessions: DataFrame, session_id: int) -> DataFrame:
    return sessions.where(F.col("session_id") == session_id)


def align_clocks(flows: DataFrame, intervals: DataFrame, ts: str = "ts") -> DataFrame:
    """Move the intervals so that the first one starts with the first flow."""
    offset = micros(flows.agg(F.min(ts)).scalar()) - micros(intervals.agg(F.min("start_ts")).scalar())
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (offset / F.lit(1000000)).cast("decimal(18,6)"))
    return intervals.withColumns({"start_ts": F.col("start_ts") + shift, "end_ts": F.col("end_ts") + shift})


# --- interval labels --------------------------------------------------------
#
# Of all intervals that cover a moment, the one that started last wins.  The
# winner changes only at interval ends, so the log is first turned into
# disjoint segments; then each flow meets exactly one segment, however many
# intervals overlap.

# Halving steps of the dyadic cover: 2**52 microseconds are 142 years.
_LEVELS = 53


def _cover_blocks(iv: DataFrame) -> DataFrame:
    """Cut each half-open [a, b) into at most two aligned power-of-two blocks per level."""
    k = F.col("level")
    one = F.lit(1).cast("bigint")
    size = F.call_function("shiftleft", one, k)
    lo = F.call_function("shiftright", F.col("a") + size - 1, k)   # first block that starts at or after a
    hi = F.call_function("shiftright", F.col("b"), k)              # first block that ends after b
    at = iv.select("*", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS - 1))).alias("level"))
    at = at.withColumns({"lo": lo, "hi": hi}).where("lo < hi")
    left = F.when(F.col("lo") % 2 == 1, F.col("lo"))
    right = F.when(F.col("hi") % 2 == 1, F.col("hi") - 1)
    nodes = F.array_compact(F.array(left, right))
    return at.select(*iv.columns, "level", F.explode(nodes).alias("node"))


def winner_segments(log: DataFrame, tie: str = "log_id", cls: str = "class_label") -> DataFrame:
    """(seg_us, seg_class): from ``seg_us`` until the next row's, ``seg_class`` holds (null = benign)."""
    iv = log.where((F.col(cls) != S.BENIGN) & (F.col("start_ts") <= F.col("end_ts"))).select(
        micros("start_ts").alias("a"), (micros("end_ts") + 1).alias("b"),
        F.struct(micros("start_ts").alias("s"), F.col(tie).alias("t"), F.col(cls).alias("c")).alias("w"))
    best = _cover_blocks(iv).groupBy("level", "node").agg(F.max("w").alias("w"))
    points = iv.select(F.explode(F.array("a", "b")).alias("seg_us")).distinct()
    steps = points.select(
        "seg_us", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS - 1))).alias("level"),
    ).withColumn("node", F.call_function("shiftright", F.col("seg_us"), F.col("level")))
    won = steps.join(best, ["level", "node"], "left").groupBy("seg_us").agg(F.max("w").alias("w"))
    return won.select("seg_us", F.col("w.c").alias("seg_class"))


def label_by_interval(flows: DataFrame, log: DataFrame, ts: str = "ts", flow_id: str = "flow_id",
                      tie: str = "log_id", cls: str = "class_label", out: str = "ground_truth_label",
                      broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Class of the last-started non-benign interval that covers each flow, else BENIGN.

    A log whose segments are few and evenly spread is broadcast and probed by
    time bucket, with no shuffle of the flows.  A larger or denser log goes
    through one range sort of flows and segments together.
    """
    segments = cut(winner_segments(log, tie, cls))
    span = segments.agg(F.count(F.lit(1)).alias("n"), F.min("seg_us").alias("lo"),
                        F.max("seg_us").alias("hi")).first()
    if span["n"] == 0:
        return flows.withColumn(out, F.lit(S.BENIGN))
    probe = None
    if span["n"] <= broadcast_rows:
        width = max((span["hi"] - span["lo"]) // (4 * span["n"]), 1)
        probe = _bucket_table(segments, width, broadcast_rows)
    if probe is None:
        return _label_by_sort(flows, segments, ts, flow_id, out)
    t = micros(ts)
    keyed = flows.withColumns({"_us": t, "_bucket": F.floor(t / F.lit(width))})
    hit = ((keyed["_bucket"] == probe["bucket"]) & (keyed["_us"] >= probe["seg_us"])
           & (keyed["_us"] < probe["seg_end"]))
    return (keyed.join(F.broadcast(probe), hit, "left")
            .withColumn(out, F.coalesce("seg_class", F.lit(S.BENIGN)))
            .select(*flows.columns, out))


def _bucket_table(segments: DataFrame, width: int, limit: int) -> DataFrame | None:
    """Attack segments by time bucket, or None where that table would be large or a bucket crowded."""
    # no more than ``limit`` segments reach this window
    ranged = segments.withColumn("seg_end", F.lead("seg_us").over(Window.orderBy("seg_us")))
    ranged = ranged.where("seg_class is not null").withColumns({
        "_first": F.floor(F.col("seg_us") / F.lit(width)),
        "_last": F.floor((F.col("seg_end") - 1) / F.lit(width)),
    })
    rows = ranged.agg(F.sum(F.col("_last") - F.col("_first") + 1)).first()[0] or 0
    if rows > limit:
        return None
    table = ranged.select("seg_us", "seg_end", "seg_class", F.explode(F.sequence("_first", "_last")).alias("bucket"))
    crowd = table.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
    return table if crowd <= MAX_SEGMENTS_PER_BUCKET else None


def _label_by_sort(flows: DataFrame, segments: DataFrame, ts: str, flow_id: str, out: str) -> DataFrame:
    """Flows and segments in one time order; each flow takes the last segment before it."""
    keys = ["_us", "_kind", "_id"]
    f = flows.select(micros(ts).alias("_us"), F.lit(1).alias("_kind"), F.col(flow_id).alias("_id"),
                     F.struct(*flows.columns).alias("_flow"))
    seg = segments.select(F.col("seg_us").alias("_us"), F.lit(0).alias("_kind"),
                          F.struct("seg_class").alias("_seg"))
    blocks = ordered_blocks(f.unionByName(seg, allowMissingColumns=True), keys)
    upto = block_window(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = carry_last(blocks, keys, F.col("_seg"), "_carry")
    seen = blocks.withColumn("_last", F.last("_seg", ignorenulls=True).over(upto)).where("_kind = 1")
    got = F.coalesce("_last", "_carry")["seg_class"]
    return seen.join(F.broadcast(carry), BLOCK).select(  # one row per block
        "_flow.*", F.coalesce(got, F.lit(S.BENIGN)).alias(out))
