from datetime import datetime, timedelta

from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.catalog import views as V
from flowtide.operators.cascade import alerts, block_requests, cascade_decide
from flowtide.operators.intervals import sessionize
from flowtide.operators.windows import tier2_windows
from flowtide.session import scratch_path
from flowtide.streaming import counts, jobs, progress, state

T0 = datetime(2024, 1, 1)


def flow_rows(spark, secs, start=0):
    data = [(start + i, T0 + timedelta(seconds=s), f"s{i % 3}", "d", 80 + i % 4, 6 if i % 5 else 17, ["BENIGN", "BOTNET", "DoS_DDoS"][i % 3],
             (i * 37 % 100) / 100, [((i + j) % 6) / 15 for j in range(6)], *[float(i)] * 12) for i, s in enumerate(secs)]
    return spark.createDataFrame(data, "flow_id long, ts timestamp, src_ip string, dst_ip string, dst_port int, protocol int, "
                                 "unified_label string, p1 double, probs array<double>, " + ", ".join(f"{c} double" for c in S.GOLDEN12))


def stream_of(spark, *frames):
    """One file per frame, read one file per trigger in the order written."""
    import time

    path = scratch_path(spark, "in")
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, stream):
    out = scratch_path(spark, "out")
    jobs.run_to_files(stream, out, scratch_path(spark, "ckpt"))
    return spark.read.schema(stream.schema).parquet(out)


def test_cascade_stream_equals_batch(spark):
    a, b = flow_rows(spark, range(0, 600, 10)), flow_rows(spark, range(600, 900, 10), 60)
    got = drain(spark, jobs.stream_cascade(stream_of(spark, a, b), seconds=False))
    want = alerts(cascade_decide(a.unionAll(b)))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want.select(got.columns)).count() == 0


def test_windows_equal_batch_and_late_rows_are_dropped(spark):
    first = flow_rows(spark, range(0, 3000, 7))
    late = flow_rows(spark, [5.0, 6.0], 5000)          # behind the watermark once the first file is in
    on_time = flow_rows(spark, range(3000, 6000, 9), 1000)
    got = drain(spark, jobs.stream_tier2_windows(stream_of(spark, first, on_time, late)))
    rows = first.unionAll(on_time)
    closed = F.col("window_start") + F.expr("interval 5 minutes") <= rows.agg(F.max("ts") - F.expr("interval 10 minutes")).scalar()
    want = tier2_windows(rows).where(closed)
    keys = ["src_ip", "window_start"]
    assert got.count() == want.count() > 30
    both = got.join(want.toDF(*[c if c in keys else f"w_{c}" for c in want.columns]), keys)
    assert both.count() == want.count()
    for c in want.columns:
        if c in keys:
            continue
        same = F.abs(F.col(c) - F.col(f"w_{c}")) < 1e-6 if dict(want.dtypes)[c] != "string" else F.col(c) == F.col(f"w_{c}")
        assert both.where(~same).count() == 0, c


def test_live_metrics(spark):
    df = flow_rows(spark, range(0, 1200, 10))
    half = flow_rows(spark, range(1200, 1500, 10), 500)
    out = scratch_path(spark, "m")
    jobs.run_updates(jobs.stream_metrics_live(cascade_decide(stream_of(spark, df, half))), out, scratch_path(spark, "c"))
    got = {r["window_start"]: r["flows"] for r in jobs.read_updates(spark, out, ["window_start"]).collect()}
    assert sum(got.values()) == 150 and len(got) == 5


def alerts_of(spark, rows):
    return spark.createDataFrame([(T0 + timedelta(seconds=t), i, s, c) for t, i, s, c in rows], "ts timestamp, flow_id long, src_ip string, predicted_class string")


def actions(spark, stream, ckpt=None, out=None):
    out = out or scratch_path(spark, "out")
    jobs.run_to_files(stream, out, ckpt or scratch_path(spark, "ckpt"))
    return sorted((tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect()), key=repr)


def test_one_block_per_source_over_several_batches(spark):
    """Three batches with one source give one request; quiet sources are released with all their alerts."""
    batches = [[(0, 1, "a", "BOTNET"), (5, 2, "a", "DoS_DDoS"), (6, 3, None, "BOTNET")], [(100, 4, "a", "WEB_ATTACK"), (90, 5, "b", "BOTNET"), (90, 4, "b", "DoS_DDoS")],
               [(400, 6, "a", "BOTNET")], [(9000, 7, "z", "BOTNET")]]
    got = actions(spark, jobs.stream_block_requests(stream_of(spark, *[alerts_of(spark, b) for b in batches]), ttl_seconds=600, delay="60 seconds"))
    blocks = [r for r in got if r[0] == "block"]
    assert sorted((r[1] or "") for r in blocks) == ["", "a", "b", "z"]
    freed = {r[1]: r for r in got if r[0] == "release"}
    assert set(freed) == {None, "a", "b"}
    assert freed["a"][2:] == (T0, T0 + timedelta(seconds=400), 4, "BOTNET")
    assert freed["b"][2:] == (T0 + timedelta(seconds=90), T0 + timedelta(seconds=90), 2, "DoS_DDoS")


def test_a_source_that_returns_is_blocked_anew(spark):
    batches = [[(0, 1, "a", "BOTNET")], [(2000, 2, "z", "BOTNET")], [(2500, 3, "a", "WEB_ATTACK")], [(9000, 4, "z", "BOTNET")]]
    got = actions(spark, jobs.stream_block_requests(stream_of(spark, *[alerts_of(spark, b) for b in batches]), ttl_seconds=600, delay="60 seconds"))
    assert [(r[0], r[5]) for r in got if r[1] == "a"] == [("block", "BOTNET"), ("block", "WEB_ATTACK"), ("release", "BOTNET"), ("release", "WEB_ATTACK")]


def test_blocks_survive_a_restart(spark):
    """The query ends and starts again from its checkpoint: nothing is repeated, counts go on."""
    path, out, ckpt = scratch_path(spark, "in"), scratch_path(spark, "out"), scratch_path(spark, "ckpt")
    first = alerts_of(spark, [(0, 1, "a", "BOTNET"), (1, 2, "b", "BOTNET")])
    first.coalesce(1).write.mode("append").parquet(path)

    def again():
        stream = spark.readStream.schema(first.schema).parquet(path)
        return actions(spark, jobs.stream_block_requests(stream, ttl_seconds=600, delay="60 seconds"), ckpt, out)

    assert [r[:2] for r in again()] == [("block", "a"), ("block", "b")]
    alerts_of(spark, [(30, 3, "a", "BOTNET"), (5000, 4, "z", "BOTNET")]).coalesce(1).write.mode("append").parquet(path)
    got = again()
    assert sorted((r[0], r[1], r[4]) for r in got) == [("block", "a", 1), ("block", "b", 1), ("block", "z", 1), ("release", "a", 2), ("release", "b", 1)]
    assert again() == got


def test_blocks_equal_the_batch_operator(spark):
    a, b = flow_rows(spark, range(100)), flow_rows(spark, range(100, 200), 100)
    end = flow_rows(spark, [10**6], 300).withColumns({"p1": F.lit(0.9), "src_ip": F.lit("end")})
    al = jobs.stream_cascade(stream_of(spark, a, b, end), seconds=False)
    out = scratch_path(spark, "b")
    jobs.run_to_files(jobs.stream_block_requests(al), out, scratch_path(spark, "c"))
    want = block_requests(alerts(cascade_decide(a.unionAll(b))))
    got = jobs.released(spark.read.parquet(out))
    assert got.count() == want.count() == 3
    assert got.select(want.columns).exceptAll(want).count() == 0


def log_of(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(seconds=s), None if e is None else T0 + timedelta(seconds=e), k) for i, s, e, k in rows],
                                 "log_id long, start_ts timestamp, end_ts timestamp, sensor string")


def sessions_of(spark, rows, batches, closing=10**6, **kw):
    """Streamed in ``batches`` (lists of row numbers) with a closing row for every sensor."""
    frames = [log_of(spark, [rows[i] for i in b]) for b in batches]
    frames.append(log_of(spark, [(10**9 + j, closing, closing, k) for j, k in enumerate(sorted({r[3] for r in rows}))]))
    return sorted((r.sensor, r.log_id, r.session_id) for r in drain(spark, state.stream_sessionize(stream_of(spark, *frames), delay="100 seconds", **kw)).collect())


LOG = [(1, 0, 30, "s"), (2, 30, 40, "s"), (3, 100, 500, "s"), (4, 161, 170, "s"), (5, 230, 231, "s"), (6, 292, 300, "s"), (7, 292, 310, "s"), (8, 400, None, "s"),
       (9, 900, 950, "s"), (10, 1010, 1011, "s"), (11, 1072, 1080, "s")]


def test_stream_sessions_equal_batch(spark):
    """Out of order inside the delay, gaps of exactly a minute, equal starts, an open end, an overlapping long row."""
    want = sorted(("s", r.log_id, r.session_id) for r in sessionize(log_of(spark, LOG)).collect())
    assert len({w[2] for w in want}) > 3
    for batches in ([[1, 0], [3, 2, 4], [6, 5, 7], [8, 9, 10]], [list(range(11))], [[i] for i in range(11)]):
        assert sessions_of(spark, LOG, batches) == want


def test_stream_sessions_by_key(spark):
    rows = LOG + [(100 + i, s * 2, None if e is None else e * 2, "t") for i, s, e, _ in LOG]
    got = sessions_of(spark, rows, [[0, 1, 2, 11, 12], [3, 4, 5, 6, 13, 14], [7, 8, 9, 10, 15, 16, 17, 18, 19, 20, 21]], by=["sensor"])
    want = [("s", r.log_id, r.session_id) for r in sessionize(log_of(spark, LOG)).collect()]
    want += [("t", r.log_id, r.session_id) for r in sessionize(log_of(spark, rows[11:])).collect()]
    assert got == sorted(want)


def test_open_sessions_wait_and_late_rows_are_counted(spark):
    frames = [log_of(spark, LOG[:5]), log_of(spark, [(50, 2000, 2010, "s")]), log_of(spark, [(60, 5, 6, "s"), (61, 7, 8, "s"), (62, 8, 9, "s"), (63, 2050, 2060, "s")])]
    path, out = scratch_path(spark, "progress"), scratch_path(spark, "out")
    with progress.watch(spark, path):
        stream = state.stream_sessionize(stream_of(spark, *frames), delay="100 seconds")
        jobs.run_to_files(stream, out, scratch_path(spark, "ckpt"), name="sessions")
    assert sorted(r.log_id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5]  # 50 and 63 are not closed yet
    rates = progress.stream_rates(progress.read_progress(spark, path)).collect()
    assert [(r["name"], r.input_rows, r.late_rows, r.batches) for r in rates] == [("sessions", 10, 3, 3)]
    assert rates[0].avg_latency_us > 0 and rates[0].throughput_fps > 0


def test_progress_of_a_repeated_batch_counts_once(spark):
    path = scratch_path(spark, "p")
    rows = [("q", "r1", "n", 0, "2024-01-01T00:00:00", 5, 10, 1, 0, 0, None), ("q", "r2", "n", 0, "2024-01-01T00:00:09", 5, 30, 1, 0, 0, None), ("q", "r2", "n", 1, "2024-01-01T00:00:10", 0, 0, 0, 0, 0, None)]
    spark.createDataFrame(rows, progress.SCHEMA).write.parquet(path)
    r = progress.stream_rates(progress.read_progress(spark, path)).first()
    assert (r.input_rows, r.late_rows, r.busy_ms, r.batches) == (5, 1, 30, 1)
    assert (r.avg_latency_us, r.throughput_fps) == (6000.0, 166.67)


def test_ids_stream(spark):
    lines = spark.createDataFrame([('{"event_type":"flow","src_ip":"7.7.7.7","timestamp":"x"}',), ("{bad",), ('{"event_type":"dns"}',)], "value string")
    path = scratch_path(spark, "lines")
    lines.write.text(path)
    from flowtide.sources.events import read_ids_events

    ev = read_ids_events(spark, path, streaming=True)
    ev = ev.withColumns({"p1": F.lit(0.9), "probs": F.array(*[F.lit(0.0)] * 6), "flow_id": F.lit(1), "ts": F.lit(T0)})
    got = drain(spark, jobs.stream_ids_events(ev)).collect()
    assert [(r["src_ip"], r["dst_ip"], r["severity"]) for r in got] == [("7.7.7.7", "0.0.0.0", "CRITICAL")]
    assert read_ids_events(spark, path).count() == 2


def test_counts_grow_by_files(spark):
    """A new file is read alone; totals equal the batch count; a lost checkpoint changes nothing."""
    path, out, ckpt, log = (scratch_path(spark, n) for n in ("in", "out", "ckpt", "log"))
    schema = "source_year int, unified_label string, x double"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    def run(checkpoint):
        with progress.watch(spark, log):
            counts.add_files(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), out, checkpoint)
        return sorted(map(tuple, counts.class_totals(counts.read_counts(spark, out)).collect()), key=repr)

    def want():
        return sorted(map(tuple, spark.read.schema(schema).parquet(path).groupBy("source_year", "unified_label").count().collect()), key=repr)

    add([(2017, "BENIGN", 1.0)] * 50 + [(2018, "BOTNET", 1.0)] * 7)
    assert run(ckpt) == want()
    add([(2018, "BENIGN", 1.0)] * 5 + [(None, None, 1.0)] * 2)
    assert run(ckpt) == want()
    sizes = sorted(r.input_rows for r in progress.read_progress(spark, log).where("input_rows > 0").collect())
    assert sizes == [7, 57]  # the second run read its own file only
    assert run(ckpt) == want()
    assert run(scratch_path(spark, "ckpt2")) == want()  # all files again under the same batch numbers
    assert counts.read_counts(spark, out).select("file_name").distinct().count() == 2
    merged = scratch_path(spark, "merged")
    counts.compact(spark, out, merged)
    assert sorted(map(tuple, counts.class_totals(counts.read_counts(spark, merged)).collect()), key=repr) == want()


def test_batches_and_files_grow_with_the_flows(spark, tmp_path, monkeypatch):
    """Bounded slices of several files each; a slice of few rows still fills its batch, so that no row comes late."""
    monkeypatch.setattr(V, "SLICE_ROWS", 100, raising=False)
    monkeypatch.setattr(V, "FILE_ROWS", 15, raising=False)
    ids = [*range(600), *range(900, 903)]
    kinds = ["view", "click", "signup", "purchase"]
    spark.createDataFrame([(i, T0, i % 50, kinds[i % 4], 1.0 + i % 9, f'{{"k": {i % 90}}}') for i in ids],
                          "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
                          ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    path, files = V.stream_folder(spark, str(tmp_path), True)
    assert files == 6 and len(spark.read.parquet(path).inputFiles()) == 7 * 6 + 1
    out = drain(spark, jobs.stream_tier2_windows(V.clean_of(V.flow_stream(spark, str(tmp_path), closed=True))))
    want = tier2_windows(V.clean(spark, str(tmp_path)))
    assert out.agg(F.sum("flow_count")).first()[0] == want.agg(F.sum("flow_count")).first()[0] > 500
    assert out.count() == want.count()
