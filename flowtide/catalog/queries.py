"""Every operator as a registered query, with its oracle SQL beside it.

Keys follow the operator inventory.  A query without SQL is not expressible
there (model training, copula draws, header scans) and is covered by tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.catalog import views as V
from flowtide.catalog.views import with_views
from flowtide.functions import decide, predict_class
from flowtide.operators import attribution, balance, cascade, evaluate, features, intervals, models, neighbors
from flowtide.operators import packets as P
from flowtide.operators import quality, sampling, setops, windows
from flowtide.operators.labels import clean_labels, drop_header_rows, drop_unmapped
from flowtide.plans import live
from flowtide.session import cut, keep, scratch_path
from flowtide.sources import events as E
from flowtide.sources import flows as FL
from flowtide.sources import packets as PK
from flowtide.sources import sinks
from flowtide.sources.dimension import label_dimension, write_label_dimension
from flowtide.streaming import counts, jobs, progress, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

G12 = S.GOLDEN12
G12_SQL = ", ".join(G12)


def query(key: str, sql: str | None = None, views: tuple = ()):
    def add(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_views(sql, *views) if views else sql
        return fn
    return add


def rounded(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    cols = only or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in cols})


def exact(columns: list[str]) -> list:
    """Each column as its finite value beside its kind, so that NaN and infinities compare as plain data."""
    inf, out = F.lit(float("inf")), []
    for c in columns:
        v = F.col(f"`{c}`")
        kind = F.when(v.isNull(), "null").when(F.isnan(v), "nan").when(v == inf, "inf").when(v == -inf, "-inf").otherwise("finite")
        out += [F.when(kind == "finite", v).alias(c), kind.alias(f"{c} kind")]
    return out


def exact_sql(columns: dict[str, str]) -> str:
    """The same in SQL; ``columns`` maps names to expressions."""
    return ", ".join(
        f"""CASE WHEN isfinite({e}) THEN {e} END AS "{c}", CASE WHEN {e} IS NULL THEN 'null' WHEN isnan({e}) THEN 'nan'
        WHEN isinf({e}) THEN CASE WHEN {e} > 0 THEN 'inf' ELSE '-inf' END ELSE 'finite' END AS "{c} kind\"""" for c, e in columns.items())


# --- scans, sources, sinks --------------------------------------------------

_CSV_COLS = ["flow_id", "src_ip", "dst_port", "raw_label", *G12, "source_year"]


@query("scan_flow_csv", f"""SELECT flow_id, src_ip, dst_port, raw_label, source_year,
    {exact_sql({c: c for c in G12})} FROM flows WHERE flow_id % 7 <> 0""", ("flows",))
def _scan_flow_csv(spark, sf):
    """Every row of CSV files in which each seventh row carries surplus fields and drops out."""
    path = scratch_path(spark, "raw_csv")
    df = V.flows(spark, sf).select(*_CSV_COLS)
    surplus = F.col("flow_id") % 7 == 0
    how = {"header": True, "encoding": "ISO-8859-1", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.where(~surplus).write.options(**how).csv(f"{path}/plain")
    df.where(surplus).withColumns({"x": F.lit("x"), "y": F.col("flow_id")}).write.options(**how).csv(f"{path}/surplus")
    back = FL.scan_flow_csv(spark, [f"{path}/plain", f"{path}/surplus"], df.schema, "ISO-8859-1")
    return back.select("flow_id", "src_ip", "dst_port", "raw_label", "source_year", *exact(G12))


@query("scan_columns", "SELECT event_type, value FROM events")
def _scan_columns(spark, sf):
    return features.scan_columns(V.table(spark, sf, "events"), ["event_type", "value"])


@query("label_dimension", """SELECT d.source_year, d.label_key, d.unified_label, CAST(count(k.flow_id) AS BIGINT) AS n_flows
    FROM label_dim d LEFT JOIN keyed k USING (source_year, label_key) GROUP BY ALL""", ("label_dim", "keyed"))
def _label_dimension(spark, sf):
    path = scratch_path(spark, "label_map")
    write_label_dimension(label_dimension(spark), path)
    dim = spark.read.schema(label_dimension(spark).schema).json(path)
    used = V.keyed(spark, sf).groupBy("source_year", "label_key").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(used, ["source_year", "label_key"], "left").select(
        "source_year", "label_key", "unified_label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_flows"))


@query("write_flows", """SELECT source_year, unified_label, count(*) AS n, CAST(sum(flow_id) AS BIGINT) AS id_sum
    FROM clean GROUP BY ALL""", ("clean",))
def _write_flows(spark, sf):
    path = scratch_path(spark, "flows")
    df = V.clean(spark, sf)
    sinks.write_flows(df, path)
    back = spark.read.schema(df.schema).parquet(path)
    return back.groupBy("source_year", "unified_label").agg(F.count(F.lit(1)).alias("n"), F.sum("flow_id").alias("id_sum"))


@query("write_splits", """SELECT split, unified_label, rows, class_pct_full, '42' AS random_seed, r.ratio,
    CAST(sum(rows) OVER (PARTITION BY split) AS BIGINT) AS split_rows, CAST(sum(rows) OVER () AS BIGINT) AS total
    FROM (SELECT split, unified_label, count(*) AS rows,
        round(sum(count(*)) OVER (PARTITION BY unified_label) * 100e0 / sum(count(*)) OVER (), 3) AS class_pct_full
        FROM split GROUP BY split, unified_label) JOIN (VALUES ('train', 0.8e0), ('val', 0.1e0), ('test', 0.1e0)) r(split, ratio) USING (split)""", ("split",))
def _write_splits(spark, sf):
    path = scratch_path(spark, "splits")
    rows = sinks.write_splits(_split(spark, sf), path, seed=42, ratios=SPLITS)
    record = sinks.read_manifest(spark, path)
    return rows.drop("class_pct_full").crossJoin(record).select(
        "split", "unified_label", "rows", F.col("class_distribution_full_pct")[F.col("unified_label")].alias("class_pct_full"),
        "random_seed", F.col("ratios")[F.col("split")].alias("ratio"), F.col("row_counts")[F.col("split")].alias("split_rows"),
        F.col("row_counts")["total"].alias("total"))


@query("write_metrics", """SELECT config, count(*) AS n_rows,
    round(avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM configs GROUP BY config""", ("configs",))
def _write_metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    cm = evaluate.confusion_matrix(V.configs(spark, sf), by=["config"])
    rep = evaluate.overall_report(cm, by=["config"])
    sinks.write_metrics(rep, path)
    return spark.read.schema(rep.schema).json(path).select("config", "n_rows", "accuracy")


def _live_csv(spark, sf) -> str:
    """Flows in the layout of a live capture: times in seconds, live column names."""
    path = scratch_path(spark, "live_csv")
    sec = {c: F.col(c) / 1e6 for c in S.TIME_COLUMNS}
    df = V.flows(spark, sf).withColumns(sec).withColumn("timestamp", F.col("ts").cast("string"))
    df = df.withColumnsRenamed(dict(zip(G12, S.LIVE_FEATURES))).select(*S.LIVE_FLOW.names)
    df.write.option("header", True).csv(path)
    return path


@query("read_live_flows", """SELECT ts, src_ip, dst_port, round((flow_duration / 1e6) * 1e6, 3) AS flow_duration,
    round(CASE WHEN isnan(flow_bytes_s) OR isinf(flow_bytes_s) THEN 0e0 ELSE flow_bytes_s END, 3) AS flow_bytes_s
    FROM flows""", ("flows",))
def _read_live_flows(spark, sf):
    stream = FL.read_live_flows(spark, _live_csv(spark, sf), streaming=True, files_per_trigger=4)
    ready = live.prepare_live(stream).select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "src_ip", "dst_port",
        F.round("flow_duration", 3).alias("flow_duration"), F.round("flow_bytes_s", 3).alias("flow_bytes_s"))
    out = scratch_path(spark, "live_out")
    jobs.run_to_files(ready, out, scratch_path(spark, "ckpt"))
    return spark.read.schema(ready.schema).parquet(out)


_EVENT_COLS = ["event_type", "src_ip", "src_port", "dest_ip", "dest_port", "proto"]


@query("read_ids_events", """SELECT flow_id, event_type, src_ip, src_port, dest_ip, dest_port, proto, age,
    pkts_toserver, bytes_toclient, psh, ack, tcp_window FROM ids_events""", ("ids_events",))
def _read_ids_events(spark, sf):
    ev = E.parse_ids_events(V.event_lines(spark, sf))
    return ev.select("flow_id", *_EVENT_COLS, "flow.age", "flow.pkts_toserver", "flow.bytes_toclient",
                     "tcp.psh", "tcp.ack", F.col("tcp.window").alias("tcp_window"))


@query("ids_line_counts", """SELECT n + blank + broken AS lines, blank AS blank_lines, broken AS broken_lines, n AS events FROM (
    SELECT count(*) AS n, count(*) FILTER (flow_id % 100 = 0) AS blank, count(*) FILTER (flow_id % 100 = 50) AS broken
    FROM flows)""", ("flows",))
def _ids_line_counts(spark, sf):
    return E.ids_line_counts(V.event_lines(spark, sf))


@query("write_alerts", """SELECT flow_id, src_ip, dst_ip, dst_port, severity, predicted_class, confidence, pipeline_tier
    FROM decided WHERE severity IS NOT NULL""", ("decided",))
def _write_alerts(spark, sf):
    scored = V.scores_of(V.flow_stream(spark, sf))
    al = jobs.stream_cascade(scored, seconds=False)
    path = scratch_path(spark, "alerts")
    sinks.write_alerts(al, path, scratch_path(spark, "ckpt")).awaitTermination()
    return spark.read.schema(al.schema).json(path).drop("ts")


@query("read_attack_log", """SELECT start_ts, end_ts, class_label FROM attack_log""", ("attack_log",))
def _read_attack_log(spark, sf):
    path = scratch_path(spark, "attack_log")
    log = V.attack_log(spark, sf)
    none = F.lit(None).cast("string")
    log.select(F.col("start_ts").cast("string").alias("timestamp_start"), F.col("end_ts").cast("string").alias("timestamp_end"),
               "class_label", none.alias("src_ip"), none.alias("dst_ip"), F.lit(None).cast("int").alias("dst_port"),
               none.alias("tool"), none.alias("detail")).write.option("header", True).csv(path)
    back = FL.read_attack_log(spark, path)
    return back.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_ts", "end_ts")], "class_label")


@query("read_packets", "SELECT event_id, point, icmp_id, icmp_seq FROM packets WHERE icmp_type = 8", ("packets",))
def _read_packets(spark, sf):
    return PK.read_packets(V.packets(spark, sf)).select("event_id", "point", "icmp_id", "icmp_seq")


@query("packet_counts", """SELECT point, count(*) AS packets, count(*) FILTER (icmp_type = 8) AS requests,
    count(*) FILTER (icmp_type = 0) AS replies, count(*) FILTER (icmp_type NOT IN (0, 8)) AS others
    FROM packets GROUP BY point""", ("packets",))
def _packet_counts(spark, sf):
    return PK.packet_counts(V.packets(spark, sf))


@query("performance_table", """SELECT config, n_rows, round(acc, 2) AS accuracy_pct,
    round(coalesce(tp / nullif(g, 0), 0), 4) AS dos_precision, round(coalesce(tp / nullif(s, 0), 0), 4) AS dos_recall,
    round(coalesce(2e0 * tp / nullif(g + s, 0), 0), 4) AS dos_f1,
    round(acc - max(CASE WHEN config = 'baseline' THEN acc END) OVER (), 2) AS accuracy_delta FROM (
    SELECT config, count(*) AS n_rows, count(*) FILTER (y_true = y_pred) * 100e0 / count(*) AS acc,
      CAST(count(*) FILTER (y_true = 'DoS_DDoS' AND y_pred = 'DoS_DDoS') AS DOUBLE) AS tp,
      count(*) FILTER (y_pred = 'DoS_DDoS') AS g, count(*) FILTER (y_true = 'DoS_DDoS') AS s
    FROM configs GROUP BY config)""", ("configs",))
def _performance_table(spark, sf):
    return evaluate.performance_table(V.configs(spark, sf))


_METRICS_SQL = """SELECT count(*) AS total_flows, count(*) FILTER (tier1_hit) AS tier1_hits,
    round(count(*) FILTER (tier1_hit) * 100e0 / count(*), 4) AS tier1_pct,
    count(*) FILTER (NOT tier1_hit) AS tier3_evaluations,
    round(count(*) FILTER (NOT tier1_hit) * 100e0 / count(*), 4) AS tier3_pct, count(severity) AS alerts FROM decided"""


@query("realtime_table", f"""SELECT total_flows, round(tier1_pct, 2) AS offload_pct, tier1_hits AS offload_flows,
    round(tier3_pct, 2) AS escalation_pct, tier3_evaluations AS escalation_flows FROM ({_METRICS_SQL})""", ("decided",))
def _realtime_table(spark, sf):
    return cascade.realtime_table(cascade.stream_metrics(cascade.cascade_decide(V.scores(spark, sf))))


# --- profiling and gates ----------------------------------------------------

@query("profile_row_counts", "SELECT file_name, count(*) AS rows FROM files GROUP BY file_name", ("files",))
def _profile_row_counts(spark, sf):
    return quality.profile_row_counts(V.files(spark, sf))


@query("profile_files", """SELECT source_year, count(*) AS rows, TRUE AS named, TRUE AS sized FROM flows GROUP BY source_year""", ("flows",))
def _profile_files(spark, sf):
    """Rows of stored files by folder; every file has its own name and a size in MB of its bytes."""
    path = scratch_path(spark, "profiled")
    df = V.flows(spark, sf).select(*_CSV_COLS)
    parts = []
    years = [r[0] for r in df.select("source_year").distinct().collect()]  # one value per year of the data
    for year in sorted(years):
        df.where(F.col("source_year") == year).write.option("header", True).csv(f"{path}/{year}")
        parts.append(quality.profile_files(spark, f"{path}/{year}").withColumn("source_year", F.lit(year)))
    files = parts[0]
    for p in parts[1:]:
        files = files.unionByName(p)
    return files.groupBy("source_year").agg(
        F.sum("rows").alias("rows"), (F.count_distinct("file_name") == F.count(F.lit(1))).alias("named"),
        F.bool_and((F.col("bytes") > 0) & (F.abs(F.col("mb") - F.col("bytes") / 1048576) <= 0.005)).alias("sized"))


@query("profile_encoding", """SELECT w.written, v.verdict, CAST(count(*) AS BIGINT) AS lines,
    CAST(count(*) FILTER (w.written = 'latin1' AND flow_id % 3 = 0) AS BIGINT) AS bad_lines
    FROM flows, (VALUES ('latin1'), ('utf8')) w(written), LATERAL (SELECT CASE w.written WHEN 'latin1' THEN 'latin1' ELSE 'utf-8' END AS verdict) v
    GROUP BY ALL""", ("flows",))
def _profile_encoding(spark, sf):
    text = V.flows(spark, sf).select(F.concat("raw_label", F.when(F.col("flow_id") % 3 == 0, "é").otherwise("")).alias("t"))
    parts = []
    for name, enc in (("latin1", "ISO-8859-1"), ("utf8", "UTF-8")):
        path = scratch_path(spark, name)
        text.write.option("encoding", enc).csv(path)
        parts.append(quality.profile_encoding(spark, path).withColumn("written", F.lit(name)))
    return parts[0].unionByName(parts[1]).groupBy("written", "verdict").agg(
        F.sum("lines").alias("lines"), F.sum("bad_lines").alias("bad_lines"))


@query("schema_consistency", """SELECT v.* FROM (VALUES ('a', 5, NULL, NULL, CAST(3 AS BIGINT)), ('b', 5, ' dst_port', 'padded', 3),
    ('b', 5, 'dst_port', 'missing', 3), ('b', 5, ' dst_port', 'extra', 3), ('c', 5, 'src_ip', 'missing', 3), ('c', 5, 'protocol', 'extra', 3))
    v(file_name, n_columns, column_name, issue, layouts) WHERE EXISTS (SELECT 1 FROM flows)""", ("flows",))
def _schema_consistency(spark, sf):
    base = scratch_path(spark, "layouts")
    df = V.flows(spark, sf).select("flow_id", "src_ip", "dst_port", "flow_duration", "raw_label")
    shapes = {
        "a": df,
        "b": df.withColumnRenamed("dst_port", " dst_port"),
        "c": df.drop("src_ip").withColumn("protocol", F.lit(6)),
    }
    for name, part in shapes.items():
        part.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(f"{base}/layout={name}")
    return quality.schema_consistency(quality.file_headers(spark, base, name=F.col("layout")))


@query("label_census", """SELECT file_name, source_year, raw_label, label_key,
    CASE WHEN label_key = 'label' THEN 'DROP' ELSE coalesce(unified_label, 'UNMAPPED') END AS verdict, count(*) AS rows
    FROM (SELECT m.*, concat('part-', CAST(flow_id % 5 AS VARCHAR), '.csv') AS file_name FROM mapped m) GROUP BY ALL""", ("mapped",))
def _label_census(spark, sf):
    return quality.label_census(V.files(spark, sf), label_dimension(spark))


@query("unmapped_labels", """SELECT source_year, label_key, CAST(count(*) AS BIGINT) AS rows,
    CASE WHEN label_key = 'label' THEN 'DROP' ELSE 'UNMAPPED' END AS verdict
    FROM mapped WHERE unified_label IS NULL GROUP BY source_year, label_key""", ("mapped",))
def _unmapped_labels(spark, sf):
    return quality.unmapped_labels(V.flows(spark, sf), label_dimension(spark))


@query("schema_guard", "SELECT source_year, count(*) AS rows FROM clean GROUP BY source_year", ("clean",))
def _schema_guard(spark, sf):
    df = V.clean(spark, sf)
    expected = [*V.CONTEXT, *G12, "unified_label", "source_year"]
    return quality.schema_guard(df, expected).groupBy("source_year").agg(F.count(F.lit(1)).alias("rows"))


@query("nan_inf_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (isnan({c}) OR {c} IS NULL) AS missing, "
    + (f"count(*) FILTER (isinf({c}))" if c in S.RATE_COLUMNS else "CAST(0 AS BIGINT)") + " AS infinite FROM labelled"
    for c in G12), ("labelled",))
def _nan_inf_profile(spark, sf):
    return quality.nan_inf_profile(V.labelled(spark, sf))


@query("row_reconciliation", """SELECT CAST(0 AS INT) AS step, 'header' AS stage, count(*) AS rows_in,
      count(*) FILTER (label_key <> 'label') AS rows_kept, count(*) FILTER (label_key = 'label') AS rows_dropped FROM mapped
    UNION ALL SELECT 1, 'unmapped', count(*), count(unified_label), count(*) - count(unified_label)
      FROM mapped WHERE label_key <> 'label'
    UNION ALL SELECT 2, 'incomplete', count(*), (SELECT count(*) FROM clean), count(*) - (SELECT count(*) FROM clean)
      FROM labelled""", ("mapped", "labelled", "clean"))
def _row_reconciliation(spark, sf):
    finite = F.lit(True)
    for c in G12:
        bad = F.col(c).isNull() | F.isnan(c)
        if c in S.RATE_COLUMNS:
            bad = bad | (F.abs(c) == F.lit(float("inf")))
        finite = finite & ~bad
    return quality.row_reconciliation(V.mapped(spark, sf), {
        "header": F.col("label_key") != S.HEADER_KEY,
        "unmapped": F.col("unified_label").isNotNull(),
        "incomplete": finite,
    })


@query("class_loss_check", """SELECT unified_label, b AS rows_before, a AS rows_after, b - a AS rows_dropped,
    round((b - a) / b * 100, 4) AS pct_of_class_lost, round(a / sum(a) OVER () * 100, 4) AS pct_of_total_after,
    round(max(a) OVER () / nullif(a, 0), 1) AS imbalance_ratio, (b - a) / b > 0.02 AS flagged FROM (
    SELECT unified_label, count(*) AS b, count(*) FILTER (flow_id IN (SELECT flow_id FROM clean)) AS a
    FROM labelled GROUP BY unified_label)""", ("labelled", "clean"))
def _class_loss_check(spark, sf):
    return quality.class_loss_check(V.labelled(spark, sf), V.clean(spark, sf))


@query("split_balance_check", """SELECT *, max_deviation < 0.1 AS passed FROM (
    SELECT *, round(max(abs(split_pct - full_pct)) OVER (), 3) AS max_deviation FROM (
    SELECT split, unified_label, round(count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY split), 3) AS split_pct,
      round(sum(count(*)) OVER (PARTITION BY unified_label) * 100e0 / sum(count(*)) OVER (), 3) AS full_pct
    FROM split GROUP BY split, unified_label))""", ("split",))
def _split_balance_check(spark, sf):
    return quality.split_balance_check(_split(spark, sf))


@query("negative_latency_check", "SELECT count(*) AS packets, count(*) FILTER (latency_ms < 0) AS negative FROM matched", ("matched",))
def _negative_latency_check(spark, sf):
    return quality.negative_latency_check(_matched(spark, sf))


@query("label_coverage_check", """SELECT count(*) AS flows, count(*) FILTER (ts NOT BETWEEN
    (SELECT min(start_ts) FROM attack_log) AND (SELECT max(end_ts) FROM attack_log)) AS outside FROM flows""", ("flows", "attack_log"))
def _label_coverage_check(spark, sf):
    return quality.label_coverage_check(V.flows(spark, sf), V.attack_log(spark, sf))


# --- projections, filters, predicates ---------------------------------------

@query("normalize_label", "SELECT flow_id, label_key FROM keyed", ("keyed",))
def _normalize_label(spark, sf):
    return V.keyed(spark, sf).select("flow_id", "label_key")


@query("map_label", "SELECT flow_id, source_year, label_key, unified_label FROM mapped", ("mapped",))
def _map_label(spark, sf):
    return V.mapped(spark, sf).select("flow_id", "source_year", "label_key", "unified_label")


@query("drop_header_rows", "SELECT flow_id, label_key FROM keyed WHERE label_key <> 'label'", ("keyed",))
def _drop_header_rows(spark, sf):
    return drop_header_rows(V.keyed(spark, sf)).select("flow_id", "label_key")


@query("drop_unmapped", "SELECT flow_id, unified_label FROM mapped WHERE unified_label IS NOT NULL", ("mapped",))
def _drop_unmapped(spark, sf):
    return drop_unmapped(V.mapped(spark, sf)).select("flow_id", "unified_label")


@query("canonical_columns", f"""SELECT flow_duration AS "Flow Duration", {exact_sql({"Flow Bytes/s": "flow_bytes_s"})},
    fwd_header_length AS "Fwd Header Length", raw_label AS "Label" FROM labelled""", ("labelled",))
def _canonical_columns(spark, sf):
    raw = V.labelled(spark, sf).select(
        F.col("ts").alias("Timestamp"), F.col("protocol").alias("Protocol"), F.col("src_ip").alias("Src IP"),
        F.col("flow_duration").alias(" Flow Duration"), F.col("flow_bytes_s").alias("Flow Byts/s"),
        F.col("fwd_header_length").alias(" Fwd Header Len"), F.col("fwd_header_length").alias("Fwd Header Length.1"),
        F.col("raw_label").alias(" Label"))
    named = FL.canonical_columns(raw, short_layout=True)
    return named.select(*[c for c in named.columns if c != "Flow Bytes/s"], *exact(["Flow Bytes/s"]))


@query("add_lineage", "SELECT flow_id, CAST(2018 AS INT) AS source_year, 'real' AS origin FROM flows", ("flows",))
def _add_lineage(spark, sf):
    return FL.add_lineage(V.flows(spark, sf).select("flow_id"), 2018, "real")


@query("select_golden12", f"""SELECT flow_id, {exact_sql({c: c for c in G12})}, unified_label, source_year FROM labelled""", ("labelled",))
def _select_golden12(spark, sf):
    g = features.select_golden12(V.labelled(spark, sf), ["flow_id"])
    return g.select("flow_id", *exact(G12), "unified_label", "source_year")


@query("inf_to_null", f"""SELECT flow_id, {exact_sql({c: f"(CASE WHEN isinf({c}) THEN NULL ELSE {c} END)" for c in S.RATE_COLUMNS})}
    FROM flows""", ("flows",))
def _inf_to_null(spark, sf):
    return features.rates_inf_to_null(V.flows(spark, sf)).select("flow_id", *exact(S.RATE_COLUMNS))


@query("drop_incomplete", f"SELECT flow_id, {G12_SQL} FROM clean", ("clean",))
def _drop_incomplete(spark, sf):
    return features.drop_incomplete(features.rates_inf_to_null(V.labelled(spark, sf))).select("flow_id", *G12)


@query("impute_zero", "SELECT flow_id, " + ", ".join(
    f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 0e0 ELSE {c} END AS {c}" for c in G12) + " FROM flows", ("flows",))
def _impute_zero(spark, sf):
    return features.impute_zero(V.flows(spark, sf)).select("flow_id", *G12)


@query("scale_time_units", "SELECT flow_id, " + ", ".join(f"{c} * 1e6 AS {c}" for c in S.TIME_COLUMNS) + " FROM flows", ("flows",))
def _scale_time_units(spark, sf):
    return FL.scale_time_units(V.flows(spark, sf)).select("flow_id", *S.TIME_COLUMNS)


@query("parse_timestamps", """SELECT * FROM (SELECT flow_id, try_strptime(CASE WHEN flow_id % 50 = 0 THEN 'not a time'
    ELSE strftime(ts, '%d/%m/%Y %H:%M:%S') END, '%d/%m/%Y %H:%M:%S') AS ts FROM flows) WHERE ts IS NOT NULL""", ("flows",))
def _parse_timestamps(spark, sf):
    text = F.when(F.col("flow_id") % 50 == 0, "not a time").otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
    raw = V.flows(spark, sf).select("flow_id", text.alias("ts"))
    return FL.parse_timestamps(raw, "ts").select("flow_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("unparsed_timestamps", """SELECT count(*) AS rows_in, count(*) FILTER (flow_id % 50 = 0) AS rows_unparsed FROM flows""", ("flows",))
def _unparsed_timestamps(spark, sf):
    text = F.when(F.col("flow_id") % 50 == 0, "not a time").otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
    return FL.unparsed_timestamps(V.flows(spark, sf).select(text.alias("ts")), "ts")


@query("encode_class", """SELECT flow_id, unified_label, CAST(CASE unified_label WHEN 'DoS_DDoS' THEN 1 WHEN 'BRUTE_FORCE' THEN 2
    WHEN 'INFILTRATION' THEN 3 WHEN 'BOTNET' THEN 4 WHEN 'WEB_ATTACK' THEN 5 ELSE 0 END AS INT) AS class_code FROM labelled""", ("labelled",))
def _encode_class(spark, sf):
    return features.encode_class(V.labelled(spark, sf)).select("flow_id", "unified_label", "class_code")


@query("binary_target", """SELECT flow_id, CAST(unified_label = 'DoS_DDoS' AS INT) AS target FROM labelled""", ("labelled",))
def _binary_target(spark, sf):
    return features.add_binary_target(V.labelled(spark, sf)).select("flow_id", "target")


@query("assemble_features", f"SELECT flow_id, [{G12_SQL}] AS v FROM clean", ("clean",))
def _assemble_features(spark, sf):
    from pyspark.ml.functions import vector_to_array

    return features.assemble_features(V.clean(spark, sf)).select("flow_id", vector_to_array("features").alias("v"))


@query("filter_event_types", "SELECT flow_id, event_type FROM flow_events", ("flow_events",))
def _filter_event_types(spark, sf):
    return E.filter_event_types(E.parse_ids_events(V.event_lines(spark, sf))).select("flow_id", "event_type")


@query("ids_event_features", "SELECT flow_id, " + ", ".join(f"round({c}, 3) AS {c}" for c in G12) + " FROM event_features", ("event_features",))
def _ids_event_features(spark, sf):
    ev = E.filter_event_types(E.parse_ids_events(V.event_lines(spark, sf)))
    return rounded(E.ids_event_features(ev).select("flow_id", *G12), 3)


@query("ids_event_tuple", """SELECT flow_id, coalesce(src_ip, '0.0.0.0') AS src_ip, coalesce(src_port, 0) AS src_port,
    dest_ip AS dst_ip, dest_port AS dst_port, coalesce(proto, 'TCP') AS proto FROM flow_events""", ("flow_events",))
def _ids_event_tuple(spark, sf):
    ev = E.filter_event_types(E.parse_ids_events(V.event_lines(spark, sf)))
    return E.ids_event_tuple(ev).select("flow_id", "src_ip", "src_port", "dst_ip", "dst_port", "proto")


@query("decide", "SELECT flow_id, CAST(p1 > 0.5 AS INT) AS live, CAST(p1 >= 0.85 AS INT) AS bench FROM scores", ("scores",))
def _decide(spark, sf):
    return V.scores(spark, sf).select("flow_id", decide("p1").alias("live"), decide("p1", 0.85, strict=False).alias("bench"))


@query("alert_severity", "SELECT flow_id, severity, predicted_class, pipeline_tier FROM decided WHERE severity IS NOT NULL", ("decided",))
def _alert_severity(spark, sf):
    d = cascade.cascade_decide(V.scores(spark, sf))
    return d.where(F.col("severity").isNotNull()).select("flow_id", "severity", "predicted_class", "pipeline_tier")


# --- joins ------------------------------------------------------------------

_TRUTH_SQL = """SELECT f.flow_id, coalesce(arg_max(i.class_label, i.start_ts), 'BENIGN') AS ground_truth_label
    FROM flows f LEFT JOIN {log} i ON i.class_label <> 'BENIGN' AND f.ts BETWEEN i.start_ts AND i.end_ts GROUP BY f.flow_id"""


@query("label_by_interval", _TRUTH_SQL.format(log="attack_log"), ("flows", "attack_log"))
def _label_by_interval(spark, sf):
    return intervals.label_by_interval(V.flows(spark, sf), V.attack_log(spark, sf)).select("flow_id", "ground_truth_label")


@query("label_by_interval_sorted", _TRUTH_SQL.format(log="attack_log"), ("flows", "attack_log"))
def _label_by_interval_sorted(spark, sf):
    """The same labels by the path a large log takes."""
    return intervals.label_by_interval(V.flows(spark, sf), V.attack_log(spark, sf), broadcast_rows=0).select(
        "flow_id", "ground_truth_label")


@query("align_clocks", """SELECT log_id, class_label, start_ts + d AS start_ts, end_ts + d AS end_ts FROM (
    SELECT *, (SELECT min(ts) FROM events) - (SELECT min(start_ts) FROM attack_log) AS d FROM attack_log)""", ("attack_log",))
def _align_clocks(spark, sf):
    moved = intervals.align_clocks(V.table(spark, sf, "events"), V.attack_log(spark, sf))
    return moved.select("log_id", "class_label", "start_ts", "end_ts")


def _requests(spark, sf, point):
    r = PK.read_packets(V.packets(spark, sf)).where(F.col("point") == point)
    return P.last_write_wins(r, ["icmp_id", "icmp_seq"], ["ts", "event_id"])


def _matched(spark, sf):
    return P.match_packets(_requests(spark, sf, "outside"), _requests(spark, sf, "inside"), ["icmp_id", "icmp_seq"])


@query("match_packets", "SELECT * FROM matched", ("matched",))
def _match_packets(spark, sf):
    return _matched(spark, sf)


@query("unmatched_packets", """SELECT count(*) FILTER (a.ts IS NOT NULL AND b.ts IS NOT NULL) AS "both",
    count(*) FILTER (b.ts IS NULL) AS a_only, count(*) FILTER (a.ts IS NULL) AS b_only
    FROM outside a FULL JOIN inside b USING (icmp_id, icmp_seq)""", ("outside", "inside"))
def _unmatched_packets(spark, sf):
    r = PK.read_packets(V.packets(spark, sf))
    return P.unmatched_packets(r.where("point = 'outside'"), r.where("point = 'inside'"), ["icmp_id", "icmp_seq"])


_MACRO_SQL = """per AS (SELECT model, label, coalesce(tp / nullif(guessed, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r,
    coalesce(2e0 * tp / nullif(guessed + support, 0), 0) AS f1, support FROM (
    SELECT m.model, l.label, CAST(count(*) FILTER (y_true = l.label AND y_pred = l.label) AS DOUBLE) AS tp,
      count(*) FILTER (y_true = l.label) AS support, count(*) FILTER (y_pred = l.label) AS guessed
    FROM predictions m, (SELECT DISTINCT y_true AS label FROM predictions UNION SELECT DISTINCT y_pred FROM predictions) l
    GROUP BY m.model, l.label)),
  ov AS (SELECT model, round(sum(r * support) / sum(support), 6) AS accuracy, round(avg(p), 6) AS macro_precision,
    round(avg(r), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
    round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS n_rows FROM per GROUP BY model)"""


def _with_macro(tail: str) -> str:
    return with_views("", "predictions").rstrip() + ",\n" + _MACRO_SQL + "\n" + tail


@query("compare_models", _with_macro("""SELECT *, row_number() OVER (ORDER BY macro_f1 DESC, model) = 1 AS winner FROM ov"""))
def _compare_models(spark, sf):
    cm = evaluate.confusion_matrix(V.predictions(spark, sf), by=["model"])
    return evaluate.compare_models(evaluate.overall_report(cm, by=["model"]))


def _shift(spark, sf):
    p = V.phi(spark, sf)
    return evaluate.attribution_shift(p.where("model = 'baseline'"), p.where("model = 'adapted'"))


@query("attribution_shift", """SELECT feature, round(baseline_mean_abs, 6) AS baseline_mean_abs,
    round(adapted_mean_abs, 6) AS adapted_mean_abs, round(shift_delta, 6) AS shift_delta FROM shift""", ("shift",))
def _attribution_shift(spark, sf):
    return rounded(_shift(spark, sf))


@query("knn_join", """SELECT vec_id, CAST(unnest(range(1, 6)) AS INT) AS nn_rank, unnest(list_transform(nn, lambda x: x.i)) AS nn_id,
    unnest(list_transform(nn, lambda x: round(sqrt(x.d), 6))) AS distance FROM (
    SELECT a.vec_id, min({'d': list_sum(list_transform(range(1, len(a.embedding) + 1),
      lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))),
      'i': b.vec_id}, 5) AS nn
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY a.vec_id)""")
def _knn_join(spark, sf):
    return rounded(neighbors.knn_join(V.table(spark, sf, "embeddings"), "embedding", 5, "vec_id"))


@query("knn_recall", "SELECT count(*) AS points, 5 * count(*) AS pairs, true AS recall_at_least_90 FROM embeddings")
def _knn_recall(spark, sf):
    """The approximate join held against the exact one."""
    v = V.table(spark, sf, "embeddings")
    exact = cut(neighbors.knn_join(v, "embedding", 5, "vec_id").select("vec_id", "nn_id"))
    near = neighbors.knn_join(v, "embedding", 5, "vec_id", method="lsh").select("vec_id", "nn_id", F.lit(1).alias("hit"))
    return exact.join(near, ["vec_id", "nn_id"], "left").agg(
        F.count_distinct("vec_id").alias("points"), F.count(F.lit(1)).alias("pairs"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("recall_at_least_90"))


# --- aggregations -----------------------------------------------------------

@query("class_counts", "SELECT source_year, unified_label, count(*) AS rows FROM labelled GROUP BY ALL", ("labelled",))
def _class_counts(spark, sf):
    return evaluate.class_counts(V.labelled(spark, sf), by=["source_year"])


@query("class_counts_live", "SELECT source_year, unified_label, count(*) AS rows FROM labelled GROUP BY ALL", ("labelled",))
def _class_counts_live(spark, sf):
    """The same counts, added up file by file."""
    out = scratch_path(spark, "counts")
    raw = V.flow_stream(spark, sf).withColumn("file_name", F.col("_metadata.file_name"))
    rows = clean_labels(raw, label_dimension(spark)).select("file_name", "source_year", "unified_label")
    counts.add_rows(rows, out, scratch_path(spark, "ckpt"))
    return counts.class_totals(counts.read_counts(spark, out))


@query("class_shares", """SELECT unified_label, count(*) AS rows, round(count(*) * 100e0 / sum(count(*)) OVER (), 3) AS pct
    FROM labelled GROUP BY unified_label""", ("labelled",))
def _class_shares(spark, sf):
    return evaluate.class_shares(V.labelled(spark, sf))


@query("worst_imbalance", """SELECT max(n) AS majority_rows, arg_min(unified_label, (n, unified_label)) AS smallest_class,
    min(n) AS smallest_rows, round(max(n) / min(n), 1) AS ratio FROM (
    SELECT unified_label, count(*) AS n FROM labelled GROUP BY unified_label)""", ("labelled",))
def _worst_imbalance(spark, sf):
    return evaluate.worst_imbalance(V.labelled(spark, sf))


_BIG = ["init_win_bytes_forward", "flow_packets_s", "flow_bytes_s", "flow_iat_mean", "fwd_iat_max", "bwd_iat_min"]


def _tier2_sql(source: str, having: str = "") -> str:
    def ent(col):
        return f"""(SELECT src_ip, window_start, greatest(round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9), 0e0) AS e FROM (
            SELECT src_ip, window_start, {col}, count(*) AS n FROM {source} GROUP BY ALL) GROUP BY src_ip, window_start)"""

    means = ", ".join(f"round(avg({c}), 2) AS mean_{c}" for c in G12 if c != "flow_duration")
    return f"""SELECT w.*, p.e AS protocol_entropy, d.e AS destination_port_entropy, coalesce(l.c, 'BENIGN') AS window_label FROM (
      SELECT src_ip, window_start, count(*) AS flow_count, round(avg(flow_duration), 2) AS mean_flow_duration, {means},
        count(DISTINCT dst_port) AS unique_destination_ports,
        round(avg(CASE WHEN unified_label <> 'BENIGN' THEN 1e0 ELSE 0e0 END), 9) AS attack_flow_fraction
      FROM {source} GROUP BY src_ip, window_start) w
      JOIN {ent('protocol')} p USING (src_ip, window_start) JOIN {ent('dst_port')} d USING (src_ip, window_start)
      LEFT JOIN (SELECT src_ip, window_start, arg_min(unified_label, (-n, unified_label)) AS c FROM (
        SELECT src_ip, window_start, unified_label, count(*) AS n FROM {source} WHERE unified_label <> 'BENIGN' GROUP BY ALL)
        GROUP BY src_ip, window_start) l USING (src_ip, window_start) {having}"""


def _round_tier2(df: DataFrame) -> DataFrame:
    means = [c for c in df.columns if c.startswith("mean_")]
    return rounded(rounded(df, 2, means), 9, ["attack_flow_fraction"])


@query("tier2_windows", _tier2_sql("windowed"), ("windowed",))
def _tier2_windows(spark, sf):
    return _round_tier2(windows.tier2_windows(V.clean(spark, sf)))


@query("shannon_entropy", """SELECT src_ip, greatest(round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9), 0e0) AS entropy FROM (
    SELECT src_ip, dst_port, count(*) AS n FROM clean GROUP BY ALL) GROUP BY src_ip""", ("clean",))
def _shannon_entropy(spark, sf):
    return windows.shannon_entropy(V.clean(spark, sf), ["src_ip"], "dst_port")


@query("window_cardinality", """SELECT count(DISTINCT src_ip) AS sources, count(DISTINCT window_start) AS windows,
    count(DISTINCT dst_port) AS ports, count(DISTINCT (src_ip, window_start)) AS groups FROM windowed""", ("windowed",))
def _window_cardinality(spark, sf):
    return windows.window_cardinality(V.windowed(spark, sf))


@query("window_label", """SELECT src_ip, window_start, coalesce(arg_min(CASE WHEN unified_label <> 'BENIGN' THEN unified_label END,
    CASE WHEN unified_label <> 'BENIGN' THEN (-n, unified_label) END), 'BENIGN') AS window_label FROM (
    SELECT src_ip, window_start, unified_label, count(*) AS n FROM windowed GROUP BY ALL) GROUP BY src_ip, window_start""", ("windowed",))
def _window_label(spark, sf):
    return windows.window_label(V.windowed(spark, sf), ["src_ip", "window_start"])


@query("attack_fraction", """SELECT src_ip, window_start, round(avg(CASE WHEN unified_label <> 'BENIGN' THEN 1e0 ELSE 0e0 END), 9)
    AS attack_flow_fraction FROM windowed GROUP BY src_ip, window_start""", ("windowed",))
def _attack_fraction(spark, sf):
    return rounded(windows.attack_fraction(V.windowed(spark, sf), ["src_ip", "window_start"]), 9)


_LONG_SQL = " UNION ALL ".join(f"SELECT tier, '{s}' AS stage, {s} AS ms FROM timings" for s in V.STAGES)
_SUMMARY_SQL = f"""SELECT tier, stage, round(avg(ms), 9) AS mean, round(quantile_cont(ms, 0.5), 9) AS median,
    round(quantile_cont(ms, 0.95), 9) AS p95, round(quantile_cont(ms, 0.99), 9) AS p99, round(max(ms), 9) AS max
    FROM ({_LONG_SQL}) GROUP BY tier, stage"""


@query("latency_summary", _SUMMARY_SQL, ("timings",))
def _latency_summary(spark, sf):
    return evaluate.latency_summary(V.timings(spark, sf), V.STAGES)


@query("latency_stats", """SELECT count(*) AS n, round(avg(latency_ms), 3) AS mean, round(quantile_cont(latency_ms, 0.5), 3) AS median,
    round(min(latency_ms), 3) AS min, round(quantile_cont(latency_ms, 0.95), 3) AS p95,
    round(quantile_cont(latency_ms, 0.99), 3) AS p99, round(max(latency_ms), 3) AS max,
    round(stddev_samp(latency_ms), 3) AS std FROM matched""", ("matched",))
def _latency_stats(spark, sf):
    return evaluate.latency_stats(_matched(spark, sf), digits=3)


@query("latency_target", f"""SELECT tier, mean, p95, 0.5e0 AS target_ms, mean < 0.5 AS mean_ok, p95 < 0.5 AS p95_ok
    FROM ({_SUMMARY_SQL}) WHERE stage = 'total_ms'""", ("timings",))
def _latency_target(spark, sf):
    return evaluate.latency_target(evaluate.latency_summary(V.timings(spark, sf), ["total_ms"]), 0.5)


@query("confusion_matrix", """SELECT m.model, t.label AS y_true, p.label AS y_pred, count(x.y_true) AS n
    FROM (SELECT DISTINCT model FROM predictions) m, (SELECT DISTINCT y_true AS label FROM predictions) t,
      (SELECT DISTINCT y_true AS label FROM predictions) p
    LEFT JOIN predictions x ON x.model = m.model AND x.y_true = t.label AND x.y_pred = p.label GROUP BY ALL""", ("predictions",))
def _confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(V.predictions(spark, sf), by=["model"])


@query("per_class_report", _with_macro("""SELECT model, label, round(p, 6) AS precision, round(r, 6) AS recall,
    round(f1, 6) AS f1, support FROM per"""))
def _per_class_report(spark, sf):
    return evaluate.per_class_report(evaluate.confusion_matrix(V.predictions(spark, sf), by=["model"]), by=["model"])


@query("overall_report", _with_macro("SELECT * FROM ov"))
def _overall_report(spark, sf):
    return evaluate.overall_report(evaluate.confusion_matrix(V.predictions(spark, sf), by=["model"]), by=["model"])


@query("stream_metrics", _METRICS_SQL, ("decided",))
def _stream_metrics(spark, sf):
    return cascade.stream_metrics(cascade.cascade_decide(V.scores(spark, sf)))


@query("mean_abs_attribution", "SELECT model, feature, round(avg(abs(phi)), 6) AS mean_abs FROM phi GROUP BY ALL", ("phi",))
def _mean_abs_attribution(spark, sf):
    return rounded(evaluate.mean_abs_attribution(V.phi(spark, sf), ["model"]))


# --- windows over an order --------------------------------------------------

@query("session_gap", "SELECT log_id, start_ts, gap_sec FROM sessions", ("sessions",))
def _session_gap(spark, sf):
    return intervals.session_gap(V.attack_log(spark, sf)).select("log_id", "start_ts", "gap_sec")


@query("sessionize", "SELECT log_id, class_label, session_id FROM sessions", ("sessions",))
def _sessionize(spark, sf):
    return intervals.sessionize(V.attack_log(spark, sf)).select("log_id", "class_label", "session_id")


@query("pick_session", "SELECT log_id, class_label, start_ts, end_ts, session_id FROM sessions WHERE session_id = 7", ("sessions",))
def _pick_session(spark, sf):
    s = intervals.pick_session(intervals.sessionize(V.attack_log(spark, sf)), 7)
    return s.select("log_id", "class_label", "start_ts", "end_ts", "session_id")


@query("tumbling_floor", "SELECT event_id, time_bucket(INTERVAL '5 minutes', ts) AS window_start FROM events")
def _tumbling_floor(spark, sf):
    return windows.with_window_start(V.table(spark, sf, "events")).select("event_id", "window_start")


@query("last_write_wins", "SELECT point, icmp_id, icmp_seq, ts, event_id FROM requests", ("requests",))
def _last_write_wins(spark, sf):
    r = PK.read_packets(V.packets(spark, sf))
    return P.last_write_wins(r, ["point", "icmp_id", "icmp_seq"], ["ts", "event_id"]).select(
        "point", "icmp_id", "icmp_seq", "ts", "event_id")


SPLITS = {"train": 0.8, "val": 0.1, "test": 0.1}


def _split(spark, sf):
    df = V.clean(spark, sf).select("flow_id", "unified_label")
    return sampling.stratified_split(df, "unified_label", "flow_id", SPLITS)


@query("stratified_split", "SELECT flow_id, unified_label, split FROM split", ("split",))
def _stratified_split(spark, sf):
    return _split(spark, sf)


# --- order, top-k, samples, sets --------------------------------------------

@query("count_order", "SELECT raw_label, count(*) AS rows FROM flows GROUP BY raw_label ORDER BY rows DESC, raw_label", ("flows",))
def _count_order(spark, sf):
    return evaluate.count_order(V.flows(spark, sf), "raw_label")


@query("top_features", """SELECT feature, round(adapted_mean_abs, 6) AS adapted_mean_abs FROM shift
    ORDER BY shift.adapted_mean_abs DESC, feature LIMIT 8""", ("shift",))
def _top_features(spark, sf):
    return rounded(evaluate.top_features(_shift(spark, sf), 8).select("feature", "adapted_mean_abs"))


@query("primary_driver", """SELECT 'baseline' AS model, arg_max(feature, baseline_mean_abs) AS feature FROM shift
    UNION ALL SELECT 'adapted', arg_max(feature, adapted_mean_abs) FROM shift""", ("shift",))
def _primary_driver(spark, sf):
    return evaluate.primary_driver(_shift(spark, sf))


@query("predict_class", f"""SELECT flow_id, [{', '.join(repr(c) for c in S.CLASSES)}][list_position(probs, list_max(probs))] AS predicted_class,
    round(list_max(probs), 6) AS confidence FROM scores""", ("scores",))
def _predict_class(spark, sf):
    best = V.scores(spark, sf).select("flow_id", predict_class("probs").alias("b"))
    return best.select("flow_id", "b.predicted_class", F.round("b.confidence", 6).alias("confidence"))


@query("sample_rows", """SELECT flow_id, unified_label FROM clean
    ORDER BY md5(concat_ws('|', CAST(flow_id AS VARCHAR), '42')), flow_id LIMIT 500""", ("clean",))
def _sample_rows(spark, sf):
    return sampling.sample_rows(V.clean(spark, sf), 500, "flow_id").select("flow_id", "unified_label")


@query("union_sources", f"""SELECT flow_id, {G12_SQL}, origin FROM (SELECT *, 'benchmark' AS origin FROM clean
    UNION ALL SELECT *, 'live' AS origin FROM clean)""", ("clean",))
def _union_sources(spark, sf):
    cols = ["flow_id", *G12]
    c = V.clean(spark, sf).select(*cols)
    return setops.union_sources(FL.add_lineage(c, origin="benchmark"), FL.add_lineage(c, origin="live"))


@query("key_set_ops", """SELECT icmp_id, icmp_seq, 'both' AS side FROM (SELECT icmp_id, icmp_seq FROM outside INTERSECT SELECT icmp_id, icmp_seq FROM inside)
    UNION ALL SELECT icmp_id, icmp_seq, 'a_only' FROM (SELECT icmp_id, icmp_seq FROM outside EXCEPT SELECT icmp_id, icmp_seq FROM inside)
    UNION ALL SELECT icmp_id, icmp_seq, 'b_only' FROM (SELECT icmp_id, icmp_seq FROM inside EXCEPT SELECT icmp_id, icmp_seq FROM outside)""",
       ("outside", "inside"))
def _key_set_ops(spark, sf):
    r = PK.read_packets(V.packets(spark, sf))
    return setops.key_set_ops(r.where("point = 'outside'"), r.where("point = 'inside'"), ["icmp_id", "icmp_seq"])


# --- streaming --------------------------------------------------------------

_ALERT_SQL = """SELECT ts, flow_id, src_ip, dst_ip, dst_port, severity, predicted_class, confidence, pipeline_tier
    FROM decided WHERE severity IS NOT NULL"""


def _drain(spark, stream: DataFrame) -> DataFrame:
    out = scratch_path(spark, "out")
    jobs.run_to_files(stream, out, scratch_path(spark, "ckpt"))
    return spark.read.schema(stream.schema).parquet(out)


def _naive(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_cascade", _ALERT_SQL, ("decided",))
def _stream_cascade(spark, sf):
    return _drain(spark, jobs.stream_cascade(V.scores_of(V.flow_stream(spark, sf)), seconds=False))


@query("stream_ids_events", """SELECT e.ts, e.flow_id, coalesce(e.src_ip, '0.0.0.0') AS src_ip, e.dest_ip AS dst_ip,
    e.dest_port AS dst_port, d.severity, d.predicted_class, d.confidence, d.pipeline_tier
    FROM flow_events e JOIN decided d USING (flow_id) WHERE d.severity IS NOT NULL""", ("flow_events", "decided"))
def _stream_ids_events(spark, sf):
    events = E.parse_ids_events(V.event_lines_of(V.flow_stream(spark, sf)))
    return _drain(spark, jobs.stream_ids_events(V.scores_of(events)))


@query("stream_metrics_live", """SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, count(*) AS flows,
    count(*) FILTER (tier1_hit) AS tier1_hits, count(severity) AS alerts FROM decided GROUP BY 1""", ("decided",))
def _stream_metrics_live(spark, sf):
    decided = cascade.cascade_decide(V.scores_of(V.flow_stream(spark, sf)))
    out = scratch_path(spark, "out")
    jobs.run_updates(jobs.stream_metrics_live(decided), out, scratch_path(spark, "ckpt"))
    return _naive(jobs.read_updates(spark, out, ["window_start"]))


@query("stream_tier2_windows", _tier2_sql("windowed"), ("windowed",))
def _stream_tier2_windows(spark, sf):
    rows = V.clean_of(V.flow_stream(spark, sf, closed=True))
    return _naive(_round_tier2(_drain(spark, jobs.stream_tier2_windows(rows))))


@query("stream_sessionize", "SELECT log_id, class_label, session_id FROM sessions", ("sessions",))
def _stream_sessionize(spark, sf):
    done = _drain(spark, state.stream_sessionize(V.log_stream(spark, sf)))
    return done.select("log_id", "class_label", "session_id")


_BLOCK_SQL = """SELECT src_ip, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n_alerts,
    arg_min(predicted_class, ts) AS predicted_class FROM decided WHERE severity IS NOT NULL GROUP BY src_ip"""


def _block_actions(spark, sf) -> DataFrame:
    al = jobs.stream_cascade(V.scores_of(V.flow_stream(spark, sf, closed=True)), seconds=False)
    done = _drain(spark, jobs.stream_block_requests(al, ttl_seconds=6 * 3600))
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


@query("block_requests", _BLOCK_SQL, ("decided",))
def _block_requests(spark, sf):
    return jobs.released(_block_actions(spark, sf))


@query("stream_ids_blocks", f"""SELECT 'block' AS action, coalesce(src_ip, '0.0.0.0') AS src_ip, arg_min(predicted_class, ts) AS predicted_class,
    min(ts) AS first_seen FROM (SELECT e.ts, e.src_ip, d.predicted_class FROM flow_events e JOIN decided d USING (flow_id)
      WHERE d.severity IS NOT NULL) GROUP BY ALL""", ("flow_events", "decided"))
def _stream_ids_blocks(spark, sf):
    events = E.parse_ids_events(V.event_lines_of(V.flow_stream(spark, sf)))
    done = _drain(spark, jobs.stream_ids_blocks(V.scores_of(events), ttl_seconds=30 * 86400))
    return done.where("action = 'block'").select("action", "src_ip", "predicted_class", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"))


def _watched(spark, sf) -> DataFrame:
    """Rates of a cascade stream and of its block requests, from their progress."""
    path = scratch_path(spark, "progress")
    with progress.watch(spark, path):
        al = jobs.stream_cascade(V.scores_of(V.flow_stream(spark, sf)), seconds=False)
        jobs.run_to_files(al, scratch_path(spark, "out"), scratch_path(spark, "ckpt"), name="alerts")
        jobs.run_to_files(jobs.stream_block_requests(al), scratch_path(spark, "out"), scratch_path(spark, "ckpt"), name="blocks")
    return progress.stream_rates(progress.read_progress(spark, path))


@query("stream_progress", """SELECT name, count(*) AS input_rows, 0 AS late_rows, true AS several_batches, true AS has_latency, true AS has_rate
    FROM flows, (VALUES ('alerts'), ('blocks')) AS q(name) GROUP BY name""", ("flows",))
def _stream_progress(spark, sf):
    return _watched(spark, sf).select(
        "name", "input_rows", F.col("late_rows").cast("int").alias("late_rows"), (F.col("batches") > 1).alias("several_batches"),
        (F.col("avg_latency_us") > 0).alias("has_latency"), (F.col("throughput_fps") > 0).alias("has_rate"))


@query("realtime_table_live")
def _realtime_table_live(spark, sf):
    """The report row of a finished stream, with mean latency and throughput from its progress."""
    rates = _watched(spark, sf).where("name = 'alerts'").first()
    decided = cascade.cascade_decide(V.scores(spark, sf))
    return cascade.realtime_table(cascade.stream_metrics(decided, rates["busy_ms"] / 1000.0))


@query("block_requests_batch", _BLOCK_SQL, ("decided",))
def _block_requests_batch(spark, sf):
    return cascade.block_requests(cascade.alerts(cascade.cascade_decide(V.scores(spark, sf))))


# --- balancing --------------------------------------------------------------

@query("downsample_majority", """SELECT flow_id, unified_label FROM clean WHERE unified_label <> 'BENIGN'
    OR CAST(('0x' || substr(md5(concat_ws('|', CAST(flow_id AS VARCHAR), '42')), 1, 8)) AS BIGINT) / 4294967296e0
       < least(1e0, 2000e0 / (SELECT count(*) FROM clean WHERE unified_label = 'BENIGN'))""", ("clean",))
def _downsample_majority(spark, sf):
    df = V.clean(spark, sf).select("flow_id", "unified_label")
    return sampling.downsample_majority(df, "flow_id", target=2000)


@query("synthesize_minority")
def _synthesize_minority(spark, sf):
    return balance.synthesize_minority(V.clean(spark, sf), "flow_id")


@query("synthesize_minority_check", """SELECT unified_label, 20000 - count(*) AS rows, 20000 - count(*) AS ids, true AS in_range, true AS negative_ids
    FROM clean GROUP BY unified_label HAVING count(*) < 20000""", ("clean",))
def _synthesize_minority_check(spark, sf):
    """Number of rows, unique ids and value ranges of the synthetic rows against the real ones."""
    real = V.clean(spark, sf)
    new = cut(balance.synthesize_minority(real, "flow_id"))
    ends = real.groupBy("unified_label").agg(*[f(c).alias(f"{n}_{c}") for c in G12 for n, f in (("lo", F.min), ("hi", F.max))])
    inside = [(F.col(c) >= F.col(f"lo_{c}")) & (F.col(c) <= F.col(f"hi_{c}")) for c in G12]
    good = inside[0]
    for x in inside[1:]:
        good = good & x
    return new.join(ends, "unified_label").groupBy("unified_label").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("flow_id").alias("ids"), F.bool_and(good).alias("in_range"),
        F.bool_and(F.col("flow_id") < 0).alias("negative_ids"))


_D2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in G12)


def _unit_sql(seed: int) -> str:
    return (f"CAST(('0x' || substr(md5(concat_ws('|', concat_ws('|', unified_label, CAST(j AS VARCHAR)), '{seed}')), 1, 8))"
            " AS BIGINT) / 4294967296e0")


@query("smote", f"""SELECT d.unified_label, d.j IS NOT NULL AS drawn, x.flow_id AS base_id, y.flow_id AS nn_id, round(d.u, 9) AS u,
    {', '.join(f'round(x.{c} + d.u * (y.{c} - x.{c}), 3) AS {c}' for c in G12)}
    FROM (SELECT unified_label, j, CAST(floor({_unit_sql(42)} * n) AS BIGINT) AS pos, {_unit_sql(43)} AS pick, {_unit_sql(44)} AS u
          FROM (SELECT unified_label, n, unnest(range(0, 20000 - n)) AS j FROM (
            SELECT unified_label, count(*) AS n FROM clean GROUP BY unified_label HAVING count(*) < 20000))) d
    JOIN (SELECT *, row_number() OVER (PARTITION BY unified_label ORDER BY flow_id) - 1 AS pos FROM clean) x USING (unified_label, pos)
    JOIN (SELECT a.flow_id, min({{'d': {_D2}, 'i': b.flow_id}}, 5) AS nn FROM clean a JOIN clean b
          ON a.unified_label = b.unified_label AND a.flow_id <> b.flow_id GROUP BY a.flow_id) k ON k.flow_id = x.flow_id
    JOIN clean y ON y.flow_id = k.nn[CAST(floor(d.pick * len(k.nn)) AS BIGINT) + 1].i""", ("clean",))
def _smote(spark, sf):
    new = balance.smote(V.clean(spark, sf), "flow_id")
    new = new.select("unified_label", F.col("flow_id").isNotNull().alias("drawn"), "base_id", "nn_id", "u", *G12)
    return rounded(rounded(new, 3, G12), 9, ["u"])


@query("enn_clean", f"""SELECT flow_id, unified_label FROM (
    SELECT a.flow_id, any_value(a.unified_label) AS unified_label,
      min({{'d': {_D2}, 'i': b.flow_id, 'l': b.unified_label}}, 3) AS nn
    FROM clean a JOIN clean b ON a.flow_id <> b.flow_id GROUP BY a.flow_id)
    WHERE len(list_filter(nn, lambda x: x.l <> unified_label)) = 0 OR unified_label = (
      SELECT arg_min(unified_label, (n, unified_label)) FROM (SELECT unified_label, count(*) AS n FROM clean GROUP BY unified_label))""",
       ("clean",))
def _enn_clean(spark, sf):
    df = V.clean(spark, sf).select("flow_id", *G12, "unified_label")
    return balance.enn_clean(df, "flow_id").select("flow_id", "unified_label")


@query("balance_dataset")
def _balance_dataset(spark, sf):
    return balance.balance_dataset(V.clean(spark, sf), "flow_id")[1]


# --- models -----------------------------------------------------------------

ROUNDS, DEPTH = 5, 5  # registered queries train small models, but for domain_adapt; the defaults are those of the operators


def _data(spark, sf):
    """Stored train / val / test rows, with the columns that models read."""
    ratios = {"train": 0.8, "val": 0.1, "test": 0.1}
    rows = V.clean(spark, sf).select("flow_id", *G12, "unified_label")
    return keep(spark, f"parts {sf}", lambda: sampling.stratified_split(rows, "unified_label", "flow_id", ratios))


def _m1(spark, sf):
    rows = _data(spark, sf).where("split <> 'test'").withColumn("is_val", F.col("split") == "val")
    return keep(spark, f"tier1 {sf}", lambda: models.train_binary(rows, rounds=ROUNDS, depth=DEPTH, hold=True))


def _m3(spark, sf):
    rows = _data(spark, sf).where("split <> 'test'").withColumn("is_val", F.col("split") == "val")
    return keep(spark, f"tier3 {sf}", lambda: models.train_multiclass(rows, rounds=3, depth=4, trees=10))


@query("train_binary")
def _train_binary(spark, sf):
    val = _data(spark, sf).where("split = 'val'")
    return models.evaluate_model(_m1(spark, sf), val, "tier1", binary=True)


@query("train_multiclass")
def _train_multiclass(spark, sf):
    val = _data(spark, sf).where("split = 'val'")
    return models.stack_reports([models.evaluate_model(m, val, n) for n, m in _m3(spark, sf).items()])


@query("evaluate_model")
def _evaluate_model(spark, sf):
    test = _data(spark, sf).where("split = 'test'")
    return models.evaluate_model(_m3(spark, sf)["forest"], test, "forest")


@query("compare_learners", _with_macro("SELECT *, row_number() OVER (ORDER BY macro_f1 DESC, model) = 1 AS winner FROM ov"))
def _compare_learners(spark, sf):
    return evaluate.compare_learners(V.predictions(spark, sf))


def _live(spark, sf):
    return live.ground_truth(live.prepare_live(V.flows(spark, sf), seconds=False), V.attack_log(spark, sf))


@query("zero_shot_eval")
def _zero_shot_eval(spark, sf):
    return live.zero_shot_eval(_m1(spark, sf), _m3(spark, sf)["boosted"], _live(spark, sf))


@query("domain_adapt")
def _domain_adapt(spark, sf):
    history = _data(spark, sf).where("split = 'train'")
    return live.domain_adapt(history, _live(spark, sf))[2]


@query("score_cascade", """SELECT flow_id, tier1_hit, predicted_class, confidence, pipeline_tier, severity FROM decided""", ("decided",))
def _score_cascade(spark, sf):
    return cascade.cascade_decide(V.scores(spark, sf)).select(
        "flow_id", "tier1_hit", "predicted_class", "confidence", "pipeline_tier", "severity")


@query("score_cascade_models")
def _score_cascade_models(spark, sf):
    out = cascade.score_cascade(V.clean(spark, sf), _m1(spark, sf), _m3(spark, sf)["forest"])
    return out.select("flow_id", "tier1_hit", "predicted_class", "confidence", "pipeline_tier", "severity")


@query("feature_attribution")
def _feature_attribution(spark, sf):
    return attribution.feature_attribution(_m1(spark, sf), V.clean(spark, sf))


@query("attribution_check", "SELECT count(*) AS rows, true AS additive FROM clean", ("clean",))
def _attribution_check(spark, sf):
    """Attributions plus bias against the margin of every row."""
    return attribution.additivity_error(_m1(spark, sf), V.clean(spark, sf)).select("rows", (F.col("error") < 1e-9).alias("additive"))
