"""Input views over the given tables, once for Spark and once as oracle SQL.

The flow-shaped inputs are derived from ``events`` and ``lineitem`` row by
row, so they grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.operators.labels import clean_labels, drop_header_rows, drop_unmapped, map_label, with_label_key
from flowtide.operators.windows import with_window_start
from flowtide.plans.dataset import golden12
from flowtide.session import keep, scratch_path
from flowtide.sources.dimension import label_dimension


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- flows ------------------------------------------------------------------

_FLOWS = """
WITH b AS (
  SELECT event_id, event_type, user_id,
    CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k,
    CASE WHEN event_id % 101 = 0 THEN 0 ELSE CAST(round(value * 10000) AS BIGINT) END AS dur,
    {TS} '2024-01-01 00:00:00' + event_id * INTERVAL '3' SECOND AS ts
  FROM {events}),
c AS (SELECT *, 1 + k % 40 AS fp, k % 25 AS bp, 40 + event_id % 1400 AS plen FROM b)
SELECT event_id AS flow_id, ts,
  concat('10.0.0.', CAST(user_id % 8 AS STRING)) AS src_ip, '10.10.10.5' AS dst_ip,
  CASE k % 5 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 21 ELSE 8080 END AS dst_port,
  CASE WHEN event_id % 10 < 7 THEN 6 WHEN event_id % 10 < 9 THEN 17 ELSE 1 END AS protocol,
  CASE WHEN event_type IN ('view','purchase') THEN 2018 ELSE 2017 END AS source_year,
  CASE WHEN event_id % 211 = 0 THEN 'Label' WHEN event_id % 197 = 0 THEN 'Mystery-Tool'
       WHEN event_type = 'view' THEN ' Benign ' WHEN event_type = 'click' THEN 'BENIGN'
       WHEN event_type = 'signup' THEN 'FTP-Patator' WHEN event_type = 'purchase' THEN 'DoS attacks-Hulk'
       ELSE concat('Web Attack ', chr(239), chr(191), chr(189), ' XSS') END AS raw_label,
  fp * 40e0 AS fwd_header_length, bp * 40e0 AS bwd_header_length,
  CAST(event_id % 2 AS DOUBLE) AS fwd_psh_flags, CAST(fp AS DOUBLE) AS ack_flag_count,
  CASE event_id % 4 WHEN 0 THEN 512e0 WHEN 1 THEN 8192e0 WHEN 2 THEN 14788e0 ELSE 65535e0 END AS init_win_bytes_forward,
  CAST(dur AS DOUBLE) AS flow_duration,
  CASE WHEN dur = 0 THEN CAST('Infinity' AS DOUBLE) ELSE (fp + bp) * 1e6 / dur END AS flow_packets_s,
  CASE WHEN dur = 0 AND event_id % 2 = 0 THEN CAST('NaN' AS DOUBLE) WHEN dur = 0 THEN CAST('Infinity' AS DOUBLE)
       ELSE (fp * plen + bp * 60) * 1e6 / dur END AS flow_bytes_s,
  CAST(plen AS DOUBLE) AS fwd_packet_length_max,
  dur * 1e0 / (fp + bp) AS flow_iat_mean, dur * 1e0 / fp AS fwd_iat_max,
  CASE WHEN bp = 0 THEN 0e0 ELSE dur * 1e0 / bp END AS bwd_iat_min
FROM c
"""


def flows_of(events: DataFrame) -> DataFrame:
    return events.sparkSession.sql(_FLOWS.replace("{TS}", "TIMESTAMP_NTZ"), events=events)


def flow_folder(spark, sf) -> str:
    """Flows derived from ``events`` once per application and stored in time order.

    Stages hand over Parquet: later scans prune columns and push filters to
    stored features instead of recomputing the derivation inside each filter.
    The events are put in order before the derivation, so that sampling the order
    and the shuffle see their few columns and each flow is derived once.
    """
    def store():
        path = scratch_path(spark, "flows")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        events = table(spark, sf, "events").select("event_id", "event_type", "user_id", "value", "props")
        flows_of(events.repartitionByRange(n, "event_id")).write.parquet(path)
        return path

    return keep(spark, f"flows {sf}", store)


def flows(spark, sf) -> DataFrame:
    return spark.read.parquet(flow_folder(spark, sf))


SLICES, SLICE_FILES = 4, 2                   # at least
SLICE_ROWS, FILE_ROWS = 2_000_000, 100_000   # aimed-at rows of a slice and of a file
CLOSING = "closing"  # source of the row that ends a closed stream


def stream_folder(spark, sf, closed: bool) -> tuple[str, int]:
    """The flows as files in time order and the number of files per slice; a closed folder ends with one row a day later.

    Slices and their files grow in number with the table, so that a micro-batch
    stays bounded and is read by many tasks.  The closing row moves the watermark
    past all others, so that every window and session of theirs is emitted; its
    own stay open.
    """
    def store():
        path = scratch_path(spark, "stream")
        f = flows(spark, sf)
        first, last, rows = f.agg(F.min("flow_id"), F.max("flow_id"), F.count(F.lit(1))).first()
        slices = max(SLICES, -(-rows // SLICE_ROWS))
        files = max(SLICE_FILES, -(-rows // (slices * FILE_ROWS)))
        step = (last - first) // slices + 1
        for i in range(slices):
            part = f.where((F.col("flow_id") >= first + i * step) & (F.col("flow_id") < first + (i + 1) * step))
            part.repartition(files, "flow_id").write.mode("append").parquet(path)
            if files > SLICE_FILES:  # a slice with fewer rows than files must not draw files of the next into its batch
                missing = (i + 1) * files - len(spark.read.schema(f.schema).parquet(path).inputFiles())
                for _ in range(missing):
                    f.limit(0).coalesce(1).write.mode("append").parquet(path)
        if closed:
            # an id whose made-up score is an alert
            end = f.where(F.col("flow_id") == last).withColumns({
                "ts": F.col("ts") + F.expr("INTERVAL '1' DAY"), "src_ip": F.lit(CLOSING), "flow_id": F.lit(10**12 + 27)})
            end.withColumns({"raw_label": F.lit("BENIGN"), "source_year": F.lit(2017), **{c: F.lit(1.0) for c in S.GOLDEN12}}).coalesce(1).write.mode("append").parquet(path)
        return path, files

    return keep(spark, f"stream {closed} {sf}", store)


def flow_stream(spark, sf, closed: bool = False) -> DataFrame:
    """The stored flows as a file stream of several micro-batches, one per slice."""
    path, files = stream_folder(spark, sf, closed)
    return spark.readStream.schema(flows(spark, sf).schema).option("maxFilesPerTrigger", files).parquet(path)


def log_stream(spark, sf) -> DataFrame:
    """The attack log as a file stream in start order, with a closing row a day later."""
    def store():
        path = scratch_path(spark, "log")
        log = attack_log(spark, sf)
        first, last = log.agg(F.min("start_ts"), F.max("start_ts")).first()
        step = (last - first) / SLICES
        for i in range(SLICES):
            low, high = first + i * step, first + (i + 1) * step
            inside = (F.col("start_ts") >= F.lit(low)) & ((F.col("start_ts") < F.lit(high)) if i < SLICES - 1 else F.lit(True))
            log.where(inside).coalesce(1).write.mode("append").parquet(path)
        end = log.limit(1).withColumns({"log_id": F.lit(10**12), "start_ts": F.lit(last) + F.expr("INTERVAL '1' DAY"),
                                        "end_ts": F.lit(last) + F.expr("INTERVAL '25' HOUR")})
        end.coalesce(1).write.mode("append").parquet(path)
        return path

    path = keep(spark, f"log stream {sf}", store)
    return spark.readStream.schema(attack_log(spark, sf).schema).option("maxFilesPerTrigger", 1).parquet(path)


def files(spark, sf) -> DataFrame:
    return flows(spark, sf).withColumn("file_name", F.concat(F.lit("part-"), (F.col("flow_id") % 5).cast("string"), F.lit(".csv")))


def keyed(spark, sf) -> DataFrame:
    return with_label_key(flows(spark, sf))


def mapped(spark, sf) -> DataFrame:
    return map_label(keyed(spark, sf), label_dimension(spark))


def labelled(spark, sf) -> DataFrame:
    return clean_labels(flows(spark, sf), label_dimension(spark))


def labelled_stepwise(spark, sf) -> DataFrame:
    return drop_unmapped(drop_header_rows(mapped(spark, sf)))


CONTEXT = ["flow_id", "ts", "src_ip", "dst_ip", "dst_port", "protocol"]


def clean_of(raw: DataFrame) -> DataFrame:
    return golden12(raw, label_dimension(raw.sparkSession), CONTEXT)


def clean(spark, sf) -> DataFrame:
    return clean_of(flows(spark, sf))


def windowed(spark, sf) -> DataFrame:
    return with_window_start(clean(spark, sf))


def attack_log(spark, sf) -> DataFrame:
    """Intervals per quarter hour and class, 60 to 180 seconds long, overlapping within a quarter."""
    q = with_window_start(labelled(spark, sf), "ts", "15 minutes")
    g = q.groupBy("window_start", F.col("unified_label").alias("class_label")).agg(
        F.min("ts").alias("start_ts"), F.min("flow_id").alias("log_id"), F.count(F.lit(1)).alias("n"))
    length = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (60 + 20 * (F.col("n") % 7)).cast("decimal(18,6)"))
    return g.select("log_id", "start_ts", (F.col("start_ts") + length).alias("end_ts"), "class_label")


def packets(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        "event_id", F.when(F.col("event_id") % 2 == 0, "outside").otherwise("inside").alias("point"),
        F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 3).otherwise(8).alias("icmp_type"),
        F.col("user_id").alias("icmp_id"),
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("icmp_seq"), "ts")


STAGES = ["feature_assembly_ms", "inference_ms", "postprocessing_ms", "total_ms"]


def timings(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", "tier1").otherwise("tier3").alias("tier"),
        (F.col("l_quantity") / 100).alias("feature_assembly_ms"),
        (F.col("l_extendedprice") / 50000).alias("inference_ms"), (F.col("l_tax") / 100).alias("postprocessing_ms"))
    return li.withColumn("total_ms", F.col("feature_assembly_ms") + F.col("inference_ms") + F.col("postprocessing_ms"))


def predictions(spark, sf) -> DataFrame:
    """Six classes with known mistakes for two learners."""
    li = table(spark, sf, "lineitem")
    truth = F.concat("l_returnflag", "l_linestatus")
    wrong = F.when(F.col("l_suppkey") % 3 == 0, "AF").when(F.col("l_suppkey") % 3 == 1, "NO").otherwise("RF")
    both = li.select(truth.alias("y_true"), F.explode(F.create_map(
        F.lit("boosted"), F.when(F.col("l_partkey") % 11 == 0, wrong).otherwise(truth),
        F.lit("forest"), F.when(F.col("l_partkey") % 13 == 0, wrong).otherwise(truth))).alias("model", "y_pred"))
    return both.select("model", "y_true", "y_pred")


def configs(spark, sf) -> DataFrame:
    """Two model configurations over labelled flows with known mistakes."""
    f, i = labelled(spark, sf), F.col("flow_id")
    truth = F.col("unified_label")
    return f.select(truth.alias("y_true"), F.explode(F.create_map(
        F.lit("baseline"), F.when(i % 13 == 0, truth).otherwise(S.BENIGN),
        F.lit("adapted"), F.when(i % 17 == 0, S.BENIGN).when(i % 23 == 0, S.DOS).otherwise(truth))).alias("config", "y_pred"))


def scores_of(raw: DataFrame) -> DataFrame:
    i = F.col("flow_id")
    weights = [(1 + i * (7 * j + 3) % 11).cast("double") for j in range(6)]
    total = sum(weights[1:], weights[0])
    return raw.withColumns({"p1": (i * 37 % 1000) / F.lit(1000.0), "probs": F.array(*[w / total for w in weights])})


def scores(spark, sf) -> DataFrame:
    return scores_of(flows(spark, sf))


def event_lines_of(f: DataFrame) -> DataFrame:
    """Flows as JSON lines, with absent fields, and blank and broken lines in between."""
    i = F.col("flow_id")
    tcp = F.when(F.col("protocol") == 6, F.struct(
        (i % 3 == 0).alias("psh"), F.when(i % 7 != 0, i % 2 == 0).alias("ack"),
        F.when(i % 5 != 0, F.col("init_win_bytes_forward").cast("int")).alias("window")))
    flow = F.struct(
        F.when(i % 19 != 0, F.col("flow_duration") / 1e6).alias("age"),
        F.when(i % 23 != 0, F.col("ack_flag_count").cast("bigint")).alias("pkts_toserver"),
        (F.col("bwd_header_length") / 40).cast("bigint").alias("pkts_toclient"),
        (F.col("ack_flag_count") * F.col("fwd_packet_length_max")).cast("bigint").alias("bytes_toserver"),
        F.when(i % 29 != 0, F.col("bwd_header_length").cast("bigint")).alias("bytes_toclient"))
    kind = F.when(i % 5 == 0, "dns").when(i % 5 == 1, "alert").when(i % 5 == 2, "netflow").otherwise("flow")
    line = F.to_json(F.struct(
        kind.alias("event_type"), F.col("ts").cast("string").alias("timestamp"),
        F.when(i % 31 != 0, F.col("src_ip")).alias("src_ip"), F.when(i % 37 != 0, 1024 + i.cast("int") % 5000).alias("src_port"),
        F.col("dst_ip").alias("dest_ip"), F.col("dst_port").alias("dest_port"),
        F.when(F.col("protocol") == 17, "UDP").when(F.col("protocol") == 1, "ICMP").alias("proto"),
        flow.alias("flow"), tcp.alias("tcp")))
    extra = F.array_compact(F.array(line, F.when(i % 100 == 0, "   "), F.when(i % 100 == 50, '{"event_type": "flow", ')))
    return f.select(i, F.col("ts"), F.explode(extra).alias("value"))


def event_lines(spark, sf) -> DataFrame:
    return event_lines_of(flows(spark, sf))


def phi(spark, sf) -> DataFrame:
    """(model, flow_id, feature, phi): two made-up attributions of every clean flow and feature."""
    i = F.col("flow_id")
    cells = []
    for j, c in enumerate(S.GOLDEN12):
        turn = (i * (7 + 2 * j) % 101 - 50) / F.lit(50.0)
        for model, w in (("baseline", (j + 1) / 100), ("adapted", (12 - j) / 50)):
            cells.append(F.struct(F.lit(model).alias("model"), F.lit(c).alias("feature"),
                                  (turn * F.log1p(c) * F.lit(w)).alias("phi")))
    return clean(spark, sf).select("flow_id", F.inline(F.array(*cells)))


# --- the same views as SQL --------------------------------------------------

_DIM_ROWS = ", ".join(f"({y}, '{k}', '{c}')" for y, m in S.LABEL_MAP.items() for k, c in m.items())
_G12 = ", ".join(S.GOLDEN12)
_KEY = r"trim(regexp_replace(replace(replace(lower(raw_label), 'ï¿½', ' '), '-', ' '), '\s+', ' ', 'g'))"
_W = [f"CAST(1 + flow_id * {7 * j + 3} % 11 AS DOUBLE)" for j in range(6)]
_WS = " + ".join(_W)
_TURN = {c: f"((flow_id * {7 + 2 * j} % 101 - 50) / 50e0)" for j, c in enumerate(S.GOLDEN12)}

SQL_VIEWS: dict[str, str] = {
    "flows": _FLOWS.replace("{TS}", "TIMESTAMP").replace("{events}", "events"),
    "label_dim": f"SELECT * FROM (VALUES {_DIM_ROWS}) AS t(source_year, label_key, unified_label)",
    "files": "SELECT *, concat('part-', CAST(flow_id % 5 AS VARCHAR), '.csv') AS file_name FROM flows",
    "keyed": f"SELECT *, {_KEY} AS label_key FROM flows",
    "mapped": "SELECT k.*, d.unified_label FROM keyed k LEFT JOIN label_dim d USING (source_year, label_key)",
    "labelled": "SELECT * FROM mapped WHERE label_key <> 'label' AND unified_label IS NOT NULL",
    "clean": f"""SELECT flow_id, ts, src_ip, dst_ip, dst_port, protocol, {_G12}, unified_label, source_year FROM labelled
        WHERE NOT isinf(flow_packets_s) AND NOT isnan(flow_packets_s)
          AND NOT isinf(flow_bytes_s) AND NOT isnan(flow_bytes_s)""",
    "windowed": "SELECT *, time_bucket(INTERVAL '5 minutes', ts) AS window_start FROM clean",
    "attack_log": """SELECT min(flow_id) AS log_id, min(ts) AS start_ts,
        min(ts) + (60 + 20 * (count(*) % 7)) * INTERVAL '1' SECOND AS end_ts, unified_label AS class_label
        FROM labelled GROUP BY time_bucket(INTERVAL '15 minutes', ts), unified_label""",
    "packets": """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'outside' ELSE 'inside' END AS point,
        CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 3 ELSE 8 END AS icmp_type, user_id AS icmp_id,
        CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS icmp_seq, ts FROM events""",
    "requests": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point, icmp_id, icmp_seq
        ORDER BY ts DESC, event_id DESC) AS rn FROM packets WHERE icmp_type = 8) WHERE rn = 1""",
    "outside": "SELECT * FROM requests WHERE point = 'outside'",
    "inside": "SELECT * FROM requests WHERE point = 'inside'",
    "matched": """SELECT a.icmp_id, a.icmp_seq, a.ts AS ts_a, b.ts AS ts_b,
        (epoch_us(b.ts) - epoch_us(a.ts)) / 1000e0 AS latency_ms FROM outside a JOIN inside b USING (icmp_id, icmp_seq)""",
    "timings": """SELECT *, feature_assembly_ms + inference_ms + postprocessing_ms AS total_ms FROM (
        SELECT CASE WHEN l_linestatus = 'F' THEN 'tier1' ELSE 'tier3' END AS tier,
          l_quantity / 100 AS feature_assembly_ms, l_extendedprice / 50000 AS inference_ms,
          l_tax / 100 AS postprocessing_ms FROM lineitem)""",
    "predictions": """SELECT m.model, l_returnflag || l_linestatus AS y_true,
        CASE WHEN l_partkey % (CASE m.model WHEN 'boosted' THEN 11 ELSE 13 END) = 0
             THEN CASE l_suppkey % 3 WHEN 0 THEN 'AF' WHEN 1 THEN 'NO' ELSE 'RF' END
             ELSE l_returnflag || l_linestatus END AS y_pred
        FROM lineitem, (VALUES ('boosted'), ('forest')) AS m(model)""",
    "configs": """SELECT c.config, unified_label AS y_true,
        CASE c.config WHEN 'baseline' THEN CASE WHEN flow_id % 13 = 0 THEN unified_label ELSE 'BENIGN' END
          ELSE CASE WHEN flow_id % 17 = 0 THEN 'BENIGN' WHEN flow_id % 23 = 0 THEN 'DoS_DDoS' ELSE unified_label END
        END AS y_pred FROM labelled, (VALUES ('baseline'), ('adapted')) AS c(config)""",
    "scores": f"""SELECT *, (flow_id * 37 % 1000) / 1000e0 AS p1,
        [{', '.join(f'{w} / ({_WS})' for w in _W)}] AS probs FROM flows""",
    "decided": f"""SELECT *, CASE WHEN tier1_hit THEN 'CRITICAL'
          WHEN predicted_class IN ('BRUTE_FORCE', 'BOTNET') THEN 'HIGH'
          WHEN predicted_class <> 'BENIGN' THEN 'MEDIUM' END AS severity FROM (
        SELECT *, p1 > 0.5 AS tier1_hit,
          CASE WHEN p1 > 0.5 THEN 'DoS_DDoS' ELSE
            [{', '.join(repr(c) for c in S.CLASSES)}][list_position(probs, list_max(probs))] END AS predicted_class,
          round(CASE WHEN p1 > 0.5 THEN p1 ELSE list_max(probs) END, 4) AS confidence,
          CASE WHEN p1 > 0.5 THEN '{S.TIER1}' ELSE '{S.TIER3}' END AS pipeline_tier FROM scores)""",
    "ids_events": """SELECT flow_id, ts,
        CASE flow_id % 5 WHEN 0 THEN 'dns' WHEN 1 THEN 'alert' WHEN 2 THEN 'netflow' ELSE 'flow' END AS event_type,
        CASE WHEN flow_id % 31 <> 0 THEN src_ip END AS src_ip,
        CASE WHEN flow_id % 37 <> 0 THEN CAST(1024 + flow_id % 5000 AS INT) END AS src_port,
        dst_ip AS dest_ip, dst_port AS dest_port,
        CASE protocol WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' END AS proto,
        CASE WHEN flow_id % 19 <> 0 THEN flow_duration / 1e6 END AS age,
        CASE WHEN flow_id % 23 <> 0 THEN CAST(ack_flag_count AS BIGINT) END AS pkts_toserver,
        CAST(bwd_header_length / 40 AS BIGINT) AS pkts_toclient,
        CAST(ack_flag_count * fwd_packet_length_max AS BIGINT) AS bytes_toserver,
        CASE WHEN flow_id % 29 <> 0 THEN CAST(bwd_header_length AS BIGINT) END AS bytes_toclient,
        CASE WHEN protocol = 6 THEN flow_id % 3 = 0 END AS psh,
        CASE WHEN protocol = 6 AND flow_id % 7 <> 0 THEN flow_id % 2 = 0 END AS ack,
        CASE WHEN protocol = 6 AND flow_id % 5 <> 0 THEN CAST(init_win_bytes_forward AS INT) END AS tcp_window
        FROM flows""",
    "flow_events": "SELECT * FROM ids_events WHERE event_type IN ('flow', 'netflow', 'alert')",
    "event_features": """SELECT flow_id, fp * 40e0 AS fwd_header_length, bp * 40e0 AS bwd_header_length,
        CASE WHEN coalesce(psh, false) THEN 1e0 ELSE 0e0 END AS fwd_psh_flags,
        CASE WHEN coalesce(ack, true) THEN fp ELSE 0e0 END AS ack_flag_count,
        CAST(coalesce(tcp_window, 512) AS DOUBLE) AS init_win_bytes_forward, us AS flow_duration,
        (fp + bp) / (us / 1e6) AS flow_packets_s, (fb + bb) / (us / 1e6) AS flow_bytes_s,
        fb / greatest(1e0, fp) AS fwd_packet_length_max, us / greatest(1e0, fp + bp) AS flow_iat_mean,
        us / greatest(1e0, fp) AS fwd_iat_max,
        CASE WHEN bp > 0 THEN us / greatest(1e0, bp) ELSE 0e0 END AS bwd_iat_min FROM (
        SELECT *, CASE WHEN coalesce(age, 0.037e0) > 0 THEN coalesce(age, 0.037e0) * 1e6 ELSE 1000e0 END AS us,
          CAST(coalesce(pkts_toserver, 1) AS DOUBLE) AS fp, CAST(coalesce(pkts_toclient, 0) AS DOUBLE) AS bp,
          CAST(coalesce(bytes_toserver, 64) AS DOUBLE) AS fb, CAST(coalesce(bytes_toclient, 0) AS DOUBLE) AS bb
        FROM flow_events)""",
    "phi": " UNION ALL ".join(
        f"SELECT '{m}' AS model, flow_id, '{c}' AS feature, {_TURN[c]} * ln(1 + {c}) * {w}e0 AS phi FROM clean"
        for j, c in enumerate(S.GOLDEN12) for m, w in (("baseline", (j + 1) / 100), ("adapted", (12 - j) / 50))),
    "shift": """SELECT b.feature, b.v AS baseline_mean_abs, a.v AS adapted_mean_abs, a.v - b.v AS shift_delta FROM
        (SELECT feature, avg(abs(phi)) AS v FROM phi WHERE model = 'baseline' GROUP BY feature) b
        JOIN (SELECT feature, avg(abs(phi)) AS v FROM phi WHERE model = 'adapted' GROUP BY feature) a USING (feature)""",
    "split": """SELECT *, CASE WHEN rn <= (n * 800 + 500) // 1000 THEN 'train'
          WHEN rn <= (n * 900 + 500) // 1000 THEN 'val' ELSE 'test' END AS split FROM (
        SELECT flow_id, unified_label, row_number() OVER (PARTITION BY unified_label
            ORDER BY md5(concat_ws('|', CAST(flow_id AS VARCHAR), '42')), flow_id) AS rn,
          count(*) OVER (PARTITION BY unified_label) AS n FROM clean)""",
    "sessions": """SELECT *, CAST(sum(CASE WHEN gap_sec > 60 THEN 1 ELSE 0 END)
          OVER (ORDER BY start_ts, log_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM (
        SELECT *, (epoch_us(start_ts) - epoch_us(lag(end_ts) OVER (ORDER BY start_ts, log_id))) / 1e6 AS gap_sec
        FROM attack_log)""",
}

_USES: dict[str, list[str]] = {
    "files": ["flows"], "keyed": ["flows"], "mapped": ["keyed", "label_dim"], "labelled": ["mapped"],
    "clean": ["labelled"], "windowed": ["clean"], "attack_log": ["labelled"], "requests": ["packets"],
    "outside": ["requests"], "inside": ["requests"], "matched": ["outside", "inside"], "configs": ["labelled"],
    "scores": ["flows"], "decided": ["scores"], "ids_events": ["flows"], "flow_events": ["ids_events"],
    "event_features": ["flow_events"], "phi": ["clean"], "shift": ["phi"], "split": ["clean"],
    "sessions": ["attack_log"],
}


def with_views(query: str, *names: str) -> str:
    """``query`` with the named views and all they rest on as common table expressions."""
    order: list[str] = []

    def add(n: str) -> None:
        for u in _USES.get(n, []):
            add(u)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in order) + "\n" + query
