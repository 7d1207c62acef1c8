"""Declared schemas and the fixed values of the flow data model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: feature names, classes, label keys, column renames -------

# Canonical long name of each of the twelve model features, in model order.
GOLDEN12_LONG = [
    "Fwd Header Length",
    "Bwd Header Length",
    "Fwd PSH Flags",
    "ACK Flag Count",
    "Init_Win_bytes_forward",
    "Flow Duration",
    "Flow Packets/s",
    "Flow Bytes/s",
    "Fwd Packet Length Max",
    "Flow IAT Mean",
    "Fwd IAT Max",
    "Bwd IAT Min",
]

# The same twelve in the column spelling used inside the engine.
GOLDEN12 = [
    "fwd_header_length",
    "bwd_header_length",
    "fwd_psh_flags",
    "ack_flag_count",
    "init_win_bytes_forward",
    "flow_duration",
    "flow_packets_s",
    "flow_bytes_s",
    "fwd_packet_length_max",
    "flow_iat_mean",
    "fwd_iat_max",
    "bwd_iat_min",
]

# Live-capture column of each of the twelve.
LIVE_FEATURES = [
    "fwd_header_len",
    "bwd_header_len",
    "fwd_psh_flags",
    "ack_flag_cnt",
    "init_fwd_win_byts",
    "flow_duration",
    "flow_pkts_s",
    "flow_byts_s",
    "fwd_pkt_len_max",
    "flow_iat_mean",
    "fwd_iat_max",
    "bwd_iat_min",
]

RATE_COLUMNS = ["flow_packets_s", "flow_bytes_s"]
TIME_COLUMNS = ["flow_duration", "flow_iat_mean", "fwd_iat_max", "bwd_iat_min"]

# Class name -> code. One order for training, scoring and reports.
CLASS_CODES = {
    "BENIGN": 0,
    "DoS_DDoS": 1,
    "BRUTE_FORCE": 2,
    "INFILTRATION": 3,
    "BOTNET": 4,
    "WEB_ATTACK": 5,
}
CLASSES = list(CLASS_CODES)
BENIGN = "BENIGN"
DOS = "DoS_DDoS"

# Key of a header row that was repeated inside the data.
HEADER_KEY = "label"

# Normalised label key -> class, per corpus year.
LABEL_MAP = {
    2017: {
        "benign": "BENIGN",
        "dos hulk": "DoS_DDoS",
        "dos goldeneye": "DoS_DDoS",
        "dos slowloris": "DoS_DDoS",
        "dos slowhttptest": "DoS_DDoS",
        "ddos": "DoS_DDoS",
        "heartbleed": "DoS_DDoS",
        "ftp patator": "BRUTE_FORCE",
        "ssh patator": "BRUTE_FORCE",
        "web attack brute force": "WEB_ATTACK",
        "web attack xss": "WEB_ATTACK",
        "web attack sql injection": "WEB_ATTACK",
        "bot": "BOTNET",
        "infiltration": "INFILTRATION",
        "portscan": "INFILTRATION",
    },
    2018: {
        "benign": "BENIGN",
        "dos attacks hulk": "DoS_DDoS",
        "dos attacks goldeneye": "DoS_DDoS",
        "dos attacks slowloris": "DoS_DDoS",
        "dos attacks slowhttptest": "DoS_DDoS",
        "ddos attacks loic http": "DoS_DDoS",
        "ddos attack hoic": "DoS_DDoS",
        "ddos attack loic udp": "DoS_DDoS",
        "ftp bruteforce": "BRUTE_FORCE",
        "ssh bruteforce": "BRUTE_FORCE",
        "brute force web": "WEB_ATTACK",
        "brute force xss": "WEB_ATTACK",
        "sql injection": "WEB_ATTACK",
        "bot": "BOTNET",
        "infilteration": "INFILTRATION",
    },
}
ENCODINGS = {2017: "ISO-8859-1", 2018: "US-ASCII"}

# Short (2018) column name -> long (2017) column name.
SHORT_TO_LONG = {
    "ACK Flag Cnt": "ACK Flag Count",
    "Bwd Blk Rate Avg": "Bwd Avg Bulk Rate",
    "Bwd Byts/b Avg": "Bwd Avg Bytes/Bulk",
    "Bwd Header Len": "Bwd Header Length",
    "Bwd IAT Tot": "Bwd IAT Total",
    "Bwd Pkt Len Max": "Bwd Packet Length Max",
    "Bwd Pkt Len Mean": "Bwd Packet Length Mean",
    "Bwd Pkt Len Min": "Bwd Packet Length Min",
    "Bwd Pkt Len Std": "Bwd Packet Length Std",
    "Bwd Pkts/b Avg": "Bwd Avg Packets/Bulk",
    "Bwd Pkts/s": "Bwd Packets/s",
    "Bwd Seg Size Avg": "Avg Bwd Segment Size",
    "Dst Port": "Destination Port",
    "ECE Flag Cnt": "ECE Flag Count",
    "FIN Flag Cnt": "FIN Flag Count",
    "Flow Byts/s": "Flow Bytes/s",
    "Flow Pkts/s": "Flow Packets/s",
    "Fwd Act Data Pkts": "act_data_pkt_fwd",
    "Fwd Blk Rate Avg": "Fwd Avg Bulk Rate",
    "Fwd Byts/b Avg": "Fwd Avg Bytes/Bulk",
    "Fwd Header Len": "Fwd Header Length",
    "Fwd IAT Tot": "Fwd IAT Total",
    "Fwd Pkt Len Max": "Fwd Packet Length Max",
    "Fwd Pkt Len Mean": "Fwd Packet Length Mean",
    "Fwd Pkt Len Min": "Fwd Packet Length Min",
    "Fwd Pkt Len Std": "Fwd Packet Length Std",
    "Fwd Pkts/b Avg": "Fwd Avg Packets/Bulk",
    "Fwd Pkts/s": "Fwd Packets/s",
    "Fwd Seg Size Avg": "Avg Fwd Segment Size",
    "Fwd Seg Size Min": "min_seg_size_forward",
    "Init Bwd Win Byts": "Init_Win_bytes_backward",
    "Init Fwd Win Byts": "Init_Win_bytes_forward",
    "PSH Flag Cnt": "PSH Flag Count",
    "Pkt Len Max": "Max Packet Length",
    "Pkt Len Mean": "Packet Length Mean",
    "Pkt Len Min": "Min Packet Length",
    "Pkt Len Std": "Packet Length Std",
    "Pkt Len Var": "Packet Length Variance",
    "Pkt Size Avg": "Average Packet Size",
    "RST Flag Cnt": "RST Flag Count",
    "SYN Flag Cnt": "SYN Flag Count",
    "Subflow Bwd Byts": "Subflow Bwd Bytes",
    "Subflow Bwd Pkts": "Subflow Bwd Packets",
    "Subflow Fwd Byts": "Subflow Fwd Bytes",
    "Subflow Fwd Pkts": "Subflow Fwd Packets",
    "Tot Bwd Pkts": "Total Backward Packets",
    "Tot Fwd Pkts": "Total Fwd Packets",
    "TotLen Bwd Pkts": "Total Length of Bwd Packets",
    "TotLen Fwd Pkts": "Total Length of Fwd Packets",
    "URG Flag Cnt": "URG Flag Count",
}

# Columns of the short layout that the long layout lacks, the identifier
# columns one short file adds, and the feature the long header lists twice.
ONLY_IN_SHORT = ["Protocol", "Timestamp"]
IDENTIFIERS_IN_ONE_FILE = ["Flow ID", "Src IP", "Src Port", "Dst IP"]
REPEATED_IN_LONG = "Fwd Header Length"

# Severity of a tier-3 class; every other attack class is MEDIUM.
HIGH_SEVERITY = ["BRUTE_FORCE", "BOTNET"]
TIER1 = "Tier 1 (Fast-Path)"
TIER3 = "Tier 3 (Slow-Path)"

# Event kinds that carry flow counters.
FLOW_EVENT_TYPES = ["flow", "netflow", "alert"]

# --- end of fixed values ----------------------------------------------------

_D, _S, _L, _I = T.DoubleType(), T.StringType(), T.LongType(), T.IntegerType()


def _struct(*pairs) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


LIVE_FLOW = _struct(
    ("timestamp", _S), ("src_ip", _S), ("dst_ip", _S), ("dst_port", _I),
    *[(c, _D) for c in LIVE_FEATURES],
)

ATTACK_LOG = _struct(
    ("timestamp_start", _S), ("timestamp_end", _S), ("class_label", _S), ("src_ip", _S),
    ("dst_ip", _S), ("dst_port", _I), ("tool", _S), ("detail", _S),
)

IDS_EVENT = _struct(
    ("event_type", _S), ("timestamp", _S), ("src_ip", _S), ("src_port", _I), ("dest_ip", _S),
    ("dest_port", _I), ("proto", _S),
    ("flow", _struct(("age", _D), ("pkts_toserver", _L), ("pkts_toclient", _L),
                     ("bytes_toserver", _L), ("bytes_toclient", _L))),
    ("tcp", _struct(("psh", T.BooleanType()), ("ack", T.BooleanType()), ("window", _I))),
)

PACKET = _struct(("point", _S), ("icmp_type", _I), ("icmp_id", _L), ("icmp_seq", _L), ("ts", _D))


def long_layout(columns: list[str]) -> T.StructType:
    """Schema of a raw file of the long layout: doubles plus a string label."""
    return _struct(*[(c, _S if c.strip() in ("Label", "Timestamp", "Flow ID", "Src IP", "Dst IP") else _D)
                     for c in columns])
