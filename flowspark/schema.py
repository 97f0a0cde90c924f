"""Schemas, column order and header aliases."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The 85 flow columns in file order.
# "Fwd Header Length" stands twice in a file; internally the second one is
# called "Fwd Header Length.1".
# ---------------------------------------------------------------------------
FLOW_FILE_HEADER = [
    "Flow ID", "Source IP", "Source Port", "Destination IP", "Destination Port",
    "Protocol", "Timestamp", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets",
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s", "Bwd Packets/s",
    "Min Packet Length", "Max Packet Length", "Packet Length Mean", "Packet Length Std",
    "Packet Length Variance",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count",
    "ACK Flag Count", "URG Flag Count", "CWE Flag Count", "ECE Flag Count",
    "Down/Up Ratio", "Average Packet Size", "Avg Fwd Segment Size", "Avg Bwd Segment Size",
    "Fwd Header Length",
    "Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk", "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate",
    "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "Init_Win_bytes_forward", "Init_Win_bytes_backward", "act_data_pkt_fwd", "min_seg_size_forward",
    "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
    "Label",
]

# Columns that stay text.
STRING_COLUMNS = ["Flow ID", "Source IP", "Destination IP", "Timestamp"]
LABEL = "Label"
LABEL_BINARY = "LabelBinary"


def _unique(names):
    """Number a repeated name the way the internal schema does (second one gets `.1`)."""
    seen, out = {}, []
    for name in names:
        k = seen.get(name, 0)
        out.append(name if k == 0 else f"{name}.{k}")
        seen[name] = k + 1
    return out


FLOW_COLUMNS = _unique(FLOW_FILE_HEADER)
NUMERIC_FEATURES = [c for c in FLOW_COLUMNS if c not in STRING_COLUMNS and c != LABEL]

# ---------------------------------------------------------------------------
# Header aliases (normalised spelling -> canonical column).
# ---------------------------------------------------------------------------
HEADER_ALIASES = {
    "srcip": "Source IP",
    "saddr": "Source IP",
    "dstip": "Destination IP",
    "daddr": "Destination IP",
    "sport": "Source Port",
    "srcport": "Source Port",
    "spt": "Source Port",
    "dsport": "Destination Port",
    "dport": "Destination Port",
    "proto": "Protocol",
    "protocol": "Protocol",
    "dur": "Flow Duration",
    "duration": "Flow Duration",
    "flowduration": "Flow Duration",
    "spkts": "Total Fwd Packets",
    "dpkts": "Total Backward Packets",
    "sbytes": "Total Length of Fwd Packets",
    "dbytes": "Total Length of Bwd Packets",
}

PACKET_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("packet_index", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("total_length", T.IntegerType()),
    T.StructField("header_length", T.IntegerType()),
    T.StructField("payload_length", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("tcp_window", T.IntegerType()),
    T.StructField("has_payload", T.BooleanType()),
    T.StructField("frame_length", T.IntegerType()),
])

FLOW_SCHEMA = T.StructType([
    T.StructField(c, T.StringType() if c in STRING_COLUMNS or c == LABEL else T.DoubleType())
    for c in FLOW_COLUMNS
])

SUMMARY_COLUMNS = [
    "pcap_file", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flow_duration",
    "total_fwd_pkts", "total_bwd_pkts", "total_len_fwd_pkts", "total_len_bwd_pkts",
    "flow_byts_per_s", "flow_pkts_per_s",
]

EXTRACTION_SCHEMA = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("path", T.StringType()),
    T.StructField("flows", T.ArrayType(FLOW_SCHEMA)),
    T.StructField("packet_stats", T.MapType(T.StringType(), T.LongType())),
    T.StructField("warnings", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
    T.StructField("label", T.IntegerType()),
])

ANNOTATION_SCHEMA = T.StructType([
    T.StructField("flow_key", T.StringType()),
    T.StructField("label", T.DoubleType()),
    T.StructField("annotator", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])

REGISTRY_SCHEMA = T.StructType([
    T.StructField("model_id", T.StringType()),
    T.StructField("trained_at", T.TimestampType()),
    T.StructField("model_path", T.StringType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("label_map", T.MapType(T.IntegerType(), T.StringType())),
    T.StructField("positive_index", T.IntegerType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("weight_metric", T.StringType()),
    T.StructField("samples", T.LongType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("quantiles", T.MapType(T.DoubleType(), T.DoubleType())),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("top_percent", T.DoubleType()),
    T.StructField("rule_profile", T.StringType()),
    T.StructField("reset", T.BooleanType()),
])
