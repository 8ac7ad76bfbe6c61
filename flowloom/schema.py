"""Column lists and fixed constants of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Relation precedence, a pair of flows keeps the smallest.
RELATION_PRIORITY = {"CR": 1, "PR": 2, "DHR": 3, "SHR": 4}
# Seconds of each relation's window, and of one that is not named.
DEFAULT_WINDOWS = {"CR": 5, "PR": 1, "DHR": 1, "SHR": 5}
FALLBACK_WINDOW = 60

# Flow columns and types.
FLOW_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("flow_id", T.StringType()),
        T.StructField("src_endpoint", T.StringType()),
        T.StructField("dst_endpoint", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("src_port", T.LongType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("dst_port", T.LongType()),
        T.StructField("protocol", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("timestamp_epoch", T.LongType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("fwd_packets", T.LongType()),
        T.StructField("bwd_packets", T.LongType()),
        T.StructField("fwd_bytes", T.LongType()),
        T.StructField("bwd_bytes", T.LongType()),
        T.StructField("l7_protocol", T.LongType()),
        T.StructField("protocol_name", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)
FLOW_FIELDS = FLOW_SCHEMA.fieldNames()

# Column names.
ENDPOINT_FIELDS = [
    "endpoint_id",
    "ip",
    "port",
    "is_private_ip",
    "port_bucket",
    "is_common_service_port",
    "is_proxy_port",
]

# Column names.
COMMUNICATES_FIELDS = [
    "edge_id",
    "src_endpoint",
    "dst_endpoint",
    "source_id",
    "target_id",
    "flow_count",
    "first_seen_epoch",
    "last_seen_epoch",
    "first_seen",
    "last_seen",
    "total_fwd_packets",
    "total_bwd_packets",
    "total_packets",
    "total_fwd_bytes",
    "total_bwd_bytes",
    "total_bytes",
    "avg_duration",
    "min_duration",
    "max_duration",
    "protocol_set",
    "protocol_name_set",
    "major_protocol",
    "major_protocol_name",
    "protocol_entropy",
    "l7_protocol_entropy",
]

# Column names.
CAUSES_FIELDS = [
    "relation_id",
    "src_record_id",
    "dst_record_id",
    "source_id",
    "target_id",
    "relation_type",
    "relation_priority",
    "delta_seconds",
    "same_timestamp",
]

# Columns that would leak the target into a raw feature table.
LEAKAGE_COLUMNS = [
    "Flow.ID",
    "record_id",
    "src_endpoint",
    "dst_endpoint",
    "Source.IP",
    "Destination.IP",
    "Timestamp",
    "Label",
    "L7Protocol",
    "ProtocolName",
]
# Columns that every feature table starts with.
FEATURE_META = ["record_id", "target", "split", "src_endpoint", "dst_endpoint"]
