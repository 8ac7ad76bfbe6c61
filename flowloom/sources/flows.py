"""Flow record sources: raw CSV, normalised parquet, feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions import hashing, net, text
from flowloom.schema import FLOW_FIELDS, FLOW_SCHEMA

ROW_NUMBER = "row_number"

# Names a flow field may have, in order of preference.
ALIASES = {
    "src_ip": ("src_ip", "Source.IP"),
    "dst_ip": ("dst_ip", "Destination.IP"),
    "src_port": ("src_port", "Source.Port"),
    "dst_port": ("dst_port", "Destination.Port"),
    "flow_id": ("flow_id", "Flow.ID"),
    "protocol": ("protocol", "Protocol"),
    "timestamp": ("timestamp", "Timestamp"),
    "duration": ("duration", "Flow.Duration"),
    "fwd_packets": ("fwd_packets", "Total.Fwd.Packets"),
    "bwd_packets": ("bwd_packets", "Total.Backward.Packets"),
    "fwd_bytes": ("fwd_bytes", "Total.Length.of.Fwd.Packets"),
    "bwd_bytes": ("bwd_bytes", "Total.Length.of.Bwd.Packets"),
    "l7_protocol": ("l7_protocol", "L7Protocol"),
    "protocol_name": ("protocol_name", "ProtocolName"),
    "label": ("label", "Label"),
}


def read_flows_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Every column as text under its header name; bytes that are not UTF-8 are replaced.

    Types are never inferred: that would read 100 TB twice, and a later file could
    disagree.  The header is taken from the first file.  A quote within a field is doubled.
    Fields with line breaks need `multi_line`, which reads each file in one task.
    """
    header = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path).columns
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    return spark.read.csv(path, schema=schema, header=True, encoding="UTF-8", mode="PERMISSIVE", escape='"', multiLine=multi_line).na.fill("")


def read_flows_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Flows that were normalised before; only `columns` are scanned when given."""
    flows = spark.read.schema(FLOW_SCHEMA).parquet(path)
    return flows.select(*columns) if columns else flows


def with_file_row_number(df: DataFrame) -> DataFrame:
    """Add the 1-based `row_number` of each row in file order (path, then position).

    `df` must be a plain file scan.  Rows get their position in their file split,
    splits get an offset from one aggregate over (file, split start): the only
    ordered step is a running sum over one row per split.
    """
    split = ["_fl_file", "_fl_start"]
    tagged = df.select(
        "*",
        F.col("_metadata.file_path").alias("_fl_file"),
        F.col("_metadata.file_block_start").alias("_fl_start"),
        F.monotonically_increasing_id().alias("_fl_pos"),
    )
    return _numbered(tagged, split).drop(*split)


def with_order_row_number(df: DataFrame, *order: str | Column, partitions: int | None = None) -> DataFrame:
    """Add the 1-based `row_number` over a total order, without a one-task sort.

    Range partitioning sorts in parallel; the result is checkpointed so that a lost
    executor cannot move the range borders between the count and the numbering.
    """
    from flowloom.session import cut_lineage

    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_fl_part", F.spark_partition_id())
        .withColumn("_fl_pos", F.monotonically_increasing_id())
    )
    return _numbered(cut_lineage(ranged), ["_fl_part"]).drop("_fl_part")


def _numbered(tagged: DataFrame, chunk: list[str]) -> DataFrame:
    from pyspark.sql import Window

    # One row per file split or partition, so this running sum stays small.
    offsets = (
        tagged.groupBy(*chunk)
        .agg(F.min("_fl_pos").alias("_fl_first"), F.count(F.lit(1)).alias("_fl_n"))
        .withColumn("_fl_before", F.sum("_fl_n").over(Window.orderBy(*chunk)) - F.col("_fl_n"))
        .select(*chunk, "_fl_first", "_fl_before")
    )
    numbered = tagged.join(offsets, chunk)
    position = F.col("_fl_before") + F.col("_fl_pos") - F.col("_fl_first") + 1
    return numbered.withColumn(ROW_NUMBER, position).drop("_fl_pos", "_fl_first", "_fl_before")


def first_rows(numbered: DataFrame, n: int | None) -> DataFrame:
    """The first n rows in file order (a smoke run); all rows for None."""
    return numbered if n is None else numbered.filter(F.col(ROW_NUMBER) <= n)


def _field(df: DataFrame, *names: str) -> Column:
    present = [F.col(f"`{name}`").cast("string") for name in names if name in df.columns]
    return text.first_present(*present) if present else F.lit("")


def normalize_endpoints(df: DataFrame) -> dict[str, Column]:
    """ip, port and endpoint of both sides, from separate columns or a packed endpoint."""
    sides: dict[str, Column] = {}
    for side in ("src", "dst"):
        ip = _field(df, *ALIASES[f"{side}_ip"])
        port_text = _field(df, *ALIASES[f"{side}_port"])
        port = text.parse_int(port_text)
        if f"{side}_endpoint" in df.columns:
            packed = _field(df, f"{side}_endpoint")
            use_packed = ((ip == "") | (port_text == "")) & (packed != "")
            port = F.when(use_packed, net.endpoint_port(packed)).otherwise(port)
            ip = F.when(use_packed, net.endpoint_ip(packed)).otherwise(ip)
        sides[f"{side}_ip"] = ip
        sides[f"{side}_port"] = port
        sides[f"{side}_endpoint"] = net.endpoint_id(ip, port)
    return sides


def normalize_flows(df: DataFrame) -> DataFrame:
    """Raw or half-normalised rows to the 19 flow fields.

    A row without `record_id` is named after its `row_number`, so give such input
    through `with_file_row_number` first and store the result.
    """
    sides = normalize_endpoints(df)
    iso, epoch = text.parse_timestamp(_field(df, *ALIASES["timestamp"]))
    if ROW_NUMBER in df.columns:
        record_id = hashing.stable_record_id(_field(df, "record_id"), F.col(ROW_NUMBER))
    else:
        record_id = _field(df, "record_id")
    whole = {
        name: text.parse_int(_field(df, *ALIASES[name]))
        for name in ("protocol", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "l7_protocol")
    }
    fields = {
        "record_id": record_id,
        "flow_id": _field(df, *ALIASES["flow_id"]),
        **sides,
        **whole,
        "timestamp": iso,
        "timestamp_epoch": epoch,
        "duration": text.parse_float(_field(df, *ALIASES["duration"])),
        "protocol_name": _field(df, *ALIASES["protocol_name"]),
        "label": _field(df, *ALIASES["label"]),
    }
    return df.select(*[fields[name].alias(name) for name in FLOW_FIELDS])


def with_graph_protocol_names(flows: DataFrame) -> DataFrame:
    """Flows as the endpoint graph counts them: one without a protocol name goes by its l7 number."""
    name = F.coalesce(F.nullif("protocol_name", F.lit("")), F.col("l7_protocol").cast("string"), F.lit(""))
    return flows.withColumn("protocol_name", name)


def flows_from_features(features: DataFrame) -> DataFrame:
    """Rebuild normalised flows from a raw feature table."""

    def whole(name: str) -> Column:
        return F.coalesce(F.col(name).try_cast("bigint"), F.lit(0).cast("bigint"))

    epoch = whole("raw_timestamp_epoch")
    src, dst = F.col("src_endpoint"), F.col("dst_endpoint")
    fields = {
        "record_id": F.col("record_id"),
        "flow_id": F.col("record_id"),
        "src_endpoint": src,
        "dst_endpoint": dst,
        "src_ip": net.endpoint_ip(src),
        "src_port": net.endpoint_port(src),
        "dst_ip": net.endpoint_ip(dst),
        "dst_port": net.endpoint_port(dst),
        "protocol": whole("raw_protocol"),
        "timestamp": text.epoch_text(epoch),
        "timestamp_epoch": epoch,
        "duration": F.coalesce(F.col("raw_flow_duration").cast("double"), F.lit(0.0)),
        "fwd_packets": whole("raw_total_fwd_packets"),
        "bwd_packets": whole("raw_total_backward_packets"),
        "fwd_bytes": whole("raw_total_length_of_fwd_packets"),
        "bwd_bytes": whole("raw_total_length_of_bwd_packets"),
        "l7_protocol": F.lit(0).cast("bigint"),
        "protocol_name": F.col("target"),
        "label": F.col("target"),
    }
    return features.select(*[fields[name].alias(name) for name in FLOW_FIELDS])
