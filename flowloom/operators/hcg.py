"""Host communication graph: endpoints and one aggregated edge per ordered endpoint pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import hashing, net, text
from flowloom.schema import COMMUNICATES_FIELDS, ENDPOINT_FIELDS

PAIR = ["src_endpoint", "dst_endpoint"]


def endpoints(flows: DataFrame) -> DataFrame:
    """Distinct endpoints of both sides with their address and port attributes.

    Distinct runs on (ip, port) before the attributes are computed.
    """
    sides = [flows.select(F.col(f"{s}_ip").alias("ip"), F.col(f"{s}_port").alias("port")) for s in ("src", "dst")]
    ip, port = F.col("ip"), F.col("port")
    fields = {
        "endpoint_id": net.endpoint_id(ip, port),
        "ip": ip,
        "port": port,
        "is_private_ip": net.is_private_ip(ip),
        "port_bucket": net.port_bucket(port),
        "is_common_service_port": net.is_common_service_port(port),
        "is_proxy_port": net.is_proxy_port(port),
    }
    return sides[0].union(sides[1]).distinct().select(*[fields[f].alias(f) for f in ENDPOINT_FIELDS])


def edge_protocols(flows: DataFrame) -> DataFrame:
    """Flow count per edge, protocol and protocol name."""
    return flows.groupBy(*PAIR, "protocol", "protocol_name").agg(F.count(F.lit(1)).alias("n"))


def _counter(hist: Column, field: str, usable=None) -> Column:
    """Array of (n, value): the joint histogram summed over one of its fields."""
    items = F.filter(hist, usable) if usable is not None else hist
    values = F.array_sort(F.array_distinct(F.transform(items, lambda h: h[field])))

    def total(value: Column) -> Column:
        same = F.filter(items, lambda h: h[field] == value)
        return F.aggregate(same, F.lit(0).cast("bigint"), lambda acc, h: acc + h["n"])

    return F.transform(values, lambda v: F.struct(total(v).alias("n"), v.alias("value")))


def _entropy(counter: Column) -> Column:
    total = F.aggregate(counter, F.lit(0).cast("bigint"), lambda acc, c: acc + c["n"])
    terms = F.transform(counter, lambda c: (c["n"] / total) * F.log2(c["n"] / total))
    return F.when(F.size(counter) == 0, F.lit(0.0)).otherwise(
        F.lit(0.0) - F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    )


def _mode(counter: Column) -> Column:
    """Most frequent value; a tie goes to the smallest text form, so 17 beats 6."""
    ranked = F.transform(
        counter, lambda c: F.struct((-c["n"]).alias("n"), c["value"].cast("string").alias("text"), c["value"])
    )
    return F.array_min(ranked)["value"]


def edges(flows: DataFrame) -> DataFrame:
    """COMMUNICATES edges with the 25 fixed fields.

    Two aggregations: first by edge and protocol (numeric buffers only, combined map-side,
    so a pair that owns a third of all flows is already small when it is shuffled), then
    by edge.  The list collected per edge has one item per distinct (protocol, protocol
    name), which the protocol number space bounds.

    Epoch 0 is an unknown time.  An edge without any known time keeps one of its original
    time texts; those come from the few unknown rows alone and join without moving the edges.
    """
    known = F.when(F.col("timestamp_epoch") != 0, F.col("timestamp_epoch"))
    by_protocol = flows.groupBy(*PAIR, "protocol", "protocol_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(known).alias("first_seen_epoch"),
        F.max(known).alias("last_seen_epoch"),
        *[F.sum(c).alias(c) for c in ("fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes")],
        F.sum("duration").alias("duration_sum"),
        F.min("duration").alias("duration_min"),
        F.max("duration").alias("duration_max"),
    )
    merged = by_protocol.groupBy(*PAIR).agg(
        F.sum("n").alias("flow_count"),
        F.coalesce(F.min("first_seen_epoch"), F.lit(0).cast("bigint")).alias("first_seen_epoch"),
        F.coalesce(F.max("last_seen_epoch"), F.lit(0).cast("bigint")).alias("last_seen_epoch"),
        F.sum("fwd_packets").alias("total_fwd_packets"),
        F.sum("bwd_packets").alias("total_bwd_packets"),
        F.sum("fwd_bytes").alias("total_fwd_bytes"),
        F.sum("bwd_bytes").alias("total_bwd_bytes"),
        F.sum("duration_sum").alias("duration_sum"),
        F.min("duration_min").alias("min_duration"),
        F.max("duration_max").alias("max_duration"),
        F.collect_list(F.struct("protocol", "protocol_name", "n")).alias("hist"),
    )
    unknown = flows.filter("timestamp_epoch = 0").groupBy(*PAIR).agg(F.min("timestamp").alias("unknown_text"))
    counted = (
        merged.join(unknown, PAIR, "left")
        .withColumn("protocols", _counter(F.col("hist"), "protocol"))
        .withColumn(
            "names", _counter(F.col("hist"), "protocol_name", lambda h: F.coalesce(h["protocol_name"], F.lit("")) != "")
        )
    )
    src, dst = F.col("src_endpoint"), F.col("dst_endpoint")
    protocols, names = F.col("protocols"), F.col("names")

    def joined(counter: Column) -> Column:
        return F.array_join(F.transform(counter, lambda c: c["value"].cast("string")), ",")

    def seen(epoch: str) -> Column:
        return F.when(F.col(epoch) == 0, F.col("unknown_text")).otherwise(text.epoch_text(F.col(epoch)))

    derived = {
        "edge_id": hashing.edge_hash(src, dst, F.lit("COMMUNICATES")),
        "source_id": src,
        "target_id": dst,
        "first_seen": seen("first_seen_epoch"),
        "last_seen": seen("last_seen_epoch"),
        "total_packets": F.col("total_fwd_packets") + F.col("total_bwd_packets"),
        "total_bytes": F.col("total_fwd_bytes") + F.col("total_bwd_bytes"),
        "avg_duration": F.col("duration_sum") / F.col("flow_count"),
        "protocol_set": joined(protocols),
        "protocol_name_set": joined(names),
        "major_protocol": _mode(protocols),
        "major_protocol_name": F.coalesce(_mode(names), F.lit("")),
        "protocol_entropy": _entropy(protocols),
        "l7_protocol_entropy": _entropy(names),
    }
    return counted.select(*[derived[f].alias(f) if f in derived else F.col(f) for f in COMMUNICATES_FIELDS])
