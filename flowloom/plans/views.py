"""Flow-shaped views over the test tables, in Spark and in SQL.

Each builder has a SQL twin of the same name in `CTE`; the twins are prefixed to the
oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import net
from flowloom.schema import FLOW_FIELDS
from flowloom.session import cut_lineage, prepare

WINDOWS = {"CR": 604800, "PR": 7200, "DHR": 86400, "SHR": 259200}
SEED = 20260525
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; one that is too small to split is dealt out to all cores.

    The test files are single row groups, which one task would read and then parse alone.
    A table of many files or row groups is left as it is.
    """
    found = scan(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if found.rdd.getNumPartitions() < cores else found


def ip_of(n: Column) -> Column:
    head = F.when(n % 10 == 9, "200.").otherwise("10.")
    return F.concat(head, F.lit("0."), F.floor(n / 256).cast("string"), F.lit("."), (n % 256).cast("string"))


def epoch_of(ts: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        "event_type",
        "value",
        epoch_of("ts").alias("epoch"),
    )


def _as_flows(events: DataFrame) -> DataFrame:
    n = F.col("event_id")
    src_port = F.lit(1024).cast("bigint") + n % 3
    dst_port = F.lit(1024).cast("bigint") + F.floor(n / 3) % 3
    fields = {
        "record_id": F.format_string("rec_%010d", n + 1),
        "flow_id": F.concat(F.lit("f"), (n % 997).cast("string")),
        "src_ip": ip_of(F.col("user_id")),
        "src_port": src_port,
        "dst_ip": ip_of(F.col("k")),
        "dst_port": dst_port,
        "src_endpoint": net.endpoint_id(ip_of(F.col("user_id")), src_port),
        "dst_endpoint": net.endpoint_id(ip_of(F.col("k")), dst_port),
        "protocol": F.when(n % 2 == 0, F.lit(6)).otherwise(F.lit(17)).cast("bigint"),
        "timestamp": F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd HH:mm:ss"),
        "timestamp_epoch": F.col("epoch"),
        "duration": F.col("value"),
        "fwd_packets": n % 11,
        "bwd_packets": n % 7,
        "fwd_bytes": F.floor(F.col("value") * 10),
        "bwd_bytes": F.floor(F.col("value") * 3),
        "l7_protocol": F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")).cast("bigint"),
        "protocol_name": F.col("event_type"),
        "label": F.col("event_type"),
    }
    return events.select(*[fields[name].alias(name) for name in FLOW_FIELDS])


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow per event."""
    return _as_flows(_events(spark, sf_dir))


def stored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows as a stored table, for queries that scan them many times."""
    return cut_lineage(flows(spark, sf_dir))


def dense_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with addresses folded onto ten hosts: many flows per edge."""
    folded = _events(spark, sf_dir).withColumn("user_id", F.col("user_id") % 10).withColumn("k", F.col("k") % 10)
    return _as_flows(folded)


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows as a raw CSV would show them: text, raw names, some damaged cells.

    Stored, as a CSV would be: parsing must not repeat the work that made the text.
    """
    base = flows(spark, sf_dir).withColumn("n", F.substring("record_id", 5, 20).cast("bigint") - 1)
    stamp = F.date_format(F.timestamp_seconds("timestamp_epoch"), "dd/MM/yyyyHH:mm:ss")
    raw = base.select(
        F.col("flow_id").alias("Flow.ID"),
        F.col("src_ip").alias("Source.IP"),
        F.when(F.col("n") % 50 == 0, "").otherwise(F.col("src_port").cast("string")).alias("Source.Port"),
        F.col("dst_ip").alias("Destination.IP"),
        F.col("dst_port").cast("string").alias("Destination.Port"),
        F.col("protocol").cast("string").alias("Protocol"),
        F.when(F.col("n") % 90 == 0, "junk").otherwise(stamp).alias("Timestamp"),
        F.when(F.col("n") % 70 == 0, "x").otherwise(F.col("duration").cast("string")).alias("Flow.Duration"),
        F.col("fwd_packets").cast("string").alias("Total.Fwd.Packets"),
        F.concat(F.col("bwd_packets").cast("string"), F.lit(".7")).alias("Total.Backward.Packets"),
        F.col("fwd_bytes").cast("string").alias("Total.Length.of.Fwd.Packets"),
        F.col("bwd_bytes").cast("string").alias("Total.Length.of.Bwd.Packets"),
        F.lit("n/a").alias("Comment"),
        F.col("label").alias("Label"),
        F.col("l7_protocol").cast("string").alias("L7Protocol"),
        F.col("protocol_name").alias("ProtocolName"),
        (F.col("n") + 1).alias("row_number"),
    )
    return cut_lineage(raw)


def endpoint_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """endpoint_id, vid, emb.  Four vectors per host and three ports, so some hosts have none."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        net.endpoint_id(ip_of(F.floor(v / 4)), F.lit(1024).cast("bigint") + v % 4).alias("endpoint_id"),
        v.alias("vid"),
        F.col("embedding").alias("emb"),
        F.col("label").cast("bigint").alias("label"),
    )


def flow_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, vid, emb for the flows whose event has a vector."""
    return table(spark, sf_dir, "embeddings").select(
        F.format_string("rec_%010d", F.col("vec_id") + 1).alias("record_id"),
        F.col("vec_id").alias("vid"),
        F.col("embedding").alias("emb"),
    )


def order_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as flows from customer hosts to supplier hosts (the large benchmark input)."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    port = F.lit(1024).cast("bigint") + F.col("l_linenumber")
    fields = {
        "src_ip": ip_of(F.col("o_custkey")),
        "src_port": port,
        "dst_ip": ip_of(F.col("l_suppkey")),
        "dst_port": F.lit(443).cast("bigint"),
        "src_endpoint": net.endpoint_id(ip_of(F.col("o_custkey")), port),
        "dst_endpoint": net.endpoint_id(ip_of(F.col("l_suppkey")), F.lit(443)),
        "protocol": F.col("l_linenumber").cast("bigint"),
        "timestamp_epoch": epoch_of("l_shipdate"),
        "duration": F.col("l_extendedprice"),
        "fwd_packets": F.col("l_quantity").cast("bigint"),
        "bwd_packets": F.col("l_linenumber").cast("bigint"),
        "fwd_bytes": F.col("l_extendedprice").cast("bigint"),
        "bwd_bytes": F.col("l_quantity").cast("bigint"),
        "protocol_name": F.col("l_returnflag"),
    }
    out = lines.select(*[c.alias(name) for name, c in fields.items()])
    return out.withColumn("timestamp", F.date_format(F.timestamp_seconds("timestamp_epoch"), "yyyy-MM-dd HH:mm:ss"))


def _sql_ip(n: str) -> str:
    return f"(CASE WHEN {n} % 10 = 9 THEN '200.' ELSE '10.' END || '0.' || ({n} // 256) || '.' || ({n} % 256))"


def _sql_flows(name: str, user: str, k: str) -> str:
    return f"""{name} AS (
  SELECT *, src_ip || ':' || src_port AS src_endpoint, dst_ip || ':' || dst_port AS dst_endpoint FROM (
    SELECT 'rec_' || lpad((event_id + 1)::VARCHAR, 10, '0') AS record_id, 'f' || (event_id % 997) AS flow_id,
      {_sql_ip(user)} AS src_ip, 1024 + event_id % 3 AS src_port,
      {_sql_ip(k)} AS dst_ip, 1024 + (event_id // 3) % 3 AS dst_port,
      CASE WHEN event_id % 2 = 0 THEN 6 ELSE 17 END::BIGINT AS protocol,
      strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS timestamp,
      (epoch_us(ts) // 1000000)::BIGINT AS timestamp_epoch, value AS duration,
      event_id % 11 AS fwd_packets, event_id % 7 AS bwd_packets,
      floor(value * 10)::BIGINT AS fwd_bytes, floor(value * 3)::BIGINT AS bwd_bytes,
      (list_position(['click','error','purchase','signup','view'], event_type))::BIGINT AS l7_protocol,
      event_type AS protocol_name, event_type AS label
    FROM (SELECT *, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events)))"""


CTE = {
    "flows": _sql_flows("flows", "user_id", "k"),
    "dense": _sql_flows("dense", "(user_id % 10)", "(k % 10)"),
    "endpoint_vectors": f"""endpoint_vectors AS (
  SELECT {_sql_ip("(vec_id // 4)")} || ':' || (1024 + vec_id % 4) AS endpoint_id, vec_id AS vid, embedding AS emb,
    label::BIGINT AS label FROM embeddings)""",
    "flow_vectors": """flow_vectors AS (
  SELECT 'rec_' || lpad((vec_id + 1)::VARCHAR, 10, '0') AS record_id, vec_id AS vid, embedding AS emb FROM embeddings)""",
}


def with_ctes(names: list[str], body: str, *extra: str) -> str:
    parts = [CTE[n] for n in names] + list(extra)
    return "WITH " + ",\n".join(parts) + "\n" + body
