"""Queries on parsing, graph construction, size estimates and graph views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import hashing, net, text
from flowloom.operators import estimate, hcg, tcg
from flowloom.plans import views
from flowloom.plans.registry import query
from flowloom.plans.views import SEED, WINDOWS, with_ctes
from flowloom.schema import COMMUNICATES_FIELDS, RELATION_PRIORITY
from flowloom.sources import flows as sources


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- parsing

_PRIVATE_SQL = " OR ".join(
    f"n BETWEEN {low} AND {high}" for low, high in (net._v4_block(c) for c in net.PRIVATE_V4)
)


@query(
    "flow_normalize",
    """WITH raw AS (
  SELECT *, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events),
cells AS (
  SELECT event_id, event_type, 'f' || (event_id % 997) AS flow_id,
    CASE WHEN user_id % 10 = 9 THEN '200.' ELSE '10.' END || '0.' || (user_id // 256) || '.' || (user_id % 256) AS src_ip,
    CASE WHEN event_id % 50 = 0 THEN 0 ELSE 1024 + event_id % 3 END::BIGINT AS src_port,
    CASE WHEN k % 10 = 9 THEN '200.' ELSE '10.' END || '0.' || (k // 256) || '.' || (k % 256) AS dst_ip,
    (1024 + (event_id // 3) % 3)::BIGINT AS dst_port, ts, value FROM raw)
SELECT 'rec_' || lpad((event_id + 1)::VARCHAR, 10, '0') AS record_id, flow_id,
  src_ip || ':' || src_port AS src_endpoint, dst_ip || ':' || dst_port AS dst_endpoint,
  src_ip, src_port, dst_ip, dst_port,
  CASE WHEN event_id % 2 = 0 THEN 6 ELSE 17 END::BIGINT AS protocol,
  CASE WHEN event_id % 90 = 0 THEN 'junk' ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS timestamp,
  CASE WHEN event_id % 90 = 0 THEN 0 ELSE epoch_us(ts) // 1000000 END::BIGINT AS timestamp_epoch,
  CASE WHEN event_id % 70 = 0 THEN 0.0 ELSE value END::DOUBLE AS duration,
  event_id % 11 AS fwd_packets, event_id % 7 AS bwd_packets,
  floor(value * 10)::BIGINT AS fwd_bytes, floor(value * 3)::BIGINT AS bwd_bytes,
  list_position(['click','error','purchase','signup','view'], event_type)::BIGINT AS l7_protocol,
  event_type AS protocol_name, event_type AS label
FROM cells""",
)
def flow_normalize(spark, sf_dir):
    return sources.normalize_flows(views.raw_flows(spark, sf_dir))


@query(
    "endpoint_split",
    with_ctes(
        ["flows"],
        """SELECT DISTINCT src_endpoint AS endpoint, regexp_extract(src_endpoint, '^(.*):([^:]*)$', 1) AS ip,
  regexp_extract(src_endpoint, '^(.*):([^:]*)$', 2)::BIGINT AS port FROM flows""",
    ),
)
def endpoint_split(spark, sf_dir):
    endpoint = F.col("endpoint")
    distinct = views.flows(spark, sf_dir).select(F.col("src_endpoint").alias("endpoint")).distinct()
    return distinct.select(
        endpoint, net.endpoint_ip(endpoint).alias("ip"), net.endpoint_port(endpoint).alias("port")
    )


@query(
    "port_bucket",
    """SELECT bucket, code, common, proxy, count(*) AS n FROM (
  SELECT CASE WHEN p BETWEEN 0 AND 1023 THEN 'well_known' WHEN p BETWEEN 1024 AND 49151 THEN 'registered'
              WHEN p BETWEEN 49152 AND 65535 THEN 'dynamic' ELSE 'invalid' END AS bucket,
         CASE WHEN p BETWEEN 0 AND 1023 THEN 1 WHEN p BETWEEN 1024 AND 49151 THEN 2
              WHEN p BETWEEN 49152 AND 65535 THEN 3 ELSE 0 END::BIGINT AS code,
         p IN (20,21,22,23,25,53,80,110,143,443,993,995,3128,8080) AS common, p IN (3128,8000,8080,8888) AS proxy
  FROM (SELECT (l_orderkey * 7 + l_partkey) % 70000 - 10 AS p FROM lineitem)) GROUP BY ALL""",
)
def port_bucket(spark, sf_dir):
    port = (F.col("l_orderkey") * 7 + F.col("l_partkey")) % 70000 - 10
    ports = views.table(spark, sf_dir, "lineitem").select(port.alias("p"))
    p = F.col("p")
    return ports.groupBy(
        net.port_bucket(p).alias("bucket"),
        net.port_bucket_code(p).cast("bigint").alias("code"),
        net.is_common_service_port(p).alias("common"),
        net.is_proxy_port(p).alias("proxy"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "private_ip",
    f"""SELECT ip, coalesce(({_PRIVATE_SQL}) AND n NOT IN (3221225481, 3221225482), false) AS is_private FROM (
  SELECT DISTINCT a || '.' || b || '.' || c || '.' || d AS ip,
    CASE WHEN a < 256 THEN ((a * 256 + b) * 256 + c) * 256 + d END AS n
  FROM (SELECT l_orderkey % 260 AS a, l_partkey % 256 AS b, l_suppkey % 256 AS c, l_linenumber AS d FROM lineitem))""",
)
def private_ip(spark, sf_dir):
    ip = F.concat_ws(
        ".",
        *[
            c.cast("string")
            for c in (
                F.col("l_orderkey") % 260,
                F.col("l_partkey") % 256,
                F.col("l_suppkey") % 256,
                F.col("l_linenumber"),
            )
        ],
    )
    ips = views.table(spark, sf_dir, "lineitem").select(ip.alias("ip")).distinct()
    return ips.select("ip", net.is_private_ip(F.col("ip")).alias("is_private"))


@query(
    "split_hash",
    with_ctes(
        ["flows"],
        f"""SELECT record_id, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.3 THEN 'valid' ELSE 'train' END AS split FROM (
  SELECT record_id, ('0x' || substr(sha1('{SEED}|' || label || '|' || record_id), 1, 16))::UBIGINT::DOUBLE
    / 18446744073709551616.0 AS u FROM flows)""".replace("0.3 ", "0.2 + 0.1 "),
    ),
)
def split_hash(spark, sf_dir):
    flows = views.flows(spark, sf_dir)
    return flows.select(
        "record_id", hashing.split_of(F.col("record_id"), F.col("label"), SEED).alias("split")
    )


@query(
    "ts_parse",
    """SELECT event_id, CASE WHEN event_id % 90 = 0 THEN 'junk' ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS iso,
  CASE WHEN event_id % 90 = 0 THEN 0 ELSE epoch_us(ts) // 1000000 END::BIGINT AS epoch,
  CASE WHEN event_id % 90 = 0 THEN 0 ELSE date_part('hour', ts) END::BIGINT AS hour,
  CASE WHEN event_id % 90 = 0 THEN 0 ELSE isodow(ts) - 1 END::BIGINT AS weekday FROM events""",
)
def ts_parse(spark, sf_dir):
    raw = views.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 90 == 0, "junk")
        .when(F.col("event_id") % 2 == 0, F.date_format("ts", "dd/MM/yyyyHH:mm:ss"))
        .otherwise(F.date_format("ts", "d/M/yyyy HH:mm:ss"))
        .alias("raw"),
    )
    iso, epoch = text.parse_timestamp(F.col("raw"))
    return raw.select("event_id", iso.alias("iso"), epoch.alias("epoch")).select(
        "*",
        text.hour_of(F.col("epoch")).cast("bigint").alias("hour"),
        text.weekday_of(F.col("epoch")).cast("bigint").alias("weekday"),
    )


@query(
    "record_ids",
    """SELECT event_id, 'rec_' || lpad((row_number() OVER (ORDER BY event_id))::VARCHAR, 10, '0') AS record_id FROM events""",
)
def record_ids(spark, sf_dir):
    """Ids from file order: the test file is written in event order."""
    numbered = sources.with_file_row_number(views.scan(spark, sf_dir, "events"))
    return numbered.select("event_id", hashing.record_id_from_row(F.col("row_number")).alias("record_id"))


# ---------------------------------------------------------------- endpoint graph


@query(
    "hcg_endpoints",
    with_ctes(
        ["flows"],
        f"""SELECT ip || ':' || port AS endpoint_id, ip, port,
  coalesce({_PRIVATE_SQL}, false) AS is_private_ip,
  CASE WHEN port <= 1023 THEN 'well_known' WHEN port <= 49151 THEN 'registered' ELSE 'dynamic' END AS port_bucket,
  port IN (20,21,22,23,25,53,80,110,143,443,993,995,3128,8080) AS is_common_service_port,
  port IN (3128,8000,8080,8888) AS is_proxy_port
FROM (SELECT ip, port, (split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536
        + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT) AS n
      FROM (SELECT src_ip AS ip, src_port AS port FROM flows UNION SELECT dst_ip, dst_port FROM flows))""",
    ),
)
def hcg_endpoints(spark, sf_dir):
    return hcg.endpoints(views.stored_flows(spark, sf_dir))


_HCG_EDGE_BODY = """, p AS (
  SELECT src_endpoint, dst_endpoint, protocol, count(*) AS n FROM {f} GROUP BY ALL),
pn AS (SELECT src_endpoint, dst_endpoint, protocol_name, count(*) AS n FROM {f} WHERE protocol_name <> '' GROUP BY ALL),
pe AS (
  SELECT src_endpoint, dst_endpoint, string_agg(protocol::VARCHAR, ',' ORDER BY protocol) AS protocol_set,
    (array_agg(protocol ORDER BY n DESC, protocol::VARCHAR))[1] AS major_protocol,
    round(-sum(n / t * log2(n / t)), 6) + 0.0 AS protocol_entropy
  FROM (SELECT *, (sum(n) OVER (PARTITION BY src_endpoint, dst_endpoint))::DOUBLE AS t FROM p) GROUP BY 1, 2),
ne AS (
  SELECT src_endpoint, dst_endpoint, string_agg(protocol_name, ',' ORDER BY protocol_name) AS protocol_name_set,
    (array_agg(protocol_name ORDER BY n DESC, protocol_name))[1] AS major_protocol_name,
    round(-sum(n / t * log2(n / t)), 6) + 0.0 AS l7_protocol_entropy
  FROM (SELECT *, (sum(n) OVER (PARTITION BY src_endpoint, dst_endpoint))::DOUBLE AS t FROM pn) GROUP BY 1, 2),
e AS (
  SELECT src_endpoint, dst_endpoint, count(*) AS flow_count,
    min(timestamp_epoch) AS first_seen_epoch, max(timestamp_epoch) AS last_seen_epoch,
    min(timestamp) AS first_seen, max(timestamp) AS last_seen,
    sum(fwd_packets)::BIGINT AS total_fwd_packets, sum(bwd_packets)::BIGINT AS total_bwd_packets,
    sum(fwd_packets + bwd_packets)::BIGINT AS total_packets,
    sum(fwd_bytes)::BIGINT AS total_fwd_bytes, sum(bwd_bytes)::BIGINT AS total_bwd_bytes,
    sum(fwd_bytes + bwd_bytes)::BIGINT AS total_bytes,
    round(sum(duration) / count(*), 6) AS avg_duration, min(duration) AS min_duration, max(duration) AS max_duration
  FROM {f} GROUP BY 1, 2)
SELECT sha1(src_endpoint || '|' || dst_endpoint || '|COMMUNICATES') AS edge_id, e.*,
  src_endpoint AS source_id, dst_endpoint AS target_id,
  protocol_set, protocol_name_set, major_protocol, major_protocol_name, protocol_entropy, l7_protocol_entropy
FROM e JOIN pe USING (src_endpoint, dst_endpoint) JOIN ne USING (src_endpoint, dst_endpoint)"""


def _edge_sql(name: str) -> str:
    return "WITH " + views.CTE[name] + _HCG_EDGE_BODY.format(f=name)


def _rounded_edges(df: DataFrame) -> DataFrame:
    return rounded(df, "avg_duration", "protocol_entropy", "l7_protocol_entropy")


@query("hcg_edges", _edge_sql("flows"))
def hcg_edges(spark, sf_dir):
    return _rounded_edges(hcg.edges(views.flows(spark, sf_dir)))


@query("hcg_edges_dense", _edge_sql("dense"))
def hcg_edges_dense(spark, sf_dir):
    return _rounded_edges(hcg.edges(views.dense_flows(spark, sf_dir)))


_UNNAMED = """, unnamed AS (
  SELECT * REPLACE (CASE WHEN l7_protocol % 2 = 0 THEN l7_protocol::VARCHAR ELSE protocol_name END AS protocol_name) FROM dense)"""


@query("hcg_edges_unnamed", "WITH " + views.CTE["dense"] + _UNNAMED + _HCG_EDGE_BODY.format(f="unnamed"))
def hcg_edges_unnamed(spark, sf_dir):
    """Flows of some protocols come without a name and are counted under their l7 number."""
    nameless = F.when(F.col("l7_protocol") % 2 == 0, F.lit("")).otherwise(F.col("protocol_name"))
    flows = views.dense_flows(spark, sf_dir).withColumn("protocol_name", nameless)
    return _rounded_edges(hcg.edges(sources.with_graph_protocol_names(flows)))


@query(
    "hcg_edge_protocols",
    with_ctes(
        ["dense"],
        "SELECT src_endpoint, dst_endpoint, protocol, protocol_name, count(*) AS n FROM dense GROUP BY ALL",
    ),
)
def hcg_edge_protocols(spark, sf_dir):
    return hcg.edge_protocols(views.dense_flows(spark, sf_dir))


# ---------------------------------------------------------------- estimates


def _same_group_sql(keys: str, window: int) -> str:
    using = ", ".join(keys.split())
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split())
    return f"""(SELECT {', '.join('a.' + k for k in keys.split())}, count(*) AS pairs FROM flows a JOIN flows b ON {on}
    AND (a.timestamp_epoch, a.record_id) < (b.timestamp_epoch, b.record_id)
    AND b.timestamp_epoch - a.timestamp_epoch <= {window} GROUP BY {', '.join('a.' + k for k in keys.split())})"""


EST_SQL = {
    "CR": f"""SELECT count(*) AS pairs FROM flows a JOIN flows b ON a.protocol = b.protocol AND a.src_ip = b.dst_ip
    AND a.src_port = b.dst_port AND a.dst_ip = b.src_ip AND a.dst_port = b.src_port AND a.record_id < b.record_id
    AND abs(a.timestamp_epoch - b.timestamp_epoch) <= {WINDOWS['CR']}""",
    "PR": f"""SELECT count(*) AS pairs FROM flows a JOIN flows b ON a.dst_ip = b.src_ip
    AND abs(a.timestamp_epoch - b.timestamp_epoch) <= {WINDOWS['PR']}""",
    "DHR": f"""SELECT count(*) AS pairs FROM flows a JOIN flows b ON a.src_ip = b.src_ip AND a.src_port <> b.src_port
    AND a.record_id < b.record_id AND abs(a.timestamp_epoch - b.timestamp_epoch) <= {WINDOWS['DHR']}""",
    "SHR": f"""SELECT count(*) AS pairs FROM flows a JOIN flows b ON a.src_ip = b.src_ip AND a.src_port = b.src_port
    AND a.record_id < b.record_id AND abs(a.timestamp_epoch - b.timestamp_epoch) <= {WINDOWS['SHR']}""",
}


def _register_estimate(relation: str) -> None:
    sql = with_ctes(["flows"], f"SELECT '{relation}' AS relation_type, pairs AS estimate FROM ({EST_SQL[relation]})")

    @query(f"est_{relation.lower()}", sql)
    def run(spark, sf_dir):
        return estimate.relation_estimate(views.stored_flows(spark, sf_dir), WINDOWS, [relation])


for _relation in RELATION_PRIORITY:
    _register_estimate(_relation)


@query(
    "est_total",
    with_ctes(
        ["flows"],
        """SELECT *, total * 180 AS estimated_csv_size, floor(total * 180 * 0.35)::BIGINT AS estimated_parquet_size
FROM (SELECT *, "CR" + "PR" + "DHR" + "SHR" AS total FROM ("""
        + " CROSS JOIN ".join(f'(SELECT pairs AS "{r}" FROM ({EST_SQL[r]}))' for r in RELATION_PRIORITY)
        + "))",
    ),
)
def est_total(spark, sf_dir):
    return estimate.estimate_summary(views.stored_flows(spark, sf_dir), WINDOWS)


@query(
    "est_top_groups",
    with_ctes(
        ["flows"],
        f"""SELECT relation_type, grp, pairs FROM (
  SELECT 'PR' AS relation_type, a.dst_ip AS grp, count(*) AS pairs FROM flows a JOIN flows b ON a.dst_ip = b.src_ip
    AND abs(a.timestamp_epoch - b.timestamp_epoch) <= {WINDOWS['PR']} GROUP BY a.dst_ip
  UNION ALL SELECT 'DHR', a.src_ip, count(*) FROM flows a JOIN flows b ON a.src_ip = b.src_ip
    AND a.src_port <> b.src_port AND a.record_id < b.record_id
    AND abs(a.timestamp_epoch - b.timestamp_epoch) <= {WINDOWS['DHR']} GROUP BY a.src_ip
  UNION ALL SELECT 'SHR', a.src_endpoint, count(*) FROM flows a JOIN flows b ON a.src_endpoint = b.src_endpoint
    AND a.record_id < b.record_id AND abs(a.timestamp_epoch - b.timestamp_epoch) <= {WINDOWS['SHR']}
    GROUP BY a.src_endpoint) ORDER BY pairs DESC, relation_type, grp LIMIT 20""",
    ),
)
def est_top_groups(spark, sf_dir):
    return estimate.top_risk_groups(views.stored_flows(spark, sf_dir), WINDOWS)


@query(
    "est_unlimited",
    with_ctes(
        ["flows"],
        """, h AS (SELECT src_ip, count(*) AS n FROM flows GROUP BY 1),
s AS (SELECT src_ip, src_port, count(*) AS n FROM flows GROUP BY 1, 2),
d AS (SELECT dst_ip, count(*) AS n FROM flows GROUP BY 1)
SELECT 'CR' AS relation_type, (SELECT count(*) FROM flows a JOIN flows b ON a.protocol = b.protocol AND a.src_ip = b.dst_ip
    AND a.src_port = b.dst_port AND a.dst_ip = b.src_ip AND a.dst_port = b.src_port AND a.record_id < b.record_id)::BIGINT AS estimate
UNION ALL SELECT 'PR', (SELECT sum(d.n * h.n) FROM d JOIN h ON d.dst_ip = h.src_ip)::BIGINT
UNION ALL SELECT 'DHR', ((SELECT sum(n * (n - 1) // 2) FROM h) - (SELECT sum(n * (n - 1) // 2) FROM s))::BIGINT
UNION ALL SELECT 'SHR', (SELECT sum(n * (n - 1) // 2) FROM s)::BIGINT""".lstrip(),
    ).replace("))\n, h AS", ")),\nh AS"),
)
def est_unlimited(spark, sf_dir):
    return estimate.relation_estimate(views.stored_flows(spark, sf_dir), dict.fromkeys(WINDOWS))


# ---------------------------------------------------------------- causal graph


def tcg_sql(windows: dict, relations: list[str], name: str = "causes") -> str:
    """CTE of the causal edges from one self-join and a first-match CASE (the reference semantics)."""

    def within(relation: str) -> str:
        if relation not in relations:
            return "false"
        return "true" if windows[relation] is None else f"delta <= {windows[relation]}"

    case = f"""CASE WHEN cr THEN CASE WHEN {within('CR')} THEN 'CR' END
      WHEN (pf OR pb) AND {within('PR')} THEN 'PR'
      WHEN pf THEN NULL
      WHEN same_host AND NOT same_port AND {within('DHR')} THEN 'DHR'
      WHEN same_host AND same_port AND {within('SHR')} THEN 'SHR' END"""
    body = """SELECT a.record_id AS aid, b.record_id AS bid, b.timestamp_epoch - a.timestamp_epoch AS delta,
        a.protocol = b.protocol AND a.src_ip = b.dst_ip AND a.src_port = b.dst_port AND a.dst_ip = b.src_ip
          AND a.dst_port = b.src_port AS cr,
        a.dst_ip = b.src_ip AS pf, b.dst_ip = a.src_ip AS pb, a.src_ip = b.src_ip AS same_host,
        a.src_port = b.src_port AS same_port
      FROM flows a JOIN flows b ON {on} AND (a.timestamp_epoch, a.record_id) < (b.timestamp_epoch, b.record_id)"""
    joins = " UNION ".join(
        body.format(on=on) for on in ("a.dst_ip = b.src_ip", "b.dst_ip = a.src_ip", "a.src_ip = b.src_ip")
    )
    return f"""{name} AS (
  SELECT sha1(aid || '|' || bid || '|' || rel) AS relation_id, aid AS src_record_id, bid AS dst_record_id,
    aid AS source_id, bid AS target_id, rel AS relation_type,
    CASE rel WHEN 'CR' THEN 1 WHEN 'PR' THEN 2 WHEN 'DHR' THEN 3 ELSE 4 END::BIGINT AS relation_priority,
    delta AS delta_seconds, delta = 0 AS same_timestamp
  FROM (SELECT aid, bid, delta, {case} AS rel FROM ({joins})) WHERE rel IS NOT NULL)"""


ALL = list(RELATION_PRIORITY)
CAUSES = tcg_sql(WINDOWS, ALL)


def causes(spark, sf_dir) -> DataFrame:
    return tcg.edges(views.stored_flows(spark, sf_dir), WINDOWS)


@query("tcg_edges", with_ctes(["flows"], "SELECT * FROM causes", CAUSES))
def tcg_edges(spark, sf_dir):
    return causes(spark, sf_dir)


@query("tcg_edges_subset", with_ctes(["flows"], "SELECT * FROM causes", tcg_sql(WINDOWS, ["CR", "SHR"])))
def tcg_edges_subset(spark, sf_dir):
    return tcg.edges(views.stored_flows(spark, sf_dir), WINDOWS, tcg.parse_relations("SHR,CR"))


@query(
    "tcg_edges_no_cr", with_ctes(["flows"], "SELECT * FROM causes", tcg_sql(WINDOWS, ["PR", "DHR", "SHR"]))
)
def tcg_edges_no_cr(spark, sf_dir):
    return tcg.edges(views.stored_flows(spark, sf_dir), WINDOWS, tcg.parse_relations("PR,DHR,SHR"))


_UNLIMITED = tcg.relation_windows(0, "PR=60,DHR=60,SHR=0")


@query(
    "tcg_edges_unlimited", with_ctes(["flows"], "SELECT * FROM causes", tcg_sql(_UNLIMITED, ["CR", "SHR"]))
)
def tcg_edges_unlimited(spark, sf_dir):
    return tcg.edges(views.stored_flows(spark, sf_dir), _UNLIMITED, ["CR", "SHR"])


@query(
    "tcg_edges_crowded", with_ctes(["flows"], "SELECT * FROM causes", CAUSES)
)
def tcg_edges_crowded(spark, sf_dir):
    """The whole graph with every crowded bucket cut into small grid cells."""
    return tcg.edges(views.stored_flows(spark, sf_dir), WINDOWS, cell_rows=8)


_SHR_CAPPED = f"""shr AS (
  SELECT sha1(aid || '|' || bid || '|SHR') AS relation_id, aid AS src_record_id, bid AS dst_record_id,
    aid AS source_id, bid AS target_id, 'SHR' AS relation_type, 4::BIGINT AS relation_priority,
    delta AS delta_seconds, delta = 0 AS same_timestamp FROM (
  SELECT record_id AS aid, unnest([{', '.join(f"lead(record_id, {i}) OVER w" for i in (1, 2, 3))}]) AS bid,
    unnest([{', '.join(f"lead(timestamp_epoch, {i}) OVER w" for i in (1, 2, 3))}]) - timestamp_epoch AS delta
  FROM flows WINDOW w AS (PARTITION BY src_ip, src_port ORDER BY timestamp_epoch, record_id))
  WHERE bid IS NOT NULL AND delta <= {WINDOWS['SHR']})"""


@query("tcg_shr_capped", with_ctes(["flows"], "SELECT * FROM shr", _SHR_CAPPED))
def tcg_shr_capped(spark, sf_dir):
    return tcg.capped_shr_edges(views.stored_flows(spark, sf_dir), 3, WINDOWS["SHR"])


@query(
    "tcg_shrcr_capped",
    with_ctes(
        ["flows"],
        """SELECT * FROM shr UNION ALL SELECT * FROM causes c WHERE NOT EXISTS (
  SELECT 1 FROM shr s WHERE s.src_record_id = c.src_record_id AND s.dst_record_id = c.dst_record_id)""",
        _SHR_CAPPED,
        tcg_sql(WINDOWS, ["CR"]),
    ),
)
def tcg_shrcr_capped(spark, sf_dir):
    return tcg.capped_edges(views.stored_flows(spark, sf_dir), 3, WINDOWS["SHR"], WINDOWS["CR"])
