"""Queries on feature tables, target encoding and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import checks, features, sampling
from flowloom.operators import target_encoding as te
from flowloom.plans import views
from flowloom.plans.graph_queries import rounded
from flowloom.plans.registry import query
from flowloom.plans.views import EVENT_TYPES, SEED, _sql_ip, with_ctes
from flowloom.session import cut_lineage
from flowloom.sources import flows as sources

DIM = 64
NC = len(EVENT_TYPES)
META = "record_id, target, split, src_endpoint, dst_endpoint"

RAW_NAMES = [
    "raw_source_port",
    "raw_destination_port",
    "raw_protocol",
    "raw_flow_duration",
    "raw_total_fwd_packets",
    "raw_total_backward_packets",
    "raw_total_length_of_fwd_packets",
    "raw_total_length_of_bwd_packets",
]
DERIVED = ["raw_timestamp_epoch", "raw_hour", "raw_dayofweek"] + [
    f"raw_{s}_{n}"
    for s in ("src", "dst")
    for n in ("port", "is_common_service_port", "is_proxy_port", "port_bucket_code")
]
RAW_LIST = ", ".join(RAW_NAMES + DERIVED)


def _code(p: str) -> str:
    return f"CASE WHEN {p} BETWEEN 0 AND 1023 THEN 1 WHEN {p} BETWEEN 1024 AND 49151 THEN 2 ELSE 3 END::FLOAT"


def _ports(side: str) -> str:
    p = f"{side}_port"
    return f"""{p}::FLOAT AS raw_{side}_port,
  ({p} IN (20,21,22,23,25,53,80,110,143,443,993,995,3128,8080))::INT::FLOAT AS raw_{side}_is_common_service_port,
  ({p} IN (3128,8000,8080,8888))::INT::FLOAT AS raw_{side}_is_proxy_port, {_code(p)} AS raw_{side}_port_bucket_code"""


A_CTE = f"""a AS MATERIALIZED (
  SELECT *, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2 + 0.1 THEN 'valid' ELSE 'train' END AS split FROM (
  SELECT record_id, target, src_ip || ':' || src_port AS src_endpoint, dst_ip || ':' || dst_port AS dst_endpoint,
    ('0x' || substr(sha1('{SEED}|' || target || '|' || record_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u,
    src_port::FLOAT AS raw_source_port, dst_port::FLOAT AS raw_destination_port,
    CASE WHEN event_id % 2 = 0 THEN 6 ELSE 17 END::FLOAT AS raw_protocol,
    CASE WHEN event_id % 70 = 0 THEN 0 ELSE value END::FLOAT AS raw_flow_duration,
    (event_id % 11)::FLOAT AS raw_total_fwd_packets,
    ((event_id % 7)::VARCHAR || '.7')::DOUBLE::FLOAT AS raw_total_backward_packets,
    floor(value * 10)::FLOAT AS raw_total_length_of_fwd_packets, floor(value * 3)::FLOAT AS raw_total_length_of_bwd_packets,
    CASE WHEN event_id % 90 = 0 THEN 0 ELSE epoch_us(ts) // 1000000 END::BIGINT AS raw_timestamp_epoch,
    CASE WHEN event_id % 90 = 0 THEN 0 ELSE date_part('hour', ts) END::FLOAT AS raw_hour,
    CASE WHEN event_id % 90 = 0 THEN 0 ELSE isodow(ts) - 1 END::FLOAT AS raw_dayofweek,
    {_ports('src')}, {_ports('dst')}
  FROM (SELECT *, event_type AS target, 'rec_' || lpad((event_id + 1)::VARCHAR, 10, '0') AS record_id,
      {_sql_ip('user_id')} AS src_ip, CASE WHEN event_id % 50 = 0 THEN 0 ELSE 1024 + event_id % 3 END AS src_port,
      {_sql_ip('k')} AS dst_ip, 1024 + (event_id // 3) % 3 AS dst_port
    FROM (SELECT *, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events))))"""

B_CTE = f"""b AS (
  SELECT a.record_id, a.target, a.split, a.src_endpoint, a.dst_endpoint,
    s.emb IS NULL AS smiss, d.emb IS NULL AS dmiss,
    coalesce(s.emb, list_transform(range({DIM}), lambda x: 0.0::FLOAT)) AS se,
    coalesce(d.emb, list_transform(range({DIM}), lambda x: 0.0::FLOAT)) AS de
  FROM a LEFT JOIN endpoint_vectors s ON s.endpoint_id = a.src_endpoint
         LEFT JOIN endpoint_vectors d ON d.endpoint_id = a.dst_endpoint)"""

_B_WIDE = ", ".join(
    [f"se[{i + 1}] AS hcg_src_emb_{i:03d}" for i in range(DIM)]
    + [f"de[{i + 1}] AS hcg_dst_emb_{i:03d}" for i in range(DIM)]
    + [f"abs(se[{i + 1}] - de[{i + 1}]) AS hcg_absdiff_emb_{i:03d}" for i in range(DIM)]
    + [f"(se[{i + 1}] * de[{i + 1}]) AS hcg_prod_emb_{i:03d}" for i in range(DIM)]
    + ["smiss::INT::FLOAT AS hcg_src_emb_missing", "dmiss::INT::FLOAT AS hcg_dst_emb_missing"]
)
D_CTE = f"""d AS (
  SELECT a.record_id, a.target, a.split, a.src_endpoint, a.dst_endpoint, (v.emb IS NULL)::TINYINT AS tcg_emb_missing,
    coalesce(v.emb, list_transform(range({DIM}), lambda x: 0.0::FLOAT)) AS fe
  FROM a LEFT JOIN flow_vectors v ON v.record_id = a.record_id)"""
_D_WIDE = ", ".join([f"fe[{i + 1}] AS emb_{i:03d}" for i in range(DIM)] + ["tcg_emb_missing"])


def _sql(body: str, *ctes: str, base: tuple[str, ...] = ()) -> str:
    return with_ctes(list(base), body, *ctes)


# ---------------------------------------------------------------- tables A to F


def table_a(spark, sf_dir) -> DataFrame:
    """A as a stored table: the later tables read it several times."""
    return cut_lineage(features.raw_features(views.raw_flows(spark, sf_dir), seed=SEED))


def table_b(spark, sf_dir, a: DataFrame | None = None) -> DataFrame:
    a = a if a is not None else table_a(spark, sf_dir)
    return features.graph_features(a, views.endpoint_vectors(spark, sf_dir), DIM)


def table_c(spark, sf_dir) -> DataFrame:
    a = table_a(spark, sf_dir)
    return features.fuse(a, table_b(spark, sf_dir, a))


def table_d(spark, sf_dir, a: DataFrame | None = None) -> DataFrame:
    a = a if a is not None else table_a(spark, sf_dir)
    return features.flow_embedding_features(a, views.flow_vectors(spark, sf_dir), DIM)


@query("features_a", _sql(f"SELECT {META}, {RAW_LIST} FROM a", A_CTE))
def features_a(spark, sf_dir):
    return features.raw_features(views.raw_flows(spark, sf_dir), seed=SEED)


@query("features_b", _sql(f"SELECT {META}, {_B_WIDE} FROM b", A_CTE, B_CTE, base=("endpoint_vectors",)))
def features_b(spark, sf_dir):
    return features.widen(table_b(spark, sf_dir), features.hcg_layout(DIM))


@query(
    "features_c",
    _sql(
        f"SELECT b.{META.replace(', ', ', b.')}, {RAW_LIST}, {_B_WIDE} FROM a JOIN b ON a.record_id = b.record_id",
        A_CTE,
        B_CTE,
        base=("endpoint_vectors",),
    ),
)
def features_c(spark, sf_dir):
    return features.widen(table_c(spark, sf_dir), features.hcg_layout(DIM))


@query("features_d", _sql(f"SELECT {META}, {_D_WIDE} FROM d", A_CTE, D_CTE, base=("flow_vectors",)))
def features_d(spark, sf_dir):
    return features.widen(table_d(spark, sf_dir), features.flow_layout(DIM))


@query(
    "features_e",
    _sql(
        f"SELECT d.{META.replace(', ', ', d.')}, {RAW_LIST}, {_D_WIDE} FROM a JOIN d ON a.record_id = d.record_id",
        A_CTE,
        D_CTE,
        base=("flow_vectors",),
    ),
)
def features_e(spark, sf_dir):
    a = table_a(spark, sf_dir)
    return features.widen(features.fuse(a, table_d(spark, sf_dir, a)), features.flow_layout(DIM))


@query(
    "features_f",
    _sql(
        f"""SELECT d.{META.replace(', ', ', d.')}, {RAW_LIST}, {_B_WIDE}, {_D_WIDE}
FROM a JOIN b ON a.record_id = b.record_id JOIN d ON a.record_id = d.record_id""",
        A_CTE,
        B_CTE,
        D_CTE,
        base=("endpoint_vectors", "flow_vectors"),
    ),
)
def features_f(spark, sf_dir):
    fused = features.fuse(table_c(spark, sf_dir), table_d(spark, sf_dir))
    return features.widen(fused, {**features.hcg_layout(DIM), **features.flow_layout(DIM)})


@query(
    "features_e_rebuilt",
    _sql(
        f"SELECT d.{META.replace(', ', ', d.')}, {RAW_LIST}, {_D_WIDE} FROM a JOIN d ON a.record_id = d.record_id",
        A_CTE,
        D_CTE,
        base=("flow_vectors",),
    ),
)
def features_e_rebuilt(spark, sf_dir):
    """E from A and a D in which every row occurs twice."""
    a = table_a(spark, sf_dir)
    d = table_d(spark, sf_dir, a)
    rebuilt = features.rebuild_with_flow_embedding(a, d.unionByName(d), DIM)
    return features.widen(rebuilt, features.flow_layout(DIM))


@query(
    "flows_from_features",
    _sql(
        """SELECT record_id, record_id AS flow_id, src_endpoint, dst_endpoint,
  regexp_extract(src_endpoint, '^(.*):([^:]*)$', 1) AS src_ip, regexp_extract(src_endpoint, '^(.*):([^:]*)$', 2)::BIGINT AS src_port,
  regexp_extract(dst_endpoint, '^(.*):([^:]*)$', 1) AS dst_ip, regexp_extract(dst_endpoint, '^(.*):([^:]*)$', 2)::BIGINT AS dst_port,
  raw_protocol::BIGINT AS protocol, strftime(make_timestamp(raw_timestamp_epoch * 1000000), '%Y-%m-%d %H:%M:%S') AS timestamp,
  raw_timestamp_epoch AS timestamp_epoch, raw_flow_duration::DOUBLE AS duration,
  trunc(raw_total_fwd_packets)::BIGINT AS fwd_packets, trunc(raw_total_backward_packets)::BIGINT AS bwd_packets,
  raw_total_length_of_fwd_packets::BIGINT AS fwd_bytes, raw_total_length_of_bwd_packets::BIGINT AS bwd_bytes,
  0::BIGINT AS l7_protocol, target AS protocol_name, target AS label FROM a""",
        A_CTE,
    ),
)
def flows_from_features(spark, sf_dir):
    return sources.flows_from_features(table_a(spark, sf_dir))


@query(
    "feature_metrics",
    _sql(
        """SELECT count(*) AS rows, count(DISTINCT b.target) AS target_class_count,
  count(*) FILTER (smiss) AS src_missing_count, count(*) FILTER (dmiss) AS dst_missing_count,
  count(*) FILTER (smiss OR dmiss) AS any_missing_count,
  round(count(*) FILTER (smiss) / count(*), 6) AS src_missing_ratio, round(count(*) FILTER (dmiss) / count(*), 6) AS dst_missing_ratio,
  round(count(*) FILTER (smiss OR dmiss) / count(*), 6) AS any_missing_ratio,
  count(*) FILTER (raw_timestamp_epoch = 0) AS timestamp_parse_failed_count, 0::BIGINT AS nan_count, 0::BIGINT AS inf_count
FROM a JOIN b ON a.record_id = b.record_id""",
        A_CTE,
        B_CTE,
        base=("endpoint_vectors",),
    ),
)
def feature_metrics(spark, sf_dir):
    return rounded(
        features.build_metrics(table_c(spark, sf_dir)), "src_missing_ratio", "dst_missing_ratio", "any_missing_ratio"
    )


@query(
    "target_top20",
    _sql(
        """SELECT split, target, count(*) AS count FROM (SELECT split, target FROM a UNION ALL SELECT 'all', target FROM a)
GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, target) <= 20""",
        A_CTE,
    ),
)
def target_top20(spark, sf_dir):
    return features.target_top(table_a(spark, sf_dir))


@query("split_counts", _sql("SELECT split, count(*) AS rows FROM a GROUP BY 1", A_CTE))
def split_counts(spark, sf_dir):
    return features.split_counts(table_a(spark, sf_dir))


# ---------------------------------------------------------------- target encoding

_IDX = "list_position(['" + "','".join(EVENT_TYPES) + "'], target) - 1"
TE_ROWS = f"""te_rows AS MATERIALIZED (SELECT *, {_IDX} AS y, CASE WHEN split = 'train'
    THEN ('0x' || substr(md5('{SEED}|' || record_id), 1, 8))::BIGINT % 5 ELSE -1 END AS fold FROM a),
folds AS (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS fold),
prior AS MATERIALIZED (SELECT fold, y, n / sum(n) OVER (PARTITION BY fold) AS prior FROM (
  SELECT f.fold, r.y, count(*)::DOUBLE AS n FROM folds f JOIN te_rows r ON r.fold <> -1 AND r.fold <> f.fold GROUP BY 1, 2))"""


def _te_one(side: str) -> str:
    """Long encoding (record_id, y, te) of one endpoint column."""
    key = f"{side}_endpoint"
    return f"""te_{side} AS MATERIALIZED (
  SELECT r.record_id, p.y, (coalesce(c.n, 0) + 10.0 * p.prior) / (coalesce(t.n, 0) + 10.0) AS te
  FROM te_rows r JOIN prior p ON p.fold = r.fold
  LEFT JOIN (SELECT f.fold, k.{key}, k.y, count(*) AS n FROM folds f JOIN te_rows k ON k.fold <> -1 AND k.fold <> f.fold
             GROUP BY 1, 2, 3) c ON c.fold = r.fold AND c.{key} = r.{key} AND c.y = p.y
  LEFT JOIN (SELECT f.fold, k.{key}, count(*) AS n FROM folds f JOIN te_rows k ON k.fold <> -1 AND k.fold <> f.fold
             GROUP BY 1, 2) t ON t.fold = r.fold AND t.{key} = r.{key}),
tw_{side} AS MATERIALIZED (SELECT record_id, {', '.join(f"round(max(te) FILTER (y = {i}), 6) AS te_{side}_{i:03d}" for i in range(NC))}
  FROM te_{side} GROUP BY 1)"""


_TE = [A_CTE, TE_ROWS, _te_one("src"), _te_one("dst")]
_TE_LIST = ", ".join(f"te_{s}_{i:03d}" for s in ("src", "dst") for i in range(NC))
_TE_FROM = "FROM a JOIN tw_src USING (record_id) JOIN tw_dst USING (record_id)"


def _round_te(df: DataFrame) -> DataFrame:
    wide = features.widen(df, {k: v for k, v in te.te_layout(NC).items() if k in df.columns})
    return rounded(wide, *[c for c in wide.columns if c.startswith("te_")])


@query(
    "te_prior",
    _sql(
        """SELECT target, count(*) AS n, round(count(*) / (SELECT count(*) FROM a WHERE split = 'train'), 6) AS prior
FROM a WHERE split = 'train' GROUP BY 1""",
        A_CTE,
    ),
)
def te_prior(spark, sf_dir):
    return rounded(te.class_prior(table_a(spark, sf_dir)), "prior")


@query(
    "te_global",
    _sql(
        f"SELECT record_id, {', '.join(f'te_src_{i:03d}' for i in range(NC))} FROM a JOIN tw_src USING (record_id) WHERE split <> 'train'",
        *_TE[:3],
    ),
)
def te_global(spark, sf_dir):
    """Single-key encoding of validation and test rows."""
    encoded = te.target_encoding(table_a(spark, sf_dir), {"src_endpoint": "te_src"})
    return _round_te(encoded.filter("split <> 'train'").select("record_id", "te_src"))


@query(
    "te_oof",
    _sql(
        f"SELECT record_id, {', '.join(f'te_dst_{i:03d}' for i in range(NC))} FROM a JOIN tw_dst USING (record_id) WHERE split = 'train'",
        A_CTE,
        TE_ROWS,
        _te_one("dst"),
    ),
)
def te_oof(spark, sf_dir):
    """Out-of-fold encoding of training rows."""
    encoded = te.target_encoding(table_a(spark, sf_dir), {"dst_endpoint": "te_dst"})
    return _round_te(encoded.filter("split = 'train'").select("record_id", "te_dst"))


@query(
    "te_label_index",
    _sql("SELECT DISTINCT target, (dense_rank() OVER (ORDER BY target) - 1)::INTEGER AS y FROM a", A_CTE),
)
def te_label_index(spark, sf_dir):
    a = table_a(spark, sf_dir)
    return te.with_label_index(a.select("target").distinct(), te.class_list(a))


@query("features_d_te", _sql(f"SELECT record_id, target, split, {_TE_LIST} {_TE_FROM}", *_TE))
def features_d_te(spark, sf_dir):
    return _round_te(te.encoded_features(table_a(spark, sf_dir)))


@query("features_e_te", _sql(f"SELECT record_id, target, split, {_TE_LIST}, {RAW_LIST} {_TE_FROM}", *_TE))
def features_e_te(spark, sf_dir):
    a = table_a(spark, sf_dir)
    raw = a.drop("src_endpoint", "dst_endpoint")
    return _round_te(features.fuse(te.encoded_features(a), raw))


@query(
    "features_f_te",
    _sql(
        f"""SELECT a.record_id, a.target, a.split, {_TE_LIST}, {RAW_LIST}, {_B_WIDE}
FROM a JOIN tw_src USING (record_id) JOIN tw_dst USING (record_id) JOIN b USING (record_id)""",
        *_TE,
        B_CTE,
        base=("endpoint_vectors",),
    ),
)
def features_f_te(spark, sf_dir):
    c = table_c(spark, sf_dir)
    fused = features.fuse(te.encoded_features(c), c.drop("src_endpoint", "dst_endpoint"))
    return _round_te(features.widen(fused, features.hcg_layout(DIM)))


@query(
    "te_summary",
    _sql(
        """SELECT count(*) AS rows, count(*) FILTER (split = 'train') AS train_rows, 10::BIGINT AS encoded_columns,
  0::BIGINT AS bad_blocks FROM a""",
        A_CTE,
    ),
)
def te_summary(spark, sf_dir):
    return te.build_summary(te.encoded_features(table_a(spark, sf_dir)))


# ---------------------------------------------------------------- sampling

SIZES = {"train": 500, "valid": 60, "test": 150}
SAMPLE_CTE = f"""sample AS MATERIALIZED (SELECT record_id FROM a QUALIFY
  row_number() OVER (PARTITION BY split ORDER BY md5((CASE split WHEN 'train' THEN {SEED} WHEN 'valid' THEN {SEED + 1}
    ELSE {SEED + 2} END) || '|' || record_id), record_id) <= CASE split WHEN 'train' THEN 500 WHEN 'valid' THEN 60 ELSE 150 END)"""


@query("sample_split", _sql(f"SELECT {META}, {RAW_LIST} FROM a SEMI JOIN sample USING (record_id)", A_CTE, SAMPLE_CTE))
def sample_split(spark, sf_dir):
    return sampling.sample_per_split(table_a(spark, sf_dir), SIZES, SEED)


@query(
    "sample_aligned",
    _sql(f"SELECT {META}, {_D_WIDE} FROM d SEMI JOIN sample USING (record_id)", A_CTE, D_CTE, SAMPLE_CTE, base=("flow_vectors",)),
)
def sample_aligned(spark, sf_dir):
    a = table_a(spark, sf_dir)
    tables = {"A": a, "D": table_d(spark, sf_dir, a)}
    picked = sampling.aligned_samples(tables, "A", SIZES, SEED)
    return features.widen(picked["D"], features.flow_layout(DIM))


@query(
    "sample_alignment",
    _sql(
        """SELECT t.n AS "table", (SELECT count(*) FROM sample) AS rows, 0::BIGINT AS missing, 0::BIGINT AS extra
FROM (VALUES ('A'), ('B'), ('D')) t(n)""",
        A_CTE,
        SAMPLE_CTE,
    ),
)
def sample_alignment(spark, sf_dir):
    a = table_a(spark, sf_dir)
    tables = {"A": a, "B": table_b(spark, sf_dir, a), "D": table_d(spark, sf_dir, a)}
    return sampling.alignment(sampling.aligned_samples(tables, "A", SIZES, SEED), "A")


# ---------------------------------------------------------------- checks on tables


@query(
    "check_features",
    _sql(
        """SELECT * FROM (VALUES ('row_counts_match', true), ('record_id_unique_A', true), ('record_id_unique_B', true),
  ('record_id_unique_C', true), ('record_id_match', true), ('target_match', true), ('split_match', true),
  ('A_has_raw_features', true), ('B_embedding_dim', true), ('B_has_missing_flags', true), ('C_has_A_and_B_columns', true),
  ('target_non_empty', true), ('split_non_empty', true), ('no_nan', true), ('no_inf', true)) t("check", ok)
UNION ALL SELECT 'split_has_all_three', count(DISTINCT split) = 3 FROM a
UNION ALL SELECT 'split_ratio_close', abs(count(*) FILTER (split = 'train') / count(*) - 0.7) <= 0.05
  AND abs(count(*) FILTER (split = 'valid') / count(*) - 0.1) <= 0.05
  AND abs(count(*) FILTER (split = 'test') / count(*) - 0.2) <= 0.05 FROM a""",
        A_CTE,
    ),
)
def check_features(spark, sf_dir):
    a = table_a(spark, sf_dir)
    b = table_b(spark, sf_dir, a)
    return checks.check_abc(a, b, features.fuse(a, b), DIM).select("check", "ok")


@query(
    "check_flow_features",
    _sql(
        """SELECT t.n || '_' || c AS "check", true AS ok FROM (VALUES ('D'), ('E'), ('F')) t(n),
  (VALUES ('rows_equal_base'), ('record_id_unique'), ('record_id_match'), ('target_match'), ('split_match'),
   ('contains_base_columns'), ('embedding_dim'), ('has_missing_flag'), ('no_nan'), ('no_inf')) s(c)"""
    ).replace("WITH \n", ""),
)
def check_flow_features(spark, sf_dir):
    a = table_a(spark, sf_dir)
    c = features.fuse(a, table_b(spark, sf_dir, a))
    d = table_d(spark, sf_dir, a)
    tables = {"D": (d, a.select(*features.FEATURE_META)), "E": (features.fuse(a, d), a), "F": (features.fuse(c, d), c)}
    return checks.check_def(tables, DIM).select("check", "ok")
