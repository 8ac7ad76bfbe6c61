"""Queries on causal-graph views, degrees, profile and random walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import hcg, subgraph, walks
from flowloom.plans import views
from flowloom.plans.graph_queries import CAUSES, causes, rounded
from flowloom.plans.registry import query
from flowloom.plans.views import SEED, with_ctes
from flowloom.session import cut_lineage

VIEW_DELTA = 43200
_ORDER = "relation_priority, delta_seconds, src_record_id, dst_record_id"

# ---------------------------------------------------------------- views and degrees


def _view(body: str, *extra: str) -> str:
    return with_ctes(["flows"], body, CAUSES, *extra)


@query("view_delta", _view(f"SELECT * FROM causes WHERE delta_seconds <= {VIEW_DELTA} AND relation_type IN ('PR', 'SHR')"))
def view_delta(spark, sf_dir):
    return subgraph.view(causes(spark, sf_dir), VIEW_DELTA, ["PR", "SHR"])


_PRED = f"""pred AS (SELECT * FROM causes WHERE delta_seconds <= {VIEW_DELTA}
  QUALIFY row_number() OVER (PARTITION BY dst_record_id ORDER BY {_ORDER}) <= 3)"""


@query("view_top_pred", _view("SELECT * FROM pred", _PRED))
def view_top_pred(spark, sf_dir):
    return subgraph.view(causes(spark, sf_dir), VIEW_DELTA, predecessors=3)


@query(
    "view_top_succ",
    _view(
        f"SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY src_record_id ORDER BY {_ORDER}) <= 2", _PRED
    ),
)
def view_top_succ(spark, sf_dir):
    return subgraph.view(causes(spark, sf_dir), VIEW_DELTA, predecessors=3, successors=2)


_DEG = """deg AS (SELECT 'out' AS side, src_record_id AS vertex, count(*) AS degree FROM causes GROUP BY 2
  UNION ALL SELECT 'in', dst_record_id, count(*) FROM causes GROUP BY 2)"""


@query("degree_out", _view("SELECT vertex, degree FROM deg WHERE side = 'out'", _DEG))
def degree_out(spark, sf_dir):
    return subgraph.out_degrees(causes(spark, sf_dir))


@query("degree_in", _view("SELECT vertex, degree FROM deg WHERE side = 'in'", _DEG))
def degree_in(spark, sf_dir):
    return subgraph.in_degrees(causes(spark, sf_dir))


@query(
    "degree_summary",
    _view(
        """SELECT side, n AS count, s[1] AS min, s[least(n * 50 // 100, n - 1) + 1] AS p50,
  s[least(n * 90 // 100, n - 1) + 1] AS p90, s[least(n * 95 // 100, n - 1) + 1] AS p95,
  s[least(n * 99 // 100, n - 1) + 1] AS p99, s[n] AS max
FROM (SELECT side, count(*) AS n, list_sort(list(degree)) AS s FROM deg GROUP BY side)""",
        _DEG,
    ),
)
def degree_summary(spark, sf_dir):
    return subgraph.degree_summary(causes(spark, sf_dir))


_CAPPED = """capped AS (SELECT k, p AS predecessor_capped_edges, s AS successor_capped_edges,
  greatest(p, s) AS union_upper_bound, (p + s) // 2 AS union_estimate
FROM (SELECT k::BIGINT AS k, sum(least(degree, k)) FILTER (side = 'in')::BIGINT AS p,
  sum(least(degree, k)) FILTER (side = 'out')::BIGINT AS s FROM deg, (VALUES (2), (5), (10)) t(k) GROUP BY k))"""


@query("capped_estimate", _view("SELECT * FROM capped", _DEG, _CAPPED))
def capped_estimate(spark, sf_dir):
    return subgraph.capped_size(causes(spark, sf_dir), (2, 5, 10))


@query(
    "capped_storage",
    _view(
        """SELECT k, union_estimate AS edges, round(union_estimate * 150 / 1073741824.0, 2) AS csv_input_gb,
  round(union_estimate * 300 / 1073741824.0, 2) AS store_gb, round(n * 300 / 1073741824.0, 2) AS walk_file_gb,
  round(n * 256 / 1048576.0, 2) AS embedding_mb,
  round(union_estimate * 450 / 1073741824.0 + n * 300 / 1073741824.0 + n * 256 / 1073741824.0, 2) AS total_peak_gb,
  'CAUTIOUS' AS verdict FROM capped, (SELECT count(*)::DOUBLE AS n FROM flows)""",
        _DEG,
        _CAPPED,
    ),
)
def capped_storage(spark, sf_dir):
    return subgraph.storage_model(subgraph.capped_size(causes(spark, sf_dir), (2, 5, 10)), views.flows(spark, sf_dir).count(), 50.0)


@query("edge_counts", _view("SELECT relation_type, count(*) AS edges FROM causes GROUP BY 1"))
def edge_counts(spark, sf_dir):
    return subgraph.edge_counts(causes(spark, sf_dir))


@query(
    "graph_size",
    _view(
        """SELECT count(*) AS total_edges, count(DISTINCT src_record_id) AS unique_src,
  count(DISTINCT dst_record_id) AS unique_dst, (SELECT count(DISTINCT vertex) FROM deg) AS vertices FROM causes""",
        _DEG,
    ),
)
def graph_size(spark, sf_dir):
    return subgraph.graph_size(causes(spark, sf_dir))


@query(
    "graph_counts",
    with_ctes(
        ["flows"],
        """SELECT 'endpoints' AS element, count(*) AS n FROM (SELECT src_endpoint FROM flows UNION SELECT dst_endpoint FROM flows)
UNION ALL SELECT 'communicates', count(*) FROM (SELECT DISTINCT src_endpoint, dst_endpoint FROM flows)
UNION ALL SELECT 'flows', count(*) FROM flows""",
    ),
)
def graph_counts(spark, sf_dir):
    flows = views.flows(spark, sf_dir)
    return subgraph.graph_counts(endpoints=hcg.endpoints(flows), communicates=hcg.edges(flows), flows=flows)


@query(
    "profile",
    with_ctes(
        ["flows"],
        """SELECT 'rows' AS element, count(*) AS n FROM flows
UNION ALL SELECT 'unique_endpoints', count(*) FROM (SELECT src_endpoint FROM flows UNION SELECT dst_endpoint FROM flows)
UNION ALL SELECT 'unique_flow_ids', count(DISTINCT flow_id) FROM flows""",
    ),
)
def profile(spark, sf_dir):
    return subgraph.profile(views.flows(spark, sf_dir))


_TOP_COLUMNS = ["protocol", "label", "l7_protocol", "protocol_name", "src_port", "dst_port"]


@query(
    "top_values",
    with_ctes(
        ["flows"],
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS count FROM flows GROUP BY 2"
            for c in _TOP_COLUMNS
        )
        + ') QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) <= 10',
    ),
)
def top_values(spark, sf_dir):
    return subgraph.top_values(views.flows(spark, sf_dir), _TOP_COLUMNS)


# ---------------------------------------------------------------- walks

# Weighted endpoint graph and its running ranges, as the walks see it.
_HW = """hw AS (SELECT src_endpoint AS src, dst_endpoint AS dst, round(ln(1.0 + count(*)) * 1000000)::BIGINT AS w
  FROM flows GROUP BY 1, 2)"""
_HW_BOTH = """hw AS (SELECT src, dst, sum(w)::BIGINT AS w FROM (
  SELECT src, dst, w FROM (SELECT src_endpoint AS src, dst_endpoint AS dst, round(sqrt(CASE WHEN sum(fwd_bytes + bwd_bytes) > 0 THEN sum(fwd_bytes + bwd_bytes) ELSE 1 END) * 1000000)::BIGINT AS w
    FROM flows GROUP BY 1, 2)
  UNION ALL SELECT dst, src, w FROM (SELECT src_endpoint AS src, dst_endpoint AS dst, round(sqrt(CASE WHEN sum(fwd_bytes + bwd_bytes) > 0 THEN sum(fwd_bytes + bwd_bytes) ELSE 1 END) * 1000000)::BIGINT AS w
    FROM flows GROUP BY 1, 2)) GROUP BY 1, 2)"""
_TW = "hw AS (SELECT src_record_id AS src, dst_record_id AS dst, 1000000::BIGINT AS w FROM causes)"
_TW_FILTERED = (
    "hw AS (SELECT src_record_id AS src, dst_record_id AS dst, 1000000::BIGINT AS w FROM causes"
    f" WHERE relation_type IN ('PR', 'SHR') AND delta_seconds <= {VIEW_DELTA})"
)
_ADJ = """adj AS MATERIALIZED (SELECT *, (upto - w)::BIGINT AS before FROM (
  SELECT src, dst, w, (sum(w) OVER (PARTITION BY src ORDER BY dst))::BIGINT AS upto FROM hw)),
tot AS MATERIALIZED (SELECT src, sum(w)::BIGINT AS total FROM hw GROUP BY 1)"""


def _u(step: int, kind: str, attempt: str = "0") -> str:
    key = f"'{SEED}|' || s.round || '|' || s.start || '|{step}|' || {attempt} || '|{kind}'"
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT::DOUBLE / 4294967296.0)"


def _walk_sql(rounds: int, length: int, start: str = "SELECT DISTINCT src AS start FROM hw") -> list[str]:
    ctes = [
        f"""s0 AS (SELECT r AS round, start, NULL::VARCHAR AS prev, start AS cur, [start] AS tokens
  FROM ({start}), range({rounds}) t(r))"""
    ]
    for i in range(1, length):
        ctes.append(_first_order_sql(i))
    return ctes


def _first_order_sql(i: int) -> str:
    return f"""s{i} AS MATERIALIZED (SELECT s.round, s.start, CASE WHEN n.dst IS NULL THEN NULL ELSE s.cur END AS prev, n.dst AS cur,
  CASE WHEN n.dst IS NULL THEN tokens ELSE list_append(tokens, n.dst) END AS tokens
  FROM (SELECT s.*, floor({_u(i, 'pick')} * total)::BIGINT AS x FROM s{i - 1} s LEFT JOIN tot ON tot.src = s.cur) s
  LEFT JOIN adj n ON n.src = s.cur AND s.x >= n.before AND s.x < n.upto)"""


def _second_order_sql(i: int, p: float, q: float, tries: int = 80) -> str:
    top = max(1 / p, 1.0, 1 / q)
    return f"""c{i} AS MATERIALIZED (SELECT s.round, s.start, s.cur, s.prev, s.tokens, s.t, n.dst,
    {_u(i, 'accept', 's.t')} < (CASE WHEN n.dst = s.prev THEN {1 / p} WHEN k.dst IS NOT NULL THEN 1.0 ELSE {1 / q} END) / {top} AS ok
  FROM (SELECT s.*, t, floor({_u(i, 'pick', 't')} * total)::BIGINT AS x
        FROM s{i - 1} s JOIN tot ON tot.src = s.cur, range({tries}) r(t)) s
  JOIN adj n ON n.src = s.cur AND s.x >= n.before AND s.x < n.upto
  LEFT JOIN hw k ON k.src = s.prev AND k.dst = n.dst),
s{i} AS MATERIALIZED (SELECT s.round, s.start, CASE WHEN b.dst IS NULL THEN NULL ELSE s.cur END AS prev, b.dst AS cur,
  CASE WHEN b.dst IS NULL THEN tokens ELSE list_append(tokens, b.dst) END AS tokens
  FROM s{i - 1} s LEFT JOIN (SELECT round, start, arg_min(dst, t) AS dst FROM c{i} WHERE ok GROUP BY 1, 2) b
  ON b.round = s.round AND b.start = s.start)"""


def _lines(walked: DataFrame) -> DataFrame:
    return walked.select(F.col("round").cast("bigint").alias("round"), "start", F.concat_ws(" ", "tokens").alias("walk"))


_LINES = "SELECT round, start, array_to_string(tokens, ' ') AS walk FROM s{last}"


def host_weights(spark, sf_dir, field: str = "flow_count", transform: str = "log1p", undirected: bool = False):
    edges = hcg.edges(views.flows(spark, sf_dir))
    return subgraph.weighted_edges(edges, "src_endpoint", "dst_endpoint", field, transform, undirected)


def host_walks(spark, sf_dir, rounds: int = 2, length: int = 8) -> DataFrame:
    weighted = cut_lineage(host_weights(spark, sf_dir))
    starts = walks.fan_out(walks.start_nodes(weighted), rounds)
    return walks.walk(walks.prepare_graph(weighted), starts, length, SEED)


_HOST_WALKS = [_HW, _ADJ, *_walk_sql(2, 8)]


@query(
    "adjacency",
    with_ctes(
        ["flows"],
        """SELECT src AS cur, 0::BIGINT AS chunk, sum(w)::BIGINT AS total, count(*) AS degree,
  string_agg(dst || '=' || w, ' ' ORDER BY dst) AS neighbours FROM hw GROUP BY 1""",
        _HW_BOTH,
    ),
)
def adjacency(spark, sf_dir):
    lists = subgraph.adjacency(host_weights(spark, sf_dir, "total_bytes", "sqrt", undirected=True))
    shown = F.transform("nbrs", lambda n: F.concat_ws("=", n["dst"], n["w"].cast("string")))
    return lists.select(
        "cur",
        "chunk",
        "total",
        F.size("nbrs").cast("bigint").alias("degree"),
        F.array_join(shown, " ").alias("neighbours"),
    )


@query(
    "walk_starts",
    with_ctes(
        ["flows"],
        """SELECT start FROM (SELECT start, row_number() OVER (ORDER BY start) AS n FROM (SELECT DISTINCT src AS start FROM hw))
WHERE n > 5 AND n <= 305""",
        _HW,
    ),
)
def walk_starts(spark, sf_dir):
    """The second batch of starts: offset 5, batch size 300."""
    return walks.start_nodes(host_weights(spark, sf_dir), offset=5, limit=300)


@query("walks_first_order", with_ctes(["flows"], _LINES.format(last=7), *_HOST_WALKS))
def walks_first_order(spark, sf_dir):
    return _lines(host_walks(spark, sf_dir))


@query(
    "walks_uniform",
    with_ctes(["flows"], _LINES.format(last=6), CAUSES.replace("causes AS (", "causes AS MATERIALIZED (", 1), _TW, _ADJ, *_walk_sql(1, 7)),
)
def walks_uniform(spark, sf_dir):
    weighted = cut_lineage(walks.uniform_edges(causes(spark, sf_dir)))
    starts = walks.fan_out(walks.start_nodes(weighted), 1)
    return _lines(walks.walk(walks.prepare_graph(weighted), starts, 7, SEED))


@query(
    "walks_filtered",
    with_ctes(
        ["flows"], _LINES.format(last=4), CAUSES.replace("causes AS (", "causes AS MATERIALIZED (", 1), _TW_FILTERED, _ADJ, *_walk_sql(2, 5)
    ),
)
def walks_filtered(spark, sf_dir):
    kept = walks.filter_edges(causes(spark, sf_dir), ["PR", "SHR"], VIEW_DELTA)
    weighted = cut_lineage(walks.uniform_edges(kept))
    starts = walks.fan_out(walks.start_nodes(weighted), 2)
    return _lines(walks.walk(walks.prepare_graph(weighted), starts, 5, SEED))


@query(
    "walks_node2vec",
    with_ctes(
        ["flows"],
        _LINES.format(last=4),
        _HW,
        _ADJ,
        *_walk_sql(1, 2),
        *[_second_order_sql(i, 0.5, 2.0) for i in (2, 3, 4)],
    ),
)
def walks_node2vec(spark, sf_dir):
    weighted = cut_lineage(host_weights(spark, sf_dir))
    starts = walks.fan_out(walks.start_nodes(weighted), 1)
    graph = walks.prepare_graph(weighted, second_order=True)
    return _lines(walks.walk(graph, starts, 5, SEED, p=0.5, q=2.0))


@query(
    "walk_filter_counts",
    _view(
        f"""SELECT count(*) FILTER (relation_type IN ('PR', 'SHR') AND delta_seconds <= {VIEW_DELTA}) AS kept,
  count(*) FILTER (NOT (relation_type IN ('PR', 'SHR') AND delta_seconds <= {VIEW_DELTA})) AS rejected FROM causes"""
    ),
)
def walk_filter_counts(spark, sf_dir):
    return walks.filtered_edge_count(causes(spark, sf_dir), ["PR", "SHR"], VIEW_DELTA)


@query(
    "walk_counters",
    with_ctes(
        ["flows"],
        """SELECT 'walks' AS counter, count(*) AS n FROM s7 UNION ALL SELECT 'completed_starts', count(DISTINCT start) FROM s7
UNION ALL SELECT 'touched_vertices', count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM s7)
UNION ALL SELECT 'weight_fallbacks', 0""",
        *_HOST_WALKS,
    ),
)
def walk_counters(spark, sf_dir):
    return walks.run_counters(host_walks(spark, sf_dir), host_weights(spark, sf_dir))


@query(
    "walk_stats",
    with_ctes(
        ["flows"],
        """SELECT count(*) AS lines, 0::BIGINT AS empty_lines, count(*) FILTER (n = 1) AS length_one,
  count(*) FILTER (n < 4) AS short_walks, min(n) AS min_length, round(avg(n), 6) AS avg_length,
  list_sort(list(n))[count(*) // 2 + 1] AS p50_length, max(n) AS max_length,
  (SELECT count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM s7)) AS unique_tokens
FROM (SELECT len(tokens) AS n FROM s7)""",
        *_HOST_WALKS,
    ),
)
def walk_stats(spark, sf_dir):
    return rounded(walks.corpus_stats(host_walks(spark, sf_dir), min_length=4), "avg_length")


@query(
    "walk_id_map",
    with_ctes(
        ["flows"],
        """SELECT row_number() OVER (ORDER BY token) - 1 AS vid, token
FROM (SELECT DISTINCT unnest(tokens) AS token FROM s7)""",
        *_HOST_WALKS,
    ),
)
def walk_id_map(spark, sf_dir):
    return walks.id_map(host_walks(spark, sf_dir))


@query(
    "walk_token_diff",
    with_ctes(
        ["flows", "endpoint_vectors"],
        """, w AS (SELECT DISTINCT unnest(tokens) AS token FROM s7)
SELECT token, 'left' AS only_in FROM w WHERE token NOT IN (SELECT endpoint_id FROM endpoint_vectors)
UNION ALL SELECT endpoint_id, 'right' FROM endpoint_vectors WHERE endpoint_id NOT IN (SELECT token FROM w)""",
        *_HOST_WALKS,
    ),
)
def walk_token_diff(spark, sf_dir):
    known = views.endpoint_vectors(spark, sf_dir).select(F.col("endpoint_id").alias("token"))
    return walks.token_differences(walks.touched_vertices(host_walks(spark, sf_dir)), known)
