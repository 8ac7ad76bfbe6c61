"""Queries that go through the parquet sink, the row cap, the id-map source, token names and batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import subgraph, walks
from flowloom.plans import views
from flowloom.plans.graph_queries import CAUSES, causes
from flowloom.plans.registry import query
from flowloom.plans.storage_queries import _folder
from flowloom.plans.view_queries import _CAPPED, _DEG, _HOST_WALKS, _LINES, _lines, host_walks, host_weights
from flowloom.plans.views import SEED, with_ctes
from flowloom.session import cut_lineage
from flowloom.sources import flows as sources
from flowloom.sources import tables

PRUNED = ["record_id", "src_endpoint", "dst_endpoint", "timestamp_epoch", "duration"]
SMOKE_ROWS = 1000


def _through_parquet(spark, sf_dir, codec: str) -> DataFrame:
    path = _folder(spark)
    tables.write_parquet(views.flows(spark, sf_dir), path, codec)
    return sources.read_flows_parquet(spark, path, PRUNED)


@query("flow_parquet", with_ctes(["flows"], f"SELECT {', '.join(PRUNED)} FROM flows"))
def flow_parquet(spark, sf_dir):
    """Flows through a zstd parquet sink and a pruned scan."""
    return _through_parquet(spark, sf_dir, "zstd")


@query("flow_parquet_snappy", with_ctes(["flows"], f"SELECT {', '.join(PRUNED)} FROM flows"))
def flow_parquet_snappy(spark, sf_dir):
    return _through_parquet(spark, sf_dir, "snappy")


@query(
    "first_flows",
    with_ctes(["flows"], f"SELECT {', '.join(PRUNED)} FROM flows ORDER BY timestamp_epoch, record_id LIMIT {SMOKE_ROWS}"),
)
def first_flows(spark, sf_dir):
    """The row cap of a smoke run, over the flows in time order."""
    numbered = sources.with_order_row_number(views.flows(spark, sf_dir).select(PRUNED), "timestamp_epoch", "record_id")
    return sources.first_rows(numbered, SMOKE_ROWS).select(PRUNED)


@query(
    "id_map_store",
    with_ctes(
        ["flows"],
        """SELECT (row_number() OVER (ORDER BY token) - 1)::VARCHAR AS vid, token
FROM (SELECT DISTINCT unnest(tokens) AS token FROM s7)""",
        *_HOST_WALKS,
    ),
)
def id_map_store(spark, sf_dir):
    """The id map written as CSV and scanned as text."""
    path = _folder(spark)
    tables.write_csv(walks.id_map(host_walks(spark, sf_dir)), path, ["vid", "token"])
    return tables.read_id_map(spark, path)


@query(
    "walk_names",
    with_ctes(
        ["flows"],
        """SELECT round, start, string_agg(coalesce(nullif(name, ''), t), ' ' ORDER BY pos) AS walk
FROM (SELECT round, start, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS pos FROM s7)
LEFT JOIN named ON named.id = t GROUP BY 1, 2""",
        *_HOST_WALKS,
        """named AS (SELECT DISTINCT src_endpoint AS id, CASE WHEN src_port % 2 = 0 THEN '' ELSE 'host ' || src_ip END AS name FROM flows)""",
    ),
)
def walk_names(spark, sf_dir):
    """Walks by host name; hosts that only receive have no name, those of even ports an empty one."""
    name = F.when(F.col("src_port") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("host "), F.col("src_ip")))
    names = views.flows(spark, sf_dir).select(F.col("src_endpoint").alias("id"), name.alias("name")).distinct()
    return _lines(walks.token_names(host_walks(spark, sf_dir), names))


@query("walk_batches", with_ctes(["flows"], _LINES.format(last=7), *_HOST_WALKS))
def walk_batches(spark, sf_dir):
    """The host walks in three batches of starts; the second is run twice, as after a failure."""
    weighted = host_weights(spark, sf_dir)
    graph = walks.prepare_graph(weighted)
    starts = cut_lineage(walks.start_nodes(weighted))
    size = max(1, -(-starts.count() // 3))
    path = _folder(spark)
    done = starts.limit(0)
    for batch, runs in enumerate((1, 2, 1)):
        todo = walks.next_batch(starts, done, size)
        for _ in range(runs):
            walks.append_batch(walks.walk(graph, walks.fan_out(todo, 2), 8, SEED), path, batch)
        done = spark.read.parquet(path)
    return _lines(done)


FACTORS = (1, 2_000, 20_000, 40_000, 80_000, 10_000_000)
FREE_GB = (30.0, 50.0, 70.0, 120.0)


@query(
    "storage_verdicts",
    with_ctes(
        ["flows"],
        f"""SELECT k, e AS edges, free AS free_gb, CASE WHEN e <= 40000000 AND free >= 60 THEN 'FEASIBLE'
  WHEN e <= 40000000 AND free >= 40 THEN 'CAUTIOUS' WHEN e <= 80000000 AND free >= 100 THEN 'FEASIBLE'
  WHEN e <= 80000000 AND free >= 60 THEN 'CAUTIOUS' WHEN e > 100000000 THEN 'NOT_RECOMMENDED' ELSE 'CAUTION' END AS verdict
FROM (SELECT k, union_estimate * unnest({list(FACTORS)}) AS e FROM capped), (SELECT unnest({list(FREE_GB)})::DOUBLE AS free)""",
        CAUSES,
        _DEG,
        _CAPPED,
    ),
)
def storage_verdicts(spark, sf_dir):
    """Storage verdicts of the capped graph and of its multiples, for several amounts of free space."""
    factor = F.explode(F.array(*[F.lit(f).cast("bigint") for f in FACTORS]))
    capped = subgraph.capped_size(causes(spark, sf_dir), (2, 5, 10)).select("k", "union_estimate", factor.alias("factor"))
    scaled = cut_lineage(capped.select("k", (F.col("union_estimate") * F.col("factor")).alias("union_estimate")))
    flow_count = views.flows(spark, sf_dir).count()
    rows = [
        subgraph.storage_model(scaled, flow_count, free).select("k", "edges", F.lit(free).alias("free_gb"), "verdict")
        for free in FREE_GB
    ]
    return reduce(DataFrame.unionByName, rows)
