"""Round trips through the sinks and sources, and vector expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowloom.functions import vectors
from flowloom.operators import walks
from flowloom.plans import views
from flowloom.plans.graph_queries import CAUSES, causes, rounded
from flowloom.plans.registry import ORACLES, query
from flowloom.plans.view_queries import _HOST_WALKS, host_walks
from flowloom.plans.views import with_ctes
from flowloom.session import shared_folder
from flowloom.sources import flows as sources
from flowloom.sources import publish, tables


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/flowloom/{uuid.uuid4().hex}"


@query("flow_csv", ORACLES["flow_normalize"])
def flow_csv(spark, sf_dir):
    """Raw flows written as CSV, scanned as text and normalised."""
    path = _folder(spark)
    raw = views.raw_flows(spark, sf_dir).withColumnRenamed("row_number", "row")
    named = raw.withColumn("record_id", F.format_string("rec_%010d", "row"))
    tables.write_csv(named, path, [c for c in named.columns if c != "row"])
    return sources.normalize_flows(sources.read_flows_csv(spark, path))


@query("edge_store", with_ctes(["flows"], "SELECT * FROM causes WHERE relation_type = 'DHR'", CAUSES))
def edge_store(spark, sf_dir):
    """Edges written per relation and read back from one relation's folder."""
    path = _folder(spark)
    tables.write_edges(causes(spark, sf_dir), path, chunk_size=5000)
    return tables.read_edges(spark, path).filter("relation_type = 'DHR'")


@query(
    "walk_store",
    with_ctes(["flows"], "SELECT array_to_string(tokens, ' ') AS walk FROM s7", *_HOST_WALKS),
)
def walk_store(spark, sf_dir):
    """Walks written as corpus lines and scanned again."""
    path = _folder(spark)
    walks.to_lines(host_walks(spark, sf_dir)).write.text(path)
    return tables.read_walks(spark, path).select(F.concat_ws(" ", "tokens").alias("walk"))


@query(
    "vector_ops",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id, a.e AS x, b.e AS y FROM v a JOIN v b ON b.vec_id = a.vec_id // 2)
SELECT vec_id, round(sqrt(list_dot_product(x, x)), 6) AS norm, round(list_dot_product(x, y), 6) + 0.0 AS dot,
  round(list_cosine_similarity(x, y), 6) + 0.0 AS cosine,
  round(list_sum(list_transform(range(1, 65), lambda i: abs(x[i] - y[i]))), 6) AS absdiff,
  round(list_sum(list_transform(range(1, 65), lambda i: (x[i] - y[i]) * (x[i] - y[i]))), 6) AS distance2 FROM p""",
)
def vector_ops(spark, sf_dir):
    table = views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    half = table.select(F.col("vec_id").alias("half"), F.col("x").alias("y"))
    pairs = table.withColumn("half", F.floor(F.col("vec_id") / 2)).join(half, "half")
    x, y = F.col("x"), F.col("y")
    out = pairs.select(
        "vec_id",
        vectors.norm(x).alias("norm"),
        (vectors.dot(x, y)).alias("dot"),
        vectors.cosine(x, y).alias("cosine"),
        F.aggregate(vectors.abs_diff(x, y), F.lit(0.0), lambda acc, v: acc + v).alias("absdiff"),
        vectors.squared_distance(x, y).alias("distance2"),
    )
    return rounded(out, "norm", "dot", "cosine", "absdiff", "distance2")


@query("edges_published", with_ctes(["flows"], "SELECT * FROM causes", CAUSES))
def edges_published(spark, sf_dir):
    """The causal graph published over an older version and read back."""
    path = _folder(spark)
    edges = causes(spark, sf_dir)
    publish.publish(edges.filter("relation_type = 'SHR'"), path)
    publish.publish(edges, path, codec="zstd", partition_by=["relation_type"])
    return publish.read_published(spark, path)
