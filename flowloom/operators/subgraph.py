"""Views over a built causal graph, degrees, size models, adjacency and the dataset profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.skew import histogram_positions, lookup_join, top_k_per_key

PERCENTILES = (50, 90, 95, 99)
CAPS = (5, 10, 20)

# Fixed values of the storage model.
CSV_BYTES_PER_EDGE = 150
STORE_BYTES_PER_EDGE = 300
WALK_BYTES_PER_TOKEN = 15
GIB = 1024**3
# A verdict holds up to so many edges and from so many free GiB on; the first that fits counts.
STORAGE_VERDICTS = [
    (40_000_000, 60, "FEASIBLE"),
    (40_000_000, 40, "CAUTIOUS"),
    (80_000_000, 100, "FEASIBLE"),
    (80_000_000, 60, "CAUTIOUS"),
]
NOT_RECOMMENDED_ABOVE = 100_000_000


def within_delta(edges: DataFrame, max_delta: int) -> DataFrame:
    return edges.filter(F.col("delta_seconds") <= max_delta)


def of_relations(edges: DataFrame, relations: list[str]) -> DataFrame:
    """On edges read from `relation_type=` folders this prunes the other folders."""
    return edges.filter(F.col("relation_type").isin(relations))


_PRECEDENCE = ["relation_priority", "delta_seconds", "src_record_id", "dst_record_id"]


def top_predecessors(edges: DataFrame, k: int) -> DataFrame:
    """The k best incoming edges of each flow: by priority, then shortest delay."""
    return top_k_per_key(edges, "dst_record_id", [F.col(c) for c in _PRECEDENCE], k)


def top_successors(edges: DataFrame, k: int) -> DataFrame:
    return top_k_per_key(edges, "src_record_id", [F.col(c) for c in _PRECEDENCE], k)


def view(
    edges: DataFrame,
    max_delta: int,
    relations: list[str] | None = None,
    predecessors: int | None = None,
    successors: int | None = None,
) -> DataFrame:
    """Delta and relation filter, then the predecessor cap, then the successor cap."""
    out = within_delta(edges, max_delta)
    if relations:
        out = of_relations(out, relations)
    if predecessors:
        out = top_predecessors(out, predecessors)
    if successors:
        out = top_successors(out, successors)
    return out


def _complete(edges: DataFrame) -> DataFrame:
    return edges.filter("coalesce(src_record_id, '') <> '' AND coalesce(dst_record_id, '') <> ''")


def out_degrees(edges: DataFrame) -> DataFrame:
    return _complete(edges).groupBy(F.col("src_record_id").alias("vertex")).agg(F.count(F.lit(1)).alias("degree"))


def in_degrees(edges: DataFrame) -> DataFrame:
    return _complete(edges).groupBy(F.col("dst_record_id").alias("vertex")).agg(F.count(F.lit(1)).alias("degree"))


def both_degrees(edges: DataFrame) -> DataFrame:
    """`side` (out or in), `vertex`, `degree` in one pass over the edges.

    Each edge is expanded to its two ends and counted map-side.
    """
    ends = F.explode(
        F.array(
            F.struct(F.lit("out").alias("side"), F.col("src_record_id").alias("vertex")),
            F.struct(F.lit("in").alias("side"), F.col("dst_record_id").alias("vertex")),
        )
    )
    return _complete(edges).select(ends.alias("e")).groupBy("e.side", "e.vertex").agg(F.count(F.lit(1)).alias("degree"))


def nearest_rank_summary(values: DataFrame, value: str, group: list[str]) -> DataFrame:
    """count, min, p50, p90, p95, p99, max per group by nearest rank `int(n * p / 100)`.

    Exact, from the histogram of distinct values; the column itself is never sorted.
    """
    positions = histogram_positions(values, value, group)

    def at(p: int) -> Column:
        index = F.least(F.expr(f"total * {p} div 100"), F.col("total") - 1)
        return F.max(F.when(index.between(F.col("first"), F.col("last")), F.col(value))).alias(f"p{p}")

    return positions.groupBy(*group).agg(
        F.sum("n").alias("count"),
        F.min(value).alias("min"),
        *[at(p) for p in PERCENTILES],
        F.max(value).alias("max"),
    )


def degree_summary(edges: DataFrame) -> DataFrame:
    return nearest_rank_summary(both_degrees(edges), "degree", ["side"])


def capped_size(edges: DataFrame, caps: tuple[int, ...] = CAPS) -> DataFrame:
    """Edges left when every flow keeps at most k predecessors, or successors."""
    degrees = both_degrees(edges)
    per_k = F.explode(F.array(*[F.lit(k) for k in caps]))
    sums = (
        degrees.select("side", "degree", per_k.alias("k"))
        .groupBy(F.col("k").cast("bigint").alias("k"))
        .agg(
            *[
                F.coalesce(F.sum(F.when(F.col("side") == side, F.least("degree", "k"))), F.lit(0)).alias(name)
                for side, name in (("in", "predecessor_capped_edges"), ("out", "successor_capped_edges"))
            ]
        )
    )
    return sums.select(
        "*",
        F.greatest("predecessor_capped_edges", "successor_capped_edges").alias("union_upper_bound"),
        F.expr("(predecessor_capped_edges + successor_capped_edges) div 2").alias("union_estimate"),
    )


def storage_model(
    capped: DataFrame, flow_count: int, free_gb: float, walks_per_flow: int = 2, walk_length: int = 10, dim: int = 64
) -> DataFrame:
    """Disk need of each cap and whether it fits into `free_gb`."""
    edges = F.col("union_estimate")
    walk_gb = flow_count * walks_per_flow * walk_length * WALK_BYTES_PER_TOKEN / GIB
    embedding_gb = flow_count * dim * 4 / GIB
    peak = edges * CSV_BYTES_PER_EDGE / GIB + edges * STORE_BYTES_PER_EDGE / GIB + F.lit(walk_gb) + F.lit(embedding_gb)
    free = F.lit(float(free_gb))
    verdict = F.when(edges > NOT_RECOMMENDED_ABOVE, "NOT_RECOMMENDED").otherwise("CAUTION")
    for most_edges, least_free, name in reversed(STORAGE_VERDICTS):
        verdict = F.when((edges <= most_edges) & (free >= least_free), name).otherwise(verdict)
    return capped.select(
        "k",
        edges.alias("edges"),
        F.round(edges * CSV_BYTES_PER_EDGE / GIB, 2).alias("csv_input_gb"),
        F.round(edges * STORE_BYTES_PER_EDGE / GIB, 2).alias("store_gb"),
        F.round(F.lit(walk_gb), 2).alias("walk_file_gb"),
        F.round(F.lit(embedding_gb * 1024), 2).alias("embedding_mb"),
        F.round(peak, 2).alias("total_peak_gb"),
        verdict.alias("verdict"),
    )


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation_type").agg(F.count(F.lit(1)).alias("edges"))


def graph_size(edges: DataFrame) -> DataFrame:
    """One row: total edges, unique sources, unique targets, vertices touched."""
    roles = both_degrees(edges).groupBy("vertex").agg(
        F.sum(F.when(F.col("side") == "out", F.col("degree")).otherwise(0)).alias("out"),
        F.sum(F.when(F.col("side") == "in", F.col("degree")).otherwise(0)).alias("in"),
    )
    return roles.agg(
        F.coalesce(F.sum("out"), F.lit(0)).alias("total_edges"),
        F.count_if(F.col("out") > 0).alias("unique_src"),
        F.count_if(F.col("in") > 0).alias("unique_dst"),
        F.count(F.lit(1)).alias("vertices"),
    )


def graph_counts(**tables: DataFrame) -> DataFrame:
    """`element`, `n` for every named vertex or edge table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("element"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionAll, parts)


def profile(flows: DataFrame) -> DataFrame:
    """Rows, distinct endpoints of both sides and distinct flow ids.

    The distincts are hash aggregations of their own: a joint countDistinct would expand
    every row once per counted column.
    """
    sides = flows.select(F.col("src_endpoint").alias("e")).union(flows.select(F.col("dst_endpoint").alias("e")))
    counts = {
        "rows": flows,
        "unique_endpoints": sides.distinct(),
        "unique_flow_ids": flows.select("flow_id").distinct(),
    }
    return graph_counts(**counts)


def top_values(flows: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """The n most frequent values of each column: `column`, `value`, `count`."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    counts = flows.select(cells.alias("c")).groupBy("c.column", "c.value").agg(F.count(F.lit(1)).alias("count"))
    return top_k_per_key(counts, "column", [F.desc("count"), F.col("value")], n)


def weighted_edges(
    edges: DataFrame, src: str, dst: str, weight: str | None, transform: str = "log1p", undirected: bool = False
) -> DataFrame:
    """`src`, `dst`, `w` BIGINT (millionths) and `fallback`, true where the weight was not positive.

    Integer weights make cumulative sums exact, so a draw picks the same neighbour in any
    engine and any partitioning.  Undirected adds each edge the other way round.
    """
    pairs = edges.select(
        F.col(src).alias("src"),
        F.col(dst).alias("dst"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("raw"),
    )
    if undirected:
        pairs = pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "raw"))
    raw = F.when(F.col("raw") > 0, F.col("raw")).otherwise(F.lit(1.0))
    value = {"none": raw, "sqrt": F.sqrt(raw), "log1p": F.log1p(raw)}[transform]
    fixed = F.greatest(F.round(value * 1_000_000).cast("bigint"), F.lit(1).cast("bigint"))
    unit = F.lit(1_000_000).cast("bigint")
    return pairs.select(
        "src",
        "dst",
        (fixed if weight else unit).alias("w"),
        (~F.coalesce(F.col("raw") > 0, F.lit(False))).alias("fallback"),
    )


def adjacency(weighted: DataFrame, chunk_rows: int = 4096) -> DataFrame:
    """`cur`, `chunk`, `nbrs`, `total`: neighbour lists in pieces of about `chunk_rows`.

    `nbrs` is sorted by neighbour and holds its weight and the running weight up to it.
    A vertex with more neighbours than a piece holds is cut by a hash of the neighbour, so
    no task ever holds a whole hub; all other vertices have the single piece 0.
    """
    merged = weighted.groupBy(F.col("src").alias("cur"), "dst").agg(F.sum("w").alias("w"))
    hubs = (
        merged.groupBy("cur")
        .agg(F.count(F.lit(1)).alias("degree"))
        .filter(F.col("degree") > chunk_rows)
        .select("cur", F.ceil(F.col("degree") / chunk_rows).cast("bigint").alias("pieces"))
    )
    piece = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("pieces")), F.lit(0).cast("bigint"))
    placed = lookup_join(merged, hubs, ["cur"], ["dst"]).withColumn("chunk", piece)
    running = Window.partitionBy("cur", "chunk").orderBy("dst")
    return (
        placed.withColumn("upto", F.sum("w").over(running))
        .groupBy("cur", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("dst", "w", "upto"))).alias("nbrs"), F.sum("w").alias("total"))
    )
