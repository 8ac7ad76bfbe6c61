"""How many candidate edges a causal graph will have, counted without enumerating pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.schema import DEFAULT_WINDOWS, RELATION_PRIORITY

# Fixed values of the size model.
CSV_BYTES_PER_EDGE = 180
PARQUET_SHARE = 0.35

MIN_BLOCK_SECONDS = 3600
TS = "timestamp_epoch"


def _block(seconds: Column, width: int) -> Column:
    return F.floor(seconds / F.lit(width)).cast("bigint")


def same_group_pairs(flows: DataFrame, keys: list[str], window: int | None) -> DataFrame:
    """Unordered pairs per key at most `window` seconds apart: `keys`, `pairs`.

    Flows are first counted per key and second.  The sliding sum runs per key and time
    block; the seconds after a block's end that its last flows can reach are repeated
    into it.  A block holds at most block + window distinct seconds, so a key that owns
    a third of all flows is spread over the time axis.
    """
    if window is None:
        n = F.count(F.lit(1))
        return flows.groupBy(*keys).agg((n * (n - 1)).alias("twice")).select(
            *keys, F.expr("twice div 2").alias("pairs")
        )
    width = max(window, MIN_BLOCK_SECONDS)
    ts = F.col(TS)
    own = _block(ts, width)
    counts = flows.groupBy(*keys, TS).agg(F.count(F.lit(1)).alias("n"))
    reached = _block(ts - window, width)
    placed = counts.select(
        *keys, TS, "n", own.alias("own"), F.explode(F.sequence(reached, own)).alias("block")
    )
    ahead = Window.partitionBy(*keys, "block").orderBy(TS).rangeBetween(1, window)
    later = F.coalesce(F.sum("n").over(ahead), F.lit(0))
    return (
        placed.withColumn("later", later)
        .filter("own = block")
        .groupBy(*keys)
        .agg(F.sum(F.expr("n * (n - 1) div 2 + n * later")).alias("pairs"))
    )


def two_sided_pairs(left: DataFrame, right: DataFrame, keys: list[str], window: int | None) -> DataFrame:
    """(left, right) pairs per key at most `window` seconds apart, in either order."""
    tagged = left.select(*keys, TS, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(*keys, TS, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    if window is None:
        sums = tagged.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
        return sums.select(*keys, (F.col("l") * F.col("r")).alias("pairs"))
    width = max(window, MIN_BLOCK_SECONDS)
    ts = F.col(TS)
    counts = tagged.groupBy(*keys, TS).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    placed = counts.select(
        *keys,
        TS,
        "l",
        "r",
        _block(ts, width).alias("own"),
        F.explode(F.sequence(_block(ts - window, width), _block(ts + window, width))).alias("block"),
    )
    near = Window.partitionBy(*keys, "block").orderBy(TS).rangeBetween(-window, window)
    return (
        placed.withColumn("near", F.coalesce(F.sum("r").over(near), F.lit(0)))
        .filter("own = block")
        .groupBy(*keys)
        .agg(F.sum(F.expr("l * near")).alias("pairs"))
    )


def _total(pairs: DataFrame, relation: str) -> DataFrame:
    return pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("bigint").alias("estimate")).select(
        F.lit(relation).alias("relation_type"), "estimate"
    )


def _cr_sides(flows: DataFrame) -> DataFrame:
    """Flows under a direction-free key; `forward` tells the direction, `mirror` a self-reverse key."""
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    return flows.select(
        "protocol",
        F.least(src, dst).alias("lo"),
        F.greatest(src, dst).alias("hi"),
        TS,
        (src <= dst).alias("forward"),
        (src == dst).alias("mirror"),
    )


def cr_pairs(flows: DataFrame, window: int | None) -> DataFrame:
    keys = ["protocol", "lo", "hi"]
    sides = _cr_sides(flows)
    mirrored = same_group_pairs(sides.filter("mirror"), keys, window)
    crossed = two_sided_pairs(
        sides.filter("NOT mirror AND forward"), sides.filter("NOT mirror AND NOT forward"), keys, window
    )
    return mirrored.unionByName(crossed)


def pr_pairs(flows: DataFrame, window: int | None) -> DataFrame:
    """Per host: flows that end there against flows that start there.

    Counts both orders and a flow against itself, so it is an upper estimate.
    """
    into = flows.select(F.col("dst_ip").alias("ip"), TS)
    out = flows.select(F.col("src_ip").alias("ip"), TS)
    return two_sided_pairs(into, out, ["ip"], window)


def dhr_pairs(flows: DataFrame, window: int | None) -> DataFrame:
    """Per source host: all pairs less those on one port."""
    hosts = same_group_pairs(flows, ["src_ip"], window).select(F.col("src_ip").alias("ip"), "pairs")
    ports = shr_pairs(flows, window).select(F.col("src_ip").alias("ip"), (-F.col("pairs")).alias("pairs"))
    return hosts.unionAll(ports).groupBy("ip").agg(F.sum("pairs").alias("pairs"))


def shr_pairs(flows: DataFrame, window: int | None) -> DataFrame:
    return same_group_pairs(flows, ["src_ip", "src_port"], window)


PAIR_COUNTERS = {"CR": cr_pairs, "PR": pr_pairs, "DHR": dhr_pairs, "SHR": shr_pairs}


def relation_estimate(
    flows: DataFrame, windows: dict[str, int | None] | None = None, relations: list[str] | None = None
) -> DataFrame:
    """`relation_type`, `estimate` for each asked relation."""
    windows = windows or DEFAULT_WINDOWS
    chosen = sorted(relations or RELATION_PRIORITY, key=RELATION_PRIORITY.get)
    return reduce(
        DataFrame.unionAll, [_total(PAIR_COUNTERS[r](flows, windows[r]), r) for r in chosen]
    )


def estimate_summary(flows: DataFrame, windows: dict[str, int | None] | None = None) -> DataFrame:
    """One row: estimate per relation, total and the two size estimates in bytes."""
    parts = relation_estimate(flows, windows)
    columns = [F.sum(F.when(F.col("relation_type") == r, F.col("estimate"))).alias(r) for r in RELATION_PRIORITY]
    total = F.col("total")
    return (
        parts.agg(*columns, F.sum("estimate").alias("total"))
        .withColumn("estimated_csv_size", total * CSV_BYTES_PER_EDGE)
        .withColumn("estimated_parquet_size", F.floor(total * CSV_BYTES_PER_EDGE * F.lit(PARQUET_SHARE)))
    )


def top_risk_groups(flows: DataFrame, windows: dict[str, int | None] | None = None, n: int = 20) -> DataFrame:
    """The n groups with most candidate edges over PR, DHR and SHR."""
    windows = windows or DEFAULT_WINDOWS
    pr = pr_pairs(flows, windows["PR"]).select(F.lit("PR").alias("relation_type"), F.col("ip").alias("grp"), "pairs")
    dhr = dhr_pairs(flows, windows["DHR"]).select(
        F.lit("DHR").alias("relation_type"), F.col("ip").alias("grp"), "pairs"
    )
    shr = shr_pairs(flows, windows["SHR"]).select(
        F.lit("SHR").alias("relation_type"),
        F.concat_ws(":", "src_ip", F.col("src_port").cast("string")).alias("grp"),
        "pairs",
    )
    return pr.unionAll(dhr).unionAll(shr).orderBy(F.desc("pairs"), "relation_type", "grp").limit(n)


class TooManyEdges(RuntimeError):
    """The estimate is above the caller's limit."""


def guard(
    flows: DataFrame,
    windows: dict[str, int | None],
    relations: list[str],
    max_edges: int,
    force: bool = False,
) -> dict[str, int]:
    """Estimate the selected relations and refuse to go on above `max_edges`.

    Runs one job and brings at most four counts to the driver.
    """
    counts = {r.relation_type: r.estimate for r in relation_estimate(flows, windows, relations).collect()}
    if sum(counts.values()) > max_edges and not force:
        raise TooManyEdges(f"estimated edges {counts} exceed the limit of {max_edges}")
    return counts
