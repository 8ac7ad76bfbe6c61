"""Joins and rankings that hold when one key owns a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key is heavy when it owns more rows than one task should take: TASK_ROWS, on small tables
# HEAVY_SHARE of the rows.  So there are fewer than 1 / HEAVY_SHARE or rows / TASK_ROWS heavy
# keys, whichever is more: 250,000 for 10^12 rows, which can be broadcast.
HEAVY_SHARE = 1 / 400
TASK_ROWS = 4_000_000


def heavy_keys(df: DataFrame, keys: list[str], share: float = HEAVY_SHARE, task_rows: int = TASK_ROWS) -> DataFrame:
    """Keys with more rows than a task should take, and `_salts`, the tasks to spread them over.

    Counts are combined map-side, so a heavy key costs no more than a rare one.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    most = F.least(total * F.lit(share), F.lit(float(task_rows)))
    return counts.filter(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_salts"))


def _with_salts(df: DataFrame, heavy: DataFrame) -> DataFrame:
    return df.join(F.broadcast(heavy), [c for c in heavy.columns if c != "_salts"], "left")


def salted(df: DataFrame, heavy: DataFrame, spread_by: list[str]) -> DataFrame:
    """Add `_salt`: rows of a heavy key are spread over its `_salts` values, others get 0."""
    spread = F.pmod(F.xxhash64(*spread_by), F.col("_salts")).cast("int")
    return _with_salts(df, heavy).withColumn("_salt", F.coalesce(spread, F.lit(0))).drop("_salts")


def repeated(df: DataFrame, heavy: DataFrame) -> DataFrame:
    """The other side of `salted`: rows of a heavy key once per salt, others once."""
    every = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    return _with_salts(df, heavy).withColumn("_salt", F.explode(every)).drop("_salts")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "left",
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Join a large, possibly skewed `left` to a `right` with few rows per key.

    Rows of a heavy key are spread over sub-keys by a hash of `spread_by`, and
    only the right rows of those keys are repeated.  `how` is inner, left, left_semi or
    left_anti: each left row meets each right row of its key exactly once.
    """
    if heavy is None:
        heavy = heavy_keys(left, keys)
    return salted(left, heavy, spread_by).join(repeated(right, heavy), [*keys, "_salt"], how).drop("_salt")


def top_k_per_key(df: DataFrame, key: str | list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key by a total order.

    The `<= k` filter on the row number lets Spark cut every key to k rows in each map
    task before the shuffle, so a heavy key sends k rows per task, not all its rows.
    """
    keys = [key] if isinstance(key, str) else key
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def histogram_positions(values: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """Distinct values with their first and last 0-based position in the sorted column.

    `value`, `n`, `first`, `last`, `total`.  Values are counted map-side first; only the
    distinct ones are ordered, within one task per `group`.
    """
    group = group or []
    counts = values.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.withColumn("last", F.sum("n").over(running) - 1)
        .withColumn("first", F.col("last") - F.col("n") + 1)
        .withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    )
