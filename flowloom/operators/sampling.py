"""Exact-size samples per split, the same rows in any table and on any cluster."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.hashing import TEST, TRAIN, VALID

PREFIX_DIGITS = 4


def _order_key(seeds: dict[str, int], split: str, key: str) -> Column:
    """md5 of `seed|key`, with the seed of the row's split."""
    seed = F.lit(None).cast("string")
    for name, value in seeds.items():
        seed = F.when(F.col(split) == name, F.lit(str(value))).otherwise(seed)
    return F.md5(F.concat_ws("|", seed, F.col(key)))


def split_seeds(seed: int) -> dict[str, int]:
    return {TRAIN: seed, VALID: seed + 1, TEST: seed + 2}


def sample_per_split(
    df: DataFrame, sizes: dict[str, int], seed: int, split: str = "split", key: str = "record_id"
) -> DataFrame:
    """Exactly `sizes[split]` rows of each split (all of them when it has fewer).

    The rows with the smallest hashes are taken.  Hash prefixes are counted first: whole
    prefixes below the cut are kept as they are, and only the rows of the one prefix on the
    cut are ranked.  The prefix table has at most 16^4 rows per split, whatever the input.
    """
    wanted = F.lit(0)
    for name, n in sizes.items():
        wanted = F.when(F.col(split) == name, F.lit(n)).otherwise(wanted)
    order = F.col("_order")
    keyed = df.filter(F.col(split).isin(list(sizes))).withColumn("_order", _order_key(split_seeds(seed), split, key))
    keyed = keyed.withColumn("_prefix", F.substring(order, 1, PREFIX_DIGITS))
    running = Window.partitionBy(split).orderBy("_prefix")
    cut = (
        keyed.groupBy(split, "_prefix")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_room", wanted - (F.col("_upto") - F.col("_n")))
        .filter("_room > 0")
        .select(split, "_prefix", "_room", (F.col("_room") >= F.col("_n")).alias("_whole"))
    )
    placed = keyed.join(F.broadcast(cut), [split, "_prefix"])
    rank = F.row_number().over(Window.partitionBy(split).orderBy("_order", key))
    edge = placed.filter("NOT _whole").withColumn("_rank", rank).filter("_rank <= _room").drop("_rank")
    return placed.filter("_whole").unionByName(edge).select(*df.columns)


def aligned_samples(
    tables: dict[str, DataFrame], ids_from: str, sizes: dict[str, int], seed: int
) -> dict[str, DataFrame]:
    """The rows sampled from one table, taken from every table."""
    ids = sample_per_split(tables[ids_from].select("record_id", "split"), sizes, seed).select("record_id")
    return {name: df.join(ids, "record_id", "left_semi") for name, df in tables.items()}


def alignment(tables: dict[str, DataFrame], base: str) -> DataFrame:
    """`table`, `rows`, `missing`, `extra`: ids of each table against those of `base`."""

    def against(name: str) -> DataFrame:
        ids, base_ids = tables[name].select("record_id"), tables[base].select("record_id")
        tagged = ids.select("record_id", F.lit(1).alias("own"), F.lit(0).alias("ref")).unionAll(
            base_ids.select("record_id", F.lit(0).alias("own"), F.lit(1).alias("ref"))
        )
        sides = tagged.groupBy("record_id").agg(F.sum("own").alias("own"), F.sum("ref").alias("ref"))
        return sides.agg(
            F.coalesce(F.sum("own"), F.lit(0)).alias("rows"),
            F.count_if(F.expr("own = 0")).alias("missing"),
            F.count_if(F.expr("ref = 0")).alias("extra"),
        ).select(F.lit(name).alias("table"), "*")

    return reduce(DataFrame.unionAll, [against(name) for name in tables])
