"""Embeddings of endpoints and flows learned from walks, and their diagnosis."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions import hashing, vectors
from flowloom.operators.skew import heavy_keys, histogram_positions, lookup_join, top_k_per_key
from flowloom.session import cut_lineage, in_steps

# MLlib keeps the whole vector table on the driver while it learns.  Above this many
# numbers (2 GB) use `skipgram.train_skipgram`, which has no such limit.
MAX_MODEL_NUMBERS = 500_000_000
# Numbers of a block of vectors, of which a task has two: 4096 rows of 64, so that small tables are spread too.
MAX_QUERY_NUMBERS = 262_144
# Blocks that meet the whole table at once: the table is shuffled once for each of them.
STEP_BLOCKS = 16


class ModelTooLarge(ValueError):
    """The vector table would not fit the driver."""


def train_word2vec(
    walks: DataFrame, dim: int = 64, window: int = 5, min_count: int = 1, epochs: int = 5, seed: int = 42,
    partitions: int | None = None,
) -> DataFrame:
    """`token`, `emb` from MLlib's skip-gram Word2Vec over `tokens`.

    MLlib trains with hierarchical softmax, so vectors differ from a negative-sampling
    trainer's; use the diagnostics below to compare.  The vocabulary is counted first and
    training is refused when the model would not fit the driver.
    """
    words = walks.select(F.explode("tokens").alias("token")).groupBy("token").count().filter(F.col("count") >= min_count)
    vocabulary = words.count()
    if vocabulary * dim * 2 > MAX_MODEL_NUMBERS:
        raise ModelTooLarge(f"{vocabulary} tokens x {dim} exceed the model limit of {MAX_MODEL_NUMBERS} numbers")
    model = Word2Vec(
        vectorSize=dim,
        windowSize=window,
        minCount=min_count,
        maxIter=epochs,
        numPartitions=partitions or walks.sparkSession.sparkContext.defaultParallelism,
        seed=seed,
        inputCol="tokens",
        outputCol="unused",
    ).fit(walks)
    return model.getVectors().select(
        F.col("word").alias("token"), vector_to_array("vector", "float32").alias("emb")
    )


def embedding_table(learned: DataFrame, id_map: DataFrame, key: str = "endpoint_id") -> DataFrame:
    """`key`, `vid`, `emb`: learned vectors with their vertex number, NULL where the map has none."""
    return learned.join(id_map.select("token", "vid"), "token", "left").select(F.col("token").alias(key), "vid", "emb")


def embedding_coverage(table: DataFrame) -> DataFrame:
    """One row: rows, rows without vid, share with one, NaN and infinite numbers."""
    rows = F.count(F.lit(1))
    missing = F.count_if(F.col("vid").isNull())
    bad = F.filter("emb", lambda v: v.isNull() | F.isnan(v))
    infinite = F.filter("emb", lambda v: F.abs(v) == F.lit(float("inf")))
    return table.agg(
        rows.alias("rows"),
        missing.alias("missing_vid"),
        F.when(rows > 0, (rows - missing) / rows).otherwise(F.lit(0.0)).alias("coverage"),
        F.coalesce(F.sum(F.size(bad)), F.lit(0)).alias("nan_count"),
        F.coalesce(F.sum(F.size(infinite)), F.lit(0)).alias("inf_count"),
    )


def corpus_checks(walks: DataFrame, table: DataFrame, key: str = "endpoint_id") -> DataFrame:
    """One row: walks read, distinct tokens, embedded tokens, tokens on one side only."""
    seen = walks.select(F.explode("tokens").alias("token")).distinct().select("token", F.lit(1).alias("walk"))
    known = table.select(F.col(key).alias("token"), F.lit(1).alias("emb"))
    lines = walks.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        seen.join(known, "token", "full")
        .agg(
            F.count("walk").alias("walk_tokens"),
            F.count("emb").alias("embedded_tokens"),
            F.count_if(F.col("emb").isNull()).alias("not_embedded"),
            F.count_if(F.col("walk").isNull()).alias("not_walked"),
        )
        .withColumn("walks", lines)
    )


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, dim))


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _k_largest(score: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the k largest finite scores of each row after rounding; equal ones go by column.

    The k-th largest of the maxima over runs of columns is no more than the k-th largest score, so only
    scores from there on are rounded and sorted.
    """
    maxima = np.fmax.reduceat(score, np.arange(0, score.shape[1], RUN_COLUMNS), axis=1)
    if maxima.shape[1] > k:
        limit = -np.partition(-np.where(np.isnan(maxima), -np.inf, maxima), k - 1, axis=1)[:, k - 1]
        # Rounding moves two scores towards each other by one unit of the last digit at most.
        line, column = np.nonzero(score >= (limit - 2 * 10.0**-digits)[:, None])
    else:
        line, column = np.nonzero(score > -np.inf)
    value = score[line, column]
    finite = np.isfinite(value)
    line, column, value = line[finite], column[finite], np.round(value[finite], digits) + 0.0
    order = np.lexsort((column, -value, line))
    line, column, value = line[order], column[order], value[order]
    kept = np.arange(len(line)) - np.searchsorted(line, line) < k
    return line[kept], column[kept], value[kept]


def nearest(
    queries: DataFrame, table: DataFrame, key: str, k: int = 5, digits: int = 6, block_numbers: int = MAX_QUERY_NUMBERS
) -> DataFrame:
    """`query`, `neighbour`, `similarity`, `rank`: the k most similar rows of each query by cosine.

    Both sides are cut into hashed blocks of bounded size; each pair of blocks is one group and gives its k
    best per query, so pairs are never rows and no vector passes the driver.  Some query blocks at a
    time meet the table, and their neighbours are written.  Ties go to the smaller key; a row is no
    neighbour of itself.
    """
    left, n_query = _blocked(queries, key, block_numbers)
    right, n_table = _blocked(table, key, block_numbers)
    order = [F.desc("similarity"), F.col("neighbour")]

    def best(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query": [], "neighbour": [], "similarity": []})]
        if len(q) and len(t):
            t = t.sort_values("q", kind="stable", ignore_index=True)
            names, ids = q["q"].to_numpy(dtype=object), t["q"].to_numpy(dtype=object)
            numbers = pd.factorize(np.concatenate([names, ids]), use_na_sentinel=False)[0]
            own, others = numbers[: len(names)], numbers[len(names) :]
            shared = len(np.intersect1d(own, others)) > 0
            a, b = _unit(_matrix(q["emb"], 0)), _unit(_matrix(t["emb"], 0))
            rows = max(1, MAX_SCORES // len(t))
            for first in range(0, len(a), rows):
                score = a[first : first + rows] @ b.T
                if shared:
                    score[own[first : first + rows, None] == others[None, :]] = -np.inf
                line, column, value = _k_largest(score, k, digits)
                parts.append(pd.DataFrame({"query": names[first + line], "neighbour": ids[column], "similarity": value}))
        return pd.concat(parts[1:] or parts, ignore_index=True)

    def step(low: int, high: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(n_table - 1)))
        mine = left.filter(F.col("block").between(low, high)).select("q", "emb", F.col("block").alias("qb"), every.alias("tb"))
        met = right.select("q", "emb", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("qb"), F.col("block").alias("tb"))
        found = mine.groupBy("qb", "tb").cogroup(met.groupBy("qb", "tb")).applyInPandas(best, "query string, neighbour string, similarity double")
        return top_k_per_key(found, "query", order, k)

    found = in_steps(n_query, step, STEP_BLOCKS)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))


# Scores that a task has at once (32 MB); columns whose largest score is looked at first.
MAX_SCORES = 4_000_000
RUN_COLUMNS = 64


def _blocked(table: DataFrame, key: str, block_numbers: int) -> tuple[DataFrame, int]:
    """(q, emb, block) of every row with a vector, stored, and the number of blocks, by a hash of the key."""
    rows = cut_lineage(table.select(F.col(key).cast("string").alias("q"), "emb").filter("emb IS NOT NULL"))
    size = rows.agg(F.coalesce(F.sum(F.size("emb")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_numbers))
    return rows.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")), blocks


def sample_rows(table: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows with the smallest seeded hashes: the same sample on any cluster."""
    return table.orderBy(hashing.draw_int(F.lit(seed), F.col(key)), key).limit(n)


def pca_variance(
    table: DataFrame, key: str, k: int = 10, sample: int | None = None, seed: int = 42
) -> DataFrame:
    """`component`, `ratio`: variance share of the first k principal components.

    Over the whole table unless a sample is asked for.  Only the dim x dim covariance reaches
    the driver.  Rows without a vector are passed over; an empty table has no components.
    """
    table = table.filter("emb IS NOT NULL")
    rows = sample_rows(table, key, sample, seed) if sample else table
    first = rows.select(F.size("emb").alias("n")).first()
    if first is None:
        return table.sparkSession.createDataFrame([], "component int, ratio double")
    dim = first.n
    fitted = PCA(k=min(k, dim), inputCol="v", outputCol="unused").fit(rows.select(array_to_vector("emb").alias("v")))
    values = [(i + 1, float(v)) for i, v in enumerate(fitted.explainedVariance.toArray())]
    return table.sparkSession.createDataFrame(values, "component int, ratio double")


def _place_counts(cosines: np.ndarray, scale: int) -> np.ndarray:
    """Counts of the cosines times `scale`, as whole numbers from -scale - 1 to scale + 1: nothing is sorted."""
    return np.bincount(np.rint(cosines * scale).astype(np.int64) + (scale + 1), minlength=2 * scale + 3)


def pair_cosine_spread(table: DataFrame, key: str, digits: int = 6, block_numbers: int = MAX_QUERY_NUMBERS) -> DataFrame:
    """Median and mean cosine over all pairs of the table, and the pair count.

    Blocks of a checked size meet in Spark, each pair of blocks once; a task turns them into counts
    of rounded cosines, so pairs are never rows and no vector passes the driver.  The work is
    that of all pairs: give a sample (`sample_rows`) where that is too much.
    """
    rows, blocks = _blocked(table, key, block_numbers)
    scale = 10**digits  # a task counts 2 * scale + 3 rounded cosines (16 MB of counts for 6 digits)

    def count_values(pair: tuple, q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"cosine": np.zeros(0), "pairs": np.zeros(0, np.int64)})]
        if len(q) and len(t):
            names, ids = q["q"].to_numpy(dtype=object), t["q"].to_numpy(dtype=object)
            a, b = _unit(_matrix(q["emb"], 0)), _unit(_matrix(t["emb"], 0))
            # A row without finite numbers at unit length has no cosine with any other.
            at_q, at_t = np.isfinite(a).all(axis=1), np.isfinite(b).all(axis=1)
            names, a, ids, b = names[at_q], a[at_q], ids[at_t], b[at_t]
            lines = max(1, MAX_SCORES // len(t))
            total = np.zeros(2 * scale + 3, np.int64)
            for first in range(0, len(a), lines):
                score = a[first : first + lines] @ b.T
                # Within a block each pair once; rows of different blocks have different keys.
                wanted = score[ids[None, :] > names[first : first + lines, None]] if pair[0] == pair[1] else score.ravel()
                total += _place_counts(wanted, scale)
            seen = np.flatnonzero(total)
            parts.append(pd.DataFrame({"cosine": (seen - (scale + 1)) / float(scale), "pairs": total[seen]}))
        return parts[-1]

    def step(low: int, high: int) -> DataFrame:
        mine = rows.filter(F.col("block").between(low, high))
        mine = mine.select("q", "emb", F.col("block").alias("a"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("b"))
        met = rows.filter(F.col("block") >= low)
        met = met.select("q", "emb", F.explode(F.sequence(F.lit(low), F.least("block", F.lit(high)))).alias("a"), F.col("block").alias("b"))
        found = mine.groupBy("a", "b").cogroup(met.groupBy("a", "b")).applyInPandas(count_values, "cosine double, pairs long")
        return found.groupBy("cosine").agg(F.sum("pairs").alias("pairs"))

    counts = in_steps(blocks, step, STEP_BLOCKS).groupBy("cosine").agg(F.sum("pairs").alias("n"))
    return _weighted_median(counts, "cosine", "cosine").withColumnRenamed("total", "pairs")


def _weighted_median(counts: DataFrame, value: str, name: str) -> DataFrame:
    """`<name>_median`, `<name>_mean`, `total` of a histogram (value, n)."""
    running = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy())
    placed = counts.withColumn("last", F.sum("n").over(running) - 1).withColumn("total", total)
    placed = placed.withColumn("first", F.col("last") - F.col("n") + 1)

    def at(index: str):
        return F.max(F.when(F.expr(index).between(F.col("first"), F.col("last")), F.col(value)))

    return placed.agg(
        ((at("(total - 1) div 2") + at("total div 2")) / 2).alias(f"{name}_median"),
        (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias(f"{name}_mean"),
        F.max("total").alias("total"),
    )


def mean_pair_cosine(table: DataFrame) -> DataFrame:
    """Mean cosine over all pairs of the whole table, from vector sums alone.

    The sum over pairs of unit vectors is (|sum of units|^2 - number of units) / 2, so one
    aggregation per dimension is enough at any size.
    """
    size = vectors.norm(F.col("emb"))
    unit = F.transform("emb", lambda v: F.when(F.col("size") > 0, v.cast("double") / F.col("size")).otherwise(F.lit(0.0)))
    units = table.select("emb", size.alias("size")).select(unit.alias("unit"), (F.col("size") > 0).cast("long").alias("one"))
    sums = units.select(F.posexplode("unit").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"))
    squared = sums.agg(F.sum(F.col("s") * F.col("s"))).scalar()
    counts = units.agg(F.count(F.lit(1)).alias("n"), F.sum("one").alias("nonzero"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return counts.select("n", ((squared - F.col("nonzero")) / 2 / pairs).alias("cosine_mean"))


def norm_spread(table: DataFrame) -> DataFrame:
    """Median (interpolated) and population standard deviation of the vector length, over the whole table.

    Rows without a vector, or with a number in it that is not finite, are passed over.
    """
    size = table.select(vectors.norm(F.col("emb")).alias("size")).filter(F.col("size") < float("inf"))
    n = size.count()
    low, high = (value_at_rank(size, "size", rank) if n else None for rank in ((n - 1) // 2, n // 2))
    median = F.lit((low + high) / 2 if n else None).cast("double")
    return size.agg(F.any_value(median).alias("norm_median"), F.stddev_pop("size").alias("norm_std"))


def value_at_rank(df: DataFrame, column: str, rank: int, ranges: int = 4096) -> float:
    """The value at a rank, from 0, of the sorted numbers of a column.

    Counts over equal ranges, then again within the range that holds the rank, until it holds
    one value: each pass is one aggregation and `ranges` rows for the driver, at any size.
    """
    value = F.col(column).cast("double")
    low, high = df.agg(F.min(value), F.max(value)).first()
    while low < high:
        place = F.least(F.floor((value - low) / (high - low) * ranges), F.lit(ranges - 1))
        counts = df.filter(value.between(low, high)).groupBy(place.alias("at"))
        for r in counts.agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).orderBy("at").collect():
            if rank < r["n"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["n"]
    return low


def neighbour_meaning(neighbours: DataFrame, info: DataFrame) -> DataFrame:
    """What near flows share: one row over (query, neighbour, similarity) pairs.

    `info` has record_id, src_endpoint, target, timestamp_epoch.
    """
    attributes = ["src_endpoint", "target", "timestamp_epoch"]

    def side(name: str, prefix: str) -> DataFrame:
        return info.select(
            F.col("record_id").alias(name),
            *[F.col(c).alias(f"{prefix}_{c}") for c in attributes],
            hashing.record_ordinal(F.col("record_id")).alias(f"{prefix}_ordinal"),
        )

    # As many pairs as queries times k: their size is left to adaptive execution.
    pairs = neighbours.join(side("query", "q"), "query").join(side("neighbour", "n"), "neighbour")
    gap = F.abs(F.col("q_ordinal") - F.col("n_ordinal"))
    seconds = F.abs(F.col("q_timestamp_epoch") - F.col("n_timestamp_epoch"))
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("similarity").alias("mean_cosine"),
        F.avg((F.col("q_src_endpoint") == F.col("n_src_endpoint")).cast("double")).alias("same_endpoint_rate"),
        F.avg((F.col("q_target") == F.col("n_target")).cast("double")).alias("same_target_rate"),
        F.percentile(gap, 0.5).alias("record_gap_median"),
        F.percentile(gap, 0.9).alias("record_gap_p90"),
        F.percentile(seconds, 0.5).alias("time_gap_median"),
        F.percentile(seconds, 0.9).alias("time_gap_p90"),
    )


def first_neighbour_agreement(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of queries whose nearest row carries the same label (`key`, `label`)."""
    own = labels.select(F.col("key").alias("query"), F.col("label").alias("own"))
    other = labels.select(F.col("key").alias("neighbour"), F.col("label").alias("other"))
    first = neighbours.filter("rank = 1").join(own, "query").join(other, "neighbour")
    return first.agg(
        F.count(F.lit(1)).alias("queries"), F.avg((F.col("own") == F.col("other")).cast("double")).alias("same_label_rate")
    )


def missing_rate(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Share of rows whose key has no vector."""
    known = table.select(key, F.lit(1).alias("hit"))
    return lookup_join(rows.select(key, "record_id"), known, [key], ["record_id"]).agg(
        F.count(F.lit(1)).alias("rows"), (F.count_if(F.col("hit").isNull()) / F.count(F.lit(1))).alias("missing_rate")
    )


# ---------------------------------------------------------------- label homogeneity


def majority_share(meta: DataFrame) -> DataFrame:
    """Share of the largest class: the accuracy of always guessing it."""
    counts = meta.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.max("n") / F.sum("n")).alias("majority_share"))


def label_purity(meta: DataFrame, key: str) -> DataFrame:
    """Mean over keys of the largest class share within the key."""
    per_class = meta.groupBy(key, "target").agg(F.count(F.lit(1)).alias("n"))
    per_key = per_class.groupBy(key).agg((F.max("n") / F.sum("n")).alias("purity"))
    return per_key.agg(F.count(F.lit(1)).alias("keys"), F.avg("purity").alias("mean_purity"))


def pair_agreement(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per relation, the share of edges whose two flows carry the same label.

    A busy flow may own many edges, so both lookups spread heavy flows; they are counted on
    `edges` itself, so give a stored table.
    """
    ends = edges.select("src_record_id", "dst_record_id", "relation_type")
    left = labels.select(F.col("record_id").alias("src_record_id"), F.col("label").alias("a"))
    right = labels.select(F.col("record_id").alias("dst_record_id"), F.col("label").alias("b"))
    busy = heavy_keys(ends, ["dst_record_id"])
    both = lookup_join(ends, left, ["src_record_id"], ["dst_record_id"], "inner")
    both = lookup_join(both, right, ["dst_record_id"], ["src_record_id"], "inner", heavy=busy)
    return both.groupBy("relation_type").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement")
    )


def group_agreement(meta: DataFrame, key: list[str]) -> DataFrame:
    """P(two rows of one key share a label), from class counts without building the pairs."""
    per_class = meta.groupBy(*key, "target").agg(F.count(F.lit(1)).alias("n"))
    per_key = per_class.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    every = F.sum(F.col("n") * (F.col("n") - 1))
    return per_key.agg(
        F.sum("same").alias("same_pairs"),
        every.alias("ordered_pairs"),
        F.when(every > 0, F.sum("same") / every).alias("agreement"),
    )


def group_sizes(meta: DataFrame, key: list[str]) -> DataFrame:
    """Number of groups, 90th percentile (interpolated) and maximum of the group size.

    The percentile is taken over the histogram of sizes.
    """
    sizes = meta.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    spread = histogram_positions(sizes, "size")
    return spread.agg(
        F.sum("n").alias("groups"), F.percentile("size", 0.9, F.col("n")).alias("size_p90"), F.max("size").alias("size_max")
    )
