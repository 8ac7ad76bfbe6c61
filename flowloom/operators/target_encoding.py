"""Smoothed target encoding of endpoints, out of fold for training rows.

Class counts are kept per (key, fold) and taken from one aggregation.  What a training row
may see is the key's total less its own fold; validation and test rows see the total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.hashing import TRAIN, fold_of
from flowloom.operators.skew import heavy_keys, lookup_join

FOLDS = 5
SMOOTHING = 10.0
SEED = 20260525
OUTSIDE = -1  # fold of rows that are not trained on


def class_list(meta: DataFrame) -> list[str]:
    """Sorted distinct targets; the driver holds one string per class."""
    return [row.target for row in meta.select("target").distinct().orderBy("target").collect()]


def with_label_index(df: DataFrame, classes: list[str], target: str = "target", out: str = "y") -> DataFrame:
    """Position of the target in the sorted class list."""
    return df.withColumn(out, (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(target)) - 1).cast("int"))


def _dense_counts(classes: list[str]) -> list[Column]:
    return [F.count_if(F.col("target") == c).alias(f"c{i}") for i, c in enumerate(classes)]


def _packed(classes: list[str]) -> Column:
    return F.array(*[F.col(f"c{i}") for i in range(len(classes))])


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, n: acc + n)


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def class_prior(meta: DataFrame) -> DataFrame:
    """Share of each class among the training rows."""
    counts = meta.filter(F.col("split") == TRAIN).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("target", "n", (F.col("n") / counts.agg(F.sum("n")).scalar()).alias("prior"))


def with_fold(meta: DataFrame, seed: int = SEED, folds: int = FOLDS) -> DataFrame:
    fold = F.when(F.col("split") == TRAIN, fold_of(F.col("record_id"), seed, folds)).otherwise(F.lit(OUTSIDE))
    return meta.withColumn("fold", fold)


def _priors(folded: DataFrame, classes: list[str]) -> DataFrame:
    """`fold`, `prior`: class shares of all training rows outside the fold; folds + 1 rows."""
    counts = (
        folded.filter(F.col("fold") != OUTSIDE)
        .groupBy("fold")
        .agg(*_dense_counts(classes))
        .select("fold", _packed(classes).alias("counts"))
    )
    every = counts.agg(F.collect_list(F.struct("fold", "counts")).alias("parts"))
    return _without_each_fold(every, len(classes)).select(
        "fold", F.transform("rest", lambda n: n / _total(F.col("rest"))).alias("prior")
    )


def _without_each_fold(parts: DataFrame, classes: int) -> DataFrame:
    """From `parts` (fold, counts): one row per fold with the other folds' counts, and the whole."""
    nothing = F.array_repeat(F.lit(0).cast("bigint"), classes)
    whole = F.aggregate("parts", nothing, lambda acc, p: _added(acc, p["counts"]))
    others = [c for c in parts.columns if c != "parts"]
    total = parts.select(*others, whole.alias("whole"), "parts")
    outside = F.array(F.struct(F.lit(OUTSIDE).alias("fold"), nothing.alias("counts")))
    part = total.select(*others, "whole", F.explode(F.concat("parts", outside)).alias("p"))
    rest = F.zip_with("whole", "p.counts", lambda a, b: a - b)
    return part.select(*others, F.col("p.fold").alias("fold"), rest.alias("rest"))


def encodings(
    folded: DataFrame, key: str, classes: list[str], smoothing: float = SMOOTHING
) -> DataFrame:
    """`key`, `fold`, `te`: (n_c + m * prior_c) / (n + m) per class.

    The rows are combined map-side to one row per (key, fold); the list then collected per
    key has one item per fold.
    """
    per_fold = (
        folded.filter(F.col("fold") != OUTSIDE)
        .groupBy(key, "fold")
        .agg(*_dense_counts(classes))
        .groupBy(key)
        .agg(F.collect_list(F.struct("fold", _packed(classes).alias("counts"))).alias("parts"))
    )
    rest = _without_each_fold(per_fold, len(classes)).join(F.broadcast(_priors(folded, classes)), "fold")
    n = _total(F.col("rest"))
    te = F.zip_with("rest", "prior", lambda c, prior: (c + F.lit(smoothing) * prior) / (n + F.lit(smoothing)))
    return rest.select(key, "fold", te.alias("te"))


def target_encoding(
    meta: DataFrame,
    keys: dict[str, str],
    classes: list[str] | None = None,
    smoothing: float = SMOOTHING,
    seed: int = SEED,
    folds: int = FOLDS,
) -> DataFrame:
    """Add one array per key: `keys` maps a key column to the name of its encoding.

    A key unseen among the rows it may learn from gets the prior.
    """
    classes = classes or class_list(meta)
    folded = with_fold(meta, seed, folds)
    priors = F.broadcast(_priors(folded, classes))
    out = folded
    for key, name in keys.items():
        table = encodings(folded, key, classes, smoothing).withColumnRenamed("te", "_te")
        joined = lookup_join(out, table, [key, "fold"], ["record_id"], heavy=heavy_keys(meta, [key]))
        out = (
            joined.join(priors, "fold", "left")
            .withColumn(name, F.coalesce("_te", "prior"))
            .drop("_te", "prior")
        )
    return out.drop("fold")


ENDPOINT_KEYS = {"src_endpoint": "te_src", "dst_endpoint": "te_dst"}


def encoded_features(meta: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """D_te: encodings of both endpoints; join A (E_te) and B (F_te) with `features.fuse`."""
    return target_encoding(meta, ENDPOINT_KEYS, classes).select("record_id", "target", "split", "te_src", "te_dst")


def te_layout(classes: int) -> dict[str, tuple[str, int]]:
    return {"te_src": ("te_src_", classes), "te_dst": ("te_dst_", classes)}


def build_summary(d_te: DataFrame) -> DataFrame:
    """One row: rows, training rows, encoded columns, and rows whose blocks do not sum to one."""
    off = F.lit(False)
    for name in ("te_src", "te_dst"):
        total = F.aggregate(name, F.lit(0.0), lambda acc, v: acc + v)
        off = off | (F.abs(total - 1.0) > 1e-6)
    return d_te.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("split") == TRAIN).alias("train_rows"),
        F.max(F.size("te_src") + F.size("te_dst")).cast("bigint").alias("encoded_columns"),
        F.count_if(off).alias("bad_blocks"),
    )
