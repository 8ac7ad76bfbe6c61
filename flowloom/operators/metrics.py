"""Classification metrics from a confusion table; one aggregation over the predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.skew import top_k_per_key


def confusion(predictions: DataFrame, truth: str = "target", guess: str = "prediction") -> DataFrame:
    """`truth`, `guess`, `n`: at most classes^2 rows, counted map-side."""
    return predictions.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(
        F.count(F.lit(1)).alias("n")
    )


def per_class(counts: DataFrame) -> DataFrame:
    """`label`, precision, recall, f1, support, predicted for labels in truth or prediction.

    A ratio with nothing to divide by is 0.
    """
    roles = F.explode(
        F.array(
            F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
            F.struct(F.col("guess").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
        )
    )
    hit = F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)
    sums = (
        counts.select(roles.alias("r"), (hit / 2).alias("hit"), "truth", "guess")
        .groupBy("r.label")
        .agg(F.sum("r.support").alias("support"), F.sum("r.predicted").alias("predicted"), F.sum("hit").alias("hit"))
    )
    precision = F.when(F.col("predicted") > 0, F.col("hit") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    both = F.col("support") + F.col("predicted")
    f1 = F.when(both > 0, 2 * F.col("hit") / both).otherwise(0.0)
    return sums.select(
        "label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "predicted", "hit"
    )


def summary(predictions: DataFrame, truth: str = "target", guess: str = "prediction") -> DataFrame:
    """One row: accuracy, macro and weighted precision, recall and F1, rows.

    Macro means run over labels seen in truth or prediction.
    """
    table = per_class(confusion(predictions, truth, guess))
    names = ("precision", "recall", "f1")
    support = F.sum("support")
    return table.agg(
        (F.sum("hit") / support).alias("accuracy"),
        *[F.avg(n).alias(f"macro_{n}") for n in names],
        *[(F.sum(F.col(n) * F.col("support")) / support).alias(f"weighted_{n}") for n in names],
        support.alias("rows"),
    )


def class_report(predictions: DataFrame, labels: DataFrame, truth: str = "target", guess: str = "prediction") -> DataFrame:
    """One row per label of `labels` (column `label`), zeros for labels never seen."""
    table = per_class(confusion(predictions, truth, guess)).drop("predicted", "hit")
    joined = labels.select("label").distinct().join(table, "label", "left")
    zeros = {"precision": 0.0, "recall": 0.0, "f1": 0.0, "support": 0}
    return joined.na.fill(zeros)


def confusion_matrix(
    predictions: DataFrame, labels: list[str], truth: str = "target", guess: str = "prediction"
) -> DataFrame:
    """`truth` and one column per label: every label is a row and a column."""
    spark = predictions.sparkSession
    rows = spark.createDataFrame([(label,) for label in labels], "truth string")
    cells = confusion(predictions, truth, guess).groupBy("truth").pivot("guess", labels).agg(F.sum("n"))
    return rows.join(cells, "truth", "left").na.fill(0)


def prediction_sample(predictions: DataFrame, n: int = 5000) -> DataFrame:
    """The first n predictions in record order, as a report shows them."""
    return predictions.select(
        "record_id", F.col("target").alias("y_true"), F.col("prediction").alias("y_pred")
    ).orderBy("record_id").limit(n)


def top_confusion(counts: DataFrame, n: int = 20) -> DataFrame:
    """Row shares of the confusion table among the n labels with most support.

    `truth`, `guess`, `share` for each pair of those labels; a row without counts is 0.
    """
    support = counts.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"))
    everyone = support.withColumn("_all", F.lit(0))
    top = top_k_per_key(everyone, "_all", [F.desc("support"), F.col("label")], n).select("label")
    as_truth = top.select(F.col("label").alias("truth"), F.lit(0).alias("_all"))
    as_guess = top.select(F.col("label").alias("guess"), F.lit(0).alias("_all"))
    grid = as_truth.join(as_guess, "_all").drop("_all")  # n^2 cells of a report table
    cells = grid.join(counts, ["truth", "guess"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("truth"))
    return cells.select("truth", "guess", F.when(total > 0, F.col("n") / total).otherwise(0.0).alias("share"))


def compare_reports(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per-class F1 of two runs side by side: `label`, `f1_left`, `f1_right`, `change`."""
    joined = left.select("label", F.col("f1").alias("f1_left")).join(
        right.select("label", F.col("f1").alias("f1_right")), "label", "full"
    )
    joined = joined.na.fill(0.0, ["f1_left", "f1_right"])
    return joined.withColumn("change", F.col("f1_right") - F.col("f1_left"))


# ---------------------------------------------------------------- result rows


def result_row(predictions: DataFrame, group: str, model: str, feature_count: int | None = None) -> DataFrame:
    """Metrics of one completed run, labelled with its feature group and model."""
    return summary(predictions).select(
        F.lit(group).alias("feature_group"),
        F.lit(model).alias("model_name"),
        F.lit("completed").alias("status"),
        F.lit(feature_count).cast("bigint").alias("feature_count"),
        "*",
    )


def union_results(parts: list[DataFrame]) -> DataFrame:
    """Rows of many runs; a column that a run lacks becomes NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _completed(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == "completed")


def best_runs(results: DataFrame) -> DataFrame:
    """`metric`, `feature_group`, `model_name`, `value` of the best macro and weighted F1."""
    done = _completed(results)
    cells = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("macro_f1", "weighted_f1")])
    )
    long = done.select("feature_group", "model_name", cells.alias("c")).select(
        "c.metric", "feature_group", "model_name", "c.value"
    )
    return top_k_per_key(long, "metric", [F.desc("value"), F.col("feature_group"), F.col("model_name")], 1)


def model_by_group(results: DataFrame, groups: list[str], metric: str = "macro_f1") -> DataFrame:
    """Best metric per model (rows) and feature group (columns)."""
    return _completed(results).groupBy("model_name").pivot("feature_group", groups).agg(F.max(metric))


GROUP_GAINS = [("C", "A"), ("C", "B"), ("E", "A"), ("F", "C")]


def gains(results: DataFrame, metric: str = "macro_f1", boosted: str = "boosted", tree: str = "tree") -> DataFrame:
    """`comparison`, `subject`, `gain`: feature groups per model, B against the dummies, boosted against tree.

    A comparison that lacks a side is left out.
    """
    done = _completed(results)
    pivot = model_by_group(results, sorted({g for pair in GROUP_GAINS for g in pair}), metric)
    per_model = F.inline(
        F.array(
            *[
                F.struct(F.lit(f"{a}-{b}").alias("comparison"), F.col("model_name").alias("subject"), (F.col(a) - F.col(b)).alias("gain"))
                for a, b in GROUP_GAINS
            ]
        )
    )
    between_groups = pivot.select(per_model)
    dummy = F.max(F.when(F.col("model_name").startswith("dummy_"), F.col(metric)))
    b_best = F.max(F.when(F.col("feature_group") == "B", F.col(metric)))
    against_dummy = done.agg((b_best - dummy).alias("gain")).select(
        F.lit("B-dummy").alias("comparison"), F.lit("best").alias("subject"), "gain"
    )
    by_group = done.groupBy("feature_group").agg(
        *[F.max(F.when(F.col("model_name") == name, F.col(metric))).alias(side) for name, side in ((boosted, "x"), (tree, "y"))]
    )
    against_tree = by_group.select(
        F.lit("boosted-tree").alias("comparison"), F.col("feature_group").alias("subject"), (F.col("x") - F.col("y")).alias("gain")
    )
    return between_groups.unionAll(against_dummy).unionAll(against_tree).filter("gain IS NOT NULL")


def divergence(results: DataFrame) -> DataFrame:
    """Weighted less macro F1 of each run, and training seconds per feature where known."""
    seconds = F.col("train_seconds") / F.col("feature_count") if "train_seconds" in results.columns else F.lit(None).cast("double")
    return _completed(results).select(
        "feature_group",
        "model_name",
        (F.col("weighted_f1") - F.col("macro_f1")).alias("weighted_minus_macro"),
        seconds.alias("seconds_per_feature"),
    )


# Feature families by name prefix, first match wins.
FAMILIES = [
    ("raw_", "raw_*"),
    ("hcg_src_emb_", "hcg_src_emb_*"),
    ("hcg_dst_emb_", "hcg_dst_emb_*"),
    ("hcg_absdiff_emb_", "hcg_absdiff_emb_*"),
    ("hcg_prod_emb_", "hcg_prod_emb_*"),
]
MISSING_FLAGS = ["hcg_src_emb_missing", "hcg_dst_emb_missing"]


def feature_family(feature):
    family = F.when(feature.isin(MISSING_FLAGS), "hcg_missing_flags")
    for prefix, name in FAMILIES:
        family = family.when(feature.startswith(prefix), name)
    return family.otherwise("other")


def importance_by_family(importances: DataFrame) -> DataFrame:
    """Summed importance per feature family of (`feature`, `importance`)."""
    return importances.groupBy(feature_family(F.col("feature")).alias("family")).agg(
        F.sum("importance").alias("importance")
    )


def top_importances(importances: DataFrame, n: int = 30) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)
