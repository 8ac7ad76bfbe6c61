"""Flow classifiers: two baselines as DataFrame queries, the rest with MLlib."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.hashing import TEST, TRAIN, draw, record_ordinal
from flowloom.operators import features as feature_ops
from flowloom.operators import boosting, knn, metrics, sampling
from flowloom.operators.target_encoding import class_list, with_label_index
from flowloom.session import cut_lineage

MAX_DEPTH = 30  # MLlib refuses deeper trees


def _class_counts(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == TRAIN).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def predict_majority(df: DataFrame) -> DataFrame:
    """Most frequent training class for every row; ties go to the smaller label."""
    first = _class_counts(df).orderBy(F.desc("n"), "target").limit(1).select("target").scalar()
    return df.withColumn("prediction", first)


def predict_stratified(df: DataFrame, seed: int) -> DataFrame:
    """A class drawn by training frequency, from a hash of the record id.

    Brings one count per class to the driver.
    """
    counts = _class_counts(df).orderBy("target").collect()
    point = F.floor(draw(F.lit(seed), F.col("record_id")) * F.lit(sum(row.n for row in counts)))
    drawn = F.lit(None).cast("string")
    upto = sum(row.n for row in counts)
    for row in reversed(counts):
        drawn = F.when(F.col("_point") < upto, F.lit(row.target)).otherwise(drawn)
        upto -= row.n
    return df.withColumn("_point", point).withColumn("prediction", drawn).drop("_point")


def scaling(df: DataFrame, columns: list[str], centre: bool = True) -> dict[str, tuple[float, float]]:
    """Mean (0 unless `centre`) and population deviation of each column over training rows.

    One aggregate; one row comes back.  A constant column is divided by 1.
    """
    row = (
        df.filter(F.col("split") == TRAIN)
        .agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
        )
        .first()
    )
    return {c: (row[f"m{i}"] if centre else 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def standardize(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(
        *[
            ((F.col(c).cast("double") - fitted[c][0]) / fitted[c][1]).alias(c) if c in fitted else F.col(c)
            for c in df.columns
        ]
    )


def as_array(df: DataFrame, columns: list[str], out: str = "v") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in columns]))


def predict_knn(
    df: DataFrame,
    columns: list[str],
    k: int = 5,
    weights: str = "distance",
    sizes: dict[str, int] | None = None,
    seed: int = 42,
    splits: tuple[str, ...] = (TEST,),
    indexed: bool = False,
) -> DataFrame:
    """k-NN vote on standardised features; `sizes` caps each split by an exact sample.

    `indexed` takes the neighbours from an inverted-list index, whose recall is measured on
    the rows with an ordinal divisible by 50, in place of all training rows.
    """
    # Stored: the sample is read as training rows, as queries and for their targets.
    chosen = cut_lineage(sampling.sample_per_split(df, sizes, seed)) if sizes else df
    scaled = as_array(standardize(chosen, scaling(chosen, columns)), columns)
    train = scaled.filter(F.col("split") == TRAIN).select(F.col("record_id").alias("id"), F.col("target").alias("label"), "v")
    queries = scaled.filter(F.col("split").isin(*splits)).select(F.col("record_id").alias("id"), "v")
    if indexed:
        train, queries = cut_lineage(train), cut_lineage(queries)
        measured = queries.filter(record_ordinal(F.col("id")) % 50 == 0)
        voted = knn.predict_indexed(train, queries, k, weights, measured)
    else:
        voted = knn.predict(train, queries, k, weights)
    voted = voted.withColumnRenamed("query_id", "record_id")
    return chosen.select("record_id", "target", "split").join(voted, "record_id")


def assemble(df: DataFrame, columns: list[str], classes: list[str]) -> DataFrame:
    """`record_id`, `target`, `split`, `features` vector and class index `y`; arrays are flattened."""
    kinds = dict(df.dtypes)
    vectors = df.select(
        "*",
        *[
            array_to_vector(F.col(c).cast("array<double>")).alias(f"_v_{c}")
            for c in columns
            if kinds[c].startswith("array")
        ],
    )
    inputs = [f"_v_{c}" if kinds[c].startswith("array") else c for c in columns]
    joined = VectorAssembler(inputCols=inputs, outputCol="features").transform(vectors)
    return with_label_index(joined, classes).select(
        "record_id", "target", "split", "features", F.col("y").cast("double").alias("y")
    )


@dataclass
class Trained:
    """A fitted model, its predictions for the asked split, and what a report shows of it."""

    predictions: DataFrame
    importances: list[float] = field(default_factory=list)
    history: list[float] = field(default_factory=list)
    train_seconds: float = 0.0


def _estimator(name: str, params: dict):
    common = {"labelCol": "y", "featuresCol": "features"}
    if name == "logistic":
        defaults = {"family": "multinomial", "maxIter": 20, "regParam": 1e-4, "standardization": True}
        return LogisticRegression(**common, **{**defaults, **params})
    if name == "tree":
        defaults = {"maxDepth": MAX_DEPTH, "minInstancesPerNode": 100, "seed": 42}
        return DecisionTreeClassifier(**common, **{**defaults, **params})
    if name == "forest":
        defaults = {"numTrees": 100, "maxDepth": 15, "minInstancesPerNode": 100, "seed": 42}
        return RandomForestClassifier(**common, **{**defaults, **params})
    if name == "gauss_nb":
        return NaiveBayes(**common, modelType="gaussian", **params)
    raise ValueError(f"unknown model {name}")


def _named_prediction(df: DataFrame, classes: list[str], index: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in classes])
    return df.select("record_id", "target", "split", names[F.col(index).cast("int")].alias("prediction"))


def train(name: str, assembled: DataFrame, classes: list[str], split: str = TEST, **params) -> Trained:
    """Fit on the training split and predict another."""
    started = time.perf_counter()
    if name == "boosted":
        return train_boosted(assembled, classes, split, **params)
    model = _estimator(name, params).fit(assembled.filter(F.col("split") == TRAIN))
    seconds = time.perf_counter() - started
    scored = model.transform(assembled.filter(F.col("split") == split))
    out = Trained(_named_prediction(scored, classes, "prediction"), train_seconds=seconds)
    if hasattr(model, "featureImportances"):
        out.importances = list(model.featureImportances.toArray())
    if name == "logistic":
        out.history = list(model.summary.objectiveHistory)
    return out


def train_boosted(assembled: DataFrame, classes: list[str], split: str = TEST, **params) -> Trained:
    """Gradient-boosted trees of all classes at once, stopped early on the validation split.

    A class without training rows is never predicted: rows of other splits are not borrowed
    for it.  The history is the validation loss after each round.
    """
    assembled = cut_lineage(assembled)
    model = boosting.fit(assembled, boosting.Settings(**params))
    scored = boosting.predict(assembled.filter(F.col("split") == split), model)
    return Trained(_named_prediction(scored, classes, "place"), list(model.gain), model.valid_loss, model.train_seconds)


def importance_table(trained: Trained, spark, names: list[str]) -> DataFrame:
    return spark.createDataFrame(
        [(n, float(v)) for n, v in zip(names, trained.importances)], "feature string, importance double"
    )


def history_table(trained: Trained, spark) -> DataFrame:
    """`step`, `value`: objective per iteration, for boosting the validation loss after each round."""
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(trained.history)], "step int, value double")


def grid(
    tables: dict[str, DataFrame], models: dict[str, dict], split: str = TEST, classes: list[str] | None = None
) -> DataFrame:
    """Result rows of every feature group with every model; each assembled table is stored once."""
    rows: list[DataFrame] = []
    for group, df in tables.items():
        columns = feature_ops.feature_columns(df)
        labels = classes or class_list(df)
        assembled = cut_lineage(assemble(df, columns, labels))
        for name, params in models.items():
            trained = train(name, assembled, labels, split, **params)
            row = metrics.result_row(trained.predictions, group, name, len(columns))
            rows.append(row.withColumn("train_seconds", F.lit(trained.train_seconds)))
    return metrics.union_results(rows)
