"""Classifiers on a planted rule, components against a plain decomposition, published tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_boosting import CLASSES, frame, made

from flowloom.operators import embeddings, models
from flowloom.sources import publish


@pytest.mark.parametrize(("name", "least", "params"), [("logistic", 0.6, {}), ("tree", 0.8, {"minInstancesPerNode": 10}), ("forest", 0.8, {"numTrees": 20, "minInstancesPerNode": 5}), ("gauss_nb", 0.6, {})])
def test_planted_rule(spark, name, least, params):
    x, y, split = made(1500, 5)
    assembled = frame(spark, x, y, split)
    trained = models.train(name, assembled, CLASSES, **params)
    rows = trained.predictions.collect()
    right = np.mean([r.target == r.prediction for r in rows])
    assert len(rows) == (split == "test").sum() and right > least > np.bincount(y[split == "train"]).max() / (split == "train").sum()
    if name == "forest":
        # The planted features first, the noise last.
        table = models.importance_table(trained, spark, ["rule", "level", "noise"]).orderBy(F.desc("importance")).collect()
        assert [r.feature for r in table][2] == "noise"
    if name == "logistic":
        values = [r.value for r in models.history_table(trained, spark).orderBy("step").collect()]
        assert values[-1] < values[0]


def test_components_equal_a_plain_decomposition(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1])
    table = spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(v)] + [("none", None)], "id string, emb array<double>")
    got = {r.component: r.ratio for r in embeddings.pca_variance(table, "id", 4).collect()}
    values = np.sort(np.linalg.eigvalsh(np.cov(v.T)))[::-1]
    assert [got[i] for i in (1, 2, 3, 4)] == pytest.approx((values / values.sum())[:4].tolist())
    assert embeddings.pca_variance(table.limit(0), "id").count() == 0


def test_lengths_of_finite_vectors(spark):
    rows = [("a", [3.0, 4.0]), ("b", [0.0, 1.0]), ("c", [float("inf"), 1.0]), ("d", [float("nan"), 1.0]), ("e", None)]
    table = spark.createDataFrame(rows, "id string, emb array<double>")
    assert tuple(embeddings.norm_spread(table).first()) == (3.0, 2.0)
    assert tuple(embeddings.norm_spread(table.filter("id > 'b'")).first()) == (None, None)
    near = embeddings.nearest(table.filter("id IN ('a', 'e')"), table.filter("id IN ('a', 'b', 'e')"), "id", 2).collect()
    assert [(r.query, r.neighbour, r.similarity) for r in near] == [("a", "b", 0.8)]


def test_published_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(publish.NotPublished):
        publish.read_published(spark, path)
    first = spark.range(10).withColumn("part", F.col("id") % 2)
    assert publish.publish(first, path, partition_by=["part"]) == 1
    # The second write fails after some of its rows.
    bad = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 900, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        publish.publish(bad, path)
    assert sorted(r.id for r in publish.read_published(spark, path).collect()) == list(range(10))
    assert publish.publish(spark.range(3), path, codec="zstd") == 2
    assert publish.read_published(spark, path).count() == 3 and publish.read_published(spark, path, 1).columns == ["id", "part"]
    assert [r.rows for r in publish.manifest(spark, path).orderBy("version").collect()] == [10, 3]
    assert publish.publish(spark.range(0), path) == 3 and publish.read_published(spark, path).count() == 0
