"""Neighbours and cosine spread over several blocks against plain loops."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import DataFrame

from flowloom.operators import embeddings, skipgram
from flowloom.session import cut_lineage, shared_folder


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    return [(f"v{i}", [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(90)] + [("zero", [0.0] * 4)]


@pytest.fixture()
def no_driver(monkeypatch):
    def refuse(self, *_):
        raise AssertionError("rows on the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    monkeypatch.setattr(embeddings, "STEP_BLOCKS", 4)


def cosine(a, b):
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(np.dot(a, b)) / size, 6) + 0.0 if size else 0.0


@pytest.mark.parametrize("block_numbers", [64, 10_000])
def test_nearest_blocks(spark, vectors, no_driver, block_numbers):
    table = spark.createDataFrame(vectors, "id string, emb array<double>")
    got = embeddings.nearest(table.filter("id <> 'v7'"), table, "id", 3, block_numbers=block_numbers).collect()
    want = []
    for q, a in vectors:
        near = sorted((-cosine(a, b), n) for n, b in vectors if n != q)[:3]
        want += [(q, n, -s + 0.0, i + 1) for i, (s, n) in enumerate(near) if q != "v7"]
    assert sorted((r["query"], r["neighbour"], r["similarity"] + 0.0, r["rank"]) for r in got) == sorted(want)


@pytest.mark.parametrize("block_numbers", [64, 10_000])
def test_cosine_spread_blocks(spark, vectors, no_driver, block_numbers):
    table = spark.createDataFrame(vectors, "id string, emb array<double>")
    got = embeddings.pair_cosine_spread(table, "id", block_numbers=block_numbers).collect()[0]
    every = [cosine(a, b) for i, (_, a) in enumerate(vectors) for _, b in vectors[:i]]
    assert got["pairs"] == len(every)
    assert got["cosine_median"] == pytest.approx(np.median(every)) and got["cosine_mean"] == pytest.approx(np.mean(every))


def test_empty(spark, no_driver):
    empty = spark.createDataFrame([], "id string, emb array<double>")
    assert embeddings.nearest(empty, empty, "id").count() == 0
    assert embeddings.pair_cosine_spread(empty, "id").collect()[0]["pairs"] is None


@pytest.mark.parametrize("name", ["word2vec", "skipgram"])
def test_trained_at_defaults(spark, monkeypatch, name):
    """Both queries learn 64 numbers a token, in five epochs, from five rounds of walks of 20 steps."""
    from flowloom.plans import model_queries

    asked = {}

    def walks(spark, sf_dir, **how):
        asked.update(how)
        return spark.createDataFrame([(["a", "b", "c", "a"],)], "tokens array<string>")

    monkeypatch.setattr(model_queries, "host_walks", walks)
    assert {r["dim"] for r in getattr(model_queries, {"skipgram": "skipgram_vectors"}.get(name, name))(spark, "").collect()} == {64}
    assert asked == {"rounds": 5, "length": 20}


def test_largest_scores_equal_a_sort_of_all(spark):
    """Few scores are sorted, with ties after rounding, missing numbers and short rows as in a sort of all."""
    rng = np.random.default_rng(3)
    for columns in (1, 3, 64, 700):
        score = np.round(rng.standard_normal((40, columns)), 1) + rng.uniform(-4e-7, 4e-7, (40, columns))
        score[rng.random(score.shape) < 0.1] = -np.inf
        score[5], score[6, ::2] = np.nan, np.nan
        rounded = np.where(np.isfinite(score), np.round(score, 6) + 0.0, -np.inf)
        top = np.argsort(-rounded, axis=1, kind="stable")[:, :5]
        want = [(i, j, rounded[i, j]) for i in range(40) for j in top[i] if np.isfinite(rounded[i, j])]
        assert list(zip(*(x.tolist() for x in embeddings._k_largest(score, 5, 6)))) == want


def test_cosines_are_counted_without_a_sort(spark, monkeypatch):
    """The counts equal those of rounded and sorted cosines; vectors of no length or no finite numbers as before."""
    rng = np.random.default_rng(4)
    cosines = np.append(rng.uniform(-1, 1, 5000), [-1.0, 1.0, 1.0 + 1e-15, 0.0, -0.0, 5e-7])
    values, counts = np.unique(np.round(cosines, 3) + 0.0, return_counts=True)
    with monkeypatch.context() as patched:
        patched.setattr(np, "unique", None)
        patched.setattr(np, "sort", None)
        total = embeddings._place_counts(cosines, 1000)
    seen = np.flatnonzero(total)
    assert ((seen - 1001) / 1000.0).tolist() == values.tolist() and total[seen].tolist() == counts.tolist()

    rows = [(f"k{i:02d}", [float(x) for x in rng.standard_normal(8)]) for i in range(60)] + [("zero", [0.0] * 8), ("inf", [float("inf")] + [1.0] * 7)]
    unit = [np.array(v) / (np.linalg.norm(v) or 1.0) for _, v in rows[:61]]
    every = np.array([np.round(unit[i] @ unit[j], 6) for i in range(61) for j in range(i)])
    got = embeddings.pair_cosine_spread(spark.createDataFrame(rows, "id string, emb array<double>"), "id", block_numbers=64).first()
    assert got["pairs"] == len(every)
    assert abs(got["cosine_median"] - np.median(every)) < 2e-6 and abs(got["cosine_mean"] - every.mean()) < 1e-6


def test_training_keeps_no_old_states(spark):
    """However many epochs are trained, as many tables are left on disk."""
    corpus = cut_lineage(spark.createDataFrame([(["a", "b", "c", "a", "d"],), (["b", "d", "c"],)], "tokens array<string>"))
    folder = f"{shared_folder(spark)}/flowloom".removeprefix("file://")
    left = []
    for epochs in (1, 2):
        before = set(os.listdir(folder))
        assert skipgram.train_skipgram(corpus, dim=4, epochs=epochs).count() == 4
        left.append(len(set(os.listdir(folder)) - before))
    assert left[0] == left[1]
