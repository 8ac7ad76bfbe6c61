"""Skewed joins, samples, encodings, k-NN, embeddings and metrics on small inputs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions import hashing
from flowloom.operators import checks, embeddings, features, knn, metrics, sampling, skew, skipgram
from flowloom.operators import target_encoding as te


def test_lookup_join_with_one_heavy_key(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i) for i in range(3000)] + [("none", 9000 + i) for i in range(5)]
    left = spark.createDataFrame(rows, "k string, n long")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(40)], "k string, v long")
    assert {r.k: r._salts for r in skew.heavy_keys(left, ["k"], 0.2).collect()} == {"hot": 2}
    # With a bound of rows per task the number of salts follows the rows of the key.
    assert {r.k: r._salts for r in skew.heavy_keys(left, ["k"], 0.2, 90).collect()} == {"hot": 12}
    for how in ("left", "inner", "left_semi", "left_anti"):
        got = skew.lookup_join(left, right, ["k"], ["n"], how).collect()
        want = left.join(right, "k", how).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, want)), how


def test_sample_is_exact_and_stable(spark):
    rows = [(f"r{i}", ("train", "valid", "test")[i % 3 if i % 10 else 0]) for i in range(4000)]
    df = spark.createDataFrame(rows, "record_id string, split string")
    sizes = {"train": 700, "valid": 5000, "test": 1}
    first = {r.record_id for r in sampling.sample_per_split(df, sizes, 7).collect()}
    again = {r.record_id for r in sampling.sample_per_split(df.repartition(3), sizes, 7).collect()}
    assert first == again
    by_split = Counter(dict(rows)[r] for r in first)
    assert by_split == {"train": 700, "valid": sum(s == "valid" for _, s in rows), "test": 1}
    assert first != {r.record_id for r in sampling.sample_per_split(df, sizes, 8).collect()}


def test_target_encoding_equals_the_loop(spark):
    rng = random.Random(1)
    rows = [
        (f"r{i}", rng.choice("xyz"), rng.choice(["train"] * 7 + ["valid", "test"]), f"s{rng.randrange(12)}", "d") for i in range(300)
    ]
    rows.append(("lonely", "x", "test", "unseen", "d"))
    rows.append(("once", "y", "train", "only_here", "d"))
    df = spark.createDataFrame(rows, "record_id string, target string, split string, src_endpoint string, dst_endpoint string")
    folds = {r.record_id: r.f for r in df.select("record_id", hashing.fold_of(F.col("record_id"), te.SEED).alias("f")).collect()}
    classes = sorted({r[1] for r in rows})

    def encode(row):
        seen = [r for r in rows if r[2] == "train" and (row[2] != "train" or folds[r[0]] != folds[row[0]])]
        prior = [sum(r[1] == c for r in seen) / len(seen) for c in classes]
        own = [r for r in seen if r[3] == row[3]]
        return [(sum(r[1] == c for r in own) + 10 * p) / (len(own) + 10) for c, p in zip(classes, prior)]

    got = {r.record_id: r.te for r in te.target_encoding(df, {"src_endpoint": "te"}).collect()}
    assert len(got) == len(rows)
    for row in rows:
        assert np.allclose(got[row[0]], encode(row)), row


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_knn_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(0)
    train = [(f"t{i:03d}", "ab"[i % 2], [float(v) for v in rng.integers(0, 5, 3)]) for i in range(60)]
    queries = [(f"q{i:03d}", [float(v) for v in rng.integers(0, 5, 3)]) for i in range(25)]
    t = spark.createDataFrame(train, "id string, label string, v array<double>")
    q = spark.createDataFrame(queries, "id string, v array<double>")
    got = defaultdict(list)
    for r in knn.neighbours(t, q, 4, block_rows=block_rows).collect():
        got[r.query_id].append((r.distance2, r.train_id))
    for name, v in queries:
        want = sorted((float(((np.array(v) - np.array(x)) ** 2).sum()), i) for i, _, x in train)[:4]
        assert sorted(got[name]) == want
    votes = spark.createDataFrame(
        [("q", "t1", "b", 0.0), ("q", "t2", "a", 0.01), ("q", "t3", "a", 0.01)],
        "query_id string, train_id string, label string, distance2 double",
    )
    assert knn.vote(votes, "distance").first().prediction == "b"
    assert knn.vote(votes, "uniform").first().prediction == "a"


def test_knn_measures_near_boxes_only(spark, monkeypatch):
    """Far boxes are not visited, in any number of steps, and ties, equal rows and far rows come out as from all pairs."""
    rng = np.random.default_rng(5)
    spots = rng.normal(size=(12, 3)) * 100
    train = [(f"t{i:03d}", "ab"[i % 2], [float(x) for x in np.round(spots[i % 12] + rng.normal(size=3), 1)]) for i in range(300)]
    train += [(f"u{i:02d}", "c", [5.0, 5.0, 5.0]) for i in range(40)]
    queries = [(f"q{i:02d}", [float(x) for x in np.round(spots[i % 12] + rng.normal(size=3), 1)]) for i in range(50)] + [("far", [1e4] * 3), ("same", [5.0] * 3)]
    t = spark.createDataFrame(train, "id string, label string, v array<double>")
    q = spark.createDataFrame(queries, "id string, v array<double>")
    points = np.array([v for *_, v in train])
    cells, _, sizes = knn._build_cells(t, len(train), 16)
    asked = np.array([v for _, v in queries])
    fifth = np.sort(((asked[:, None] - points[None]) ** 2).sum(2), axis=1)[:, 4]
    assert sum(sizes) == len(train) and len(cells.reached(asked, fifth, 6)[0]) < len(queries) * len(sizes) / 4
    for visits in (10**6, 60):
        monkeypatch.setattr(knn, "MOST_VISITS", visits)
        got = defaultdict(list)
        for r in knn.neighbours(t, q, 5, block_rows=16).collect():
            got[r.query_id].append((r.distance2, r.train_id, r.label))
        for name, v in queries:
            want = sorted((round(float(((np.array(v) - np.array(x)) ** 2).sum()), 6), i, y) for i, y, x in train)[:5]
            assert sorted(got[name]) == want


def test_nearest_and_pair_cosine(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(80, 6))
    df = spark.createDataFrame([(f"v{i:02d}", [float(x) for x in v]) for i, v in enumerate(vectors)], "id string, emb array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine = np.round(unit @ unit.T, 6)
    got = defaultdict(list)
    for r in embeddings.nearest(df.limit(20), df.repartition(5), "id", 3).collect():
        got[r.query].append((r.rank, r.neighbour))
    for i in range(20):
        order = sorted((j for j in range(80) if j != i), key=lambda j: (-cosine[i, j], j))[:3]
        assert [n for _, n in sorted(got[f"v{i:02d}"])] == [f"v{j:02d}" for j in order]
    pairs = cosine[np.triu_indices(80, 1)]
    row = embeddings.pair_cosine_spread(df, "id").first()
    assert row.pairs == len(pairs) and np.isclose(row.cosine_median, np.median(pairs)) and np.isclose(row.cosine_mean, pairs.mean())
    assert np.isclose(embeddings.mean_pair_cosine(df).first().cosine_mean, pairs.mean(), atol=1e-5)


def test_model_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "MAX_MODEL_NUMBERS", 10)
    corpus = spark.createDataFrame([(["a", "b", "c"],)], "tokens array<string>")
    with pytest.raises(embeddings.ModelTooLarge):
        embeddings.train_word2vec(corpus, dim=4)


def test_cooccurrences_equal_the_loop(spark):
    corpus = [list("abcab"), ["a"], ["b", "c"]]
    df = spark.createDataFrame([(w,) for w in corpus], "tokens array<string>")
    want = defaultdict(float)
    for tokens in corpus:
        for i, a in enumerate(tokens):
            for j, b in enumerate(tokens):
                if i != j and abs(i - j) <= 3:
                    want[a, b] += (3 - abs(i - j) + 1) / 3
    got = {(r.center, r.context): r.w for r in skipgram.cooccurrences(df, 3).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_skipgram_brings_communities_together(spark):
    """Walks stay in one of three groups; the vectors must show it, however many blocks there are."""
    rng = random.Random(4)
    corpus = [([f"g{g}_{rng.randrange(8)}" for _ in range(10)],) for g in range(3) for _ in range(120)]
    df = spark.createDataFrame(corpus, "tokens array<string>")
    found = []
    for how in ({}, {"block_tokens": 4, "group_pairs": 20}):
        learned = skipgram.train_skipgram(df, 8, 3, epochs=4, sample=0, seed=3, rate=0.3, rounds=2, **how)
        found.append({r.token: tuple(r.emb) for r in learned.collect()})
    # The vectors are the same with one block as with seven.
    assert found[0] == found[1]
    vectors = {t: np.array(v) for t, v in found[0].items()}
    assert len(vectors) == 24 and all(np.isfinite(v).all() for v in vectors.values())
    unit = {t: v / np.linalg.norm(v) for t, v in vectors.items()}
    for a in unit:
        near = sorted((b for b in unit if b != a), key=lambda b: -(unit[a] @ unit[b]))[:7]
        assert sum(b[:2] == a[:2] for b in near) >= 6, (a, near)


def test_negative_slots_follow_the_weights(spark):
    counts = spark.createDataFrame([(f"t{i}", n) for i, n in enumerate([1, 16, 81, 256] * 50)], "token string, n long")
    total = sum(n**0.75 for n in [1, 16, 81, 256] * 50)
    slots, n = skipgram.negative_slots(counts, total, 200, 1)
    rows = slots.collect()
    assert sorted(r.slot for r in rows) == list(range(n)) and abs(n - 8 * 200) < 100
    share = [sum(int(r.noise[1:]) % 4 == k for r in rows) / n for k in range(4)]
    assert np.allclose(share, np.array([1, 8, 27, 64]) / 100, atol=0.02)


def test_metrics_with_a_label_never_true(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")]
    df = spark.createDataFrame(rows, "target string, prediction string")
    row = metrics.summary(df).first()
    assert row.accuracy == 0.5 and row.rows == 4
    assert np.isclose(row.macro_f1, (2 / 3 + 1 / 2 + 0) / 3) and np.isclose(row.macro_precision, (1 + 1 / 2 + 0) / 3)
    assert np.isclose(row.weighted_recall, 0.5)
    matrix = {r.truth: (r.a, r.b, r.c) for r in metrics.confusion_matrix(df, ["a", "b", "c"]).collect()}
    assert matrix == {"a": (1, 1, 0), "b": (0, 1, 1), "c": (0, 0, 0)}


def test_checks_report_what_is_wrong(spark):
    a = spark.createDataFrame(
        [("r1", "x", "train", "s", "d", 1.0), ("r1", "", "train", "s", "d", float("nan"))],
        "record_id string, target string, split string, src_endpoint string, dst_endpoint string, raw_v float",
    )
    emb = spark.createDataFrame([("s", [1.0, float("inf")])], "endpoint_id string, emb array<float>")
    b = features.graph_features(a, emb, 2)
    bad = {r.check for r in checks.failed(checks.check_abc(a, b, features.fuse(a, b), 2)).collect()}
    assert {"no_nan", "no_inf", "target_non_empty", "record_id_unique_A", "split_has_all_three", "split_ratio_close"} <= bad
    assert "B_embedding_dim" not in bad


def test_numeric_columns_are_chosen_once(spark):
    raw = spark.createDataFrame([("1", "x", "a"), ("y", "z", "2.5")], "`Flow.A` string, `Flow.B` string, `Odd  Name!` string")
    assert features.numeric_source_columns(raw) == ["Flow.A", "Odd  Name!"]
    assert features.text.raw_feature_name("Odd  Name!") == "raw_odd_name"
