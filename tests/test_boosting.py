"""Multi-class boosting against a plain loop over all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from flowloom.operators import boosting, models

CLASSES = ["a", "b", "c", "never"]


def made(n, seed):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 6, n), rng.normal(size=n)], axis=1)
    y = np.where(x[:, 0] > 0.3, 0, np.where(x[:, 1] > 2, 1, 2))
    noise = rng.random(n) < 0.1
    y[noise] = rng.integers(0, 3, noise.sum())
    split = np.where(np.arange(n) % 5 < 3, "train", np.where(np.arange(n) % 5 == 3, "valid", "test"))
    return x, y, split


def frame(spark, x, y, split, parts=3):
    rows = [(f"r{i:06d}", CLASSES[c], s, Vectors.dense(v), float(c)) for i, (v, c, s) in enumerate(zip(x.tolist(), y.tolist(), split.tolist()))]
    return spark.createDataFrame(rows, ["record_id", "target", "split", "features", "y"]).repartition(parts)


def plain(x, y, split, edges, settings):
    """The same trees from one array of rows."""
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    train = split == "train"
    bins, y = bins[train], y[train]
    scores = np.log(np.bincount(y, minlength=3) / len(y)) + np.zeros((len(y), 3))
    out = []
    for r in range(settings.rounds):
        p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        trees = []
        for k in range(3):
            g, h = np.rint((p[:, k] - (y == k)) * 2**20) / 2**20, np.rint(p[:, k] * (1 - p[:, k]) * 2**20) / 2**20
            allowed = boosting.allowed_features(3, settings, r, k)
            leaves, level = {(): np.arange(len(y))}, [()]
            cuts = {}
            for _ in range(settings.depth):
                found = []
                for path in level:
                    rows, best = leaves[path], None
                    for f in np.flatnonzero(allowed):
                        for b in range(len(edges[f])):
                            left = bins[rows, f] <= b
                            if min(left.sum(), (~left).sum()) < settings.least_rows:
                                continue
                            s = [g[r_].sum() ** 2 / (h[r_].sum() + settings.ridge) for r_ in (rows[left], rows[~left], rows)]
                            gain = s[0] + s[1] - s[2]
                            if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, int(f), b)
                    if best:
                        found.append((best, path))
                level = []
                for (gain, f, b), path in sorted(found, key=lambda c: -c[0][0]):
                    if len(leaves) == settings.leaves:
                        break
                    rows = leaves.pop(path)
                    cuts[path] = (f, b)
                    left = bins[rows, f] <= b
                    for side, own in ((0, rows[left]), (1, rows[~left])):
                        leaves[(*path, side)] = own
                        level.append((*path, side))
                level.sort()
            for rows in leaves.values():
                if cuts:
                    scores[rows, k] -= settings.step * g[rows].sum() / (h[rows].sum() + settings.ridge)
            trees.append(cuts)
        out.append(trees)
    return out


def cuts_of(tree):
    found, todo = {}, [(0, ())]
    while todo:
        node, path = todo.pop()
        if tree.feature[node] != boosting.LEAF:
            found[path] = (tree.feature[node], tree.cut[node])
            todo += [(tree.left[node], (*path, 0)), (tree.right[node], (*path, 1))]
    return found


def test_same_trees_as_plain_loop(spark):
    x, y, split = made(330, 1)
    settings = boosting.Settings(rounds=4, leaves=6, bins=8, least_rows=8, step=0.3, column_share=0.7)
    model = boosting.fit(frame(spark, x, y, split), settings)
    assert [[cuts_of(t) for t in trees] for trees in model.trees] == plain(x, y, split, model.edges, settings)


def test_any_partitioning_and_passes(spark, monkeypatch):
    x, y, split = made(300, 2)
    settings = boosting.Settings(rounds=12, leaves=4, bins=8, least_rows=5, step=0.3)
    one = boosting.fit(frame(spark, x, y, split, 1), settings)
    monkeypatch.setattr(boosting, "MAX_CELLS", 1)
    monkeypatch.setattr(boosting, "bin_edges", lambda *_: one.edges)
    other = boosting.fit(frame(spark, x, y, split, 7), settings)
    assert [[vars(t) for t in r] for r in one.trees] == [[vars(t) for t in r] for r in other.trees]
    assert one.valid_loss == other.valid_loss


def test_planted_rule_and_patience(spark):
    x, y, split = made(2000, 3)
    trained = models.train("boosted", frame(spark, x, y, split), CLASSES, rounds=60, patience=3, step=0.5, leaves=8, bins=32, least_rows=20)
    rows = trained.predictions.collect()
    assert len(rows) == (split == "test").sum()
    right = np.mean([r.target == r.prediction for r in rows])
    assert right > 0.85 > np.bincount(y).max() / len(y)
    assert "never" not in {r.prediction for r in rows}
    # Stopped by the validation loss, which fell and then no more; the useless feature gains least.
    assert len(trained.history) < 60 and min(trained.history) < trained.history[0]
    assert np.argmin(trained.history) == len(trained.history) - 4
    assert np.argmin(trained.importances) == 2


@pytest.mark.parametrize("kept", ["train", "test"])
def test_missing_splits(spark, kept):
    x, y, _ = made(60, 4)
    rows = frame(spark, x, y, np.full(60, kept))
    model = boosting.fit(rows, boosting.Settings(rounds=2, least_rows=5, bins=4))
    assert model.best_round == (2 if kept == "train" else 0)
    assert boosting.predict(rows, model).count() == 60
