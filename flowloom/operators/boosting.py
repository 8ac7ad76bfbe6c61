"""Multi-class gradient boosting of trees on feature histograms, stopped by patience.

Every round grows one tree per class towards the softmax gradients, level by level.  A level
is one pass over the stored rows: each task sums gradients by (class, node, feature, bin), Spark
adds the sums up and picks the best cut of every node, and the driver gets those cuts alone.
Gradients are rounded to whole multiples of 2^-20, so sums, trees and predictions
do not depend on how the rows are partitioned or on tasks that ran twice.

Rows are stored once as one byte per feature (its bin) and the scores of the classes.  A pass adds the trees
grown since; every few rounds the scores are stored anew.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.hashing import TRAIN, VALID
from flowloom.session import cut_lineage

UNIT = 2.0**20
STORE_EVERY = 10  # rounds
BLOCK_FEATURES = 64  # of a histogram that is added up as one row
MAX_CELLS = 4_000_000  # sums a task holds; more classes take several passes
LEAF = -1


@dataclass(frozen=True)
class Settings:
    rounds: int = 3000
    patience: int = 100
    step: float = 0.05
    leaves: int = 63
    bins: int = 64
    least_rows: int = 100
    ridge: float = 1.0
    column_share: float = 0.8
    seed: int = 42

    @property
    def depth(self) -> int:
        return max(1, math.ceil(math.log2(self.leaves)))


class Tree:
    """Nodes by number; rows with a bin up to `cut` of `feature` go left."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.value = [LEAF], [0], [0], [0], [0.0]

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node] = feature, cut
        for side in (self.left, self.right):
            side[node] = len(self.feature)
            for column, empty in ((self.feature, LEAF), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
                column.append(empty)
        return self.left[node], self.right[node]

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            at = feature[node]
            inner = at != LEAF
            if not inner.any():
                return node
            down = np.where(bins[rows, np.where(inner, at, 0)] <= cut[node], left[node], right[node])
            node = np.where(inner, down, node)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


@dataclass
class Boosted:
    """A fitted ensemble: `trees[round][class]`, cuts of the bins, and what a report shows."""

    classes: list[int]
    prior: list[float]
    edges: list[np.ndarray]
    trees: list[list[Tree]] = field(default_factory=list)
    best_round: int = 0
    valid_loss: list[float] = field(default_factory=list)
    gain: np.ndarray | None = None
    splits: np.ndarray | None = None
    train_seconds: float = 0.0


def bin_edges(assembled: DataFrame, bins: int) -> list[np.ndarray]:
    """At most bins - 1 cuts per feature at quantiles of the training rows; a value goes to the first cut not below it."""
    rows = assembled.filter(F.col("split") == TRAIN).select(vector_to_array("features").alias("v"))
    first = rows.first()
    if first is None:
        return []
    width = len(first.v)
    columns = [f"f{i}" for i in range(width)]
    points = [i / bins for i in range(1, bins)]
    found = rows.select(*[F.col("v")[i].alias(c) for i, c in enumerate(columns)]).approxQuantile(columns, points, 1 / (4 * bins))
    return [np.unique(np.array(q, float)) for q in found]


def binned(assembled: DataFrame, edges: list[np.ndarray], prior: list[float]) -> DataFrame:
    """(record_id, target, split, y, bins, scores): bins as bytes, scores as packed doubles at the prior."""
    start = np.array(prior, float).tobytes()
    keep = ["record_id", "target", "split", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            values = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(n, len(edges)) if n else np.zeros((0, len(edges)))
            out = np.empty((n, len(edges)), np.uint8)
            for j, cuts in enumerate(edges):
                out[:, j] = np.searchsorted(cuts, values[:, j], side="left")
            packed = [row.tobytes() for row in out]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(packed, pa.binary()), pa.array([start] * n, pa.binary())], [*keep, "bins", "scores"])

    rows = assembled.select("record_id", "target", "split", F.col("y").cast("int").alias("y"), vector_to_array("features").alias("v"))
    return rows.mapInArrow(run, "record_id string, target string, split string, y int, bins binary, scores binary")


def _unpacked(batch: pa.RecordBatch, width: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch["bins"].to_pylist()), np.uint8).reshape(-1, width)
    scores = np.frombuffer(b"".join(batch["scores"].to_pylist()), float).reshape(-1, classes)
    return bins, scores


def _with_trees(scores: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    scores = scores.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            scores[:, k] += tree.scores(bins)
    return scores


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(p: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of class k in units of 2^-20."""
    return np.rint((p[:, k] - (y == k)) * UNIT), np.rint(p[:, k] * (1 - p[:, k]) * UNIT)


def histogram(bins: np.ndarray, slot: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    """Sums of g, h and rows by (node slot, feature, bin); rows of slot -1 are left out."""
    at = np.flatnonzero(slot >= 0)
    width = bins.shape[1]
    place = ((slot[at, None] * width + np.arange(width)) * size + bins[at]).ravel()
    cells = nodes * width * size
    sums = [np.bincount(place, np.repeat(w[at], width), cells) for w in (g, h)]
    return np.stack([*sums, np.bincount(place, minlength=cells)], axis=1).reshape(nodes, width, size, 3)


def best_cut(sums: np.ndarray, allowed: np.ndarray, settings: Settings) -> tuple | None:
    """(gain, feature, cut, left g, left h, right g, right h, left rows, right rows) of the best cut of one node, ties to the lower feature and cut."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    total = sums.sum(axis=1)[:, None]
    right = total - left

    def score(x: np.ndarray) -> np.ndarray:
        return (x[..., 0] / UNIT) ** 2 / (x[..., 1] / UNIT + settings.ridge)

    gain = score(left) + score(right) - score(total)
    ok = (left[..., 2] >= settings.least_rows) & (right[..., 2] >= settings.least_rows) & allowed[:, None]
    gain = np.where(ok, gain, -np.inf)
    if not gain.size or gain.max() <= 0:
        return None
    f, b = divmod(int(gain.argmax()), gain.shape[1])
    one, other = left[f, b], right[f, b]
    return float(gain[f, b]), f, b, float(one[0]), float(one[1]), float(other[0]), float(other[1]), int(one[2]), int(other[2])


_CUT = "class int, slot int, gain double, feature int, cut int, lg double, lh double, rg double, rh double, ln long, rn long"


def allowed_features(width: int, settings: Settings, rounds: int, k: int) -> np.ndarray:
    """Features that the tree of a class may use in a round: a drawn share of all, one at least."""
    rng = np.random.default_rng([settings.seed, rounds, k])
    out = np.zeros(width, bool)
    out[rng.permutation(width)[: max(1, math.ceil(settings.column_share * width))]] = True
    return out


def _level(state: DataFrame, since: list[list[Tree]], growing: list[Tree], active: list[list[int]], chosen: list[int], settings: Settings, width: int, rounds: int):
    """Best cut of every active node of the chosen classes; one pass over the training rows."""
    size, classes = settings.bins, len(growing)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((len(active[k]), width, size, 3)) for k in chosen}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, scores = _unpacked(batch, width, classes)
            p, y = softmax(_with_trees(scores, bins, since)), batch["y"].to_numpy(zero_copy_only=False)
            for k in chosen:
                slots = np.full(len(growing[k].feature), -1)
                slots[active[k]] = np.arange(len(active[k]))
                total[k] += histogram(bins, slots[growing[k].leaf_of(bins)], len(active[k]), *gradients(p, y, k), size)
        keys = [(k, s, low) for k in chosen for s in range(len(active[k])) for low in range(0, width, BLOCK_FEATURES)]
        for at in range(0, len(keys), 256):
            some = keys[at : at + 256]
            packed = [total[k][s, low : low + BLOCK_FEATURES].tobytes() for k, s, low in some]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in zip(*some)), pa.array(packed, pa.binary())], ["class", "slot", "low", "sums"])

    def cut(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        k, slot, low = (int(x) for x in key)
        added = sum(np.frombuffer(x, float) for x in rows["sums"]).reshape(-1, size, 3)
        found = best_cut(added, allowed_features(width, settings, rounds, k)[low : low + len(added)], settings)
        out = [] if found is None else [(k, slot, found[0], found[1] + low, *found[2:])]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _CUT.split(", ")])

    part = state.filter(F.col("split") == TRAIN).select("y", "bins", "scores").mapInArrow(sums, "class int, slot int, low int, sums binary")
    found = part.groupBy("class", "slot", "low").applyInPandas(cut, _CUT)
    best = F.max_by(F.struct("*"), F.struct("gain", -F.col("feature"))).alias("best")
    return [r.best for r in found.groupBy("class", "slot").agg(best).collect()]


def _valid_loss(state: DataFrame, since: list[list[Tree]], width: int, classes: int) -> float | None:
    """Mean log loss of the validation rows of known classes, in whole units so that it is the same on every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = n = 0
        for batch in batches:
            if batch.num_rows:
                bins, scores = _unpacked(batch, width, classes)
                p, y = softmax(_with_trees(scores, bins, since)), batch["y"].to_numpy(zero_copy_only=False)
                own = np.maximum(p[np.arange(len(y)), y], 1e-15)
                loss, n = loss + int(np.rint(-np.log(own) * UNIT).sum()), n + len(y)
        yield pa.RecordBatch.from_arrays([pa.array([loss], pa.int64()), pa.array([n], pa.int64())], ["loss", "n"])

    rows = state.filter((F.col("split") == VALID) & (F.col("y") >= 0)).select("y", "bins", "scores")
    total = rows.mapInArrow(run, "loss long, n long").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
    return total.loss / UNIT / total.n if total.n else None


def _stored(state: DataFrame, since: list[list[Tree]], width: int, classes: int) -> DataFrame:
    """The state with the trees added to its scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, scores = _unpacked(batch, width, classes)
            packed = [row.tobytes() for row in _with_trees(scores, bins, since)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], batch.schema.names)

    return cut_lineage(state.mapInArrow(run, state.schema))


def grow(level, width: int, classes: int, settings: Settings, rounds: int, gain: np.ndarray, splits: np.ndarray) -> list[Tree]:
    """One tree per class; `level(trees, active nodes, classes)` gives the best cut of every active node."""
    trees = [Tree() for _ in range(classes)]
    active = [[0] for _ in range(classes)]
    leaves = [1] * classes
    for _ in range(settings.depth):
        per_pass = max(1, MAX_CELLS // (3 * settings.bins * width * max(1, max(map(len, active)))))
        todo = [k for k in range(classes) if active[k] and leaves[k] < settings.leaves]
        cuts = [c for low in range(0, len(todo), per_pass) for c in level(trees, active, todo[low : low + per_pass])]
        following = [[] for _ in range(classes)]
        for c in sorted(cuts, key=lambda c: (-c["gain"], c["slot"])):
            k = c["class"]
            if leaves[k] == settings.leaves:
                continue
            leaves[k] += 1
            gain[c["feature"]] += c["gain"]
            splits[c["feature"]] += 1
            sides = trees[k].split(active[k][c["slot"]], c["feature"], c["cut"])
            for node, g, h in zip(sides, (c["lg"], c["rg"]), (c["lh"], c["rh"])):
                trees[k].value[node] = -settings.step * (g / UNIT) / (h / UNIT + settings.ridge)
            # Nodes too small to be cut again need no pass.
            following[k] += [node for node, n in zip(sides, (c["ln"], c["rn"])) if n >= 2 * settings.least_rows]
        active = [sorted(f) for f in following]
        if not any(active):
            break
    return trees


def fit(assembled: DataFrame, settings: Settings = Settings()) -> Boosted:
    """Fits on the training rows of `assembled` (record_id, target, split, features, y); `valid` rows decide when to stop.

    Classes without training rows are never predicted.  Without valid rows all rounds are run.
    An empty training split gives an ensemble without classes.
    """
    started = time.perf_counter()
    counts = assembled.filter(F.col("split") == TRAIN).groupBy(F.col("y").cast("int").alias("y")).count().orderBy("y").collect()
    present, total = [r.y for r in counts], sum(r["count"] for r in counts)
    model = Boosted(present, [math.log(r["count"] / total) for r in counts], bin_edges(assembled, settings.bins))
    width, classes = len(model.edges), len(present)
    model.gain, model.splits = np.zeros(width), np.zeros(width, np.int64)
    if not classes:
        return model
    places = F.array(*[F.lit(y) for y in present])
    known = F.array_position(places, F.col("y").cast("int")).cast("int") - 1
    state = cut_lineage(binned(assembled.filter(F.col("split").isin(TRAIN, VALID)).withColumn("y", known), model.edges, model.prior))
    since: list[list[Tree]] = []
    best = loss = _valid_loss(state, since, width, classes)
    while len(model.trees) < settings.rounds:
        rounds = len(model.trees)
        trees = grow(
            lambda growing, active, chosen: _level(state, since, growing, active, chosen, settings, width, rounds),
            width, classes, settings, rounds, model.gain, model.splits,
        )
        model.trees.append(trees)
        since.append(trees)
        if best is None:
            model.best_round = rounds + 1
        else:
            loss = _valid_loss(state, since, width, classes)
            model.valid_loss.append(loss)
            if loss < best:
                best, model.best_round = loss, rounds + 1
            elif rounds + 1 - model.best_round >= settings.patience:
                break
        if all(t.feature[0] == LEAF for t in trees):
            break  # no cut is allowed, nor will be
        if len(since) == STORE_EVERY:
            state, since = _stored(state, since, width, classes), []
    model.train_seconds = time.perf_counter() - started
    return model


def predict(assembled: DataFrame, model: Boosted) -> DataFrame:
    """(record_id, target, split, place) with the place of the likeliest class, ties to the first; null without classes."""
    keep = ["record_id", "target", "split"]
    if not model.classes:
        return assembled.select(*keep, F.lit(None).cast("int").alias("place"))
    width, classes, used, places = len(model.edges), len(model.classes), model.trees[: model.best_round], np.array(model.classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins, scores = _unpacked(batch, width, classes)
                place = places[_with_trees(scores, bins, used).argmax(axis=1)]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(place, pa.int32())], [*keep, "place"])

    return binned(assembled, model.edges, model.prior).select(*keep, "bins", "scores").mapInArrow(run, "record_id string, target string, split string, place int")
