"""Exact k-nearest-neighbour vote over boxes of training rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import hashing
from flowloom.operators.skew import top_k_per_key
from flowloom.session import cut_lineage, in_steps

BLOCK_ROWS = 4096
SAMPLE_ROWS = 65_536  # rows the boxes are cut by
RUN_COLUMNS = 64  # columns whose nearest row is looked at first
GROUP_QUERIES = 16_384  # queries that a task meets a box's rows with
MOST_VISITS = 4_000_000  # visits of queries to boxes in a step, each with its vector


def _k_smallest(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k smallest values per row; equal values go by column."""
    k = min(k, values.shape[1])
    limit = np.partition(values, k - 1, axis=1)[:, k - 1]
    row, column = np.nonzero(values <= limit[:, None])
    order = np.lexsort((column, values[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _k_nearest(q: pd.DataFrame, t: pd.DataFrame, k: int, digits: int, own: bool) -> pd.DataFrame:
    """The k nearest rows of `t` within the limit of each row of `q`; `own` rows, of the same id, may be among them."""
    out: list[tuple] = []
    if len(q) and len(t):
        t = t.sort_values("id", ignore_index=True)
        a, b = np.stack(q["v"].to_numpy()).astype(float), np.stack(t["v"].to_numpy()).astype(float)
        names, ids, labels, limits = q["id"].to_numpy(dtype=object), t["id"].to_numpy(dtype=object), t["label"].to_numpy(), q["limit"].to_numpy(float)
        numbers = None if own else pd.factorize(np.concatenate([names, ids]), use_na_sentinel=False)[0]
        a2, b2 = (a * a).sum(1), (b * b).sum(1)
        slack = _slack(digits, a2, np.max(b2[np.isfinite(b2)], initial=0.0))
        for low in range(0, len(a), 512):
            part = slice(low, low + 512)
            double = 2.0 * a[part] @ b.T
            near = double - b2[None, :]  # the smaller the distance, the larger
            if numbers is not None:
                near[numbers[: len(a)][part, None] == numbers[None, len(a) :]] = -np.inf
            least = a2[part] - limits[part]
            if b.shape[0] > RUN_COLUMNS * k:
                # No more than the k-th largest of all is the k-th largest of the maxima over runs of columns.
                maxima = np.nan_to_num(np.fmax.reduceat(near, np.arange(0, len(b), RUN_COLUMNS), axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                least = np.fmax(least, -np.partition(-maxima, k - 1, axis=1)[:, k - 1])
            line, column = np.nonzero((near >= (least - slack[part])[:, None]) & (near > -np.inf))
            d2 = np.round(np.maximum(a2[part][line] + b2[column] - double[line, column], 0.0), digits) + 0.0
            kept = d2 <= limits[part][line]
            line, column, d2 = line[kept], column[kept], d2[kept]
            order = np.lexsort((column, d2, line))
            line, column, d2 = line[order], column[order], d2[order]
            kept = np.arange(len(line)) - np.searchsorted(line, line) < k
            line, column, d2 = line[kept], column[kept], d2[kept]
            out.append((names[part][line], ids[column], labels[column], d2))
    columns = [np.concatenate(x) for x in zip(*out)] or [[], [], [], []]
    kinds = [object, object, t["label"].dtype, float]
    return pd.DataFrame({n: pd.Series(x, dtype=d) for n, x, d in zip(["query_id", "train_id", "label", "distance2"], columns, kinds)})


def _slack(digits: int, a2: np.ndarray, b2: np.ndarray | float) -> np.ndarray:
    """How far rounding, to digits and of the machine, may move a squared distance of vectors of these squared lengths."""
    return 2 * 10.0**-digits + 1e-13 * (a2 + b2)


@dataclass
class _Cells:
    """Boxes that hold the training rows: a tree of cuts that finds a row's box, and what each box spans."""

    tree: np.ndarray  # dimension, cut, and the nodes on either side; a cell c is ~c
    low: np.ndarray
    high: np.ndarray

    def of(self, v: np.ndarray) -> np.ndarray:
        at = np.zeros(len(v), np.int64) if len(self.tree) else np.full(len(v), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            dim, cut, left, right = self.tree[at[inner]].T
            at[inner] = np.where(v[inner, dim.astype(int)] <= cut, left, right)
        return ~at

    def reached(self, v: np.ndarray, limit: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and cell for each cell, but its own, that may hold a row as near as the row's limit."""
        d2 = np.zeros((len(v), len(self.low)))
        for i in range(v.shape[1]):
            gap = np.maximum(self.low[None, :, i] - v[:, i, None], v[:, i, None] - self.high[None, :, i])
            np.maximum(gap, 0.0, out=gap)
            d2 += gap * gap
        most = np.maximum(self.low**2, self.high**2).sum(1)
        found = d2 <= limit[:, None] + _slack(digits, (v * v).sum(1)[:, None], most[None, :])
        found[:, np.isinf(self.low).any(1)] = False  # no row fell into them
        found[np.arange(len(v)), self.of(v)] = False
        return np.nonzero(found)


def _cuts(sample: np.ndarray, cells: int) -> np.ndarray:
    """Tree of cuts at the middle of the widest spread dimension, until there are as many cells or nothing to cut."""
    tree: list[tuple[int, float, int, int]] = []
    count = 0

    def cut(rows: np.ndarray, wanted: int) -> int:
        nonlocal count
        dim = int(np.argmax(rows.var(0))) if len(rows) > 1 else 0
        values = np.unique(rows[:, dim])
        if wanted < 2 or len(values) < 2:
            count += 1
            return ~(count - 1)
        middle = min(float(np.median(rows[:, dim])), float(values[-2]))
        at = len(tree)
        tree.append((dim, middle, 0, 0))
        left = rows[:, dim] <= middle
        share = min(wanted - 1, max(1, round(wanted * left.mean())))
        tree[at] = (dim, middle, cut(rows[left], share), cut(rows[~left], wanted - share))
        return at

    cut(sample, cells)
    return np.array(tree).reshape(-1, 4)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _build_cells(train: DataFrame, n: int, cell_rows: int) -> tuple[_Cells, DataFrame, list[int]]:
    """Cells of about `cell_rows` rows, `train` with its `cell`, and the number of rows of each cell."""
    wanted = max(1, math.ceil(n / cell_rows))
    usable = train.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    tree = np.zeros((0, 4))
    if wanted > 1:
        share = min(1 << 20, math.ceil(SAMPLE_ROWS / n * (1 << 20)))
        drawn = usable.filter(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 20)) < share)
        sample = drawn.select(F.col("v").cast("array<double>").alias("v")).toArrow()["v"].combine_chunks()
        tree = _cuts(_vectors(sample), wanted) if len(sample) else tree
    cells = _Cells(tree, np.zeros((0, 0)), np.zeros((0, 0)))

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(cells.of(np.stack(v.to_numpy())).astype(np.int32)) if len(v) else pd.Series([], dtype=np.int32)

    placed = cut_lineage(usable.withColumn("cell", cell_of("v")))
    spans = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.first(F.size("v")).alias("size"))
    sizes = spans.collect()  # a row a cell
    dims = sizes[0]["size"] if sizes else 0
    number = len(tree) + 1
    low, high, rows = np.full((number, dims), np.inf), np.full((number, dims), -np.inf), [0] * number
    for r in sizes:
        rows[r["cell"]] = r["n"]
    for r in placed.groupBy("cell").agg(*[f(F.col("v")[i]).alias(f"{f.__name__}{i}") for i in range(dims) for f in (F.min, F.max)]).collect():
        low[r["cell"]], high[r["cell"]] = r[1::2], r[2::2]
    return _Cells(tree, low, high), placed, rows


def neighbours(
    train: DataFrame, queries: DataFrame, k: int = 5, digits: int = 6, block_rows: int = BLOCK_ROWS, own: bool = True
) -> DataFrame:
    """`query_id`, `train_id`, `label`, `distance2` of the k nearest training rows of each query.

    `train`: id, label, v; `queries`: id, v (arrays of numbers).  Training rows lie in boxes of about
    `block_rows` rows.  A query meets the rows of its own box, and then those of every other box that
    is as near as the k-th distance found: no nearer row can be missed, and no pair of far boxes is measured.
    Queries go in steps of a bounded number of such visits, whose neighbours are written.  Ties go to the
    smaller training id.  Without `own`, a row is no neighbour of one of its id.
    """
    train, queries = cut_lineage(train.select("id", "label", "v")), cut_lineage(queries.select("id", "v"))
    cells, placed, rows = _build_cells(train, train.count(), block_rows)
    schema = f"query_id string, train_id string, label {dict(train.dtypes)['label']}, distance2 double"
    order = [F.col("distance2"), F.col("train_id")]
    n_query = queries.count()
    # Cells may be crowded by equal rows, and visited by many queries of a step: groups hold a part of either.
    parts = F.array(*[F.lit(max(1, math.ceil(n / block_rows))) for n in rows])[F.col("cell")]
    met_rows = placed.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))

    def placed_queries(asked: DataFrame, others: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, 512):
                    part = batch.slice(low, 512)
                    v, limit = _vectors(part["v"]), part["limit"].to_numpy(zero_copy_only=False)
                    line, cell = cells.reached(v, limit, digits) if others else (np.arange(len(v)), cells.of(v))
                    taken = part.take(pa.array(line))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int32())], [*taken.schema.names, "cell"])

        return asked.select("id", "v", "limit").mapInArrow(run, "id string, v array<double>, limit double, cell int")

    def counted(visits: DataFrame) -> dict[int, int]:
        return {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}

    def met(visits: DataFrame, counts: dict[int, float]) -> DataFrame:
        blocks = F.array(*[F.lit(max(1, math.ceil(counts.get(c, 0) / GROUP_QUERIES))) for c in range(len(rows))])[F.col("cell")]
        left = visits.withColumns({"block": F.pmod(F.xxhash64("id"), blocks).cast("int"), "part": F.explode(F.sequence(F.lit(0), parts - 1))})
        right = met_rows.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        keys = ["cell", "part", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda q, t: _k_nearest(q, t, k, digits, own), schema)

    finite = queries.select("id", F.col("v").cast("array<double>").alias("v")).filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    at_home = placed_queries(finite.withColumn("limit", F.lit(float("inf"))), False)
    home = cut_lineage(top_k_per_key(met(at_home, counted(at_home)), "query_id", order, k))
    if len(rows) == 1:
        return home
    # Every slice of the queries may visit every cell and still is a step.
    slices = max(1, math.ceil(n_query * len(rows) / MOST_VISITS))

    def slice_of(ident: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(7), ident), F.lit(slices))

    full = F.when(F.count(F.lit(1)) >= k, F.max("distance2")).otherwise(float("inf"))
    asked = finite.join(home.groupBy(F.col("query_id").alias("id")).agg(full.alias("limit")), "id", "left")
    asked = cut_lineage(asked.withColumn("limit", F.coalesce("limit", F.lit(float("inf")))).withColumn("slice", slice_of("id")))
    # Slices are drawn by a hash, so the first shows how many visits another makes.
    seen = counted(placed_queries(asked.filter("slice = 0"), True))
    width = min(slices, max(1, MOST_VISITS // max(1, sum(seen.values()))))

    def step(low: int, high: int) -> DataFrame:
        found = met(placed_queries(asked.filter(F.col("slice").between(low, high)), True), {c: x * width for c, x in seen.items()})
        return top_k_per_key(found.unionByName(home.filter(slice_of("query_id").between(low, high))), "query_id", order, k)

    return in_steps(slices, step, width)


def vote(found: DataFrame, weights: str = "uniform", digits: int = 6) -> DataFrame:
    """`query_id`, `prediction`.  `distance` weights by 1/distance; exact matches outvote all others.

    Ties go to the smaller label.
    """
    if weights == "distance":
        exact = F.count_if(F.col("distance2") == 0)
        near = F.sum(F.when(F.col("distance2") > 0, 1.0 / F.sqrt("distance2")).otherwise(0.0))
        scores = found.groupBy("query_id", "label").agg(
            exact.cast("double").alias("exact"), F.round(near, digits).alias("score")
        )
        order = [F.desc("exact"), F.desc("score"), F.col("label")]
    elif weights == "uniform":
        scores = found.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("score"))
        order = [F.desc("score"), F.col("label")]
    else:
        raise ValueError(f"weights must be uniform or distance, not {weights}")
    return top_k_per_key(scores, "query_id", order, 1).select("query_id", F.col("label").alias("prediction"))


def predict(
    train: DataFrame, queries: DataFrame, k: int = 5, weights: str = "distance", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    return vote(neighbours(train, queries, k, block_rows=block_rows), weights)


def predict_indexed(
    train: DataFrame, queries: DataFrame, k: int = 5, weights: str = "distance", measured: DataFrame | None = None, least_recall: float = 0.9
) -> DataFrame:
    """The vote over neighbours from an inverted-list index of the training rows.

    As many lists are visited as reach the recall on the `measured` queries (all, unless given).
    """
    from flowloom.operators import neighbour_index as ni

    index = ni.build(train)
    lists, _ = ni.tuned(index, queries if measured is None else measured, k, least_recall)
    found = ni.search(index, queries, k, lists).withColumnsRenamed({"id": "train_id", "value": "distance2"})
    labelled = found.join(train.select(F.col("id").cast("string").alias("train_id"), "label"), "train_id")
    return vote(labelled, weights)
