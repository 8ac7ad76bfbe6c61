"""Nearest rows by an inverted-list index, without meeting all pairs.

Centres are learned on a bounded sample of the table; every row of the table goes to the list of its
nearest centre.  A query meets the lists of its nearest centres alone, and all their rows are
measured exactly, so only neighbours in lists that were not visited can be missed.  `tuned`
measures that share against all rows and visits as many lists as it takes.  Where every neighbour
must be found, use `knn.neighbours` or `embeddings.nearest`.

Long lists are cut into parts, and the queries that visit a list into blocks, so a task never
holds more than one part and one block, however the rows crowd around a centre.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import hashing
from flowloom.operators import knn
from flowloom.operators.knn import _k_smallest
from flowloom.operators.skew import top_k_per_key
from flowloom.session import cut_lineage, in_steps

SAMPLE_ROWS = 65_536  # rows the centres are learned on
MOST_LISTS = 4096  # centres every task holds
PART_ROWS = 4096
MOST_VISITS = 4_000_000  # visits of queries to lists in a step, each with its vector


@dataclass
class Index:
    """`rows`: id, v, list, part of every row with a vector; `parts`: number of parts of each list."""

    rows: DataFrame
    centres: np.ndarray
    parts: list[int]
    cosine: bool


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _vectors(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1)


def _usable(table: DataFrame, cosine: bool) -> DataFrame:
    """id and vector of rows that have one, at unit length for cosines."""
    rows = table.select(F.col("id").cast("string").alias("id"), F.col("v").cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    if not cosine:
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(list(_unit(_vectors(batch["v"]))), pa.list_(pa.float64()))], ["id", "v"])

    return rows.mapInArrow(run, "id string, v array<double>")


def _nearest_lists(rows: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """`rows` once for each of the n lists with the nearest centres, ties to the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                v = _vectors(part["v"])
                d2 = (centres * centres).sum(1)[None, :] - 2.0 * v @ centres.T
                row, chosen = _k_smallest(d2, n)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken["id"], taken["v"], pa.array(chosen, pa.int32())], ["id", "v", "list"])

    return rows.mapInArrow(run, "id string, v array<double>, list int")


def build(table: DataFrame, cosine: bool = False, lists: int | None = None, sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS, seed: int = 42) -> Index:
    """Index of all rows (`id`, `v`) that have an id and a vector; vectors have one length.

    About as many lists as the square root of the number of rows, at most MOST_LISTS.  The
    sample is the rows with the smallest seeded hashes of their ids.
    """
    rows = cut_lineage(_usable(table, cosine))
    n = rows.count()
    if not n:
        return Index(rows.withColumns({"list": F.lit(0), "part": F.lit(0)}), np.zeros((0, 0)), [], cosine)
    wanted = min(lists or round(math.sqrt(n)), MOST_LISTS, n)
    sample = rows.orderBy(hashing.draw_int(F.lit(seed), F.col("id")), "id").limit(sample_rows)
    # Equal rows would be drawn as several first centres.
    sample = cut_lineage(sample.select("v").distinct())
    wanted = min(wanted, sample.count())
    if wanted < 2:
        centres = np.array([sample.first().v])
    else:
        fitted = KMeans(k=wanted, maxIter=10, initMode="random", seed=seed).fit(sample.select(array_to_vector("v").alias("features")))
        centres = np.array(fitted.clusterCenters())
    placed = cut_lineage(_nearest_lists(rows, centres, 1))
    parts = [1] * len(centres)
    for r in placed.groupBy("list").count().collect():
        parts[r["list"]] = math.ceil(r["count"] / part_rows)
    part = F.pmod(F.xxhash64("id"), F.array(*[F.lit(p) for p in parts])[F.col("list")]).cast("int")
    return Index(placed.withColumn("part", part), centres, parts, cosine)


def search(index: Index, queries: DataFrame, k: int, lists: int, digits: int = 6, block_rows: int = PART_ROWS) -> DataFrame:
    """`query_id`, `id`, `value`: the k nearest rows of each query in its nearest lists; a row is no neighbour of itself.

    The value is the squared distance, or the cosine less than zero, rounded; ties go to the smaller id.
    Queries go in steps of a bounded number of visits, whose neighbours are written.
    """
    asked = _usable(queries, index.cosine)
    if not index.parts:
        return asked.limit(0).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("value"))
    lists = min(lists, len(index.centres))
    slices = max(1, math.ceil(asked.count() * lists / MOST_VISITS))
    def of(numbers: list[int]):
        return F.array(*[F.lit(x) for x in numbers])[F.col("list")]

    def every(numbers: list[int]):
        return F.explode(F.sequence(F.lit(0), of(numbers) - 1))

    cosine = index.cosine

    def meet(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(t):
            t = t.sort_values("id", ignore_index=True)
            names, ids = q["id"].to_numpy(dtype=object), t["id"].to_numpy(dtype=object)
            a, b = np.stack(q["v"].to_numpy()), np.stack(t["v"].to_numpy())
            for low in range(0, len(a), 512):
                mine = a[low : low + 512]
                value = -(mine @ b.T) if cosine else np.maximum((mine * mine).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * mine @ b.T, 0.0)
                value = np.round(value, digits) + 0.0
                value[names[low : low + 512, None] == ids[None, :]] = np.inf
                row, column = _k_smallest(value, k)
                near = value[row, column]
                keep = np.isfinite(near)
                out.append((names[low + row[keep]], ids[column[keep]], near[keep]))
        columns = [np.concatenate(x) for x in zip(*out)] or [[], [], []]
        return pd.DataFrame({n: pd.Series(x, dtype=t) for n, x, t in zip(["query_id", "id", "value"], columns, [object, object, float])})

    keys = ["list", "part", "block"]

    def step(low: int, high: int) -> DataFrame:
        mine = asked.filter(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(slices)).between(low, high))
        visits = _nearest_lists(mine, index.centres, lists)
        blocks = [1] * len(index.centres)
        for r in visits.groupBy("list").count().collect():
            blocks[r["list"]] = math.ceil(r["count"] / block_rows)
        left = visits.select("id", "v", "list", F.pmod(F.xxhash64("id"), of(blocks)).cast("int").alias("block"), every(index.parts).alias("part"))
        right = index.rows.select("id", "v", "list", "part", every(blocks).alias("block"))
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id string, id string, value double")
        return top_k_per_key(found, "query_id", [F.col("value"), F.col("id")], k)

    return in_steps(slices, step, 1)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (`query_id`, `value`) that were found; equal values stand for one another."""
    limit = exact.groupBy("query_id").agg(F.max("value").alias("limit"), F.count("*").alias("n"))
    hits = found.join(limit, "query_id").filter("value <= limit").groupBy("query_id").agg(F.count("*").alias("hits"))
    row = limit.join(hits, "query_id", "left").agg(F.sum(F.least("n", F.coalesce("hits", F.lit(0)))).alias("hits"), F.sum("n").alias("n")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0


def exact_search(index: Index, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The same as `search` over all lists: every row is measured, or for distances known to lie too far."""
    if not index.cosine and index.parts:
        rows = index.rows.select("id", F.lit("").alias("label"), "v")
        found = knn.neighbours(rows, _usable(queries, False), k, digits, own=False)
        return found.select("query_id", F.col("train_id").alias("id"), F.col("distance2").alias("value"))
    return search(index, queries, k, max(1, len(index.centres)), digits)


def tuned(index: Index, queries: DataFrame, k: int, least_recall: float = 0.9) -> tuple[int, float]:
    """Number of lists to visit, and the recall measured with them on the given queries against all rows.

    The number is doubled until the recall is reached; with all lists it is 1.
    """
    exact = cut_lineage(exact_search(index, queries, k))
    lists = 1
    while True:
        got = recall(search(index, queries, k, lists), exact)
        if got >= least_recall or lists >= len(index.centres):
            return lists, got
        lists = min(2 * lists, len(index.centres))
