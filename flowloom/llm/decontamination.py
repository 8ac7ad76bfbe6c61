"""Benchmark decontamination by greedy string tiling.

Seeds are the runs of five words (running hashes) of letters, digits and other characters
beyond ASCII, in lower case.  Seeds that a document and a test item
share are joined; for each pair the seeds are put together to maximal common runs, and the
longest run that overlaps no marked words is marked again and again.  The marked share of
the item's words is its coverage: it is reached by whole, cut and reordered passages alike.

Defined results: nulls and texts of fewer than five words have no seeds and give no rows.
Rows equal in id and text are one document, items equal in id and text one item; null ids
are kept as they are.  Ties between runs of one length go to the earlier place in the
document, then in the item.  Other columns play no part.  Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import arrays
from flowloom.llm.common import map_batches, table

SEED_WORDS = 5
COVERAGE = 0.5
FILTER_BITS = 25


def _seeds(df: DataFrame, keep: list[str], marks=None) -> DataFrame:
    """(keep..., n_words, place, seed) of every seed; with marks, of those whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(marks.value, np.uint8)) if marks is not None else None
        for batch in batches:
            texts = arrays.byte_list(batch["text"])
            for low, high in arrays.pieces(texts):
                w = arrays.words(texts[low:high], arrays.NOT_ALPHANUMERIC)
                seed, at = arrays.shingles(w, SEED_WORDS)
                if bits is not None:
                    hit = bits[seed >> np.uint64(64 - FILTER_BITS)] > 0
                    seed, at = seed[hit], at[hit]
                doc = w.doc[at]
                length = np.diff(w.first)
                kept = [batch[c].take(pa.array(doc + low)) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(length[doc], pa.int64()), pa.array(at - w.first[doc], pa.int32()), pa.array(seed.astype(np.int64), pa.int64())],
                    [*keep, "n_words", "place", "seed"],
                )

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "n_words long, place int, seed long"])
    return df.select(*keep, F.lower("text").alias("text")).mapInArrow(run, schema)


def seed_filter(items: DataFrame) -> bytes:
    """A bit for each of 2^25 ranges of hashes in which an item has a seed; 4 MB for any benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seed = batch["seed"].to_numpy(zero_copy_only=False).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(seed >> np.uint64(64 - FILTER_BITS)).astype(np.int64))], ["bit"])

    bits = np.zeros(1 << FILTER_BITS, bool)
    groups = items.select("seed").mapInArrow(run, "bit long").groupBy(F.floor(F.col("bit") / 4096).alias("group")).agg(F.collect_set(F.col("bit")).alias("bits"))
    for row in groups.toLocalIterator():  # at most 8192 groups of at most 4096 bits, one partition at a time
        bits[row["bits"]] = True
    return np.packbits(bits).tobytes()


def tile(doc_at: np.ndarray, item_at: np.ndarray, k: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiles (document place, item place, words) from the places of shared seeds."""
    order = np.lexsort((doc_at, item_at - doc_at))
    d, i = doc_at[order], item_at[order]
    new = np.concatenate([[True], (d[1:] != d[:-1] + 1) | (i[1:] != i[:-1] + 1)])
    start = np.flatnonzero(new)
    runs = [(int(n) + k - 1, int(d[s]), int(i[s])) for s, n in zip(start, np.diff(np.append(start, len(d))))]
    doc_free, item_free = np.ones(int(d.max()) + k, bool), np.ones(int(i.max()) + k, bool)
    heap = [(-n, a, b) for n, a, b in runs]
    heapq.heapify(heap)
    tiles = []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = doc_free[a : a - n] & item_free[b : b - n]
        if free.all():
            tiles.append((a, b, -n))
            doc_free[a : a - n] = item_free[b : b - n] = False
            continue
        # What is left of the run between marked words comes back with its own length.
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for x, y in zip(edge[::2], edge[1::2]):
            if y - x >= k:
                heapq.heappush(heap, (-int(y - x), a + int(x), b + int(x)))
    return tiles


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, text_hash, coverage, item_words, tiles) of pairs that reach the coverage."""
    spark = docs.sparkSession
    item_seeds = _seeds(items.select("item_id", "text").distinct(), ["item_id"])
    marks = spark.sparkContext.broadcast(seed_filter(item_seeds))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    hits = _seeds(keyed, ["doc_id", "text_hash"], marks).select("doc_id", "text_hash", F.col("place").alias("doc_at"), "seed")
    found = hits.join(item_seeds.select("item_id", F.col("n_words").alias("item_words"), F.col("place").alias("item_at"), "seed"), "seed")
    # A document has at most its own words times the places of a seed in one item here.
    pairs = found.groupBy("doc_id", "text_hash", "item_id", "item_words").agg(F.collect_set(F.struct("doc_at", "item_at")).alias("at"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch["item_words"].to_pylist()
        tiles, share = [], []
        values, cut = batch["at"].flatten(), np.concatenate([[0], np.cumsum(batch["at"].value_lengths().to_numpy(zero_copy_only=False))])
        doc_at, item_at = (values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_at", "item_at"))
        for j in range(batch.num_rows):
            got = tile(doc_at[cut[j] : cut[j + 1]], item_at[cut[j] : cut[j + 1]])
            tiles.append([{"doc_at": a, "item_at": b, "words": m} for a, b, m in got])
            share.append(sum(m for _, _, m in got) / n[j])
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["text_hash"], batch["item_id"], batch["item_words"], pa.array(share, pa.float64()), pa.array(tiles, _TILES)],
            ["doc_id", "text_hash", "item_id", "item_words", "coverage", "tiles"],
        )

    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id long, text_hash long, item_id {kind}, item_words long, coverage double, tiles array<struct<doc_at:int,item_at:int,words:int>>"
    return map_batches(pairs, run, schema).where(F.col("coverage") >= coverage)


_TILES = pa.list_(pa.struct([("doc_at", pa.int32()), ("item_at", pa.int32()), ("words", pa.int32())]))


def without_contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that reach the coverage of no item; rows are known by id and text."""
    found = contaminated(docs, items, coverage).select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_hash")).distinct()
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("gone")) & (F.xxhash64("text") == F.col("gone_hash")), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "item_id", "coverage", F.size("tiles").alias("n_tiles"), "item_words")
