"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, its word pairs and its pairs with
one or two words between, lower case, edge punctuation aside.  Learning is online with one rate
per coordinate and L1, so that few weights are not zero; those are broadcast.

Defined results: a null or empty text gets the score of the bias alone.  Label rows that are
null, repeated or contradictory count as they stand, a document with two labels as two
rows; labels without document are left out.  Repeated documents get equal scores, an empty
table gives no rows.  Without labels every score is 0.5 less a hair: predicted 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import arrays
from flowloom.llm.common import ddl, hash31, hash_threshold, map_batches, remainder, table

HALF = 1 << 22  # words hash into the lower half, pairs into the upper one
SAMPLE_ROWS = 16_000
SKIPS = (1, 2, 3)


def feature_hashes(w: arrays.Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature and text of every word, pair and skip pair."""
    found, of = [w.hash & np.uint64(HALF - 1)], [w.doc]
    for gap in SKIPS:
        if len(w.hash) > gap:
            pair = arrays.mix(w.hash[:-gap] * np.uint64(2 * gap + 1) + w.hash[gap:])
            same = w.doc[:-gap] == w.doc[gap:]
            found.append((pair[same] & np.uint64(HALF - 1)) + np.uint64(HALF))
            of.append(w.doc[gap:][same])
    return np.concatenate(found).astype(np.uint32), np.concatenate(of)


def train(docs: DataFrame, labels: DataFrame, alpha: float = 0.3, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0, epochs: int = 3, positive: float = 3.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the weights that are not zero, and the bias.

    Fits on a bounded sample of labelled rows, about SAMPLE_ROWS picked by a hash of the id.
    Their features are made in parallel; the online pass runs in one task over them.
    `positive` is the weight of a toxic row, as these are few.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic"))
    limit = hash_threshold(marked.count(), SAMPLE_ROWS)
    picked = marked.where(hash31(F.col("labelled")) < limit)  # at most about SAMPLE_ROWS pairs of numbers
    rows = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("labelled")).select("doc_id", "toxic", "text")

    def featurise(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = arrays.byte_list(batch["text"]), []
        for low, high in arrays.pieces(texts):
            found, of = feature_hashes(arrays.words(texts[low:high], arrays.NOT_ALPHANUMERIC))
            keys = np.unique((of.astype(np.uint64) << np.uint64(32)) | found)
            cut = np.searchsorted(keys, np.arange(high - low + 1, dtype=np.uint64) << np.uint64(32))
            out += [keys[a:b].astype(np.uint32).tobytes() for a, b in zip(cut, cut[1:])]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(out, pa.binary())], ["doc_id", "toxic", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = np.zeros(2 * HALF + 1, np.float32), np.zeros(2 * HALF + 1, np.float32)

        def weights(at: np.ndarray) -> np.ndarray:
            # the bias, kept in the last place, is not drawn to zero
            pull = np.where(at == 2 * HALF, 0.0, l1)
            return np.where(np.abs(z[at]) <= pull, 0.0, (np.sign(z[at]) * pull - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

        rows = [(int(y > 0), np.frombuffer(x, np.uint32)) for b in batches for y, x in zip(b["toxic"].to_pylist(), b["x"].to_pylist())]
        for _ in range(epochs):
            for y, x in rows:
                at = np.append(x, np.uint32(2 * HALF))
                w = weights(at)
                p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
                g = np.float32((p - y) * (positive if y else 1.0))
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
                z[at] += g - sigma * w
                n[at] += g * g
        used = np.flatnonzero(n)
        w = weights(used)
        used, w = used[w != 0], w[w != 0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(w, pa.float64())], ["i", "w"])
        rows.clear()
        arrays.release()

    sample = map_batches(rows, featurise, "doc_id long, toxic int, x binary")
    ordered = sample.repartition(1).sortWithinPartitions(hash31(F.col("doc_id")), "doc_id", "toxic", F.crc32("x"))
    found = ordered.mapInArrow(fit, "i long, w double").collect()  # the weights that are not zero
    bias = sum(r["w"] for r in found if r["i"] == 2 * HALF)
    found = sorted((r["i"], r["w"]) for r in found if r["i"] != 2 * HALF)
    return np.array([i for i, _ in found], np.uint32), np.array([w for _, w in found], np.float64), bias if found or bias else -1e-9


def scores(texts: list[bytes], used: np.ndarray, weight: np.ndarray, bias: float, marks: np.ndarray) -> np.ndarray:
    out = np.full(len(texts), bias)
    for low, high in arrays.pieces(texts):
        found, of = feature_hashes(arrays.words(texts[low:high], arrays.NOT_ALPHANUMERIC))
        hit = marks[found]
        pairs = np.unique((of[hit].astype(np.uint64) << np.uint64(32)) | found[hit])
        value = weight[np.searchsorted(used, pairs.astype(np.uint32))]
        out[low:high] += np.bincount((pairs >> np.uint64(32)).astype(np.int64), value, high - low)
    return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def predict(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All given columns, the text too, with the score and the decision."""
    keep = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, weight, bias = shared.value
        marks = np.zeros(2 * HALF, bool)
        marks[used] = True
        for batch in batches:
            s = scores(arrays.byte_list(batch["text"]), used, weight, bias, marks)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in keep), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], [*keep, *names]
            )

    return docs.select(keep).mapInArrow(run, f"{ddl(docs, keep)}`{names[0]}` double, `{names[1]}` int")


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 5) == 0


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[np.ndarray, np.ndarray, float]:
    return train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return predict(docs, fitted(spark, docs, sf_dir)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
