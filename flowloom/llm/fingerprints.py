"""Document fingerprints by one-permutation MinHash.

Each word shingle (five words) is hashed once; the high bits pick a bin, which keeps its
least value.  An empty bin takes the value of the first filled bin in a sequence of bins drawn
for it alone (optimal densification), the same for all texts.  Of every bin the low-order bits
are kept and packed.  Two fingerprints agree in a share of their bins; chance agreement is taken
off that share, which gives an unbiased estimate of the Jaccard similarity.

Defined results: fewer than five words make one shingle of the whole sequence.  A null
text or one without words has the empty fingerprint: alike to another empty one (1), and to no
other (0).  Equal texts have equal fingerprints.  Rows of equal id are ordered by text;
null ids come last in descending order.  Other columns play no part.  An empty table
gives no rows; a single row is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import arrays
from flowloom.llm.common import ddl, table

BINS_LOG2 = 9
BINS = 1 << BINS_LOG2
KEPT_BITS = 4
PARTITION_BYTES = 32_000_000
MOST_RANGES = 4096  # beyond it ranges grow; a range is sorted on disk and read as a stream
_EMPTY = np.uint64(2**64 - 1)


def _draws(low: int, high: int) -> np.ndarray:
    """Bins drawn for each bin at the tries low to high."""
    bins, tries = np.arange(BINS, dtype=np.uint64)[:, None], np.arange(low, high, dtype=np.uint64)[None, :]
    return (arrays.mix(bins * np.uint64(1_000_003) + tries + np.uint64(17)) >> np.uint64(64 - BINS_LOG2)).astype(np.int32)


_FIRST_DRAWS = _draws(0, 16)
# Few shingles fill many bins with one value; salted by bin, their kept bits agree by chance one by one.
_SALT = arrays.mix(np.arange(BINS, dtype=np.uint64) + np.uint64(99))


def densify(bins: np.ndarray) -> np.ndarray:
    """Fills the empty bins of one text that has a filled one."""
    filled = bins != _EMPTY
    if filled.all():
        return bins
    out, todo, low, high = bins.copy(), np.flatnonzero(~filled), 0, 16
    while len(todo):
        draws = (_FIRST_DRAWS if low == 0 else _draws(low, high))[todo]
        hit = filled[draws]
        found = hit.any(axis=1)
        out[todo[found]] = bins[draws[found, hit[found].argmax(axis=1)]]
        todo, low, high = todo[~found], high, min(high * 4, high + 4096)
    return out


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Low-order bits of the bins, one row per text; row of 255 for a text without words."""
    out = np.full((len(texts), BINS), 255, np.uint8)
    for low, high in arrays.pieces(texts):
        n = high - low
        w = arrays.words(texts[low:high])
        h, at = arrays.shingles(w)
        doc = w.doc[at]
        short = np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < 5))
        if len(short):
            sets = arrays.shingle_sets([texts[low + d] for d in short])
            h, doc = np.concatenate([h, *sets]), np.concatenate([doc, short])
        bins = np.full(n * BINS, _EMPTY)
        np.minimum.at(bins, doc * BINS + (h >> np.uint64(64 - BINS_LOG2)).astype(np.int64), h & np.uint64((1 << (64 - BINS_LOG2)) - 1))
        bins = bins.reshape(n, BINS)
        for d in np.flatnonzero((bins != _EMPTY).any(axis=1)):
            out[low + d] = arrays.mix(densify(bins[d]) + _SALT) & np.uint64((1 << KEPT_BITS) - 1)
    return out


def packed(prints: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal text, one digit per bin; empty for a text without words."""
    both = (prints[:, ::2] << 4) | (prints[:, 1::2] & 15)
    return ["" if p[0] == 255 else b.tobytes().hex() for p, b in zip(prints, both)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity, row by row, free of chance agreement."""
    chance = 2.0**-KEPT_BITS
    share = (a == b).mean(axis=1)
    value = np.clip((share - chance) / (1 - chance), 0.0, 1.0)
    none_a, none_b = a[:, 0] == 255, b[:, 0] == 255
    return np.where(none_a | none_b, (none_a & none_b).astype(float), value)


def fingerprint(docs: DataFrame) -> DataFrame:
    """All given columns with `fingerprint` of the text."""
    keep = [c for c in docs.columns if c != "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints(arrays.byte_list(batch["text"]))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(packed(prints), pa.string())], [*keep, "fingerprint"])

    return docs.select(keep).mapInArrow(run, f"{ddl(docs, keep)}`fingerprint` string")


def edited_text(text: str, following: str) -> str:
    """The last half (rounded down) of a text replaced by as much of the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """(range, doc_id, text, guest): rows dealt into ranges of descending id and sorted in them.

    Every range also gets, as a guest at its end, the first row of the next range; the last
    range gets the first row of all.  Ranges hold about PARTITION_BYTES, so that each row is
    moved once and no task sees more than its range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.coalesce(F.bitwise_not("doc_id"), F.lit(2**63 - 1))  # falls as the id rises
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = min(MOST_RANGES, max(1, (size["bytes"] or 0) // PARTITION_BYTES))
    cuts = sorted(set(rows.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)), reverse=True) if ranges > 1 else []
    edges = F.array(*(F.lit(~int(c)) for c in cuts)).cast("array<long>")
    number = F.size(F.filter(edges, lambda e: e < F.col("o"))).cast("int")
    rows = rows.withColumn("o", order).withColumn("range", number)
    # The first row of each range, known by its order, text hash; one row per range.
    firsts = rows.groupBy("range").agg(F.min(F.struct("o", F.xxhash64("text").alias("h"))).alias("x")).collect()
    firsts = sorted((r["range"], r["x"]["o"], r["x"]["h"]) for r in firsts)
    if not firsts:
        return rows.select("range", "doc_id", "text", F.lit(False).alias("guest"))
    to = {firsts[i][0]: firsts[i - 1][0] for i in range(len(firsts))}  # the first range's first row goes to the last range
    lead = spark.createDataFrame([(r, o, h, to[r]) for r, o, h in firsts], "of int, fo long, fh long, goes int")
    guests = (
        rows.join(F.broadcast(lead), (F.col("range") == F.col("of")) & (F.col("o") == F.col("fo")) & (F.xxhash64("text") == F.col("fh")))
        .select(F.col("goes").alias("range"), "doc_id", "text", F.lit(True).alias("guest"), "o")
        .dropDuplicates(["range"])
    )
    own = rows.select("range", "doc_id", "text", F.lit(False).alias("guest"), "o")
    dealt = own.unionByName(guests).repartition(len(firsts), "range")
    return dealt.sortWithinPartitions("range", "guest", "o", F.xxhash64("text"), "text").select("range", "doc_id", "text", "guest")


def compare_edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for batch in batches:
            rows = [*last, *zip(batch["range"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["guest"].to_pylist())]
            last = rows[-1:]
            for low in range(0, len(rows) - 1, 500):
                part = rows[low : low + 501]
                texts = [r[2].encode() for r in part]
                prints = fingerprints(texts)
                own = [i for i in range(len(part) - 1) if not part[i][3]]
                edited = [edited_text(part[i][2], part[i + 1][2]) for i in own]
                raw = [e.encode() for e in edited]
                other = fingerprints(raw)
                a, b = prints[own], prints[[i + 1 for i in own]]
                if own:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part[i][1] for i in own], pa.int64()), pa.array([len(part[i][2]) for i in own], pa.int64()),
                            pa.array([hashlib.sha256(e).hexdigest() for e in raw], pa.string()), pa.array(packed(a), pa.string()),
                            pa.array(packed(other), pa.string()), pa.array(likeness(a, other), pa.float64()), pa.array(likeness(a, b), pa.float64()),
                        ],
                        names,
                    )

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, schema)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
