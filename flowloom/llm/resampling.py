"""Target-distribution importance resampling of documents.

Words are hashed into a fixed number of buckets.  A bucket's gain is the logarithm of its
share in the target over its share in the corpus, held as one array; a document's weight is the
sum over its words, read off that array.  With Gumbel noise from a hash of the id, the highest
scores are a draw without replacement in proportion to the weights.

The draw is a parallel sort by regular sampling: every partition sorts its rows and writes
them as a run; rows at regular places of the runs give splitters at regular places of the sorted sample;
the segments between splitters are exchanged and merged, and the counts of the segments before
give exact ranks.  Segments behind the last drawn rank are counted but not exchanged.

Defined results: a null or empty text has no words and weight 0.  Documents of fewer than
`least_words` words keep a null rank.  Equal scores go to the smaller id, null ids last, and
repeated rows to the row written first: each has a rank of its own.  A null id is hashed as
empty text.  Other columns play no part.  An empty table gives no rows, an empty target
gains from smoothing alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import arrays
from flowloom.llm.common import table
from flowloom.session import cut_lineage

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
SLICE_BYTES = 1_000_000
SEGMENT_ROWS = 8192
SAMPLES_PER_SEGMENT = 16
# Splitters reach the driver; beyond 100 million rows segments grow, and a segment is sorted on disk.
MOST_SAMPLES = 200_000
# Separators become spaces and A-Z lower case, so that words are what `split` leaves.
WORD_BYTES = np.where(arrays.NOT_ALPHANUMERIC, 32, arrays.LOWER).astype(np.uint8).tobytes()
PLACE_BITS = 33  # of a row number: the place in its partition


def slices(text: bytes, limit: int = SLICE_BYTES) -> Iterator[bytes]:
    """Parts of about `limit` bytes, cut before a space; a longer word is not cut."""
    low = 0
    while len(text) - low > limit:
        cut = text.rfind(b" ", low + 1, low + limit)
        if cut < 0:
            cut = text.find(b" ", low + limit)
            if cut < 0:
                break
        yield text[low:cut]
        low = cut
    yield text[low:] if low else text


def word_buckets(text: bytes, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all words of a text, in parts."""
    for part in slices(text.translate(WORD_BYTES)):
        words = part.split()
        yield np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Words of all texts by bucket; each task sends its counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in arrays.byte_list(batch["text"]):
                for part in word_buckets(text, buckets):
                    counts += np.bincount(part, minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])
        arrays.release()

    found = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of smoothed target share over corpus share, rounded down."""
    n = len(corpus)
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = np.zeros((2, batch.num_rows), np.int64)
            for i, text in enumerate(arrays.byte_list(batch["text"])):
                for part in word_buckets(text, len(gain)):
                    n[i] += len(part)
                    weight[i] += gain[part].sum()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n), pa.array(weight)], ["doc_id", "n_features", "weight"])
        arrays.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_features long, weight long")


def with_noise(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds `score`: the weight with Gumbel noise in thousandths, from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighted.withColumn("score", F.col("weight") + noise)


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """Rows as byte strings that sort like (highest score, smallest id, null ids last, place)."""
    out = np.zeros((batch.num_rows, 4), ">u8")
    sign = np.uint64(1 << 63)
    out[:, 0] = ~(batch["score"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ sign)
    out[:, 1] = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
    out[:, 2] = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ sign
    out[:, 3] = batch["place"].to_numpy(zero_copy_only=False)
    return out.view("S32").ravel()


def _splitters(runs: DataFrame, rows: int) -> np.ndarray:
    """Keys at regular places of the sorted regular sample of all runs; bounded by MOST_SAMPLES.

    Every run starts its regular places at a hash of its number, so that many short runs
    are sampled as evenly as one long one.
    """
    step = max(1, SEGMENT_ROWS // SAMPLES_PER_SEGMENT, -(-rows // MOST_SAMPLES))
    run, place = F.shiftright("place", PLACE_BITS), F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    sample = runs.where(F.pmod(place + F.pmod(F.xxhash64(run), F.lit(step)), F.lit(step)) == 0).select("score", "doc_id", "place").toArrow()
    keys = np.sort(np.concatenate([np.zeros(0, "S32"), *(_keys(b) for b in sample.to_batches())]))
    per = max(1, round(SEGMENT_ROWS / step))
    return keys[per::per]


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """`scored` with `rank` (1, 2, ... by score) of the drawn share of documents, else null."""
    spark = scored.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    runs = cut_lineage(scored.sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    can = F.col("n_features") >= least_words
    columns = ["doc_id", "n_features", "weight", "score"]
    out = runs.where(~can).select(*columns, F.lit(None).cast("long").alias("rank"))
    able = runs.where(can)
    rows = able.count()
    wanted = rows * percent // 100
    splitters = _splitters(able, rows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segment = np.searchsorted(splitters, _keys(batch), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment)], [*batch.schema.names, "segment"])

    dealt = able.select(*columns, "place").mapInArrow(deal, "doc_id long, n_features long, weight long, score long, place long, segment int")
    counts = {r["segment"]: r["n"] for r in dealt.groupBy("segment").agg(F.count("*").alias("n")).collect()}
    before, segments = [0], 0
    while before[-1] < wanted:
        before.append(before[-1] + counts.get(segments, 0))
        segments += 1
    out = out.unionAll(dealt.where(F.col("segment") >= segments).select(*columns, F.lit(None).cast("long").alias("rank")))
    if not segments:
        return out
    # One partition a segment: the place in the partition counts on from the segments before.
    merged = dealt.where(F.col("segment") < segments).repartitionById(segments, "segment").sortWithinPartitions(*order, "place")
    merged = merged.withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    starts = spark.createDataFrame([(i, n) for i, n in enumerate(before[:segments])], "segment int, before long")
    rank = F.col("before") + F.col("place") + 1
    ranked = merged.join(F.broadcast(starts), "segment").select(*columns, F.when(rank <= wanted, rank).alias("rank"))
    return out.unionAll(ranked)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document, drawn towards the words of `target`."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    return draw(with_noise(weights(docs, gain), seed), percent, least_words)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH crcs AS (SELECT list(list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
texts AS (
  SELECT row_number() OVER () AS row, doc_id, false AS target, text FROM documents
  UNION ALL SELECT -1, NULL, true, text FROM benchmark),
words AS MATERIALIZED (
  SELECT row, target, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
features AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2),
      lambda j: ('0x' || substr(h, 1 + 2 * j, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM words), crcs),
counts AS (
  SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM words JOIN features USING (word) GROUP BY 1),
totals AS (SELECT sum(s)::DOUBLE AS a, sum(t)::DOUBLE AS b FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (a + 10000) / ((s + 1)::DOUBLE * (b + 10000))))::BIGINT AS gain FROM counts, totals),
weights AS (
  SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM words JOIN features USING (word) JOIN gains USING (bucket)
  WHERE NOT target GROUP BY 1),
scored AS (
  SELECT row, doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (row) WHERE NOT target),
ranks AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranks USING (row)
"""
