"""K-d tree partitioning of rows into shards of near equal bytes.

The tree splits a cell along its widest metadata dimension (spread in the cell over spread in
the table) at the weighted median of the bytes; a cell that owes an odd number of shards is
cut at the matching share.  Medians are exact: a histogram of the cell's keys over 2^12
ranges is summed by Spark and refined within the range that holds the median, for all cells at
once, so each refinement is one aggregation and what reaches the driver is bounded by the
number of cells.

Equal texts stay together where they can: they have one place on every dimension, and a cut
goes beside a group of equal texts unless the group is larger than a set share of a shard; then
it goes through the group, by a hash of the id.

Defined results: null text has no bytes, null language or source is empty text, null ids
are rows like others.  Rows with equal id and text can't be told apart, so they stay together.
Other columns play no part.  An empty table gives no rows.  With fewer rows than
shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm.common import table
from flowloom.session import cut_lineage

SHARDS = 24
ROW_BYTES = 8
WHOLE_GROUP = 1 / 64  # a group of equal texts below this share of a shard is not cut
BITS = 12
KEY_BITS = 60
SLOT_ROWS = 200_000
DIMENSIONS = ("d_size", "d_lang", "d_source")


def _described(docs: DataFrame) -> DataFrame:
    """Narrow rows: id, bytes, hash of the text and metadata dimensions, each 20 bits wide."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
    )
    # Copies can differ in language and source; the group takes the least of them.
    rows = cut_lineage(rows)
    groups = rows.groupBy("text_hash", "size").agg(F.min("lang").alias("lang"), F.min("source").alias("source"))
    rank = 2**20
    dims = groups.select(
        F.col("text_hash").alias("of"),
        F.col("size").alias("of_size"),
        F.least(F.lit(rank - 1), F.floor(F.log2(F.col("size")) * 2**14)).cast("long").alias("d_size"),
        F.pmod(F.xxhash64("lang"), F.lit(rank)).alias("d_lang"),
        F.pmod(F.xxhash64("source"), F.lit(rank)).alias("d_source"),
        F.pmod(F.xxhash64("text_hash", "size"), F.lit(2**40)).alias("tie"),
    )
    return cut_lineage(
        rows.drop("lang", "source")
        .join(dims, (F.col("text_hash") == F.col("of")) & (F.col("size") == F.col("of_size")))
        .drop("of", "of_size")
        .withColumn("inner", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2**KEY_BITS)))
    )


def _median_keys(rows: DataFrame, key: str, wanted: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Per cell the key at which the running bytes pass the wanted bytes, and the bytes before that key."""
    spark = rows.sparkSession
    found = {cell: (0, 0) for cell in wanted}
    for shift in range(KEY_BITS - BITS, -1, -BITS):
        at = spark.createDataFrame([(c, low, wanted[c] - before) for c, (low, before) in found.items()], "at int, low long, rest long")
        inside = rows.join(F.broadcast(at), F.col("cell") == F.col("at"))  # one row per cell
        inside = inside.where(F.shiftright(F.col(key), shift + BITS) == F.shiftright("low", shift + BITS))
        bins = inside.groupBy("cell", "rest", F.shiftright(F.col(key), shift).alias("bin")).agg(F.sum("size").alias("bytes"))
        by = Window.partitionBy("cell").orderBy("bin")  # at most 2^12 bins of a cell
        passed = bins.withColumn("upto", F.sum("bytes").over(by)).where("upto >= rest")
        first = passed.groupBy("cell").agg(F.min(F.struct("bin", (F.col("upto") - F.col("bytes")).alias("before"))).alias("x"))
        for r in first.collect():  # one row per cell
            low, before = found[r["cell"]]
            found[r["cell"]] = (r["x"]["bin"] << shift, before + r["x"]["before"])
    return found


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard) of every row."""
    rows = _described(docs).withColumns({"cell": F.lit(0), "key": F.lit(0).cast("long")})
    spread = {d: (F.max(d) - F.min(d)).cast("double").alias(d) for d in DIMENSIONS}
    whole = rows.agg(*spread.values(), F.sum("size").alias("bytes")).first()
    if not whole["bytes"]:
        return rows.select("doc_id", "size", "text_crc32", F.col("cell").alias("shard"))
    limit = int(whole["bytes"] / shards * WHOLE_GROUP)
    owes = {0: shards}  # shards that a cell is still to be cut into; a cell is named by its first shard
    while max(owes.values()) > 1:
        cells = {r["cell"]: r for r in rows.groupBy("cell").agg(*spread.values(), F.sum("size").alias("bytes")).collect()}
        owes = {c: n if c in cells else 1 for c, n in owes.items()}  # a cell without rows is not cut
        active = [c for c, n in owes.items() if n > 1]
        if not active:
            break
        widest = {c: max(DIMENSIONS, key=lambda d: (cells[c][d] / (whole[d] or 1.0), d)) for c in active}
        # The key of a cell: the widest dimension, then the group of equal texts.
        value = F.lit(None).cast("long")
        for d in DIMENSIONS:
            chosen = [c for c in active if widest[c] == d]
            if chosen:
                value = F.when(F.col("cell").isin(chosen), F.col(d) * 2**40 + F.col("tie")).otherwise(value)
        rows = rows.withColumn("key", value)
        wanted = {c: max(1, cells[c]["bytes"] * (owes[c] // 2) // owes[c]) for c in active}
        keys = _median_keys(rows.where("key IS NOT NULL"), "key", wanted)
        at_key = F.lit(False)
        for c, (k, _) in keys.items():
            at_key = at_key | ((F.col("cell") == c) & (F.col("key") == k))
        met = rows.where(at_key)
        sizes = {r["cell"]: r["bytes"] for r in met.groupBy("cell").agg(F.sum("size").alias("bytes")).collect()}
        inner = {c: wanted[c] - keys[c][1] for c in active if sizes[c] > limit}
        within = _median_keys(met, "inner", inner) if inner else {}
        moved = F.col("cell")
        for c in active:
            k, before = keys[c]
            low_side = owes[c] // 2
            if c in inner:
                # The group is cut by id; the row at the cut goes where less is wrong.
                stop, upto = within[c]
                right = (F.col("key") > k) | ((F.col("key") == k) & (F.col("inner") >= stop))
            elif wanted[c] - before > sizes[c] / 2:
                right = F.col("key") > k
            else:
                right = F.col("key") >= k
            moved = F.when((F.col("cell") == c) & right, F.lit(c + low_side)).otherwise(moved)
            owes[c + low_side] = owes[c] - low_side
            owes[c] = low_side
        rows = cut_lineage(rows.withColumn("cell", moved.cast("int")))
    return rows.select("doc_id", "size", "text_crc32", F.col("cell").alias("shard"))


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard: by sub-range of a hash, so that no task orders a whole shard."""
    parts = max(1, -(-rows.count() // SLOT_ROWS))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(3)), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "sub").count()
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("shard").alias("in_shard"), F.col("sub").alias("in_sub"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32")
    numbered = rows.withColumn("place", F.row_number().over(order))
    joined = numbered.join(first, (F.col("shard") == F.col("in_shard")) & (F.col("sub") == F.col("in_sub")))
    return joined.withColumn("slot", (F.col("place") - 1 + F.col("first")).cast("long"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return with_slots(assign(docs)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
