"""Traffic causality graph: time-windowed relations between flows.

For an earlier flow a and a later flow b (by time, then record id):

    CR   b answers a: same protocol, 5-tuple reversed
    PR   a host passes traffic on: a ends where b starts, or b ends where a starts
    DHR  same source host, another source port
    SHR  same source host and port

A pair carries the first relation that holds, within that relation's window.  Two rules
keep a pair out even when its window would let it in: a reversed 5-tuple is never anything
but CR, and a pair where a ends at b's source is never DHR or SHR.

Each relation is a time-bucketed equi-join.  Buckets are one window wide; the earlier flow
visits its own bucket and the next, the later flow stays in its own, so every pair meets
in exactly one bucket and nothing has to be de-duplicated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions import hashing
from flowloom.schema import CAUSES_FIELDS, DEFAULT_WINDOWS, FALLBACK_WINDOW, RELATION_PRIORITY
from flowloom.session import cut_lineage

# A bucket where one side has more rows than this is cut into a grid of cells.
CELL_ROWS = 4096
# Up to this many hot buckets are broadcast; beyond it they are joined by shuffle.
MAX_BROADCAST_CELLS = 100_000
# Flows of an endpoint in one block of time that a task still takes; then flows are cut by rank.
DENSE_ROWS = 1_000_000
RANK_ROWS = 65_536
# Counters of the sketch that looks for crowded buckets: rows of hashed counters, and their least and
# largest length.  Above about 4 billion flows it can rule out ever fewer buckets.
SKETCH_ROWS = 2
SKETCH_LEAST, SKETCH_MOST = 1 << 12, 1 << 22
# Counters, of both sides, that a task sends together; at most 65,536, as places in them have 16 bits.
SENT_COUNTERS = 8192

_COLUMNS = {
    "id": "record_id",
    "ts": "timestamp_epoch",
    "protocol": "protocol",
    "src_ip": "src_ip",
    "src_port": "src_port",
    "dst_ip": "dst_ip",
    "dst_port": "dst_port",
}


def parse_relations(text: str) -> list[str]:
    """`SHR,CR` -> ['CR', 'SHR'], in order of precedence."""
    chosen = [part.strip().upper() for part in text.split(",") if part.strip()]
    return check_relations(chosen)


def check_relations(relations: list[str]) -> list[str]:
    unknown = [r for r in relations if r not in RELATION_PRIORITY]
    if unknown or not relations:
        raise ValueError(f"relations must be some of {list(RELATION_PRIORITY)}, got {relations}")
    return sorted(set(relations), key=RELATION_PRIORITY.get)


def relation_windows(default: int | None = FALLBACK_WINDOW, overrides: str | dict | None = None) -> dict:
    """Seconds per relation; 0 means unlimited (None).  Overrides may be text: `CR=5,PR=1`."""
    if isinstance(overrides, str):
        overrides = dict(part.split("=", 1) for part in overrides.split(",") if part.strip())
    windows = dict.fromkeys(RELATION_PRIORITY, default or None)
    for name, seconds in (overrides or {}).items():
        name = name.strip().upper()
        if name not in RELATION_PRIORITY:
            raise ValueError(f"unknown relation {name}")
        seconds = int(seconds or 0)
        if seconds < 0:
            raise ValueError("a window must not be negative")
        windows[name] = seconds or None
    return windows


@dataclass
class _Band:
    """One equi-join: names of a's key columns, of b's key columns, window, extra condition."""

    name: str
    relation: str
    a_keys: list[str]
    b_keys: list[str]
    window: int | None
    residual: Column | None = None
    hot: DataFrame | None = field(default=None)
    hot_rows: int = 0


def _reverse_tuple() -> Column:
    return (
        (F.col("a_protocol") == F.col("b_protocol"))
        & (F.col("a_src_ip") == F.col("b_dst_ip"))
        & (F.col("a_src_port") == F.col("b_dst_port"))
        & (F.col("a_dst_ip") == F.col("b_src_ip"))
        & (F.col("a_dst_port") == F.col("b_src_port"))
    )


def _bands(relations: list[str], windows: dict[str, int | None]) -> list[_Band]:
    cr = _reverse_tuple()
    forward = F.col("a_dst_ip") == F.col("b_src_ip")
    backward = F.col("a_src_ip") == F.col("b_dst_ip")
    same_host = ~cr & ~forward
    if "PR" in relations:
        taken = backward if windows["PR"] is None else backward & (_delta() <= windows["PR"])
        same_host = same_host & ~taken
    bands = {
        "CR": [
            _Band(
                "CR",
                "CR",
                ["protocol", "src_ip", "src_port", "dst_ip", "dst_port"],
                ["protocol", "dst_ip", "dst_port", "src_ip", "src_port"],
                windows["CR"],
            )
        ],
        "PR": [
            _Band("PR_forward", "PR", ["dst_ip"], ["src_ip"], windows["PR"], ~cr),
            _Band("PR_backward", "PR", ["src_ip"], ["dst_ip"], windows["PR"], ~cr & ~forward),
        ],
        "DHR": [
            _Band(
                "DHR",
                "DHR",
                ["src_ip"],
                ["src_ip"],
                windows["DHR"],
                same_host & (F.col("a_src_port") != F.col("b_src_port")),
            )
        ],
        "SHR": [_Band("SHR", "SHR", ["src_ip", "src_port"], ["src_ip", "src_port"], windows["SHR"], same_host)],
    }
    return [band for relation in relations for band in bands[relation]]


def _delta() -> Column:
    return F.col("b_ts") - F.col("a_ts")


def _side(flows: DataFrame, prefix: str, keys: list[str], window: int | None) -> DataFrame:
    """Slim, prefixed flows with join keys k0.. and the bucket(s) they belong to."""
    side = flows.select(
        *[F.col(source).alias(f"{prefix}_{name}") for name, source in _COLUMNS.items()],
        *[F.col(key).alias(f"k{i}") for i, key in enumerate(keys)],
    )
    if window is None:
        return side.withColumn("bucket", F.lit(0).cast("bigint"))
    own = F.floor(F.col(f"{prefix}_ts") / F.lit(window)).cast("bigint")
    return side.withColumn("bucket", F.explode(F.array(own, own + 1)) if prefix == "a" else own)


def _cell_keys(band: _Band) -> list[str]:
    return [f"k{i}" for i in range(len(band.a_keys))] + ["bucket"]


def _hot_cells(flows: DataFrame, band: _Band, number: int, cell_rows: int, marked: Callable) -> DataFrame:
    """Buckets that need a grid: their keys and its size `na` x `nb`, counted exactly among the possible ones."""
    keys = _cell_keys(band)
    sides = []
    for prefix, names in (("a", band.a_keys), ("b", band.b_keys)):
        side = _side(flows, prefix, names, band.window)
        cell = F.xxhash64(F.lit(number), *[F.col(f"k{i}") for i in range(len(names))], F.col("bucket"))
        crowded = side.filter(marked(cell))
        sides.append(crowded.select(*keys, F.lit(int(prefix == "a")).alias("a"), F.lit(int(prefix == "b")).alias("b")))
    counts = sides[0].unionAll(sides[1]).groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return counts.filter(_crowded(cell_rows)).select(
        *keys,
        F.ceil(F.col("a") / cell_rows).cast("int").alias("na"),
        F.ceil(F.col("b") / cell_rows).cast("int").alias("nb"),
    )


def _crowded(cell_rows: int) -> Column:
    return (F.greatest("a", "b") > cell_rows) & (F.least("a", "b") > 0)


def _slots(cells: np.ndarray, row: int, width: int) -> np.ndarray:
    """Counter of each cell hash in one row of a sketch; the width is a power of two."""
    mixed = cells.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * row)
    return (mixed >> np.uint64(64 - int(width).bit_length() + 1)).astype(np.int64)


def _marked(possible: bytes, width: int):
    """Whether a cell's counters are all among those of crowded buckets, given as bits."""

    @F.pandas_udf("boolean")
    def marked(cells: pd.Series) -> pd.Series:
        values = cells.to_numpy(np.int64).view(np.uint64)
        bits = np.frombuffer(possible, np.uint8)
        slots = [row * width + _slots(values, row, width) for row in range(SKETCH_ROWS)]
        return pd.Series(np.logical_and.reduce([(bits[at >> 3] >> (at & 7)) & 1 == 1 for at in slots]))

    return marked


def _sketch(flows: DataFrame, bands: list[_Band], width: int, cell_rows: int) -> bytes:
    """Counters that a crowded bucket may have, as bits, row after row of a count-min sketch.

    The sketch holds the visits of all flows to the buckets of all bands, counted for both sides.  A
    task sends the counters that are not 0, in chunks; chunks are added up and judged in
    Spark, so the driver gets one bit a counter, whatever the number of flows.
    """
    visits, of_a = [], []
    for i, band in enumerate(bands):
        for side, keys in ((1, band.a_keys), (0, band.b_keys)):
            own = F.lit(0).cast("bigint")
            if band.window is not None:
                own = F.floor(F.col("timestamp_epoch") / F.lit(band.window)).cast("bigint")
            for bucket in (own, own + 1) if side and band.window is not None else (own,):
                visits.append(F.xxhash64(F.lit(i), *[F.col(k) for k in keys], bucket))
                of_a.append(side)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH_ROWS * width * 2, np.int32)
        for batch in batches:
            for name, side in zip(batch.schema.names, of_a):
                cells = batch[name].to_numpy(zero_copy_only=False).view(np.uint64)
                for row in range(SKETCH_ROWS):
                    np.add.at(total, 2 * (row * width + _slots(cells, row, width)) + side, 1)
        for low in range(0, len(total), 64 * SENT_COUNTERS):
            at = low + np.flatnonzero(total[low : low + 64 * SENT_COUNTERS])
            chunk, first = np.unique(at // SENT_COUNTERS, return_index=True)
            parts = [at[i:j] for i, j in zip(first, [*first[1:], len(at)])]
            places = [(x % SENT_COUNTERS).astype(np.uint16).tobytes() for x in parts]
            sent = [pa.array(chunk, pa.int32()), pa.array(places, pa.binary()), pa.array([total[x].tobytes() for x in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(sent, ["chunk", "at", "n"])

    def judge(found: pa.Table) -> pa.Table:
        total = np.zeros(SENT_COUNTERS, np.int64)
        for at, n in zip(found["at"], found["n"]):
            total[np.frombuffer(at.as_py(), np.uint16)] += np.frombuffer(n.as_py(), np.int32)
        b, a = total.reshape(-1, 2).T
        bits = np.packbits((np.maximum(a, b) > cell_rows) & (np.minimum(a, b) > 0), bitorder="little")
        return pa.table({"chunk": found["chunk"][:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    named = flows.select(*[v.alias(f"v{i}") for i, v in enumerate(visits)])
    sums = named.mapInArrow(count, "chunk int, at binary, n binary").groupBy("chunk").applyInArrow(judge, "chunk int, bits binary")
    size = SENT_COUNTERS // 16  # bytes of the bits of a chunk
    out = bytearray(size * -(-SKETCH_ROWS * width * 2 // SENT_COUNTERS))
    for r in sums.collect():
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = r["bits"]
    return bytes(out)


def _find_hot_cells(flows: DataFrame, bands: list[_Band], cell_rows: int) -> None:
    """Find the crowded buckets of all bands and count them.

    A count-min sketch never counts too little, so a bucket that is not crowded in it is not
    crowded; only flows of the other buckets are counted again, exactly.  The sketch has a few
    counters per crowded bucket that there can be, and at most SKETCH_MOST a row.
    """
    wanted = 64 * len(bands) * flows.count() // max(1, cell_rows)
    width = 1 << (min(max(wanted, SKETCH_LEAST), SKETCH_MOST) - 1).bit_length()
    possible = _sketch(flows, bands, width, cell_rows)
    if not any(possible):
        return
    for i, band in enumerate(bands):
        band.hot = cut_lineage(_hot_cells(flows, band, i, cell_rows, _marked(possible, width)))
        band.hot_rows = band.hot.count()


def _pairs(flows: DataFrame, band: _Band) -> DataFrame:
    a = _side(flows, "a", band.a_keys, band.window)
    b = _side(flows, "b", band.b_keys, band.window)
    keys = _cell_keys(band)
    if band.hot_rows:
        # Each a row goes to one grid row and all its columns, each b row to one column
        # and all its rows: a pair still meets once, in a cell of bounded size.
        hot = F.broadcast(band.hot) if band.hot_rows <= MAX_BROADCAST_CELLS else band.hot
        na, nb = F.coalesce("na", F.lit(1)), F.coalesce("nb", F.lit(1))

        def spread(size: Column, ident: str) -> Column:
            return F.pmod(F.xxhash64(ident), size).cast("int")

        def every(size: Column) -> Column:
            return F.explode(F.sequence(F.lit(0), size - 1))

        a = a.join(hot, keys, "left").withColumn("ca", spread(na, "a_id")).withColumn("cb", every(nb)).drop("na", "nb")
        b = b.join(hot, keys, "left").withColumn("cb", spread(nb, "b_id")).withColumn("ca", every(na)).drop("na", "nb")
        keys = keys + ["ca", "cb"]
    tie = (F.col("a_ts") == F.col("b_ts")) & (F.col("a_id") < F.col("b_id"))
    ordered = (F.col("a_ts") < F.col("b_ts")) | tie
    keep = ordered if band.window is None else ordered & (_delta() <= band.window)
    if band.residual is not None:
        keep = keep & band.residual
    return a.join(b, keys).filter(keep).select("a_id", "b_id", _delta().alias("delta"))


def _project(pairs: DataFrame, relation: str) -> DataFrame:
    a, b = F.col("a_id"), F.col("b_id")
    fields = {
        "relation_id": hashing.edge_hash(a, b, F.lit(relation)),
        "src_record_id": a,
        "dst_record_id": b,
        "source_id": a,
        "target_id": b,
        "relation_type": F.lit(relation),
        "relation_priority": F.lit(RELATION_PRIORITY[relation]).cast("bigint"),
        "delta_seconds": F.col("delta"),
        "same_timestamp": F.col("delta") == 0,
    }
    return pairs.select(*[fields[f].alias(f) for f in CAUSES_FIELDS])


def edges(
    flows: DataFrame,
    windows: dict[str, int | None] | None = None,
    relations: list[str] | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """CAUSES edges of the selected relations.

    Runs a sketch of the buckets to find those too crowded for one task, then returns the
    lazy union of at most five equi-joins.
    """
    windows = windows or DEFAULT_WINDOWS
    chosen = check_relations(relations or list(RELATION_PRIORITY))
    bands = _bands(chosen, windows)
    _find_hot_cells(flows, bands, cell_rows)
    return reduce(DataFrame.unionByName, [_project(_pairs(flows, band), band.relation) for band in bands])


def capped_shr_edges(
    flows: DataFrame, k: int = 15, window: int = 5, block_seconds: int | None = None, dense_rows: int = DENSE_ROWS
) -> DataFrame:
    """Each flow to the next k flows of its source endpoint within `window` seconds.

    No join: a look-ahead of k rows per endpoint.  The endpoint's rows are cut into time
    blocks (eight windows long by default), and flows within `window` after a block's end
    are repeated into it as candidates, so a busy endpoint is spread over many tasks.
    Time does not cut a dense second, nor anything where a window of 0 is unlimited: when a block
    has more than `dense_rows` flows (one counting job), flows are cut by their rank instead.
    """
    limited = window > 0
    width = max(block_seconds or 8 * window, window, 1)
    ts = F.col("timestamp_epoch")

    def block(seconds: Column) -> Column:
        return F.floor(seconds / F.lit(width)).cast("bigint") if limited else F.lit(0).cast("bigint")

    fullest = flows.groupBy("src_ip", "src_port", block(ts)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n
    if (fullest or 0) > dense_rows:
        return _project(_ranked_pairs(flows, k, window), "SHR")
    placed = flows.select(
        "src_ip",
        "src_port",
        F.struct(ts.alias("ts"), F.col("record_id").alias("id")).alias("flow"),
        block(ts).alias("own"),
        F.explode(F.sequence(block(ts - window), block(ts))).alias("block"),
    )
    ahead = (
        Window.partitionBy("src_ip", "src_port", "block").orderBy("flow.ts", "flow.id").rowsBetween(1, k)
    )
    followed = placed.withColumn("next", F.collect_list("flow").over(ahead)).filter("own = block")
    pairs = (
        followed.select("flow", F.explode("next").alias("next"))
        .select(
            F.col("flow.id").alias("a_id"),
            F.col("next.id").alias("b_id"),
            (F.col("next.ts") - F.col("flow.ts")).alias("delta"),
        )
        .filter((F.col("delta") <= window) if limited else F.lit(True))
    )
    return _project(pairs, "SHR")


def _ranked_pairs(flows: DataFrame, k: int, window: int) -> DataFrame:
    """Each flow with the next k of its endpoint, by way of the rank of every flow among all.

    Flows are sorted by (endpoint, time, id) over range partitions and written; the counts of the
    partitions before give ranks, and ranks are cut into chunks of a fixed size.  The first k flows of a chunk are also
    seen by the chunk before.  So a task holds one chunk, whatever endpoint or second its flows are of.
    """
    order = ["src_ip", "src_port", "timestamp_epoch", "record_id"]
    rows = flows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut_lineage(rows.withColumn("place", F.monotonically_increasing_id()))
    part, place = F.shiftright("place", 33).cast("int"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row a partition
    before, starts = 0, []
    for r in counts:
        starts.append((r["part"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(starts, "part int, before long")
    ranked = rows.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + place)
    chunk = F.floor(F.col("rank") / RANK_ROWS)
    seen = F.when((F.col("rank") % RANK_ROWS < k) & (chunk > 0), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    flow = F.struct("src_ip", "src_port", F.col("timestamp_epoch").alias("ts"), F.col("record_id").alias("id"))
    placed = ranked.select("rank", flow.alias("flow"), chunk.alias("own"), F.explode(seen).alias("chunk"))
    ahead = Window.partitionBy("chunk").orderBy("rank").rowsBetween(1, k)
    pairs = placed.withColumn("next", F.collect_list("flow").over(ahead)).filter("own = chunk").select("flow", F.explode("next").alias("next"))
    delta = F.col("next.ts") - F.col("flow.ts")
    keep = F.expr("flow.src_ip = next.src_ip AND flow.src_port = next.src_port")
    keep = keep & (delta <= window) if window > 0 else keep
    return pairs.filter(keep).select(F.col("flow.id").alias("a_id"), F.col("next.id").alias("b_id"), delta.alias("delta"))


def capped_edges(
    flows: DataFrame, k: int = 15, shr_window: int = 5, cr_window: int | None = 5, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Degree-capped SHR edges, and every CR edge whose pair is not among them."""
    shr = capped_shr_edges(flows, k, shr_window)
    cr = edges(flows, {**DEFAULT_WINDOWS, "CR": cr_window}, ["CR"], cell_rows)
    pair = ["src_record_id", "dst_record_id"]
    return shr.unionByName(cr.join(shr.select(*pair), pair, "left_anti").select(*CAUSES_FIELDS))
