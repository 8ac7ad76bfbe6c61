"""Language-model scores by online logistic context mixing.

A token is coded in three parts.  First its group, as a path of binary decisions in a Huffman
tree over several hundred groups: each frequent token is a group, other tokens are grouped by
a hash of their last bytes.  Then, within a hashed group, the low bits of the token's hash, one by
one.  Last, where several tokens of a group agree in these bits, the token by its share of their count.
Every decision is predicted by several context predictors at the same node:

* the node alone, from the corpus;
* what is before (groups for the group; words for the bits), hashed into a fixed table of counts of the corpus;
* the two groups or words before, hashed likewise;
* the node in this text so far, adapting after every decision.

Their logits are combined by weights, one set per depth of the tree (the gate), and the weights are
refined after every decision by the gradient of the coding cost.  Weights and the adapting
predictor go through a whole text; many texts run side by side.  Bits over bytes of a text is `bits_per_byte`.

What is gathered from the corpus grows with it: each task sends the distinct tokens of its
blocks, packed, to buckets by hash; a bucket sums the counts and hands back to each block
the counts of its tokens.  No task or driver holds the vocabulary.  The group tables are of fixed size:
at most 1 / FREQUENT frequent tokens, GROUPS hashed groups, 2^SLOT_BITS and 2^REST_SLOT_BITS slots,
alike at every size of the corpus.

Defined results: a null text is empty and has one token, the end.  Null ids count as empty
text in the split.  Repeated rows get equal scores, bit for bit.  Other columns play no part.  An
empty table gives no rows.  Without training rows every token is unknown.

Tokens are compared by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import arrays
from flowloom.llm.common import remainder, table
from flowloom.session import cut_lineage

FREQUENT = 1 / 1024  # a token of at least this share of the training tokens is a group
GROUPS = 512
SLOT_BITS = 19
REST_SLOT_BITS = 21
REST_BITS = 12  # hash bits of a token that are coded within its hashed group
REST_CELL_BITS = 7  # cells of the adapting predictor of each hash bit, for each text
LANES = 512  # texts side by side
STEP_TOKENS = 8192  # tokens whose logits are looked up at once
SMOOTHING = 0.1
RATE = 0.02
START_WEIGHT = 0.35
BLOCK_BYTES = 4_000_000
TABLE_BYTES = 100_000_000  # texts for which a task sends one set of context tables
WORK_BYTES = 250_000  # what a task has as arrays at once
_END = np.uint64(0x2545F4914F6CDD1D)  # hash of the end token


class Block:
    """Tokens of some texts: hash, hashed group and text of each; ends included."""

    def __init__(self, texts: list[bytes]):
        n = len(texts)
        hashes, suffixes, docs = [], [], []
        for low, high in arrays.pieces(texts, WORK_BYTES):
            w = arrays.words(texts[low:high])
            last = w.end - 1
            three = np.zeros(len(last), np.uint64)
            for j in range(3):
                at = np.maximum(last - j, w.start)
                three = three * np.uint64(257) + arrays.LOWER[w.data[at]]
            hashes.append(w.hash)
            suffixes.append((arrays.mix(three) >> np.uint64(32)).astype(np.int32) % GROUPS)
            docs.append(w.doc + low)
        hash_, suffix, doc = (np.concatenate([*x, np.zeros(0, k)]) for x, k in ((hashes, np.uint64), (suffixes, np.int32), (docs, np.int64)))
        # An end after the words of each text.
        place = np.arange(len(hash_)) + doc
        ends = np.searchsorted(doc, np.arange(n), side="right") + np.arange(n)
        total = len(hash_) + n
        self.hash, self.suffix, self.doc = np.empty(total, np.uint64), np.zeros(total, np.int32), np.empty(total, np.int64)
        self.hash[place], self.suffix[place], self.doc[place] = hash_, suffix, doc
        self.hash[ends], self.doc[ends] = _END, np.arange(n)
        self.first = np.concatenate([[0], ends + 1])


def _packed(rows: list[pa.RecordBatch]) -> bytes:
    """Rows of a block as one compressed value, without threads: a forked Python worker has none of its parent's."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
        for batch in rows:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _rows_of(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data, options=pa.ipc.IpcReadOptions(use_threads=False)).read_all()


def _texts_by_block(docs: DataFrame) -> DataFrame:
    """(block, bytes, data): texts in blocks of bounded bytes, one compressed row each, written once so that blocks are fixed.

    Texts of like length share a block: coding one takes as many steps as its longest text has tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, size, rows = TaskContext.get().partitionId(), 0, 0, []

        def block() -> pa.RecordBatch:
            n = sum(pc.sum(r["bytes"]).as_py() for r in rows)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + count], pa.int64()), pa.array([n], pa.int64()), pa.array([_packed(rows)], pa.binary())], ["block", "bytes", "data"])

        for batch in batches:
            low = 0
            for i, n in enumerate(batch["bytes"].to_pylist()):
                if size and size + n > BLOCK_BYTES:
                    if i > low:
                        rows.append(batch.slice(low, i - low))
                    yield block()
                    low, count, size, rows = i, count + 1, 0, []
                size += n + 1
            if batch.num_rows > low:
                rows.append(batch.slice(low))
        if rows:
            yield block()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        (~held_out(F.col("doc_id"))).alias("train"), F.coalesce("text", F.lit("")).alias("text"),
    ).sortWithinPartitions("bytes")
    return cut_lineage(rows.mapInArrow(run, "block long, bytes long, data binary"))


def _distinct(b: Block, buckets: int) -> tuple[np.ndarray, ...]:
    """Distinct tokens of a block: hash, suffix, place of each token among them, and for each bucket in use which they are.

    Buckets go by leaf, so that a bucket has all tokens of its leaves.
    """
    hashes, first, inverse = np.unique(b.hash, return_index=True, return_inverse=True)
    suffix = b.suffix[first]
    to = (arrays.mix(_leaf(suffix, hashes, REST_BITS)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    used, cut = np.unique(to[order], return_index=True)
    return hashes, suffix, inverse, dict(zip(used.tolist(), np.split(order, cut[1:])))


def _block_tokens(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, hashes, suffixes, counts): distinct tokens of each block with their training counts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch["block"].to_pylist(), batch["data"]):
                rows = _rows_of(data.as_py())
                b = Block(arrays.byte_list(rows["text"]))
                hashes, suffix, inverse, parts = _distinct(b, buckets)
                counts = np.bincount(inverse, np.array(rows["train"].to_pylist())[b.doc], len(hashes)).astype("<i4")
                suffix = suffix.astype("<i2")
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": list(parts), "block": [block] * len(parts), "hashes": [hashes[p].tobytes() for p in parts.values()],
                        "suffixes": [suffix[p].tobytes() for p in parts.values()], "counts": [counts[p].tobytes() for p in parts.values()],
                    },
                    schema=_TOKENS,
                )

    return texts.select("block", "data").mapInArrow(run, "bucket long, block long, hashes binary, suffixes binary, counts binary")


_TOKENS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("suffixes", pa.binary()), ("counts", pa.binary())])


def _leaf(suffix: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """What the tokens of a hashed group with equal low bits share."""
    return (suffix.astype(np.uint64) << np.uint64(32)) | (hashes & np.uint64((1 << bits) - 1))


_COUNTS = np.dtype([("total", "<i8"), ("others", "<i8"), ("types", "<i4")])


def _summed(tokens: DataFrame, bits: int) -> DataFrame:
    """(block, bucket, data): per bucket the summed counts for each block, in the block's order, and, once, with
    block -1, its `_statistics`.

    A bucket is given by a hash of the leaf, so it has all tokens that share a leaf: `others` is the count
    of the other tokens of each token's leaf and `types` the number of its tokens.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(h, np.uint64) for h in rows["hashes"]]
        counts = np.concatenate([np.frombuffer(c, "<i4") for c in rows["counts"]])
        suffix = np.concatenate([np.frombuffer(s, "<i2") for s in rows["suffixes"]])
        hashes, first, inverse = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        suffix = suffix[first].astype(np.int64)
        found = np.zeros(len(hashes), _COUNTS)
        found["total"] = np.bincount(inverse, counts)
        _, of = np.unique(_leaf(suffix, hashes, bits), return_inverse=True)
        found["others"] = np.bincount(of, found["total"])[of] - found["total"]
        found["types"] = np.bincount(of, found["total"] > 0)[of]
        cut = np.cumsum([len(p) for p in parts])[:-1]
        bucket = int(rows["bucket"].iloc[0])
        out = [(int(b), bucket, pa.compress(b"".join(found[name][i].tobytes() for name in _COUNTS.names), "zstd", asbytes=True)) for b, i in zip(rows["block"], np.split(inverse, cut))]
        out.append((-1, bucket, _statistics(hashes, suffix, found["total"])))
        return pd.DataFrame(out, columns=["block", "bucket", "data"])

    return tokens.groupBy("bucket").applyInPandas(run, "block long, bucket long, data binary")


def _statistics(hashes: np.ndarray, suffix: np.ndarray, total: np.ndarray) -> bytes:
    """Tokens and kinds of tokens of a bucket, the same for each hashed group, and hash, suffix and count of
    all that may be frequent: who has a share of all tokens has it of the bucket's too."""
    known = total > 0
    may = known & ((total >= total.sum() * FREQUENT) | (hashes == _END))
    sums = np.bincount(suffix, total, GROUPS), np.bincount(suffix[known], minlength=GROUPS)
    columns = [total.sum(), known.sum()], *sums, hashes[may].view(np.int64), suffix[may], total[may]
    return b"".join(np.asarray(c).astype("<i8").tobytes() for c in columns)


def _group_statistics(summed: DataFrame) -> dict:
    """Token totals, the frequent tokens, and count and tokens of each hashed group."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = np.array([np.frombuffer(x, "<i8", 2) for x in batch["data"].to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(heads[:, 0], pa.int64()), pa.array(heads[:, 1], pa.int64())], ["n", "v"])

    whole = summed.where("block = -1").select("data")
    sums = whole.mapInArrow(totals, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = int(sums["n"] or 0), int(sums["v"] or 0)
    least = max(1, math.ceil(n * FREQUENT))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["data"].to_pylist():
                x = np.frombuffer(data, "<i8")[2:]
                total, types = x[:GROUPS].copy(), x[GROUPS : 2 * GROUPS].copy()
                hashes, suffix, counts = x[2 * GROUPS :].reshape(3, -1)
                often = (counts >= least) | (hashes.view(np.uint64) == _END)
                # The frequent ones are no part of a hashed group.
                np.subtract.at(total, suffix[often], counts[often])
                np.subtract.at(types, suffix[often], 1)
                keys = [*np.arange(GROUPS), *hashes[often]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([False] * GROUPS + [True] * int(often.sum())), pa.array(keys, pa.int64()), pa.array([*total, *counts[often]], pa.int64()), pa.array([*types, *[1] * int(often.sum())], pa.int64()), pa.array([*[0] * GROUPS, *suffix[often]], pa.int64())],
                    ["frequent", "key", "n", "types", "suffix"],
                )

    # At most 1 / FREQUENT + 1 frequent tokens and GROUPS groups.
    rows = whole.mapInArrow(groups, "frequent boolean, key long, n long, types long, suffix long").groupBy("frequent", "key").agg(F.sum("n").alias("n"), F.sum("types").alias("types"), F.max("suffix").alias("suffix")).collect()
    often = {r["key"]: r["n"] for r in rows if r["frequent"]}
    often.setdefault(int(_END.astype(np.int64)), 0)
    frequent = np.array(sorted(often), np.int64).astype(np.uint64)
    frequent.sort()
    total, types = np.zeros(GROUPS + len(frequent)), np.zeros(GROUPS + len(frequent))
    for r in rows:
        if not r["frequent"]:
            total[r["key"]], types[r["key"]] = r["n"], r["types"]
    total[GROUPS:] = [often[int(h.astype(np.int64))] for h in frequent]
    suffixes = {r["key"]: r["suffix"] for r in rows if r["frequent"]}
    suffix = np.array([suffixes.get(int(h.astype(np.int64)), 0) for h in frequent], np.int64)
    return {"n": n, "v": v, "frequent": frequent, "frequent_suffix": suffix, "total": total, "types": types}


def _huffman(total: np.ndarray) -> dict:
    """Paths of the groups: node and bit at each depth, and the share of ones at each node."""
    count = len(total)
    heap = [(float(t) + SMOOTHING, i) for i, t in enumerate(total)]
    heapq.heapify(heap)
    parent, bit, mass = {}, {}, {i: w for w, i in heap}
    node = count
    while len(heap) > 1:
        (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a], bit[a], parent[b], bit[b], mass[node] = node, 0, node, 1, wa + wb
        heapq.heappush(heap, (wa + wb, node))
        node += 1
    paths = []
    for i in range(count):
        path = []
        while i in parent:
            path.append((parent[i] - count, bit[i]))
            i = parent[i]
        paths.append(path[::-1])
    depth = max(map(len, paths))
    nodes, bits = np.zeros((count, depth), np.int32), np.zeros((count, depth), np.int8)
    length = np.array([len(p) for p in paths], np.int32)
    for i, p in enumerate(paths):
        for j, (x, y) in enumerate(p):
            nodes[i, j], bits[i, j] = x, y
    ones = np.full(max(1, node - count), 0.5)
    for child, up in parent.items():
        if bit[child]:
            ones[up - count] = mass[child] / mass[up]
    return {"nodes": nodes, "bits": bits, "length": length, "ones": np.log(ones / (1 - ones)).astype(np.float32)}


def _groups_of(b: Block, model: dict) -> np.ndarray:
    at = np.minimum(np.searchsorted(model["frequent"], b.hash), len(model["frequent"]) - 1)
    return np.where(model["frequent"][at] == b.hash, GROUPS + at, b.suffix).astype(np.int32)


_NODE = np.uint64(0x9E3779B97F4A7C15)


def _contexts(group: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the group before and of the two groups before; nothing reaches across texts."""
    before = np.concatenate([[0], group[:-1] + 1]).astype(np.uint64)
    before[first[:-1]] = 0
    two = np.concatenate([[0], before[:-1]])
    two[first[:-1]] = 0
    return arrays.mix(before + np.uint64(1 << 20)), arrays.mix(before * np.uint64(4099) + two + np.uint64(1 << 40))


def _slot(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Slot of a hashed context at a node; `node` is already scrambled."""
    return ((context + node) >> np.uint64(64 - SLOT_BITS)).view(np.int64)


def _word_contexts(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word before and the two words before; nothing reaches across texts."""
    before = np.concatenate([np.zeros(1, np.uint64), b.hash[:-1]])
    before[b.first[:-1]] = 0
    two = np.concatenate([np.zeros(1, np.uint64), before[:-1]])
    two[b.first[:-1]] = 0
    return arrays.mix(before + np.uint64(1)), arrays.mix(before * np.uint64(4099) + arrays.mix(two + np.uint64(2)))


def _rest_nodes(leaf: np.ndarray, levels: int) -> np.ndarray:
    """Scrambled nodes [leaf, level] of each leaf's path: the group, the level and the bits before it."""
    below = np.uint64(1) << np.arange(levels, dtype=np.uint64)
    return ((leaf >> np.uint64(32) << np.uint64(32))[:, None] | below | (leaf[:, None] & (below - np.uint64(1)))) * _NODE


def _rest_slot(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    return ((context + node) >> np.uint64(64 - REST_SLOT_BITS)).view(np.int64)


def _training_blocks(data: bytes) -> Iterator[Block]:
    rows = _rows_of(data)
    texts = arrays.byte_list(rows.filter(rows["train"])["text"])
    for low, high in arrays.pieces(texts, WORK_BYTES):
        yield Block(texts[low:high])


def _context_counts(texts: DataFrame, parts: int, shared) -> tuple[np.ndarray, np.ndarray]:
    """Counts [context, bit, slot] of the decisions of all training texts, of groups and of hash bits; tables of fixed size."""
    slots, rest_slots = 1 << SLOT_BITS, 1 << REST_SLOT_BITS
    chunk = 1 << 14

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        depth, scrambled = model["nodes"].shape[1], model["nodes"].ravel().astype(np.uint64) * _NODE
        half = model["bits"].ravel().astype(np.int64) * slots
        counts, one = np.zeros(4 * slots + 6 * rest_slots, np.uint32), np.uint32(1)
        for batch in batches:
            for b in (b for data in batch["data"] for b in _training_blocks(data.as_py())):
                group = _groups_of(b, model)
                contexts = _contexts(group, b.first)
                # All decisions of the block at once: each token as often as its path is long.
                length = model["length"][group].astype(np.int64)
                upto = np.cumsum(length)
                path = np.repeat(group * np.int64(depth) - (upto - length), length)
                path += np.arange(len(path))
                node, bit = scrambled.take(path), half.take(path)
                for c, context in enumerate(contexts):
                    np.add.at(counts[2 * c * slots : 2 * (c + 1) * slots], bit + _slot(np.repeat(context, length), node), one)
                rest = np.flatnonzero(group < GROUPS)
                leaf = _leaf(group[rest], b.hash[rest], model["rest_bits"])
                levels = np.arange(model["rest_bits"], dtype=np.uint64)
                distinct, which, times = np.unique(leaf, return_inverse=True, return_counts=True)
                node = _rest_nodes(distinct, len(levels))
                bit = ((distinct[:, None] >> levels) & np.uint64(1)).astype(np.int64) * rest_slots
                # The leaf alone: each distinct one as often as it is there.
                own = counts[4 * slots : 4 * slots + 2 * rest_slots]
                np.add.at(own, (bit + _rest_slot(np.uint64(0), node)).ravel(), np.repeat(times.astype(np.uint32), len(levels)))
                node, bit = node[which], bit[which]
                for c, context in enumerate(_word_contexts(b), 1):
                    low = 4 * slots + 2 * c * rest_slots
                    np.add.at(counts[low : low + 2 * rest_slots], (bit + _rest_slot(context[rest][:, None], node)).ravel(), one)
        ranges = counts.reshape(-1, chunk)
        used = np.flatnonzero(ranges.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(ranges[i].astype("<u4").tobytes(), 1) for i in used], pa.binary())], ["range", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), "<u4").astype("<i8") for c in rows["counts"])
        return pd.DataFrame({"range": [rows["range"].iloc[0]], "counts": [total.astype("<f4").tobytes()]})

    # Few tasks, as each sends its tables.
    found = texts.select("data").coalesce(parts).mapInArrow(run, "range int, counts binary").groupBy("range").applyInPandas(add, "range int, counts binary")
    counts = np.zeros(((4 * slots + 6 * rest_slots) // chunk, chunk), np.float32)
    for r in found.toLocalIterator():  # 4 * 2^SLOT_BITS + 6 * 2^REST_SLOT_BITS numbers in all
        counts[r["range"]] = np.frombuffer(r["counts"], "<f4")
    counts = counts.ravel()
    return counts[: 4 * slots].reshape(2, 2, slots), counts[4 * slots :].reshape(3, 2, rest_slots)


class Decisions:
    """The binary decisions of some tokens, the group's path first and then the hash bits: where they lie among
    the cells of the adapting predictor and among the gated weights of their lane, the bit, and the logits."""

    def __init__(self, total: int):
        self.x = np.empty((4, total), np.float32)  # node, one before, two before, adapting
        self.bit = np.empty(total, np.float32)
        self.cell = np.empty(total, np.int64)
        self.gate = np.empty(total, np.int64)


class Mixer:
    """Codes the tokens of texts side by side, one text a lane.

    The decisions of one token lie at different depths and nodes, so they share neither a weight nor an adapting
    cell, and taking them at once is the same as one after the other.  All numbers are
    32-bit and every operation is by element, so a text's score does not depend on what is coded beside it.
    """

    def __init__(self, model: dict):
        self.model = model
        self.levels = model["rest_bits"] if "rest" in model else 0
        self.coded = "logits" in model
        if self.coded:
            self.depth, self.n_nodes = model["nodes"].shape[1], len(model["ones"])
            self.nodes, self.bits = model["nodes"].ravel().astype(np.int64), model["bits"].ravel().astype(np.float32)
            self.scrambled = self.nodes.astype(np.uint64) * _NODE
        else:
            self.depth = self.n_nodes = 0
        self.gates = self.depth + self.levels
        self.cells = self.n_nodes + (self.levels << REST_CELL_BITS)

    def leaves(self, leaf: np.ndarray) -> np.ndarray:
        """Tables of what each distinct leaf brings to its decisions, and the place of each leaf in them."""
        distinct, which = np.unique(leaf, return_inverse=True)
        level = np.arange(self.levels, dtype=np.uint64)
        self.leaf_node = _rest_nodes(distinct, self.levels)
        self.leaf_x = self.model["rest"][0].take(_rest_slot(np.uint64(0), self.leaf_node))
        self.leaf_bit = ((distinct[:, None] >> level) & np.uint64(1)).astype(np.float32)
        hashed = (self.leaf_node >> np.uint64(64 - REST_CELL_BITS)).view(np.int64)
        self.leaf_cell = self.n_nodes + (level.view(np.int64) << REST_CELL_BITS) + hashed
        return which

    def decisions(self, lane: np.ndarray, group: np.ndarray, outer: tuple, rest: np.ndarray, leaf: np.ndarray, inner: tuple) -> tuple[Decisions, np.ndarray]:
        """Decisions of tokens in order, and how many each token has; `rest` are the tokens that `leaf`, a place in
        the table of leaves, and `inner` are of."""
        model, n = self.model, len(lane)
        deep = model["length"][group].astype(np.int64) if self.coded else np.zeros(n, np.int64)
        size = deep.copy()
        size[rest] += self.levels
        start = np.cumsum(size) - size
        d = Decisions(int(size.sum()))
        if self.coded:
            token = np.repeat(np.arange(n), deep)
            level = np.arange(len(token)) - np.repeat(np.cumsum(deep) - deep, deep)
            at = start[token] + level
            path = group[token].astype(np.int64) * self.depth + level
            node, hashed = self.nodes.take(path), self.scrambled.take(path)
            d.x[0][at] = model["ones"].take(node)
            for x, context, logits in zip(d.x[1:], outer, model["logits"]):
                x[at] = logits.take(_slot(context.take(token), hashed))
            d.bit[at] = self.bits.take(path)
            mine = lane.take(token)
            d.cell[at] = mine * self.cells + node
            d.gate[at] = mine * self.gates + level
        if self.levels:
            level = np.arange(self.levels)
            at = ((start + deep)[rest][:, None] + level).ravel()
            node = self.leaf_node[leaf]
            d.x[0][at] = self.leaf_x[leaf].ravel()
            for x, context, logits in zip(d.x[1:], inner, model["rest"][1:]):
                x[at] = logits.take(_rest_slot(context[:, None], node)).ravel()
            d.bit[at] = self.leaf_bit[leaf].ravel()
            mine = lane[rest][:, None]
            d.cell[at] = (mine * self.cells + self.leaf_cell[leaf]).ravel()
            d.gate[at] = (mine * self.gates + self.depth + level).ravel()
        return d, size

    def code(self, cuts: list[tuple[int, int]], group: np.ndarray, outer: tuple, rest: np.ndarray, leaf: np.ndarray, inner: tuple) -> np.ndarray:
        """Natural log probability of the coded part of each token; `cuts` are the texts, `rest` the tokens with a leaf."""
        out = np.zeros(len(group))
        if self.levels:
            leaf = self.leaves(leaf)
        place = np.full(len(group), -1, np.int64)
        place[rest] = np.arange(len(rest))
        cuts = sorted((c for c in cuts if c[1] > c[0]), key=lambda c: c[0] - c[1])  # longest first: those that still run are a prefix
        for low in range(0, len(cuts), LANES):
            start, end = np.array(cuts[low : low + LANES], np.int64).T
            length = end - start
            weights = np.full((len(start) * self.gates, 4), START_WEIGHT, np.float32)
            weights[:, 3] = 0.15
            state = np.zeros((len(start) * self.cells, 2), np.float32)
            running = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
            upto = np.concatenate([[0], np.cumsum(running)])
            step = 0
            while step < len(running):
                # Tokens of some steps, step by step; logits and places of all their decisions at once.
                last = max(step + 1, int(np.searchsorted(upto, upto[step] + STEP_TOKENS, side="right")) - 1)
                many = running[step:last]
                first = upto[step : last + 1] - upto[step]
                lane = np.arange(first[-1]) - np.repeat(first[:-1], many)
                token = start[lane] + np.repeat(np.arange(step, last), many)
                with_leaf = place[token]
                own = np.flatnonzero(with_leaf >= 0)
                which = with_leaf[own]
                d, size = self.decisions(lane, group[token], tuple(c[token] for c in outer), own, leaf[which], tuple(c[which] for c in inner))
                ends = np.concatenate([[0], np.cumsum(size)])
                probability = _refined(d, ends[first].tolist(), weights, state)
                some = np.flatnonzero(size)
                if len(some):
                    out[token[some]] = np.log(np.multiply.reduceat(probability, ends[some], dtype=np.float64))
                step = last
        return out


def _refined(d: Decisions, steps: list[int], weights: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Probability of each decision; `weights` and `state` (adapting logit, times used) are refined after every token of a text."""
    probability = np.empty(len(d.bit), np.float32)
    # Rows of four and of two 32-bit numbers as one number each, so that a row is read and written at once.
    weight_rows, state_rows = weights.view(np.complex128).ravel(), state.view(np.complex64).ravel()
    one, rate, most = np.float32(1), np.float32(RATE), np.float32(250)
    widest = max((high - low for low, high in zip(steps[:-1], steps[1:])), default=0)
    # Room that every step uses anew.
    now_room, weight_room = np.empty(widest, np.complex64), np.empty(widest, np.complex128)
    z_room, logit_room, error_room = np.empty((4, widest), np.float32), np.empty((2, widest), np.float32), np.empty((2, widest), np.float32)
    for low, high in zip(steps[:-1], steps[1:]):
        if low == high:
            continue
        x, bit, cell, gate = d.x[:, low:high], d.bit[low:high], d.cell[low:high], d.gate[low:high]
        n = high - low
        now_row, w_row = now_room[:n], weight_room[:n]
        state_rows.take(cell, out=now_row, mode="clip")
        now = now_row.view(np.float32).reshape(n, 2)
        own, times = now[:, 0], now[:, 1]
        # An adapting cell that was not used starts as the node's logit.
        np.multiply(x[0], times == 0, out=x[3])
        own += x[3]
        x[3] = own
        weight_rows.take(gate, out=w_row, mode="clip")
        w = w_row.view(np.float32).reshape(n, 4).T
        z, logit, error = z_room[:, :n], logit_room[:, :n], error_room[:, :n]
        np.multiply(w, x, out=z)
        np.add(z[0], z[1], out=logit[0])
        np.add(z[2], z[3], out=z[2])
        logit[0] += z[2]
        logit[1] = own
        np.minimum(logit, np.float32(12), out=logit)
        np.maximum(logit, np.float32(-12), out=logit)
        np.negative(logit, out=logit)
        np.exp(logit, out=logit)
        logit += one
        np.divide(one, logit, out=logit)
        np.subtract(bit, logit, out=error)
        shown = probability[low:high]
        np.abs(error[0], out=shown)
        np.subtract(one, shown, out=shown)
        # Gradient of the coding cost.
        error[0] *= rate
        x *= error[0]
        w += x
        weight_rows[gate] = w_row
        # The adapting predictor moves by its own error, less as it has seen more.
        speed = z[0]
        np.add(times, np.float32(3), out=speed)
        np.divide(np.float32(4), speed, out=speed)
        speed *= error[1]
        speed += own
        np.minimum(speed, np.float32(8), out=speed)
        np.maximum(speed, np.float32(-8), out=own)
        np.minimum(times, most, out=times)
        times += one
        state_rows[cell] = now_row
    return probability


_NOTHING = np.zeros(0, np.int64)


def mixed_rest(leaf: np.ndarray, contexts: tuple[np.ndarray, ...], cuts: list[tuple[int, int]], model: dict) -> np.ndarray:
    """Natural log probability of the hash bits of each token within its group; cuts are the texts."""
    only = {k: v for k, v in model.items() if k != "logits"}
    return Mixer(only).code(cuts, np.zeros(len(leaf), np.int32), (), np.arange(len(leaf)), leaf, contexts)


def mixed_bits(group: np.ndarray, contexts: tuple[np.ndarray, np.ndarray], cuts: list[tuple[int, int]], model: dict) -> np.ndarray:
    """Natural log probability of the group of each token; cuts are the texts."""
    only = {k: v for k, v in model.items() if k != "rest"}
    return Mixer(only).code(cuts, group, contexts, _NOTHING, _NOTHING.view(np.uint64), ())


def score_block(rows: pd.DataFrame, words: pd.DataFrame, model: dict) -> pd.DataFrame:
    """Scores of the texts of one block, given the counts of its tokens."""
    texts = _rows_of(rows["data"].iloc[0])
    b = Block(arrays.byte_list(texts["text"]))
    n = texts.num_rows
    hashes, _, place, parts = _distinct(b, model["buckets"])
    known = np.zeros(len(hashes), _COUNTS)
    for bucket, data in zip(words["bucket"], words["data"]):
        at = parts[bucket]
        packed = pa.decompress(data, len(at) * _COUNTS.itemsize, "zstd", asbytes=True)
        for name, low in zip(_COUNTS.names, (0, 8, 16)):
            known[name][at] = np.frombuffer(packed, _COUNTS[name], len(at), low * len(at))
    count, others, types = (known[name][place].astype(np.float64) for name in _COUNTS.names)
    tokens = np.diff(b.first)
    base = np.log10((count + 0.1) / (model["n"] + 0.1 * (model["v"] + 1)))
    group = _groups_of(b, model)
    # A frequent token is its group and has no part in a leaf.
    rest = np.flatnonzero(group < GROUPS)
    leaf = _leaf(group[rest], b.hash[rest], model["rest_bits"])
    taken, which = np.unique(_leaf(model["frequent_suffix"], model["frequent"], model["rest_bits"]), return_inverse=True)
    taken_count, taken_types = np.bincount(which, model["total"][GROUPS:]), np.bincount(which, model["total"][GROUPS:] > 0)
    at = np.minimum(np.searchsorted(taken, leaf), len(taken) - 1)
    shared = taken[at] == leaf
    total = (count + others)[rest] - np.where(shared, taken_count[at], 0)
    types = types[rest] - np.where(shared, taken_types[at], 0)
    # Tokens of one leaf share it by count, with room for unknown ones.
    inner = np.zeros(len(group))
    inner[rest] = np.log((count[rest] + SMOOTHING) / (total + SMOOTHING * (types + 1)))
    cuts = list(zip(b.first[:-1].tolist(), b.first[1:].tolist()))
    outer = Mixer(model).code(cuts, group, _contexts(group, b.first), rest, leaf, tuple(c[rest] for c in _word_contexts(b)))
    score = np.bincount(b.doc, inner + outer, n) / math.log(10)
    size = texts["bytes"].to_numpy()
    return pd.DataFrame({
        "doc_id": pd.array(texts["doc_id"].to_pylist(), "Int64"), "n_tokens": tokens, "n_known": np.bincount(b.doc, count > 0, n).astype(np.int64), "train_tokens": model["n"],
        "base_score": np.bincount(b.doc, base, n), "score": score, "bits_per_byte": np.where(size > 0, -score * math.log2(10) / np.maximum(size, 1), 0.0),
    })


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 10) == 0


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row."""
    spark = docs.sparkSession
    texts = _texts_by_block(docs)
    total = texts.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    buckets = max(16, math.ceil(total / 25_000_000))
    summed = cut_lineage(_summed(_block_tokens(texts, buckets), REST_BITS))
    model = _group_statistics(summed)
    model["rest_bits"], model["buckets"] = REST_BITS, buckets
    model |= _huffman(model["total"])
    counts, rest = _context_counts(texts, max(8, math.ceil(total / TABLE_BYTES)), spark.sparkContext.broadcast(model))
    # Slots of few counts say little: their logits are drawn to none.
    model["logits"] = np.log((counts[:, 1] + 0.4) / (counts[:, 0] + 0.4)).astype(np.float32)
    model["rest"] = np.log((rest[:, 1] + 0.4) / (rest[:, 0] + 0.4)).astype(np.float32)
    shared = spark.sparkContext.broadcast(model)

    def run(rows: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])
        return score_block(rows, words, shared.value)

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    words = summed.where("block >= 0")
    return texts.select("block", "data").groupBy("block").cogroup(words.groupBy("block")).applyInPandas(run, schema)


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
