"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary joins anything to a white space marker after it (this is checked), so a text's
ids are those of its chunks in turn, a chunk being a run of markers and what follows up to
the next one.  Documents are cut into blocks.  Every block sends its distinct chunks,
dealt into buckets by their hash, to the tasks of those buckets, where each distinct chunk
is segmented once for all blocks; the ids go back to their block in the order the chunks were sent, and
every chunk of a text takes its ids from there.  Texts move once, compressed, to meet the ids.

A bucket's table is bounded: when full it is begun anew and chunks seen again are segmented
again, to the same ids.

Defined results: a null or empty text is the begin and end ids.  Spaces and the marker itself
count alike, as in the library.  Repeated rows give repeated results; null ids and other
columns are kept.  An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import arrays
from flowloom.llm.common import ddl, table

BLOCK_BYTES = 16_000_000
BUCKETS = 512
TABLE_CHUNKS = 300_000
CHUNKS_AT_ONCE = 20_000
DECODED_AT_ONCE = 200_000  # ids
MARKER = "▁"
_CHUNK = re.compile(" +[^ ]*")


class PieceModel:
    """The library's model, and whether chunks can be segmented apart."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.processor = p = SentencePieceProcessor(model_file=path)
        pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        if any(re.search(f"[^{MARKER}]{MARKER}", x) for x in pieces):
            raise ValueError("pieces of this model cross white space markers")
        probe = f" a  b\t{MARKER} ﬁ "
        if p.normalize(probe) != MARKER + probe.replace(" ", MARKER):
            raise ValueError("this model changes texts before it segments them")
        self.begin, self.end = p.bos_id(), p.eos_id()
        # Ids behind which the next ones are decoded as in the middle of a text.
        self.before = p.encode("a")
        self.shown = len(p.decode(self.before))
        # A marker alone ends a text; given as a text of its own, it would be no marker.
        self.alone = p.encode("a ")[len(self.before) :]

    def segment(self, chunks: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each chunk; the library puts the first marker there itself."""
        found = self.processor.encode([c[1:] for c in chunks], num_threads=1)
        return [np.array(ids if c != " " else self.alone, "<u4").tobytes() for c, ids in zip(chunks, found)]

    def decode(self, ids: np.ndarray, first: bool) -> str:
        if first:
            return self.processor.decode(ids.tolist())
        return self.processor.decode([*self.before, *ids.tolist()])[self.shown :]


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One per Python worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def chunks_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = " " + text.replace(MARKER, " ")
    if "  " in text:
        return _CHUNK.findall(text)
    return [" " + word for word in text[1:].split(" ")]


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Runs of rows of about `limit` bytes, named by partition, number and a hash of their texts."""
    part, number = TaskContext.get().partitionId(), 0
    waiting: list[pa.RecordBatch] = []
    size = 0

    def block() -> tuple[str, pa.RecordBatch]:
        rows = pa.concat_batches(waiting)
        seen = 0
        for text in rows["text"]:
            seen = zlib.crc32((text.as_py() or "").encode() + b"\n", seen)
        return f"{part}-{number}-{seen}", rows

    for batch in batches:
        sizes = np.cumsum([len(t) for t in arrays.byte_list(batch["text"])])
        low = 0
        while low < batch.num_rows:
            start = sizes[low - 1] if low else 0
            high = min(batch.num_rows, int(np.searchsorted(sizes, start + limit - size)) + 1)
            waiting.append(batch.slice(low, high - low))
            size += int(sizes[high - 1] - start)
            low = high
            if size >= limit:
                yield block()
                waiting, size, number = [], 0, number + 1
    if waiting:
        yield block()


def _distinct(texts: list[str | None]) -> list[str]:
    """Distinct chunks of a block in the order of first occurrence."""
    return list(dict.fromkeys(chain.from_iterable(map(chunks_of, texts))))


def _dealt(chunks: list[str], buckets: int) -> Iterator[tuple[int, list[str]]]:
    """Chunks by bucket, in the given order."""
    bucket = np.fromiter((zlib.crc32(c.encode()) for c in chunks), np.int64, len(chunks)) % buckets
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        yield b, [chunks[i] for i in order[cut[b] : cut[b + 1]]]


def _compressed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _plain(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _sent_chunks(docs: DataFrame, block_bytes: int, buckets: int) -> DataFrame:
    """(block, bucket, chunks): distinct chunks of every block, joined as one text.

    The marker is between them, as no chunk has it: a chunk of spaces alone would run into the next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in _blocks(batches, block_bytes):
            dealt = [(b, _compressed(MARKER.join(c).encode())) for b, c in _dealt(_distinct(rows["text"].to_pylist()), buckets)]
            if dealt:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(dealt)), pa.array([b for b, _ in dealt], pa.int32()), pa.array([c for _, c in dealt], pa.binary())], ["block", "bucket", "chunks"]
                )
        arrays.release()

    return docs.select("text").mapInArrow(run, "block string, bucket int, chunks binary")


def _segmented(sent: DataFrame, path: str, table_chunks: int) -> DataFrame:
    """(block, bucket, ids): ids of the chunks sent, each distinct chunk of a bucket segmented once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        wide = "<u2" if model.processor.get_piece_size() <= 1 << 16 else "<u4"
        ids: dict[str, bytes] = {}
        of = None
        for batch in batches:
            out = []
            for bucket, packed in zip(batch["bucket"].to_pylist(), batch["chunks"].to_pylist()):
                if bucket != of or len(ids) > table_chunks:
                    ids, of = {}, bucket
                chunks = _plain(packed).decode().split(MARKER)
                new = [c for c in chunks if c not in ids]
                for low in range(0, len(new), CHUNKS_AT_ONCE):
                    some = new[low : low + CHUNKS_AT_ONCE]
                    ids.update(zip(some, model.segment(some)))
                found = [ids[c] for c in chunks]
                sizes = np.fromiter(map(len, found), "<u4", len(found)) // 4
                out.append(_compressed(sizes.tobytes() + np.frombuffer(b"".join(found), "<u4").astype(wide).tobytes()))
            yield pa.RecordBatch.from_arrays([batch["block"], batch["bucket"], pa.array(out, pa.binary())], ["block", "bucket", "ids"])
        arrays.release()

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "block string, bucket int, ids binary")


def _packed_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, rows): every block as one compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in _blocks(batches, block_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])
        arrays.release()

    return docs.mapInArrow(run, "block string, rows binary")


def _table(chunks: list[str], packed: dict[int, bytes], wide: str, buckets: int) -> dict[str, bytes]:
    """Ids of each distinct chunk of a block, from what the buckets sent back."""
    out: dict[str, bytes] = {}
    for bucket, some in _dealt(chunks, buckets):
        if bucket not in packed:
            raise RuntimeError("the documents changed between two reads; store them first")
        data = _plain(packed[bucket])
        sizes = np.frombuffer(data, "<u4", len(some))
        ids = np.frombuffer(data, wide, offset=4 * len(some)).astype("<u4").tobytes()
        cut = np.concatenate([[0], 4 * np.cumsum(sizes, dtype=np.int64)]).tolist()
        out.update(zip(some, (ids[a:b] for a, b in zip(cut, cut[1:]))))
    return out


def _decoded(model: PieceModel, chunk_ids: list[bytes]) -> str:
    """The library's text of all ids, taken in parts that end with a chunk."""
    if sum(map(len, chunk_ids)) <= 4 * DECODED_AT_ONCE:
        return model.decode(np.frombuffer(b"".join([_ID(model.begin), *chunk_ids, _ID(model.end)]), "<u4"), True)
    parts, some, size = [], [_ID(model.begin)], 0
    for ids in [*chunk_ids, None]:
        if ids is None or size + len(ids) > 4 * DECODED_AT_ONCE and size:
            end = [_ID(model.end)] if ids is None else []
            parts.append(model.decode(np.frombuffer(b"".join(some + end), "<u4"), not parts))
            some, size = [], 0
        if ids is not None:
            some.append(ids)
            size += len(ids)
    return "".join(parts)


def _ID(value: int) -> bytes:
    return value.to_bytes(4, "little")


def encode(
    docs: DataFrame, path: str, names: tuple[str, str] = ("ids", "decoded"),
    block_bytes: int = BLOCK_BYTES, buckets: int = BUCKETS, table_chunks: int = TABLE_CHUNKS,
) -> DataFrame:
    """All columns of `docs`, the ids of `text` (little-endian unsigned 32-bit, with begin and end) and the text decoded from them.

    `docs` is read twice and must give the same rows in the same partitions: a stored table does.
    """
    keep = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    if "text" not in keep:
        raise ValueError("the result may not replace the text")
    docs = docs.select(keep)
    ids = _segmented(_sent_chunks(docs, block_bytes, buckets), path, table_chunks)
    types = {n: t for n, t in zip(names, (pa.binary(), pa.string()))}

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        model = piece_model(path)
        wide = "<u2" if model.processor.get_piece_size() <= 1 << 16 else "<u4"
        packed = dict(zip(right["bucket"].to_pylist(), right["ids"].to_pylist()))
        out = []
        for stream in left["rows"].to_pylist():
            (rows,) = pa.ipc.open_stream(stream).read_all().to_batches()
            texts = rows["text"].to_pylist()
            known = _table(_distinct(texts), packed, wide, buckets)
            encoded, decoded = [], []
            for text in texts:
                own = list(map(known.__getitem__, chunks_of(text)))
                encoded.append(b"".join([_ID(model.begin), *own, _ID(model.end)]))
                decoded.append(_decoded(model, own))
            columns = [*(rows[c] for c in keep), pa.array(encoded, types[names[0]]), pa.array(decoded, types[names[1]])]
            out.append(pa.RecordBatch.from_arrays(columns, [*keep, *names]))
        arrays.release()
        if not out:
            raise RuntimeError("the documents changed between two reads; store them first")
        return pa.Table.from_batches(out)

    schema = f"{ddl(docs, keep)}`{names[0]}` binary, `{names[1]}` string"
    return _packed_blocks(docs, block_bytes).groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(join, schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return encode(docs, model_path()).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
