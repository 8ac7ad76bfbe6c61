"""Bounded-space online packing of tokenised documents into sequences.

Each partition keeps a fixed number of open windows.  A document's whole windows are cut off
and emitted; the rest goes to the open window that it fills best, or to a new one, for which
the fullest is emitted once all are open.  What is left open in the partitions is merged, in groups
of a fixed number of partitions, by the same rule, largest first.

Defined results: a document ends with the end id; a null or empty text is that id alone.
Ties go to the window opened first.  Repeated rows are packed as often as they occur; null
ids and other columns do no harm.  An empty table gives no rows.
"""

from __future__ import annotations

import os
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import compress
from operator import add, not_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import arrays
from flowloom.llm.common import table
from flowloom.session import cut_lineage

LENGTH = 2048
OPEN_WINDOWS = 64
END_ID = 1
MERGED_PARTITIONS = 64
CACHE_WORDS = 250_000
WORDS_AT_ONCE = 1000
PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
# The letter that stands for each byte in the vocabulary: printable ones for themselves, the
# others from 256 on; the space between words is kept.
_OWN = np.isin(np.arange(256), [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])
BYTE_ALPHABET = np.where(_OWN, np.arange(256), 255 + np.cumsum(~_OWN)).astype("<u4")
BYTE_ALPHABET[0x20] = 0x20


class WordIds:
    """Ids of texts by way of a bounded cache of the ids of words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of
    its words in turn.  A run of punctuation after letters is an own pre-token as well.  A word of
    letters alone is one pre-token in lower case, whose last id ends a word; so new ones are
    encoded many at a time and cut apart at those ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        # The same merges for words that are normal, in lower case and in the alphabet of bytes.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        return [np.array(got.ids, "<u4").tobytes() for got in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letter_ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters."""
        out: list[bytes] = []
        for low in range(0, len(words), WORDS_AT_ONCE):
            some = words[low : low + WORDS_AT_ONCE]
            text = unicodedata.normalize("NFC", b" ".join(some).decode())
            small = text.lower()
            if "\u03a3" in text or not small.replace(" ", "").isalpha():
                # A sigma's or another letter's lower case needs the whole tokenizer.
                out += self._ids([w.decode() for w in some])
                continue
            (got,) = self.merges.encode_batch_fast([BYTE_ALPHABET[np.frombuffer(small.encode(), np.uint8)].tobytes().decode("utf-32-le")], add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            packed = ids.tobytes()
            cut = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            out += [packed[a:b] for a, b in zip(cut, cut[1:])]
        return out

    def learn(self, words: set[bytes]) -> None:
        if len(self.new) > CACHE_WORDS:
            self.old, self.new = self.new, {}
        fresh = list(self._missing(words))
        if not fresh:
            return
        stems = [w.rstrip(PUNCTUATION) for w in b" ".join(fresh).lower().split(b" ")]
        lettered = list(map(str.isalpha, b" ".join(stems).decode().split(" ")))
        stems, whole = list(compress(stems, lettered)), list(compress(fresh, lettered))
        tails = [w[len(s) :] for w, s in zip(whole, stems)]
        other = list(self._missing({*compress(fresh, map(not_, lettered)), *tails}))
        self.new.update(zip(other, self._ids([w.decode() for w in other]), strict=True))
        asked = list(self._missing(set(stems)))
        self.new.update(zip(asked, self._letter_ids(asked), strict=True))
        self.new.update(zip(whole, map(add, map(self.new.__getitem__, stems), map(self.new.__getitem__, tails))))

    def _missing(self, words: set[bytes]) -> set[bytes]:
        """Words not in the cache; those of its older half go over to the newer."""
        words = words.difference(self.new)
        again = [w for w in words if w in self.old]
        self.new.update(zip(again, map(self.old.__getitem__, again)))
        return words.difference(again)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.new.__getitem__, words)) for words in split]


_encoders: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per Python worker, so that its cache serves all of the worker's tasks."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


class Windows:
    """Open windows by free space; `close` gets a window's number when it is emitted."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.free: list[tuple[int, int]] = []  # (free space, window)
        self.count = 0

    def put(self, n: int) -> tuple[int, int, int | None]:
        """(window, offset, emitted window or None) for n items that fit in one window."""
        at = bisect_left(self.free, (n, -1))
        emitted = None
        if at < len(self.free):
            free, window = self.free.pop(at)
        else:
            if len(self.free) == self.most:
                emitted = self.free.pop(0)[1]
            free, window = self.length, self.new()
        if free > n:
            insort(self.free, (free - n, window))
        else:
            emitted = window
        return window, self.length - free, emitted

    def new(self) -> int:
        self.count += 1
        return self.count - 1


def _pieces(docs: DataFrame, path: str, length: int, most: int) -> DataFrame:
    """Pieces with their windows; `open` marks windows left at the end of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, windows = word_ids(path), Windows(length, most)
        end = np.array([END_ID], "<u4").tobytes()
        waiting: dict[int, list] = {}
        out: list = []

        def batch_of(rows: list, is_open: bool) -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays_ = [pa.array(c, f.type) for c, f in zip([*columns, [part] * len(rows), [is_open] * len(rows)], _SCHEMA)]
            return pa.RecordBatch.from_arrays(arrays_, schema=_SCHEMA)

        for batch in batches:
            doc_ids, texts = batch["doc_id"].to_pylist(), arrays.byte_list(batch["text"])
            for low, high in arrays.pieces(texts, 1_000_000):
                for doc_id, tokens in zip(doc_ids[low:high], ids.encode(texts[low:high])):
                    tokens += end
                    total = len(tokens) // 4
                    start = 0
                    while total - start >= length:
                        out.append((doc_id, start, length, tokens[4 * start : 4 * (start + length)], total, windows.new(), 0))
                        start += length
                    if start < total:
                        n = total - start
                        window, offset, emitted = windows.put(n)
                        waiting.setdefault(window, []).append((doc_id, start, n, tokens[4 * start :], total, window, offset))
                        if emitted is not None:
                            out += waiting.pop(emitted)
                if len(out) > 2000:
                    yield batch_of(out, False)
                    out = []
        if out:
            yield batch_of(out, False)
        if waiting:
            yield batch_of([row for rows in waiting.values() for row in rows], True)
        arrays.release()

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, window long, offset long, part long, open boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("window", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("open", pa.bool_())])


def pack(docs: DataFrame, path: str, length: int = LENGTH, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset), one row per piece.

    `ids` are little-endian unsigned 32-bit; a sequence is its pieces by offset, then padding.
    """
    pieces = cut_lineage(_pieces(docs, path, length, open_windows))
    sequence = F.col("part") * (1 << 33) + F.col("window")
    pieces = pieces.withColumn("sequence_id", sequence)
    left = pieces.where("open")
    groups = left.groupBy("part", "window", "sequence_id").agg(F.sum("length").alias("fill")).withColumn("group", F.floor(F.col("part") / MERGED_PARTITIONS))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["fill", "sequence_id"], ascending=[False, True])
        windows, place = Windows(length, 1 << 60), []
        for fill in rows["fill"]:
            place.append(windows.put(int(fill))[:2])
        window, shift = np.array(place, np.int64).reshape(-1, 2).T
        # A merged window keeps the number of the first window put into it.
        first = rows["sequence_id"].to_numpy()[np.unique(window, return_index=True)[1]]
        return pd.DataFrame({"old": rows["sequence_id"], "new": first[window], "shift": shift})

    moved = groups.select("group", "sequence_id", "fill").groupBy("group").applyInPandas(merge, "old long, new long, shift long")
    merged = left.join(moved, F.col("sequence_id") == F.col("old")).withColumns({"sequence_id": F.col("new"), "offset": F.col("offset") + F.col("shift")})
    columns = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pieces.where(~F.col("open")).select(columns).unionByName(merged.select(columns))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, tokenizer_path()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
