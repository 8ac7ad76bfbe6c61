"""Importance resampling against a plain loop."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from flowloom.llm import resampling

DOCS = "doc_id long, text string, weight string, rank int"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, target, percent=10, least=20, buckets=10_000, seed=2024):
    def bucket(word):
        return zlib.crc32(word.encode()) % buckets

    s, t = (collections.Counter(bucket(w) for text in texts for w in words_of(text)) for texts in ([d[1] for d in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        features = [bucket(w) for w in words_of(text)]
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in features)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = order[: len(order) * percent // 100]
    ranks = {id(r): i + 1 for i, r in enumerate(drawn)}
    return [(*r, ranks.get(id(r))) for r in rows]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def made(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"Wörd{i}" if i % 3 else f"w{i}" for i in range(500)]
    return [(int(i), " ".join(vocabulary[j] for j in rng.zipf(1.5, rng.integers(1, 80)) % 500)) for i in rng.permutation(n)]


@pytest.mark.parametrize("segment_rows", [8192, 64])
def test_against_plain_loop(spark, monkeypatch, segment_rows):
    monkeypatch.setattr(resampling, "SEGMENT_ROWS", segment_rows)
    docs, target = made(3000, 1), ["w3 w6 Wörd1-wörd2", None, ""]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([(t,) for t in target], "text string"), percent=40)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs, target, 40), key=key)


def test_edges(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs = [(1, words), (1, words), (1, words), (None, words), (None, words), (2, None), (3, ""), (4, " \t"), (5, "few words"), (6, "x" * 3_000_000 + " y" * 25), (7, "a b\0c-" * 700_000)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)
    target = spark.createDataFrame([("a b c", 1)], "text string, bucket int")
    got = resampling.resample(frame, target, percent=70)
    # Equal rows have ranks of their own.
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs, ["a b c"], 70), key=key)
    assert resampling.resample(frame.limit(0), target).count() == 0
    nothing = resampling.resample(frame, target.limit(0), percent=70).collect()
    assert sorted(map(tuple, nothing), key=key) == sorted(plain(docs, [], 70), key=key)
    assert all(r["rank"] is None for r in resampling.resample(frame, target, percent=0).collect())


def test_one_hot_key_is_spread(spark, monkeypatch):
    """Rows of one id and one score fall into several segments and still get ranks without gaps."""
    monkeypatch.setattr(resampling, "SEGMENT_ROWS", 50)
    rows = [(7, 25, 10, 10)] * 1000 + [(i, 25, i % 40, i % 40) for i in range(1000)]
    scored = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long").repartition(5)
    got = [r for r in resampling.draw(scored, percent=90).collect() if r["rank"]]
    assert sorted(r["rank"] for r in got) == list(range(1, 1801))
    by_rank = [(-r["score"], r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"])]
    assert by_rank == sorted((-r[3], r[0]) for r in rows)[:1800]


def test_slices():
    rng = np.random.default_rng(3)
    text = bytes(rng.choice([32, 97, 98], 5000, p=[0.05, 0.6, 0.35]).astype(np.uint8)) + b"c" * 300
    for limit in (1, 7, 100, 10_000):
        parts = list(resampling.slices(text, limit))
        assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()
