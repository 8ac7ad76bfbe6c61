"""Runs of periodic word sequences against a plain search."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.llm import periodic_runs

SF_DIR = "/root/testdata/sf0.001"


def plain_runs(words, least=6, exponent=4):
    """Stretches of equal words one period apart, for every period; only the smallest counts."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found(texts, **kwargs):
    for runs, text in periodic_runs.find([t.encode() for t in texts], **kwargs):
        yield sorted((r["start"], r["length"], r["period"]) for r in runs), text.decode()


def check(texts, **kwargs):
    for text, (runs, left) in zip(texts, found(texts, **kwargs)):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        want = plain_runs(words, kwargs.get("least_words", 6), kwargs.get("least_exponent", 4))
        assert sorted(runs, key=lambda r: (r[0], r[2])) == sorted(want, key=lambda r: (r[0], r[2]))
        assert left == plain_collapsed(words, want)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c"]), max_size=60), max_size=6))
def test_random_texts(texts):
    check([" ".join(t) for t in texts])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b"]), max_size=40), max_size=4))
def test_all_repetitions(texts):
    check([" ".join(t) for t in texts], least_words=2, least_exponent=2)


def test_repeated_passages():
    rng = np.random.default_rng(2)
    texts = []
    for p in (1, 2, 3, 7, 20):
        block = [f"w{i}" for i in rng.integers(0, 3, p)]
        texts.append(" ".join(["x", *block * 9, *block[: p // 2], "y"]))
        texts.append(" ".join(block * 4))
    texts += ["a " * 3000, "a b " * 1000 + "a", "", " \n", "a", texts[0], texts[0]]
    check(texts)
    # What follows a text does not lengthen its runs.
    check(["a a a a a", "a a a a a a a", "a a a a a"])


def test_blocks_and_pairs_in_parts(monkeypatch):
    texts = [" ".join("ab"[int(x)] for x in np.random.default_rng(i).integers(0, 2, 200)) + " a" * 30 for i in range(10)]
    whole = list(found(texts))
    monkeypatch.setattr(periodic_runs, "PAIRS_AT_ONCE", 50)
    assert list(found(texts)) == whole


def test_edges(spark):
    long = " ".join(f"w{i % 977}x{i % 1013}" for i in range(200_000))
    rows = [(1, "a a A a a a a a\tb", 1, "x"), (1, "a a A a a a a a\tb", 1, "x"), (None, "é é é é é é", 2, None), (2, None, 3, "x"), (3, "", 4, "x"), (4, long + " z" * 50, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, Collapsed string")
    got = sorted(((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"][-20:]) for r in periodic_runs.periodic_runs(docs).collect()), key=str)
    want = [(0, [(0, 6, 1)], "é"), (1, [], "a a A a a a a a b"), (1, [], "a a A a a a a a b"), (2, [], ""), (3, [], ""), (4, [(200_000, 50, 1)], (long + " z")[-20:])]
    assert got == sorted(want, key=str)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    assert periodic_runs.with_periodic_tails(docs, "text").count() == len(rows)


@pytest.fixture(scope="module")
def result(spark):
    return {r["doc_id"]: r for r in periodic_runs.op13_periodic_runs(spark, SF_DIR).collect()}


def test_query(spark, result):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert len(docs) == len(result)
    tails = 0
    for doc in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", doc["text"] or "")
        n, h = len(words), zlib.crc32(str(doc["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            tails += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 1500:
            continue
        runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
        row = result[doc["doc_id"]]
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert (row["n_runs"], row["runs_sha256"]) == (len(runs), hashlib.sha256(lines.encode()).hexdigest())
        assert row["collapsed_sha256"] == hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        assert (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
    assert tails > 5 and sum(r["n_runs"] for r in result.values()) > 5
