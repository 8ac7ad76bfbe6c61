"""Runs of periodic word sequences in documents, found with an enhanced suffix array.

The suffixes of each text are sorted by prefix doubling, all texts of a block at once but
each among its own.  An LCP interval of depth d holds the suffixes that share their first d words.  Two
suffixes d words apart that part within it mark a square that cannot be
shifted right (a branching tandem repeat); so the smaller side of every split of an interval
is walked, and for each of its suffixes i the places of i + d and i - d in the suffix order tell
whether they lie on the other side.  Smaller sides sum to n log n; no tree is built.  Words too rare in their
text to lie in a run are taken out first, which parts texts into stretches sorted each for themselves.  A square
is rotated to the left as far as its words allow, which gives the run that it ends; squares of
one run (its multiples) merge into the smallest period.

Defined results: words are runs of bytes outside ASCII white space, compared exactly, in
their own case.  A null or empty text has no words and no runs.  A run has at least `least_words`
words and `least_exponent` periods; runs that share their words but not their period are all
reported.  A null id is an id like any other; repeated rows give repeated results;
other columns are kept.  An empty table gives no rows.  A task holds a few dozen
8-byte numbers per word of one text at most.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import arrays
from flowloom.llm.common import ddl, fresh, table

LEAST_WORDS = 6
LEAST_EXPONENT = 4
BLOCK_BYTES = 2_000_000
PAIRS_AT_ONCE = 2_000_000
FREQUENCY_ROUNDS = 8  # more would only save time
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@dataclass
class SuffixOrder:
    """Suffix array of many texts, one after the other; `ranks[j]` tells equal runs of 2^j words."""

    order: np.ndarray
    place: np.ndarray
    ranks: list[np.ndarray]


def suffix_order(word: np.ndarray, doc: np.ndarray) -> SuffixOrder:
    """Sorts the suffixes of each text; suffixes of different texts never compare equal.

    A rank is the place of the first suffix of its group.  Each round sorts only the groups
    that still have several members, by the rank of what follows.
    """
    n = len(word)
    key = doc.astype(np.int64) * (int(word.max(initial=0)) + 1) + word
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    fresh_group = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(fresh_group, np.arange(n), 0)).astype(np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = head
    ranks, width = [rank], 1
    ends = np.searchsorted(doc, doc, side="right") if n else np.zeros(0, np.int64)
    while True:
        last = np.concatenate([fresh_group[1:], [True]]) if n else fresh_group
        at = np.flatnonzero(~(fresh_group & last))
        if not len(at):
            return SuffixOrder(order, _inverse(order), ranks)
        suffix = order[at]
        after = suffix + width
        follows = np.where(after < ends[suffix], rank[np.minimum(after, n - 1)], -1)
        group = rank[suffix].astype(np.int64)
        key = group * (n + 1) + follows + 1
        sort = np.argsort(key)
        key = key[sort]
        order[at] = suffix[sort]
        fresh_group = fresh_group.copy()
        fresh_group[at] = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.maximum.accumulate(np.where(fresh_group, np.arange(n), 0)).astype(np.int32)
        rank = rank.copy()
        rank[order[at]] = head[at]
        ranks.append(rank)
        width *= 2


def _inverse(order: np.ndarray) -> np.ndarray:
    place = np.empty_like(order)
    place[order] = np.arange(len(order), dtype=order.dtype)
    return place


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """Equal words from a and b on (step 1), or before a and b backwards (step -1)."""
    n = len(ranks[0])
    length = np.zeros(len(a), np.int64)
    for j in reversed(range(len(ranks))):
        width = 1 << j
        shift = length if step > 0 else -length - width
        x, y = a + shift, b + shift
        inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < n)
        same = inside & (ranks[j][np.where(inside, x, 0)] == ranks[j][np.where(inside, y, 0)])
        length += same * width
    return length


def _extents(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each split, the first suffix behind the last split before it that is no deeper, and the next split that is less deep."""
    n = len(depth)
    depths, open_ = memoryview(depth), array("q")
    left, right = array("q", bytes(8 * n)), array("q", [n]) * n
    for i, d in enumerate(depths):
        while open_ and depths[open_[-1]] > d:
            right[open_.pop()] = i
        left[i] = open_[-1] + 1 if open_ else 0
        open_.append(i)
    return np.frombuffer(left, np.int64), np.frombuffer(right, np.int64)


def squares(s: SuffixOrder) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, period) of all branching tandem repeats."""
    n = len(s.order)
    if n < 2:
        return
    order = s.order.astype(np.int64)
    depth = _common(s.ranks, order[:-1], order[1:], 1)
    # Split p parts suffixes up to place p from those after it.
    left, right = _extents(depth)
    at = np.flatnonzero(depth)
    left, right, depth = left[at], right[at], depth[at]
    smaller_left = at - left < right - at
    first = np.where(smaller_left, left, at + 1)
    size = np.where(smaller_left, at - left + 1, right - at)
    other_low, other_high = np.where(smaller_left, at + 1, left), np.where(smaller_left, right, at)
    upto = np.cumsum(size)
    cut = [0, *np.searchsorted(upto, np.arange(PAIRS_AT_ONCE, upto[-1] if len(upto) else 0, PAIRS_AT_ONCE)).tolist(), len(at)]
    for a, b in zip(cut, cut[1:]):
        split = np.repeat(np.arange(a, b), size[a:b])
        begin = np.cumsum(size[a:b]) - size[a:b]
        suffix = order[first[split] + np.arange(len(split)) - begin[split - a]]
        for sign in (1, -1):
            partner = suffix + sign * depth[split]
            inside = (partner >= 0) & (partner < n)
            place = s.place[np.where(inside, partner, 0)]
            hit = np.flatnonzero(inside & (place >= other_low[split]) & (place <= other_high[split]))
            yield np.minimum(suffix[hit], partner[hit]), depth[split[hit]]


def _frequent(word: np.ndarray, doc: np.ndarray, least_words: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that can lie in a run, and the number of the stretch each is in.

    All words of a run occur at least `least` times in it.  So a rarer word parts its text in two, a short
    part holds no run, and what is left is searched for rarer words again, a few times over.
    """
    at, part = np.arange(len(word)), doc.astype(np.int64)
    for _ in range(FREQUENCY_ROUNDS):
        if not len(at):
            break
        key = part * (int(word.max()) + 1) + word[at]
        order = np.argsort(key)
        new = np.concatenate([[True], np.diff(key[order]) != 0])
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        keep = np.empty(len(at), bool)
        keep[order] = np.repeat(size >= least, size)
        # A stretch ends where a word was taken out or another one began.
        stretch = np.cumsum(np.concatenate([[True], (np.diff(part) != 0) | ~keep[1:] | ~keep[:-1]]))
        keep &= (np.bincount(stretch) >= least_words)[stretch]
        if keep.all():
            break
        at, part = at[keep], stretch[keep]
    return at, part


def runs(word: np.ndarray, doc: np.ndarray, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """(start, end, period) of all runs of texts whose word numbers follow one another, by start and period."""
    at, part = _frequent(word, doc, least_words, least_exponent)
    word = word[at]
    s = suffix_order(word, part)
    found = []
    for start, period in squares(s):
        # A run of e periods has equal words one period apart through all of them.
        keep = np.ones(len(start), bool)
        for back in range(1, least_exponent - 1):
            x = start - back * period
            keep &= (x >= 0) & (word[np.maximum(x, 0)] == word[start])
        start, period = start[keep], period[keep]
        begin = start - _common(s.ranks, start, start + period, -1)
        end = start + 2 * period
        keep = end - begin >= np.maximum(least_words, least_exponent * period)
        found.append(np.stack([begin, end, period], axis=1)[keep])
    out = np.concatenate([np.zeros((0, 3), np.int64), *found])
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    # The multiples of a run's period have its very start and end.
    first = np.ones(len(out), bool)
    first[1:] = (out[1:, :2] != out[:-1, :2]).any(axis=1)
    out = out[first]
    out[:, 0], out[:, 1] = at[out[:, 0]], at[out[:, 1] - 1] + 1
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def find(texts: list[bytes], least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> Iterator[tuple[list[dict], bytes]]:
    """Runs of each text, and the text without the words of runs behind their first period."""
    split = [t.split() for t in texts]
    numbers = {w: i for i, w in enumerate(set().union(*split))}
    count = [len(words) for words in split]
    total = sum(count)
    word = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int64, total)
    first = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
    all_runs = runs(word, np.repeat(np.arange(len(texts), dtype=np.int32), count), least_words, least_exponent)
    cut = np.searchsorted(all_runs[:, 0], first)
    for d, words in enumerate(split):
        own = all_runs[cut[d] : cut[d + 1]] - [first[d], first[d], 0]
        if len(own):
            edge = np.zeros(count[d] + 1, np.int64)
            np.add.at(edge, own[:, 0] + own[:, 2], 1)
            np.add.at(edge, own[:, 1], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
        yield [{"start": b, "length": e - b, "period": p} for b, e, p in own.tolist()], b" ".join(words)


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT, names: tuple[str, str] = ("runs", "collapsed")) -> DataFrame:
    """All columns of `docs`, `runs` (start, length, period by start and period) and `collapsed` text."""
    keep = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrays.byte_list(batch["text"])
            for low, high in arrays.pieces(texts, BLOCK_BYTES):
                got, left = zip(*find(texts[low:high], least_words, least_exponent))
                part = batch.slice(low, high - low)
                columns = [*(part[c] for c in keep), pa.array(got, pa.list_(RUN)), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *names])
        arrays.release()

    schema = f"{ddl(docs, keep)}`{names[0]}` array<struct<start:long,length:long,period:long>>, `{names[1]}` string"
    return docs.select(keep).mapInArrow(run, schema)


def with_periodic_tails(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with `text`: one in ten documents, by a hash of the id, ends in a repeated passage."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, a, p, i = (fresh(docs.columns, f"_{c}") for c in ("n", "a", "p", "words"))
    g = F.floor(h / 10)
    tailed: Column = F.array_join(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda k: F.get(F.col(i), F.when(k < F.col(a), k).otherwise(F.col(a) + F.pmod(k - F.col(a), F.col(p))).cast("int"))),
        " ",
    )
    chosen = F.when(h % 10 == 0, words)
    out = docs.withColumn(i, chosen).withColumn(n, F.size(i).cast("long")).withColumn(a, F.when(F.col(n) > 0, g % F.col(n)))
    out = out.withColumn(p, 1 + F.floor((F.col(n) - F.col(a)) / (3 + g % 8)))
    return out.withColumn(text, F.when(F.col(n) > 0, tailed).otherwise(F.col("text"))).drop(i, n, a, p)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = periodic_runs(docs).withColumn("n_runs", F.size("runs").cast("long"))

    def greater(best: Column, run: Column) -> Column:
        """The run of greater length / period; products of whole numbers compare exactly."""
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), greater)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
