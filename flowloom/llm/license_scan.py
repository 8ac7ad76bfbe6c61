"""License scan: exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words of a text, as long as the template and a fourth of
that more, wherever the lines break.  It is a match if it holds at least the threshold share of the
template's distinct words and all words that tell the template from other texts.  Every place in a text starts a block; those that start at a word of
the template give the highest shares, so only they are counted.  Words are ordered by their
frequency over all lines of the corpus, rarest first.  The rarest word of a block bounds what
can still be found (positional filter), so a match must hold a word of the template's prefix
(with m distinct words and c wanted, the m - c + 1 rarest), and only what is near such a word is
looked at; blocks with fewer than c words of the template fall to the length filter.  What is left
is counted exactly.  Of blocks that overlap only the best counts: the highest share, then the longer
template, then the one listed first; so a notice that varies another does not bring the other's label.

The templates are a fixed list, so they go to every task; texts are never shuffled.

Phrases are searched besides, as consecutive words, for the base labels.

Defined results: a null or empty text has no words and no labels.  Rows are judged one by
one, so repeated rows get equal results.
Other columns play no part.  An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import arrays
from flowloom.llm.common import ddl, table

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


class Template(NamedTuple):
    """A text, its label, and the words of it without which a block is no match."""

    label: str
    text: str
    required: str = ""


# Sentences of well-known licenses and notices.
TEMPLATES = [
    Template("apache", "licensed under the apache license version 2 0", "apache"),
    Template("apache", "you may not use this file except in compliance with the license", "file compliance license"),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public"),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gnu general public"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser public"),
    Template("lgpl", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details", "gnu lesser public"),
    Template("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "gnu affero public"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission granted software"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "copyright permission software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution source binary"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions source copyright"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission software fee granted"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered public domain"),
]
CONTAINMENT = 0.8
_NEWLINE = 0x0A


def vocabulary(templates: list[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.text.split()})


def wanted(size: int, threshold: float) -> int:
    """Least number of a template's distinct words that reaches the threshold."""
    return next(c for c in range(size + 1) if c >= threshold * size)


def _lines(w: arrays.Words) -> np.ndarray:
    """Line number of every word; lines of different texts differ."""
    breaks = np.cumsum(w.data == _NEWLINE, dtype=np.int64)
    return breaks[w.start] + w.doc if len(w.start) else np.zeros(0, np.int64)


def block_words(template: Template) -> int:
    """Words of a block: room for the template and some words between its own."""
    n = len(template.text.split())
    return n + max(2, n // 4)


def occurrences(place: np.ndarray, rank: np.ndarray, size: int, enough: int, block: int, required: list[int] = []) -> list[tuple[int, int, int]]:
    """(index of the first word, of the last word, distinct words) of each match of one template.

    `place` and `rank` of each word of the template that a text holds, ascending by place;
    texts lie at least a block apart.  A match has all words of the `required` ranks.
    """
    rare = place[rank <= size - enough]
    near = np.flatnonzero(np.searchsorted(rare, place + block) > np.searchsorted(rare, place - block, "right"))
    place, rank = place[near], rank[near]
    n = np.arange(len(place))
    end = np.searchsorted(place, place + block)
    if not (end - n >= enough).any():  # length filter
        return []
    # A word counts for the blocks that start after the same word before it.
    order = np.lexsort((place, rank))
    before = np.full(len(place), -1, np.int64)
    again = np.flatnonzero(rank[order][1:] == rank[order][:-1])
    before[order[again + 1]] = order[again]
    first = np.maximum(before + 1, np.searchsorted(place, place - block, "right"))
    count = np.cumsum(np.bincount(first, minlength=len(place) + 1) - np.bincount(n + 1, minlength=len(place) + 1))[:-1]
    fits = count >= enough
    for r in required:
        own = np.append(np.flatnonzero(rank == r), len(place))
        fits &= own[np.searchsorted(own, n)] < end
    found = []
    reach = np.flatnonzero(fits)
    at = 0
    while at < len(reach):
        overlap = reach[at : np.searchsorted(reach, end[reach[at]])]
        best = overlap[np.argmax(count[overlap])]
        # From where the block has all its words on back to the last place that still has them.
        words, ends = np.unique(rank[best : end[best]], return_index=True)
        last = best + ends.max()
        start = last - np.unique(rank[best : last + 1][::-1], return_index=True)[1].max()
        found.append((int(near[start]), int(near[last]), len(words)))
        at = int(np.searchsorted(reach, last, "right"))
    return found


class Vocabulary:
    """Places of words in a fixed list, for arrays of word hashes."""

    def __init__(self, words: list[str]):
        hashes = arrays.words([" ".join(words).encode()]).hash if words else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.bits = np.zeros(1 << 16, bool)
        self.bits[hashes >> np.uint64(48)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that are in the list, and their places in the list."""
        at = np.flatnonzero(self.bits[hashes >> np.uint64(48)])
        place = np.searchsorted(self.sorted, hashes[at])
        place = np.minimum(place, len(self.sorted) - 1)
        same = self.sorted[place] == hashes[at]
        return at[same], self.order[place[same]]


def word_frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many lines of all texts each of the given words occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Vocabulary(words), np.zeros(len(words), np.int64)
        for batch in batches:
            texts = arrays.byte_list(batch["text"])
            for low, high in arrays.pieces(texts):
                w = arrays.words(texts[low:high], arrays.NOT_ALPHANUMERIC)
                at, word = known.find(w.hash)
                pairs = np.unique(_lines(w)[at] * len(words) + word)
                total += np.bincount(pairs % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words)), pa.int32()), pa.array(total, pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {words[r["word"]]: r["n"] for r in counts}
    return {w: found.get(w, 0) for w in words}


def _apart(candidates: list[tuple]) -> list[tuple]:
    """The best candidates (share, length, number, first, last, label) that do not overlap a better one, by first word."""
    taken: list[tuple] = []  # by first word; they do not overlap, so only the neighbours can
    for c in sorted(candidates):
        at = bisect_left(taken, c[3], key=lambda t: t[3])
        if (at == 0 or taken[at - 1][4] < c[3]) and (at == len(taken) or c[4] < taken[at][3]):
            taken.insert(at, c)
    return taken


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = CONTAINMENT) -> DataFrame:
    """All given columns but the text, with n_words, n_base, first_word, last_word, base_labels,
    labels, score and matches (label, line, containment) of each text; the line is the one that a match starts on."""
    words = vocabulary(templates)
    frequency = word_frequencies(docs, words)
    order = sorted(words, key=lambda w: (frequency[w], w))
    place = {w: i for i, w in enumerate(order)}
    sets = [(t.label, np.array(sorted(place[w] for w in set(t.text.split())))) for t in templates]
    enough = [wanted(len(s), threshold) for _, s in sets]
    required = [[int(np.searchsorted(s, place[w])) for w in t.required.split()] for t, (_, s) in zip(templates, sets)]
    blocks = [block_words(t) for t in templates]
    apart = max(blocks, default=0)
    keep = [c for c in docs.columns if c not in ("text", *_RESULT.names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(order)
        first_words = Vocabulary(sorted({p.split()[0] for p in phrases}))
        phrase_hashes = [(arrays.words([p.encode()]).hash, label) for p, label in phrases.items()]
        # Rank of every word in each template, rarest first; outside it -1.
        ranks = np.full((len(sets), len(order)), -1)
        for (_, s), row in zip(sets, ranks):
            row[s] = np.arange(len(s))
        for batch in batches:
            texts = arrays.byte_list(batch["text"])
            rows: list[tuple] = []
            for low, high in arrays.pieces(texts):
                rows += judge(texts[low:high], known, first_words, phrase_hashes, ranks)
            result = [pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *result], [*keep, *_RESULT.names])

    def judge(texts, known, first_words, phrase_hashes, ranks) -> list[tuple]:
        w = arrays.words(texts, arrays.NOT_ALPHANUMERIC)
        n = len(texts)
        hits: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        starts, _ = first_words.find(w.hash)
        for hashes, label in phrase_hashes:
            k = len(hashes)
            at = starts[starts <= len(w.hash) - k]
            for j in range(k):
                at = at[w.hash[at + j] == hashes[j]]
            for i in at[w.doc[at] == w.doc[at + k - 1]]:
                hits[w.doc[i]].append((int(i - w.first[w.doc[i]]), label))
        line = _lines(w)
        at, word = known.find(w.hash)
        place = at + w.doc[at] * apart
        candidates: list[list[tuple]] = [[] for _ in range(n)]
        for number, ((label, s), c, rank) in enumerate(zip(sets, enough, ranks)):
            own = rank[word]
            if not ((own >= 0) & (own <= len(s) - c)).any():  # prefix filter
                continue
            here = np.flatnonzero(own >= 0)
            for i, j, count in occurrences(place[here], own[here], len(s), c, blocks[number], required[number]):
                first, last = int(at[here[i]]), int(at[here[j]])
                candidates[w.doc[first]].append((-count / len(s), -blocks[number], number, first, last, label))
        matches = [[(label, int(line[first] - line[w.first[d]]), -share) for share, _, _, first, last, label in _apart(found)] for d, found in enumerate(candidates)]
        out = []
        for d in range(n):
            at_words = [p for p, _ in hits[d]]
            base = {label for _, label in hits[d]}
            found = base | {label for label, _, _ in matches[d]}
            out.append((
                int(w.first[d + 1] - w.first[d]), len(at_words), min(at_words, default=None), max(at_words, default=None),
                ",".join(sorted(base)), ",".join(sorted(found)), max((s for _, _, s in matches[d]), default=0.0),
                [{"label": a, "line": b, "containment": s} for a, b, s in matches[d]],
            ))
        return out

    schema = f"{ddl(docs, keep)}n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,line:long,containment:double>>"
    return docs.select(*keep, "text").mapInArrow(run, schema)


_RESULT = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("matches", pa.list_(pa.struct([("label", pa.string()), ("line", pa.int64()), ("containment", pa.float64())]))),
])


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).drop("matches")
