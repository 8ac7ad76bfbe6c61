"""Language of a text by hierarchical discrimination.

A first level of linear support vector machines (one per pair of families, by votes) picks
the language family; a second level (one per pair of languages of that family) picks the
language.  Features are hashed letter n-grams of one to three bytes, counted over the whole
text and scaled to unit length.

Defined results: a text that is null or has no letter is `und` with score 0.  Rows are
judged one by one, so repeated rows get equal results and an empty table gives none; other
columns, whatever their names, play no part.  Without training rows every text is `und`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import arrays
from flowloom.llm.common import ddl, fresh, hash31, map_batches, remainder, table

# Language families by code; any other code is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "da", "no", "sv", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
BINS = 4096
UNKNOWN = "und"

# A-Z in lower case, letters and bytes of multi-byte characters kept, all else a space.
_LETTER = np.array([b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], np.uint8)


def features(texts: list[bytes]) -> np.ndarray:
    """Unit-length n-gram counts, one row per text."""
    out = np.zeros((len(texts), BINS), np.float32)
    for d, text in enumerate(texts):
        x = _LETTER[np.frombuffer(b" " + text + b"  ", np.uint8)].astype(np.uint32)
        a, b, c = x[:-2], x[1:-1], x[2:]
        two, three = a * 257 + b, (a * 257 + b) * 263 + c
        used = np.concatenate([a[a != 32], two[(a != 32) | (b != 32)] + 100_003, three[(b != 32)] + 7_000_003])
        counts = np.bincount((used * np.uint32(2654435761)) >> np.uint32(20), minlength=BINS)
        norm = np.sqrt((counts.astype(np.float64) ** 2).sum())
        if norm:
            out[d] = counts / norm
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, regular: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Averaged sub-gradient descent on the hinge loss, both classes weighing the same;
    the last weight is the bias."""
    x = np.hstack([x, np.full((len(x), 1), 0.3, np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    total = np.zeros_like(w)
    for step in range(1, rounds + 1):
        active = y * (x @ w) < 1
        gradient = regular * w - x.T @ (share * y * active)
        w = w - 20.0 / np.sqrt(step) * gradient.astype(np.float32)
        if step > rounds // 2:
            total += w
    total /= rounds - rounds // 2
    total[-1] *= 0.3
    return total


def train(docs: DataFrame, learn: Column, per_language: int = 500) -> dict:
    """Pairwise machines of both levels.

    Learns from a bounded sample of the labelled rows: about `per_language` of each language
    (by a hash of id and text), so what reaches the one fitting task is bounded by the number
    of languages alone; the features are made in parallel before.
    """
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = labelled.groupBy("lang").count()
    share = counts.select(F.col("lang").alias("of"), (F.lit(float(per_language)) / F.col("count")).alias("share"))
    picked = (
        labelled.select("lang", "text", hash31(F.col("doc_id"), F.xxhash64("text")).alias("draw"))
        .join(F.broadcast(share), F.col("lang") == F.col("of"))
        .where(F.col("draw") < F.col("share") * (2.0**31))
        .select("lang", "draw", "text")
    )

    def featurise(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(arrays.byte_list(batch["text"]))
        return pa.RecordBatch.from_arrays([batch["lang"], batch["draw"], pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "draw", "x"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lang", "draw", "x"])
        x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, BINS)
        lang = rows["lang"].to_numpy()
        family = np.array([FAMILY_OF.get(v, v) for v in lang])
        model, weights = [], []
        for level, labels in [("", family), *((f, np.where(family == f, lang, None)) for f in sorted(set(family)))]:
            names = sorted({v for v in labels if v is not None})
            if len(names) == 1:
                model.append((level, names[0], None))
                weights.append(np.zeros(BINS + 1, np.float32))
            for a, b in combinations(names, 2):
                at = (labels == a) | (labels == b)
                model.append((level, a, b))
                weights.append(fit_svm(x[at], np.where(labels[at] == a, 1.0, -1.0).astype(np.float32)))
        return pd.DataFrame({"level": [m[0] for m in model], "a": [m[1] for m in model], "b": [m[2] for m in model], "w": [w.tobytes() for w in weights]})

    sample = map_batches(picked, featurise, "lang string, draw long, x binary")
    # One row per pair of classes: bounded by the number of languages.
    machines = sample.groupBy(F.lit("all").alias("all")).applyInPandas(fit, "level string, a string, b string, w binary").collect()
    machines.sort(key=lambda m: (m["level"], m["a"], m["b"] or ""))
    return {
        "pairs": [(m["level"], m["a"], m["b"]) for m in machines],
        "weights": np.array([np.frombuffer(m["w"], np.float32) for m in machines], np.float32).reshape(-1, BINS + 1),
    }


def decide(model: dict, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Winner and score of each row of margins, family first."""
    n = len(margins)
    sure = 1 / (1 + np.exp(-2 * margins.astype(np.float64)))
    place: dict[str, list[int]] = {}
    for i, (level, _, _) in enumerate(model["pairs"]):
        place.setdefault(level, []).append(i)

    def votes(level: str) -> tuple[np.ndarray, np.ndarray]:
        names = sorted({v for i in place[level] for v in model["pairs"][i][1:] if v is not None})
        if len(names) == 1:
            return np.array(names * n), np.ones(n)
        won, weight = np.zeros((n, len(names))), np.zeros((n, len(names)))
        for i in place[level]:
            a, b = (names.index(v) for v in model["pairs"][i][1:])
            won[:, a] += margins[:, i] >= 0
            won[:, b] += margins[:, i] < 0
            weight[:, a] += sure[:, i]
            weight[:, b] += 1 - sure[:, i]
        best = np.argmax(won + weight / (2 * len(names)), axis=1)
        return np.array(names)[best], weight[np.arange(n), best] / (len(names) - 1)

    family, score = votes("")
    lang = np.array([UNKNOWN] * n, dtype=object)
    for f in set(family):
        name, inner = votes(f)
        at = family == f
        lang[at], score[at] = name[at], score[at] * inner[at]
    return list(lang), score


def predict(docs: DataFrame, model: dict, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All given columns, the text too, with the predicted language and its score."""
    keep = [c for c in docs.columns if c not in names]
    letter = fresh(docs.columns, "_letter")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    known = docs.select(*keep, F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias(letter))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, texts = shared.value, arrays.byte_list(batch["text"])
        has_letter = np.array(batch[letter].to_pylist(), bool)
        found, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        w = model["weights"]
        for low in range(0, len(texts) if len(w) else 0, 256):
            part = slice(low, low + 256)
            found[part], scores[part] = decide(model, features(texts[part]) @ w[:, :-1].T + w[:, -1])
        found = [n if ok else UNKNOWN for n, ok in zip(found, has_letter)]
        return pa.RecordBatch.from_arrays(
            [*(batch[c] for c in keep), pa.array(found, pa.string()), pa.array(np.where(has_letter, scores, 0.0), pa.float64())], [*keep, *names]
        )

    return map_batches(known, score, f"{ddl(docs, keep)}`{names[0]}` string, `{names[1]}` double")


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 4) == 2


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out(F.col("doc_id")))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
