"""Exact Jaccard self-join of texts on word 5-gram sets by multiple-global-order filtering.

1. Texts with equal sets are one class, known by a hash of the set, and counted once.
2. Shingle hashes are sent, packed, to buckets of equal hash range.  A bucket counts in how
   many classes each shingle occurs and hands back those that occur in two or more.
3. Under every global order the shingles of one class only come first, as they can never be
   shared.  A class whose prefix (n - ceil(0.8 n) + 1 shingles) is all unique links with
   nothing, which settles most texts.  For the rest the prefixes under several orders (rarest
   first; then by bands of frequency, ties by other hashes) are kept.
4. Rows meet on a shared prefix shingle of the first order, within the length and the
   positional filter; a pair is verified only if its prefixes meet under every order.
5. Large groups of near copies are not paired out.  First each class meets a few partners
   per prefix shingle, drawn by hash; components of the links found are taken, and then only
   classes of different components meet, so no link that could join two components is lost.

Defined results: null texts and texts without words have an empty set and link with nothing;
fewer than five words make one shingle of the whole sequence.  Rows with equal sets, so also
repeated rows, are linked.  Null ids are passed over in the smallest id of a component, which
is null if all are.  Other columns play no part.  An empty table gives no rows.

Shingles are compared by 64-bit hashes (48 bits beside the bucket in packed rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm import arrays
from flowloom.llm.common import map_batches, table
from flowloom.llm.components import components
from flowloom.session import cut_lineage

ORDERS = 3
RING_ROWS = 20_000
RINGS = ((1, 1), (2, 8), (3, 16))  # seed and reach of the drawn partners of each round
_FEW = np.uint64(48)
_LOW = np.uint64((1 << 48) - 1)


def set_class(s: np.ndarray) -> int:
    """Signed 64-bit hash of a set of shingles."""
    with np.errstate(over="ignore"):
        total = arrays.mix(arrays.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum() + np.uint64(len(s)))
    return int(total.astype(np.int64))


def with_class(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, text_hash, class, n): class of the set of each text (null if empty) and its size."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, cls, n = arrays.byte_list(batch["text"]), [], []
        for low, high in arrays.pieces(texts):
            for s in arrays.shingle_sets(texts[low:high], k):
                n.append(len(s))
                cls.append(set_class(s) if len(s) else None)
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(cls, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "text_hash", "class", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return map_batches(rows, run, "doc_id long, text_hash long, class long, n long")


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray((h & _LOW).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def packed_shingles(docs: DataFrame, bits: int, k: int = 5) -> DataFrame:
    """(bucket, classes, sizes, at, hashes): per block of texts and bucket the shingles in packed form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrays.byte_list(batch["text"])
            for low, high in arrays.pieces(texts, 8_000_000):
                seen: dict[int, np.ndarray] = {}
                for a, b in arrays.pieces(texts[low:high]):
                    for s in arrays.shingle_sets(texts[low + a : low + b], k):
                        if len(s):
                            seen.setdefault(set_class(s), s)
                for block in range(0, len(seen), 60_000):
                    part = list(seen.items())[block : block + 60_000]
                    cls, n = np.array([c for c, _ in part], np.int64), np.array([len(s) for _, s in part], np.int32)
                    h = np.concatenate([s for _, s in part])
                    at = np.repeat(np.arange(len(part), dtype=np.uint16), n)
                    order = np.argsort(h, kind="stable")
                    h, at = h[order], at[order]
                    cut = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
                    rows: dict[str, list] = {"bucket": [], "classes": [], "sizes": [], "at": [], "hashes": []}
                    for i, (x, y) in enumerate(zip(cut, [*cut[1:], len(h)])):
                        if y > x:
                            used, place = np.unique(at[x:y], return_inverse=True)
                            rows["bucket"].append(i)
                            rows["classes"].append(cls[used].tobytes())
                            rows["sizes"].append(n[used].tobytes())
                            rows["at"].append(place.astype(np.uint16).tobytes())
                            rows["hashes"].append(_six((h[x:y] << np.uint64(bits)) >> np.uint64(16)))
                    yield pa.RecordBatch.from_pydict(rows, schema=_PACKED)
        arrays.release()

    return docs.select("text").mapInArrow(run, "bucket int, classes binary, sizes binary, at binary, hashes binary")


_PACKED = pa.schema([("bucket", pa.int32()), ("classes", pa.binary()), ("sizes", pa.binary()), ("at", pa.binary()), ("hashes", pa.binary())])


def shared_shingles(packed: DataFrame, parts: int, bits: int) -> DataFrame:
    """(part, rows): packed (class, n, shingle, frequency) of shingles that two classes or more have."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([_from_six(b) for b in rows["hashes"]])
        cls = np.concatenate([np.frombuffer(c, np.int64)[np.frombuffer(a, np.uint16)] for c, a in zip(rows["classes"], rows["at"])])
        n = np.concatenate([np.frombuffer(c, np.int32)[np.frombuffer(a, np.uint16)] for c, a in zip(rows["sizes"], rows["at"])])
        order = np.argsort(hashes, kind="stable")
        hashes, cls, n = hashes[order], cls[order], n[order]
        fresh = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        length = np.diff(np.append(np.flatnonzero(fresh), len(hashes)))
        many = np.repeat(length > 1, length)
        hashes, cls, n = hashes[many], cls[many], n[many]
        order = np.lexsort((cls, hashes))  # the same class came from several blocks
        hashes, cls, n = hashes[order], cls[order], n[order]
        keep = np.ones(len(hashes), bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (cls[1:] != cls[:-1])
        hashes, cls, n = hashes[keep], cls[keep], n[keep]
        if not len(hashes):
            return pd.DataFrame({"part": pd.Series([], dtype="int32"), "rows": pd.Series([], dtype=object)})
        start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        df = np.diff(np.append(start, len(hashes)))
        df = np.repeat(df, df)
        token = (np.uint64(rows["bucket"].iloc[0]) << _FEW) | hashes
        out = np.zeros(len(hashes), _SHARED)
        out["class"], out["n"], out["token"], out["df"] = cls, n, token, df
        out = out[df > 1]
        to = arrays.mix(out["class"].astype(np.uint64)) % np.uint64(parts)
        order = np.argsort(to, kind="stable")
        out, to = out[order], to[order]
        used, cut = np.unique(to, return_index=True)
        packed = [x.tobytes() for x in np.split(out, cut[1:])] if len(used) else []
        return pd.DataFrame({"part": used.astype(np.int32), "rows": pd.Series(packed, dtype=object)})

    return packed.groupBy("bucket").applyInPandas(run, "part int, rows binary")


_SHARED = np.dtype([("class", "<i8"), ("token", "<u8"), ("n", "<i4"), ("df", "<i4")])


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def prefixes(shared: DataFrame, percent: int, orders: int = ORDERS) -> DataFrame:
    """(class, n, tokens, unique, prefix, others): all shared shingles, the number of those of this class
    only, the prefix under the first order, in order, and the prefixes under the other orders."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.frombuffer(b, _SHARED) for b in rows["rows"]])
        x = x[np.argsort(x["class"], kind="stable")]
        start = np.flatnonzero(np.concatenate([[True], x["class"][1:] != x["class"][:-1]]))
        out: dict[str, list] = {"class": [], "n": [], "tokens": [], "unique": [], "prefix": [], "others": []}
        for a, b in zip(start, np.append(start[1:], len(x))):
            n, unique = int(x["n"][a]), int(x["n"][a]) - (b - a)
            length = int(prefix_length(np.int64(n), percent)) - unique
            if length <= 0:
                continue
            token, df = x["token"][a:b], x["df"][a:b].astype(np.int64)
            cuts = []
            for k in range(orders):
                band = df if k == 0 else np.frexp(df)[1] // k
                tie = arrays.mix(token ^ np.uint64(0x5851F42D4C957F2D * (k + 1) & (2**64 - 1)))
                cuts.append(token[np.lexsort((tie, band))[:length]].astype(np.int64))
            out["class"].append(int(x["class"][a]))
            out["n"].append(n)
            out["tokens"].append(token.astype(np.int64))
            out["unique"].append(unique)
            out["prefix"].append(cuts[0])
            out["others"].append(cuts[1:])
        return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in out.items()})

    return shared.groupBy("part").applyInPandas(run, "class long, n long, tokens array<long>, unique long, prefix array<long>, others array<array<long>>")


def _may_link(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Length filter and positional filter of two rows that share a prefix shingle.

    At the first shingle that two sets share under the order, their overlap is no more than
    what follows it in either; so a linked pair passes there, and passing once is enough.
    """
    overlap = F.least(na - pa_, nb - pb)
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (overlap * (100 + percent) >= (na + nb) * percent)


def verify(pairs: DataFrame, sets: DataFrame, percent: int, orders: int) -> DataFrame:
    """Pairs whose prefixes meet under the other orders too and whose similarity reaches the threshold.

    All shared shingles of a class are in `tokens`, so the overlap is exact.
    """
    left = sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"), F.col("others").alias("oa"))
    right = sets.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"), F.col("others").alias("ob"))
    meet = F.lit(True)
    for k in range(orders - 1):
        meet = meet & F.arrays_overlap(F.col("oa")[k], F.col("ob")[k])
    both = F.size(F.array_intersect("ta", "tb")).cast("long")
    sizes = F.col("na") + F.col("nb")
    return pairs.join(left, "a").join(right, "b").where(meet & (both * 100 >= (sizes - both) * percent)).select("a", "b")


def _ring(entries: DataFrame, percent: int, seed: int, reach: int) -> DataFrame:
    """Pairs of classes of different components that lie close in a drawn order within a prefix shingle."""
    # Shingles of very many classes are dealt out, so that no task orders a whole such group.
    sizes = entries.groupBy("token").count().where(F.col("count") > RING_ROWS).select("token", F.ceil(F.col("count") / RING_ROWS).alias("salts"))
    dealt = entries.join(sizes, "token", "left").withColumn("salt", F.pmod(F.xxhash64("class", F.lit(seed)), F.coalesce("salts", F.lit(1))))
    by = Window.partitionBy("token", "salt").orderBy(F.xxhash64("class", "token", F.lit(seed)), "class")
    near = F.array_compact(F.array(*(F.lag(F.struct("class", "n", "place", "comp"), i).over(by) for i in range(1, reach + 1))))
    other = F.filter("near", lambda x: (F.col("comp") != x["comp"]) & _may_link(F.col("n"), F.col("place"), x["n"], x["place"], percent))
    met = dealt.withColumn("near", near).select("class", F.explode(other).alias("x"))
    return met.select(F.least("class", "x.class").alias("a"), F.greatest("class", "x.class").alias("b")).distinct()


def _placed(entries: DataFrame, links: DataFrame) -> DataFrame:
    """The entries with the component of their class by the links so far."""
    roots = components(links, "a", "b")
    joined = entries.join(roots, F.col("class") == F.col("node"), "left")
    return cut_lineage(joined.withColumn("comp", F.coalesce("root", "class")).drop("node", "root"))


def class_links(entries: DataFrame, sets: DataFrame, percent: int, orders: int) -> DataFrame:
    """(node, root) of all classes that have a link."""
    placed, links = entries.withColumn("comp", F.col("class")), None
    for seed, reach in RINGS:
        found = cut_lineage(verify(_ring(placed, percent, seed, reach), sets, percent, orders))
        links = found if links is None else links.unionByName(found)
        placed = _placed(entries, links)
    # Last, only members of different components meet.
    comps = placed.groupBy("token", "comp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("place")).alias("rest"))
    several = comps.groupBy("token").agg(F.count("*").alias("comps")).where("comps > 1").select("token")
    comps = cut_lineage(comps.join(several, "token"))
    x, y = comps.alias("x"), comps.alias("y")
    meet = x.join(
        y,
        (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") < F.col("y.comp"))
        & (F.col("x.most") * 100 >= F.col("y.least") * percent) & (F.col("y.most") * 100 >= F.col("x.least") * percent)
        & (F.least("x.rest", "y.rest") * (100 + percent) >= (F.col("x.least") + F.col("y.least")) * percent),
    ).select(F.col("x.token").alias("token"), F.col("x.comp").alias("ca"), F.col("y.comp").alias("cb"))
    p, q = placed.alias("p"), placed.alias("q")
    pairs = (
        meet.join(p, (F.col("p.token") == meet["token"]) & (F.col("p.comp") == meet["ca"]))
        .join(
            q,
            (F.col("q.token") == meet["token"]) & (F.col("q.comp") == meet["cb"])
            & _may_link(F.col("p.n"), F.col("p.place"), F.col("q.n"), F.col("q.place"), percent),
        )
        .select(F.least("p.class", "q.class").alias("a"), F.greatest("p.class", "q.class").alias("b"))
        .distinct()
    )
    more = cut_lineage(verify(pairs, sets, percent, orders))
    return components(links.unionByName(more), "a", "b")


def jaccard_components(docs: DataFrame, percent: int = 80, k: int = 5, orders: int = ORDERS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, class, component_id) for every row of docs(doc_id, text)."""
    members = cut_lineage(with_class(docs, k))
    total = members.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    # Buckets of about 2 million shingles; the number follows the corpus.
    bits = max(4, int(np.ceil(np.log2(max(1, total["n"] or 0) / 2_000_000))) if total["n"] else 4)
    parts = max(16, (total["n"] or 0) // 1_000_000)
    packed = packed_shingles(docs, bits, k).repartition(1 << bits, "bucket")
    sets = cut_lineage(prefixes(shared_shingles(packed, parts, bits), percent, orders))
    # Shingles of one class only come before the prefix's first.
    entries = sets.select("class", "n", "unique", F.posexplode("prefix").alias("pos", "token"))
    entries = entries.select("class", "n", "token", (F.col("unique") + F.col("pos")).alias("place"))
    roots = class_links(entries, sets.select("class", "n", "tokens", "others"), percent, orders)
    placed = members.groupBy("class").agg(F.min("doc_id").alias("least")).where(F.col("class").isNotNull())
    placed = placed.join(roots, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component"))
    placed = cut_lineage(placed.join(smallest, "root").select(F.col("class").alias("of"), "root", "component"))
    return members.join(placed, F.col("class") == F.col("of"), "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), "class", "root", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    )


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs less all but one of each component: the one of the smallest id.

    Rows are known by id and text; of equal rows one stays.  Texts without words all stay.
    """
    linked = cut_lineage(jaccard_components(docs, percent).where(F.col("class").isNotNull()))
    row = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = linked.groupBy("root").agg(F.min(row).alias("first"))
    gone = linked.join(first, "root").where(row != F.col("first")).select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_hash")).distinct()
    kept = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("gone")) & (F.xxhash64("text") == F.col("gone_hash")), "left_anti")
    twice = linked.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_hash"))
    if twice.isEmpty():
        return kept
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("gone")) & (F.xxhash64("text") == F.col("gone_hash"))
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
