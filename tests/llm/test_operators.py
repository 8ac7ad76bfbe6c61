"""The corpus operators against plain loops, and their edge cases.

Edge rows: null id, null text, empty text, one very long text, repeated rows, an extra column
whose name an operator uses itself.
"""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from compare import compare, connect

from flowloom.llm import (
    arrays,
    context_mixing,
    decontamination,
    fingerprints,
    language_id,
    license_scan,
    ngram_join,
    packing,
    queries,
    sharding,
    toxicity,
    url_filter,
)
from flowloom.llm.components import components

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text):
    w = split(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.fixture(scope="module")
def edge(spark):
    words = [f"w{i % 977}x{i % 13}" for i in range(40_000)]
    rows = [
        (1, "the cat sat on the mat today", "en", "s", 5, "x"),
        (1, "the cat sat on the mat today", "en", "s", 5, "x"),
        (2, "the cat sat on the mat today", "de", None, 5, None),
        (None, "the cat sat on the mat today", None, None, None, None),
        (3, None, "en", "s", None, "x"),
        (4, "", "en", "s", 0, "x"),
        (5, " \t\n", None, "s", 3, "x"),
        (6, " ".join(words), "en", "s", 1, "x"),
        (7, "one two", "fr", "s", 7, "x"),
        (8, "ONE  two", "fr", "s", 7, "x"),
        (9, "12345 !!! ...", "fr", "s", 7, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words():
    w = arrays.words([b"Hello wOrld", b"", b"  a hello ", "é È".encode()])
    assert list(w.doc) == [0, 0, 2, 2, 3, 3] and list(w.first) == [0, 2, 2, 4, 6]
    assert w.hash[0] == w.hash[3] and len(set(w.hash)) == 5


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000, i) for i in range(1001, 1400)] + [(2000 + i, 2001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}


def test_url_filter(spark):
    rows = [
        (1, "http://a.net/x", '<link rel="canonical" href="http://b.net/es/1">'),
        (2, "https://b.net/es/1", None),
        (3, "http://c.net/z.html", '<meta http-equiv="refresh" content="0; url=http://a.net/x/">'),
        (4, None, "x"),
        (5, "nope", ""),
        (6, "http://d.net/q", "<link rel=canonical href='http://b.net/es/9'>"),
        (7, "http://e.com/", "<link rel=canonical href=http://d.net/q>"),
        (7, "http://e.com/", "<link rel=canonical href=http://d.net/q>"),
        (None, "http://C.net/z?x=1", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS verdict", "1 AS host")
    got = sorted((r["page_id"] or 0, r["verdict"], r["rule"]) for r in url_filter.judge(pages).collect())
    want = [(0, "allow", None), (1, "block", None), (2, "block", "net/es/"), (3, "block", None), (4, "allow", None), (5, "allow", None), (6, "allow", None), (7, "allow", "com/"), (7, "allow", "com/")]
    assert got == want
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_targets(spark):
    """Targets that are no pages, and relative ones."""
    rows = [
        (1, "http://d.net/q", "<link rel=canonical href='http://b.net/es/9'>"),  # blocked target, not crawled
        (2, "http://f.net/q", "<link rel=canonical href=http://www.g.com/x>"),  # allowed target, not crawled
        (3, "http://b.net/es/7", '<meta http-equiv=refresh content="0; url=http://f.net/q">'),
        (4, "http://f.net/q/", None),
        (5, "http://h.net/a/b/start.html", '<meta http-equiv="refresh" content="0; url=next">'),
        (6, "http://h.net/a/b/next", '<link rel="canonical" href="../../es/./1?x">'),
        (7, "http://h.net/p", '<link rel="canonical" href="es/2#top">'),
        (8, "http://h.net", '<link rel="canonical" href="fr/">'),
        (9, "http://h.net/r", "<link rel=canonical href=mailto:x@b.net/es/1>"),
        (10, "http://h.net/s/t", '<link rel=canonical href="?u=http://b.net/es/1">'),
        (11, "http://h.net/v", '<link rel=canonical href="//b.net/es/3">'),
        (12, "http://h.net/w/", '<link rel=canonical href="../fr/../es/y/..">'),
        (13, "http://h.net/z/", '<link rel=canonical href="../../../../es/1">'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["rule"]) for r in url_filter.judge(pages).collect()}
    blocked = {1, 5, 6, 7, 8, 11, 12, 13}
    assert got == {i: ("block", "net/es/") if i == 3 else ("block" if i in blocked else "allow", None) for i in range(1, 14)}
    # The SQL twin knows the same targets.
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [*rows, (14, None, "x"), (15, "nope", None)])
    judged = url_filter.judge(spark.createDataFrame([*rows, (14, None, "x"), (15, "nope", None)], pages.schema)).drop("alias_group")
    assert compare(judged, con, url_filter.ORACLE) is None


def test_url_queries_are_pages_of_their_own(spark):
    """A page's redirect does not block pages that differ from it in their query."""
    rows = [
        (1, "http://a.org/view?id=1", '<meta http-equiv="refresh" content="0; url=http://b.net/es/1">'),
        (2, "http://a.org/view?id=2", None),
        (3, "http://a.org/view?id=3", '<link rel="canonical" href="?id=4">'),
        (4, "https://A.org/view/?id=1#top", None),
        (5, "http://a.org/view?id=4", '<link rel="canonical" href="http://b.net/fr/2">'),
        (6, "http://a.org/view", None),
    ]
    pages = spark.createDataFrame(rows * 3, "page_id long, url string, html string")
    got = {(r["page_id"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got == {(1, "block"), (2, "allow"), (3, "block"), (4, "block"), (5, "block"), (6, "allow")}


def test_url_rules(spark):
    urls = ["http://x.www.example.com/en/a", "http://example.com/en/", "http://notexample.com/en/", "http://a.net/es/?q", "http://a.net/es", "x://A.NET#/fr/", "http://net/fr/1"]
    got = {r["url"]: r["rule"] for r in url_filter.with_rule(spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_filter.host_of("url").alias("h"), url_filter.path_of("url").alias("p")), "h", "p").collect()}
    assert list(map(got.get, urls)) == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", None, None, "net/fr/"]


def test_sharding(spark, texts, edge, empty):
    got = queries.QUERIES["op2_sharding"](spark, SF_DIR).toPandas()
    assert sorted(got["doc_id"]) == sorted(texts)
    for r in got.itertuples():
        raw = texts[r.doc_id].encode()
        assert r[2] == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    assert set(got["shard"]) <= set(range(24))
    for _, shard in got.groupby("shard"):
        assert sorted(shard["slot"]) == list(range(len(shard)))
    largest = max(len(t.encode()) for t in texts.values()) + 8
    bytes_ = got.groupby("shard")["size"].sum()
    assert bytes_.max() - bytes_.min() <= 2 * largest
    small = sharding.with_slots(sharding.assign(edge, 3)).collect()
    assert len(small) == 11 and sharding.assign(empty).count() == 0


def test_hot_copies_are_cut(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "IF(id < 2000, 'same text', concat('t', id)) AS text", "'en' AS lang", "'s' AS source")
    sizes = sharding.assign(docs, 8).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(sizes) == 8 and sizes.max() < 1.05 * sizes.min()


def test_toxicity(spark, edge, empty):
    words = ["good", "fine", "calm", "tree", "lake", "road", "bread", "light"]
    rows = [(i, " ".join(words[(i * k) % 8] for k in range(1, 9)) + (" awful" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.where("doc_id < 400").select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int"))
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    got = toxicity.predict(docs, model).toPandas()
    assert (got["predicted"] == got["toxic"]).all() and got["score"].between(0, 1).all()
    judged = toxicity.predict(edge, model).toPandas()
    assert len(judged) == 11 and judged["score"].notna().all() and judged["score"].dtype == float
    assert toxicity.predict(empty, model).count() == 0
    none = toxicity.predict(edge, toxicity.train(docs.select("doc_id", "text"), labels.limit(0))).toPandas()
    assert (none["predicted"] == 0).all()


def test_context_mixing_blocks_hold_texts_of_like_length(spark):
    """Coding a block takes as many steps as its longest text has tokens."""
    sizes = [100_000 if i % 40 == 0 else 9_000 for i in range(1200)]
    docs = spark.createDataFrame([(i, "x " * (n // 2)) for i, n in enumerate(sizes)], "doc_id long, text string").coalesce(1)
    blocks = context_mixing._texts_by_block(docs).collect()
    found = [context_mixing._rows_of(r["data"]).column("bytes").to_pylist() for r in blocks]
    assert sorted(n for b in found for n in b) == sorted(sizes) and len(found) >= 4
    assert sum(max(b) == 100_000 for b in found) <= 2


def test_context_mixing(spark, texts, edge, empty):
    got = queries.QUERIES["op4_context_mixing"](spark, SF_DIR).toPandas()
    tokens = {i: [*split(t), "\0"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    count = collections.Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(count.values()), len(count)
    assert len(got) == len(texts)
    for r in got.itertuples():
        w = tokens[r.doc_id]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    rest = got[got["held_out"]]
    assert rest["score"].sum() > rest["base_score"].sum()
    small = context_mixing.score(edge).toPandas()
    assert len(small) == 11 and (small["score"] <= 0).all() and sorted(small["n_tokens"])[:3] == [1, 1, 1]
    assert context_mixing.score(empty).count() == 0


def test_mixed_rest_is_a_distribution():
    rng = np.random.default_rng(2)
    model = {"rest_bits": 5, "rest": rng.normal(0, 1, (3, 1 << context_mixing.REST_SLOT_BITS)).astype(np.float32)}
    history = (np.uint64(7) << np.uint64(32)) | rng.integers(0, 32, 600).astype(np.uint64)
    contexts = tuple(rng.integers(0, 2**63, 601).astype(np.uint64) for _ in range(2))
    ends = [(np.uint64(7) << np.uint64(32)) | np.uint64(x) for x in range(32)]
    found = [context_mixing.mixed_rest(np.append(history, x), contexts, [(0, 601)], model)[-1] for x in ends]
    assert np.exp(found).sum() == pytest.approx(1, rel=1e-4)


def plain_scores(rows):
    """Scores of (doc_id, text) by one loop over decisions, one after the other, in 64-bit numbers."""
    mask = (1 << 64) - 1
    coded, count = [], collections.Counter()
    for i, text in rows:
        words = split(text)
        hashes = [int(arrays.word_hash(w)) for w in words] + [int(context_mixing._END)]
        coded.append((i, hashes))
    suffix = {int(context_mixing._END): 0}
    for _, text in rows:
        b = context_mixing.Block([text.encode()])
        suffix.update({int(h): int(x) for h, x in zip(b.hash, b.suffix) if int(h) != int(context_mixing._END)})
    train = [(i, h) for i, h in coded if zlib.crc32(str(i).encode()) % 10]
    for _, hashes in train:
        count.update(hashes)
    n = sum(count.values())
    often = sorted({h for h, c in count.items() if c >= max(1, math.ceil(n / 1024))} | {int(context_mixing._END)})
    total = [0] * context_mixing.GROUPS + [count[h] for h in often]
    for h, c in count.items():
        if h not in often:
            total[suffix[h]] += c
    tree = context_mixing._huffman(np.array(total, float))
    group = {h: context_mixing.GROUPS + often.index(h) if h in often else suffix[h] for h in suffix}
    mix = lambda x: int(arrays.mix(np.array([x & mask], np.uint64))[0])
    scramble = int(context_mixing._NODE)

    def decisions(hashes):
        """For each token (kind, node, level, bit, slots) of each decision."""
        for at, h in enumerate(hashes):
            g1, g2 = (group[hashes[at - j]] + 1 if at >= j else 0 for j in (1, 2))
            w1, w2 = (hashes[at - j] if at >= j else 0 for j in (1, 2))
            outer = [mix(g1 + (1 << 20)), mix(g1 * 4099 + g2 + (1 << 40))]
            inner = [0, mix(w1 + 1), mix(w1 * 4099 + mix((w2 if at >= 2 else 0) + 2))]
            g = group[h]
            out = []
            for level in range(tree["length"][g]):
                node = int(tree["nodes"][g, level])
                slots = [((c + node * scramble) & mask) >> (64 - context_mixing.SLOT_BITS) for c in outer]
                out.append(("group", node, level, int(tree["bits"][g, level]), slots))
            if g < context_mixing.GROUPS:
                for level in range(context_mixing.REST_BITS):
                    node = (((g << 32) | (1 << level) | (h & ((1 << level) - 1))) * scramble) & mask
                    slots = [((c + node) & mask) >> (64 - context_mixing.REST_SLOT_BITS) for c in inner]
                    cell = (level, node >> (64 - context_mixing.REST_CELL_BITS))
                    out.append(("bits", cell, level, h >> level & 1, slots))
            yield h, g, out

    table = collections.Counter()
    for _, hashes in train:
        for _, _, path in decisions(hashes):
            for kind, _, _, bit, slots in path:
                table.update((kind, c, s, bit) for c, s in enumerate(slots))
    logit = lambda kind, c, s: math.log((table[kind, c, s, 1] + 0.4) / (table[kind, c, s, 0] + 0.4))
    leaf = lambda h: (suffix[h], h & ((1 << context_mixing.REST_BITS) - 1))
    scores = {}
    for i, hashes in coded:
        weights, own, times, score = {}, {}, collections.Counter(), 0.0
        for h, g, path in decisions(hashes):
            for kind, cell, level, bit, slots in path:
                x = [float(tree["ones"][cell])] if kind == "group" else []
                x += [logit(kind, c, s) for c, s in enumerate(slots)]
                x.append(own.get((kind, cell), x[0]))
                w = weights.setdefault((kind, level), [0.35, 0.35, 0.35, 0.15])
                p = 1 / (1 + math.exp(-min(max(sum(a * b for a, b in zip(w, x)), -12), 12)))
                score += math.log(p if bit else 1 - p)
                for k in range(4):
                    w[k] += 0.02 * (bit - p) * x[k]
                pace = 4 / (times[kind, cell] + 3)
                own[kind, cell] = min(max(x[3] + (bit - 1 / (1 + math.exp(-x[3]))) * pace, -8), 8)
                times[kind, cell] = min(times[kind, cell], 250) + 1
            if g < context_mixing.GROUPS:
                same = [t for t in count if t not in often and leaf(t) == leaf(h)]
                score += math.log((count[h] + 0.1) / (sum(count[t] for t in same) + 0.1 * (len(same) + 1)))
        scores[i] = score / math.log(10)
    return scores


def test_scores_against_plain_loops(spark):
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in "kuvwxyz" for b in range(300)]
    rows = [(i, " ".join(words[j] for j in rng.zipf(1.3, rng.integers(0, 90)) % len(words))) for i in range(60)]
    got = {r["doc_id"]: r["score"] for r in context_mixing.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    plain = plain_scores(rows)
    assert len(got) == 60 and all(got[i] == pytest.approx(plain[i], rel=1e-4, abs=1e-4) for i in plain)


def test_score_of_a_text_is_the_same_beside_others():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{x}q" for x in rng.integers(0, 400, n)).encode() for n in (700, 3, 0, 90, 91, 92, 5)]
    b = context_mixing.Block(texts)
    model = context_mixing._huffman(np.append(np.bincount(b.suffix, minlength=context_mixing.GROUPS), 7))
    model |= {"frequent": np.array([context_mixing._END]), "rest_bits": context_mixing.REST_BITS}
    model["logits"] = rng.normal(0, 1, (2, 1 << context_mixing.SLOT_BITS)).astype(np.float32)
    model["rest"] = rng.normal(0, 1, (3, 1 << context_mixing.REST_SLOT_BITS)).astype(np.float32)
    cuts = list(zip(b.first[:-1].tolist(), b.first[1:].tolist()))
    group = context_mixing._groups_of(b, model)
    rest = np.flatnonzero(group < context_mixing.GROUPS)
    leaf = context_mixing._leaf(group[rest], b.hash[rest], context_mixing.REST_BITS)
    contexts = context_mixing._contexts(group, b.first), tuple(c[rest] for c in context_mixing._word_contexts(b))
    together = context_mixing.Mixer(model).code(cuts, group, contexts[0], rest, leaf, contexts[1])
    for low, high in cuts:
        alone = context_mixing.Mixer(model).code([(low, high)], group, contexts[0], rest, leaf, contexts[1])
        assert np.array_equal(alone[low:high], together[low:high])


def test_mixing_of_rare_words(spark):
    """Rare words of one hashed group are told apart by the words before; a long text goes on adapting."""
    rng = np.random.default_rng(4)
    run = [" ".join(f"{(j + i) % 3000}zzz" for i in range(50)) for j in rng.integers(0, 3000, 800)]
    held = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    docs = [*enumerate(run), (held[0], " ".join(f"{i}zzz" for i in range(700, 900))), (held[1], "17zzz " * 250), (held[2], "17zzz " * 4000)]
    got = {r["doc_id"]: r for r in context_mixing.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[held[0]]["score"] > 0.7 * got[held[0]]["base_score"]
    short, long = (got[i]["score"] / got[i]["n_tokens"] for i in held[1:])
    assert long > 0.5 * short


def test_mixed_groups_are_a_distribution():
    """The probabilities of all groups at one place add up to one."""
    model = context_mixing._huffman(np.arange(1.0, 40.0))
    model["logits"] = np.random.default_rng(1).normal(0, 1, (2, 1 << context_mixing.SLOT_BITS)).astype(np.float32)
    total = 0.0
    for g in range(39):
        group = np.array([3, 7, g], np.int32)
        total += math.exp(context_mixing.mixed_bits(group, context_mixing._contexts(group, np.array([0, 3])), [(0, 3)], model)[2])
    assert total == pytest.approx(1.0, rel=1e-4)


def test_decontamination(spark, edge, empty):
    a, b = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)]
    items = [(1, " ".join(a)), (2, " ".join(b)), (2, " ".join(b)), (3, None), (4, "too short"), (None, " ".join(f"c{i}" for i in range(9)))]
    docs = [
        (10, "x " + " ".join(a[10:] + ["y"] + a[:10]).upper(), "reordered"),
        (11, " ".join(a[:6]), "partial"),
        (12, " ".join(b).replace(" ", "!! "), "marks"),
        (12, " ".join(b).replace(" ", "!! "), "marks"),
        (13, "nothing here of that kind at all", "clean"),
        (None, " ".join(b), "null id"),
        (14, None, "null"),
        (15, " ".join(a[:7] * 4), "repeats"),
    ]
    items, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string, coverage string")
    got = {(r["doc_id"], r["item_id"]): (round(r["coverage"], 3), len(r["tiles"])) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(10, 1): (1.0, 2), (12, 2): (1.0, 1), (None, 2): (1.0, 1)}
    kept = decontamination.without_contaminated(docs, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [11, 13, 14, 15] and kept.columns == docs.columns
    assert decontamination.contaminated(empty, items).count() == 0
    assert decontamination.contaminated(edge, items.limit(0)).count() == 0


def test_tiles_against_plain_greedy():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x, y = list(rng.integers(0, 4, 60)), list(rng.integers(0, 4, 40))
        k = 3
        seeds = [(i, j) for i in range(58) for j in range(38) if x[i : i + k] == y[j : j + k]]
        if not seeds:
            continue
        free_x, free_y, want = [True] * 60, [True] * 40, []
        while True:
            best = (k - 1, 0, 0)
            for i in range(60):
                for j in range(40):
                    n = 0
                    while i + n < 60 and j + n < 40 and x[i + n] == y[j + n] and free_x[i + n] and free_y[j + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, i, j)
            if best[0] < k:
                break
            want.append(best)
            for t in range(best[0]):
                free_x[best[1] + t] = free_y[best[2] + t] = False
        got = decontamination.tile(*map(np.array, zip(*seeds)), k)
        assert sorted((n, i, j) for i, j, n in got) == sorted(want)


def test_ngram_join(spark, texts, edge, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op6_ngram_join"](spark, SF_DIR).collect()}
    assert got == plain_components(texts)
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(edge).collect()}
    assert {(1, 3, 1), (2, 3, 1), (None, 3, 1), (3, 0, 3), (4, 0, 4), (7, 1, 7), (8, 1, 7)} <= rows
    assert ngram_join.jaccard_components(empty).count() == 0
    kept = [r["doc_id"] for r in ngram_join.keep_one(edge).collect()]
    assert sorted(kept) == [1, 3, 4, 5, 6, 7, 9]


def plain_components(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_copies_all_linked(spark):
    """A large group of near copies, of which many pairs are below the threshold."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(300):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 7)):
            words[at] = f"e{i}x{at}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == plain_components(texts)


def test_language_id(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    rest = got[got["held_out"] & (got["text"].str.len() > 30)]
    assert (rest["lang_pred"] == rest["lang"]).mean() > 0.97
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in got[got["held_out"]]["doc_id"])
    model = language_id.train(docs, ~language_id.held_out(docs["doc_id"]))
    judged = language_id.predict(edge, model).toPandas()
    assert len(judged) == 11 and set(judged[judged["doc_id"].isin([3, 4, 5, 9])]["lang_pred"]) == {"und"}
    assert language_id.predict(empty, model).count() == 0
    untrained = language_id.train(empty, ~language_id.held_out(empty["doc_id"]))
    assert set(language_id.predict(edge, untrained).toPandas()["lang_pred"]) == {"und"}


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_share(words, template):
    """Highest share of a template's words in a window a fourth longer than it that has its required words; None below 0.8."""
    wanted, n = set(template.text.split()), len(template.text.split())
    windows = (set(words[j : j + n + max(2, n // 4)]) & wanted for j in range(len(words)))
    shares = [len(x) / len(wanted) for x in windows if set(template.required.split()) <= x]
    return max((x for x in shares if x >= 0.8), default=None)


def test_license_scan(spark, texts, edge, empty):
    got = queries.QUERIES["op8_license_scan"](spark, SF_DIR).toPandas().set_index("doc_id")
    for i, text in texts.items():
        w = license_words(text)
        at = [(j, label) for p, label in license_scan.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        base = {label for _, label in at}
        shares = [(t.label, plain_share(w, t)) for t in license_scan.TEMPLATES] if any(set(t.required.split()) <= set(w) for t in license_scan.TEMPLATES) else []
        r = got.loc[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at)) and r["base_labels"] == ",".join(sorted(base))
        # The best match always counts; others may only be left out where they overlap a better one.
        assert r["score"] == pytest.approx(max((x for _, x in shares if x), default=0.0))
        assert base <= set(filter(None, r["labels"].split(","))) <= base | {label for label, x in shares if x}
        assert (r["first_word"] if at else -1) == min((j for j, _ in at), default=-1)
    assert license_scan.scan(edge).count() == 11 and license_scan.scan(empty).count() == 0


def test_license_labels_of_notices_and_prose(spark):
    said = {
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "lgpl",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "licensed under CC BY 4.0": "cc-by",
        "licensed under CC BY-NC 4.0": "cc-by,cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
        "The album was released in May under the terms of a Sony license.": "",
        "The film, released by the studio under a new distribution license, did well.": "",
        "The software is distributed by the store, and you can return it in compliance with the law.": "",
        "Permission to enter was granted free of charge to any person with a copy of the ticket.": "",
        "released under the MIT license. " + "x " * 30 + "Licensed under the Apache License, Version 2.0": "apache,mit",
    }
    got = {r["text_"]: r["labels"] for r in license_scan.scan(spark.createDataFrame([(t, t) for t in said], "text string, text_ string")).collect()}
    assert got == said


WRAPPED = {
    "apache": "# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an \"AS IS\" BASIS,\n# WITHOUT WARRANTIES",
    "gpl": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by",
    "lgpl": " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\r\nof this software and associated documentation files (the \"Software\"), to deal",
    "bsd": "// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that the following conditions are\n// met:",
    "mpl": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed */",
}


def test_license_wrapped(spark):
    rows = [(label, text) for label, text in WRAPPED.items()]
    rows += [(f"{label} one line", re.sub(r"\s+", " ", text)) for label, text in WRAPPED.items()]
    rows += [("narrow", "\n".join(WRAPPED["lgpl"].split())), ("cut", WRAPPED["bsd"][:60])]
    rows += [("twice", "a b\n\n" + WRAPPED["mpl"] + "\n" + WRAPPED["mpl"])]
    got = {r["name"]: r for r in license_scan.scan(spark.createDataFrame(rows, "name string, text string")).collect()}
    for label in WRAPPED:
        for name in (label, f"{label} one line"):
            assert label in got[name]["labels"].split(",") and got[name]["score"] == 1.0
    assert got["narrow"]["score"] == 1.0 and "lgpl" in got["narrow"]["labels"]
    assert (got["cut"]["labels"], got["cut"]["score"]) == ("", 0.0)
    assert [m[:2] for m in got["twice"]["matches"]] == [("mpl", 2), ("mpl", 4)]


def test_license_blocks(spark):
    rng = np.random.default_rng(8)
    templates = [license_scan.Template("a", "the red fox ran to the old barn"), license_scan.Template("b", "one of the cats", "cats"), license_scan.Template("c", "fox and cats ran of barn old", "and of")]
    pool = sorted({w for t in templates for w in t.text.split()} | set("xyz"))
    texts = ["".join(str(w) + " \n"[rng.integers(2)] for w in rng.choice(pool, rng.integers(0, 60))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for t in templates:
        got = license_scan.scan(frame, [t], {}, 0.8).collect()
        assert {r["i"]: r["score"] for r in got} == {i: plain_share(text.split(), t) or 0.0 for i, text in enumerate(texts)}
        assert all(r["labels"] == (t.label if r["score"] else "") for r in got)
    best = {r["i"]: r["score"] for r in license_scan.scan(frame, templates, {}, 0.8).collect()}
    assert best == {i: max(plain_share(text.split(), t) or 0.0 for t in templates) for i, text in enumerate(texts)}


def test_packing(spark, texts, edge, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    got = queries.QUERIES["op9_packing"](spark, SF_DIR).toPandas()
    assert set(got["doc_id"]) == set(texts)
    for i, pieces in got.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1], "<u4")
        pieces = pieces.sort_values("start")
        assert list(pieces["start"]) == [0, *np.cumsum(pieces["length"])[:-1]] and pieces["length"].sum() == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces.itertuples())
    for _, sequence in got.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert list(sequence["offset"]) == [0, *np.cumsum(sequence["length"])[:-1]] and sequence["length"].sum() <= 2048
    small = packing.pack(edge, packing.tokenizer_path(), 64, 2).toPandas()
    assert small[small["start"] == 0].shape[0] == 11 and small.groupby("sequence_id")["length"].sum().max() <= 64
    assert packing.pack(empty, packing.tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["it's a, b. c", "é. É, e\u0301x.", "a <|endoftext|> b", "x.. y,, .", "1.5, 2.", "don't, can't.", "\u00a0a\u2003b.\u0301"])
def test_word_ids_equal_the_tokenizer(text):
    ids = packing.WordIds(packing.tokenizer_path())
    want = np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert ids.encode([text.encode()]) == [want]


def test_fingerprints(spark, texts, edge, empty, monkeypatch):
    got = queries.QUERIES["op10_fingerprints"](spark, SF_DIR).toPandas().set_index("doc_id")
    ids = sorted(texts, reverse=True)
    error = []
    for i, j in zip(ids, ids[1:] + ids[:1]):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[j][:half]
        r, a, b = got.loc[i], shingle_set(texts[i]), shingle_set(edited)
        assert r["n_chars"] == len(texts[i]) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        error.append(r["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.abs(error).max() < 0.2 and abs(np.mean(error)) < 0.01
    monkeypatch.setattr(fingerprints, "PARTITION_BYTES", 30_000)
    again = queries.QUERIES["op10_fingerprints"](spark, SF_DIR).toPandas().set_index("doc_id").loc[got.index]
    assert again.equals(got)
    small = fingerprints.compare_edited(edge).toPandas()
    assert len(small) == 11 and small["near_edited"].between(0, 1).all()
    assert fingerprints.compare_edited(empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.ORACLES[name]) is None


def test_word_ids_are_the_tokenizers():
    texts = [
        "", "a", "A A. a, a", "it's IT'S don't. c' d's. x.y a., .. , . 12.5, e!!! .!?",
        "ΑΣΑ ΑΣ ΑΣ. Σ Ŝŝ Ǆ ǅ ŉ ẞ ß ﬁ. ª. İstanbul, İ KelvinK",
        "H̱ello À. e.́ a.≮ b≮ กำ ñ. 中文, 　가 한",
        "<|endoftext|> x<|endoftext|> y<|startoftext|>.. \x1ca\x1d. \x85 \x00. a‍.",
    ]
    ids = packing.WordIds(packing.tokenizer_path())
    for text, got in [*zip(texts, ids.encode([t.encode() for t in texts])), *((t, ids.encode([t.encode()])[0]) for t in texts)]:
        assert list(np.frombuffer(got, "<u4")) == ids.tokenizer.encode(text, add_special_tokens=False).ids
    ids.new, ids.old = {}, ids.new  # words of the older half are taken over
    assert list(np.frombuffer(ids.encode([b"A A. a, a"])[0], "<u4")) == ids.tokenizer.encode(texts[2], add_special_tokens=False).ids
