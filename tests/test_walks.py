from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowloom.operators import checks, subgraph, walks


def weighted(spark, edges):
    return subgraph.weighted_edges(spark.createDataFrame(edges, "s string, d string, w double"), "s", "d", "w", "none")


def close(counts, expected, total):
    for key, share in expected.items():
        assert abs(counts[key] / total - share) < 4.5 * (share * (1 - share) / total) ** 0.5, (key, counts[key] / total, share)


def test_hub_steps_follow_the_weights(spark):
    """The hub's neighbours lie in several pieces; walks must not see that."""
    edges = [("hub", f"n{i:02d}", float(1 + i % 4)) for i in range(40)]
    w = weighted(spark, edges)
    graph = walks.prepare_graph(w, chunk_rows=8)
    assert graph.hubs is not None
    runs = 6000
    out = walks.walk(graph, walks.fan_out(walks.start_nodes(w), runs), 2, seed=5, chunk_rows=8).collect()
    assert len(out) == runs
    counts = Counter(r.tokens[1] for r in out)
    total = sum(x for *_, x in edges)
    close(counts, {d: x / total for _, d, x in edges}, runs)


@pytest.mark.parametrize("chunk_rows", [4096, 2])
def test_second_order_bias(spark, chunk_rows):
    # From s to m; m leads back to s, to c (known to s) and to f (unknown).
    edges = [("s", "m", 1.0), ("m", "s", 1.0), ("m", "c", 2.0), ("m", "f", 1.0), ("s", "c", 1e-6)]
    p, q = 0.25, 4.0
    w = weighted(spark, edges)
    graph = walks.prepare_graph(w, second_order=True, chunk_rows=chunk_rows)
    runs = 4000
    out = walks.walk(graph, walks.fan_out(walks.start_nodes(w, only="s"), runs), 3, 7, p, q, chunk_rows).collect()
    third = Counter(r.tokens[2] for r in out if r.tokens[1] == "m")
    mass = {"s": 1 / p, "c": 2.0, "f": 1 / q}
    total = sum(mass.values())
    close(third, {k: v / total for k, v in mass.items()}, sum(third.values()))


def test_walks_do_not_depend_on_partitions(spark):
    edges = [(f"v{i}", f"v{(i * k) % 30}", float(k)) for i in range(30) for k in (2, 3, 5)] + [("v1", "end", 1.0)]
    w = weighted(spark, edges)
    starts = walks.fan_out(walks.start_nodes(w), 3)
    known = {(s, d) for s, d, _ in edges}
    results = []
    for partitions in (1, 7):
        out = walks.walk(walks.prepare_graph(w.repartition(partitions)), starts.repartition(partitions), 12, 9)
        results.append(sorted((r["round"], r.start, r.tokens) for r in out.collect()))
    assert results[0] == results[1] and len(results[0]) == 90
    for _, start, tokens in results[0]:
        assert tokens[0] == start and len(tokens) <= 12
        assert all(pair in known for pair in zip(tokens, tokens[1:]))
        assert len(tokens) == 12 or tokens[-1] == "end"


def test_batches_resume(spark, tmp_path):
    w = weighted(spark, [(f"v{i}", f"v{i + 1}", 1.0) for i in range(7)])
    starts, graph = walks.start_nodes(w), walks.prepare_graph(w)
    path = str(tmp_path / "walks")
    done = spark.createDataFrame([], "start string")
    seen = []
    for batch in range(3):
        chosen = walks.next_batch(starts, done, 3)
        walks.append_batch(walks.walk(graph, walks.fan_out(chosen, 2), 4, 1 + batch), path, batch)
        done = spark.read.parquet(path).select("start")
        seen.append(chosen.count())
    assert seen == [3, 3, 1]
    assert spark.read.parquet(path).groupBy("start").count().filter("count <> 2").count() == 0


def test_id_map_names_and_stats(spark):
    corpus = spark.createDataFrame(
        [(0, "a", ["a", "b", "c"]), (0, "b", ["b"]), (0, "c", ["c", "a"])], "round int, start string, tokens array<string>"
    )
    assert [(r.vid, r.token) for r in walks.id_map(corpus).orderBy("vid").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    stats = walks.corpus_stats(corpus, min_length=2).first()
    assert (stats.lines, stats.length_one, stats.min_length, stats.max_length, stats.p50_length, stats.unique_tokens) == (3, 1, 1, 3, 2, 3)
    names = spark.createDataFrame([("a", "A"), ("b", "")], "id string, name string")
    named = {r.start: r.tokens for r in walks.token_names(corpus, names).collect()}
    assert named == {"a": ["A", "b", "c"], "b": ["b"], "c": ["c", "A"]}
    bad = spark.createDataFrame([("0", "a"), ("x", "a"), ("2", "")], "vid string, token string")
    assert {r.check: r.ok for r in checks.check_id_map(bad).collect()} == {
        "id_map_not_empty": True, "vid_is_number": False, "token_not_empty": False, "token_unique": False,
    }


def test_weight_fallbacks(spark):
    df = spark.createDataFrame([("a", "b", 0.0), ("a", "c", -1.0), ("a", "d", 9.0)], "s string, d string, w double")
    rows = {r.dst: (r.w, r.fallback) for r in subgraph.weighted_edges(df, "s", "d", "w", "sqrt").collect()}
    assert rows == {"b": (1_000_000, True), "c": (1_000_000, True), "d": (3_000_000, False)}
    both = subgraph.weighted_edges(df, "s", "d", "w", "sqrt", undirected=True)
    assert both.filter(F.col("dst") == "a").count() == 3
