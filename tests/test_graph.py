"""Causal graph, estimates and endpoint graph against plain loops."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowloom.operators import estimate, hcg, subgraph, tcg
from flowloom.schema import FLOW_SCHEMA

PRIORITY = {"CR": 1, "PR": 2, "DHR": 3, "SHR": 4}


def flow(number, src, dst, ts, protocol=6, name="web", duration=1.0):
    (sip, sport), (dip, dport) = src, dst
    text = "" if ts == 0 else f"t{ts}"
    return (
        f"rec_{number:010d}", f"f{number}", f"{sip}:{sport}", f"{dip}:{dport}", sip, sport, dip, dport, protocol, text, ts,
        duration, 1, 2, 3, 4, 0, name, name,
    )


def frame(spark, rows):
    return spark.createDataFrame(rows, FLOW_SCHEMA)


def random_flows(seed, n, hosts=3, ports=2, span=60, hot=0.0):
    rng = random.Random(seed)

    def end():
        host = 0 if rng.random() < hot else rng.randrange(hosts)
        return f"h{host}", rng.randrange(ports)

    times = sorted(rng.randrange(1, span) for _ in range(n))
    return [flow(i + 1, end(), end(), t, rng.choice([6, 17])) for i, t in enumerate(times)]


def expected_edges(rows, windows, relations):
    """Relation by relation in order of precedence; the first writer of a pair wins."""
    found = {}
    ordered = sorted(rows, key=lambda r: (r[10], r[0]))
    for relation in sorted(relations, key=PRIORITY.get):
        for a, b in itertools.combinations(ordered, 2):
            gap = b[10] - a[10]
            window = windows[relation]
            if (window is not None and gap > window) or (a[0], b[0]) in found:
                continue

            def kind(x, y):
                if x[8] == y[8] and (x[4], x[5], x[6], x[7]) == (y[6], y[7], y[4], y[5]):
                    return "CR"
                if x[6] == y[4]:
                    return "PR"
                if x[4] == y[4]:
                    return "SHR" if x[5] == y[5] else "DHR"
                return None

            either_way = relation in ("CR", "PR")
            if kind(a, b) == relation or (either_way and kind(b, a) == relation):
                found[(a[0], b[0])] = (relation, gap)
    return {(a, b, r, g) for (a, b), (r, g) in found.items()}


def got_edges(df):
    rows = df.collect()
    assert len({r.relation_id for r in rows}) == len(rows)
    for r in rows:
        assert r.same_timestamp == (r.delta_seconds == 0) and r.relation_priority == PRIORITY[r.relation_type]
    return {(r.src_record_id, r.dst_record_id, r.relation_type, r.delta_seconds) for r in rows}


@pytest.mark.parametrize("cell_rows", [4096, 3])
@pytest.mark.parametrize("relations", [["CR", "PR", "DHR", "SHR"], ["PR", "SHR"], ["CR", "DHR"], ["SHR"]])
def test_edges_equal_the_loop(spark, relations, cell_rows):
    windows = {"CR": 5, "PR": 2, "DHR": 3, "SHR": 7}
    rows = random_flows(len(relations), 120, hot=0.4)
    got = got_edges(tcg.edges(frame(spark, rows), windows, relations, cell_rows))
    assert got == expected_edges(rows, windows, relations)


def test_unlimited_windows_and_one_hot_second(spark):
    windows = tcg.relation_windows(0)
    rows = [flow(i, ("h0", i % 2), ("h1", i % 2), 9 if i % 3 else 8) for i in range(40)]
    rows.sort(key=lambda r: (r[10], r[0]))
    got = got_edges(tcg.edges(frame(spark, rows), windows, cell_rows=5))
    assert got == expected_edges(rows, windows, list(PRIORITY))


def test_hand_made_cases(spark):
    windows = {"CR": 5, "PR": 1, "DHR": 1, "SHR": 5}
    self_pair = [flow(1, ("a", 1), ("a", 1), 10), flow(2, ("a", 1), ("a", 1), 12)]
    assert got_edges(tcg.edges(frame(spark, self_pair), windows)) == {("rec_0000000001", "rec_0000000002", "CR", 2)}
    # Same source, the first also ends at that source: PR's window is over, SHR may not take it.
    shadowed = [flow(1, ("a", 1), ("a", 2), 10), flow(2, ("a", 1), ("b", 2), 14)]
    assert got_edges(tcg.edges(frame(spark, shadowed), windows)) == set()


def test_relation_parameters():
    assert tcg.parse_relations(" shr, cr ") == ["CR", "SHR"]
    assert tcg.relation_windows(60, "CR=5,PR=0") == {"CR": 5, "PR": None, "DHR": 60, "SHR": 60}
    with pytest.raises(ValueError):
        tcg.parse_relations("XX")
    with pytest.raises(ValueError):
        tcg.relation_windows(60, "CR=-1")


@pytest.mark.parametrize("window", [0, 4, 5000])
def test_estimates_equal_pair_counts(spark, window):
    span = 60 if window < 100 else 40_000
    rows = random_flows(window, 150, span=span, hot=0.3)
    w = window or None
    near = (lambda a, b: True) if w is None else (lambda a, b: abs(a[10] - b[10]) <= w)
    pairs = [(a, b) for a, b in itertools.combinations(rows, 2) if near(a, b)]
    expected = {
        "CR": sum(a[8] == b[8] and a[4:8] == (b[6], b[7], b[4], b[5]) for a, b in pairs),
        "PR": sum(near(a, b) and a[6] == b[4] for a in rows for b in rows),
        "DHR": sum(a[4] == b[4] and a[5] != b[5] for a, b in pairs),
        "SHR": sum(a[4:6] == b[4:6] for a, b in pairs),
    }
    got = {r.relation_type: r.estimate for r in estimate.relation_estimate(frame(spark, rows), dict.fromkeys(PRIORITY, w)).collect()}
    assert got == expected
    with pytest.raises(estimate.TooManyEdges):
        estimate.guard(frame(spark, rows), dict.fromkeys(PRIORITY, w), ["SHR"], max_edges=0)
    assert estimate.guard(frame(spark, rows), dict.fromkeys(PRIORITY, w), ["SHR"], 0, force=True) == {"SHR": expected["SHR"]}


def test_capped_edges_equal_the_loop(spark, monkeypatch):
    rows = random_flows(5, 200, span=9000, hot=0.6)
    groups = {}
    for r in rows:
        groups.setdefault(r[4:6], []).append(r)
    expected = set()
    for members in groups.values():
        members.sort(key=lambda r: (r[10], r[0]))
        for i, a in enumerate(members):
            for b in members[i + 1 : i + 4]:
                if b[10] - a[10] <= 700:
                    expected.add((a[0], b[0], "SHR", b[10] - a[10]))
    for block in (700, 3600):
        assert got_edges(tcg.capped_shr_edges(frame(spark, rows), 3, 700, block)) == expected
        for rank_rows in (4, 7, 65_536):
            monkeypatch.setattr(tcg, "RANK_ROWS", rank_rows)
            assert got_edges(tcg.capped_shr_edges(frame(spark, rows), 3, 700, block, dense_rows=10)) == expected
    unlimited = got_edges(tcg.capped_shr_edges(frame(spark, rows), 3, 0))
    assert len(unlimited) > len(expected) and got_edges(tcg.capped_shr_edges(frame(spark, rows), 3, 0, dense_rows=10)) == unlimited
    both = got_edges(tcg.capped_edges(frame(spark, rows), 3, 700, 700))
    assert {e for e in both if e[2] == "SHR"} == expected
    assert len({e[:2] for e in both}) == len(both)


def test_joins_are_equi_joins(spark):
    plan = tcg.edges(frame(spark, random_flows(1, 50)), {"CR": 5, "PR": 2, "DHR": 3, "SHR": 7}, cell_rows=2)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    edges = tcg.edges(frame(spark, random_flows(1, 50)), {"CR": 5, "PR": 2, "DHR": 3, "SHR": 7})
    text = subgraph.top_predecessors(edges, 2)._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_endpoint_graph_details(spark):
    a, b = ("10.0.0.1", 1), ("8.8.8.8", 53)
    rows = [flow(1, a, b, 0, 6, "x", 2.0), flow(2, a, b, 50, 17, "y", 4.0), flow(3, a, b, 20, 17, "", 6.0), flow(4, a, b, 30, 6, "x", 0.0)]
    edge = hcg.edges(frame(spark, rows)).first()
    assert (edge.first_seen_epoch, edge.last_seen_epoch, edge.flow_count) == (20, 50, 4)
    assert (edge.major_protocol, edge.protocol_set, edge.protocol_name_set, edge.major_protocol_name) == (17, "6,17", "x,y", "x")
    assert edge.avg_duration == 3.0 and edge.protocol_entropy == 1.0
    assert math.isclose(edge.l7_protocol_entropy, -(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3)))
    unknown = hcg.edges(frame(spark, [flow(1, a, b, 0, 6, "")])).first()
    assert (unknown.first_seen_epoch, unknown.first_seen, unknown.major_protocol_name, unknown.l7_protocol_entropy) == (0, "", "", 0.0)
    hosts = {r.endpoint_id: r for r in hcg.endpoints(frame(spark, rows)).collect()}
    assert hosts["10.0.0.1:1"].is_private_ip and not hosts["8.8.8.8:53"].is_private_ip
    assert hosts["8.8.8.8:53"].is_common_service_port


def test_degree_percentiles_are_nearest_rank(spark):
    values = [random.Random(3).randrange(30) for _ in range(137)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v long")
    row = subgraph.nearest_rank_summary(df, "v", ["g"]).first()
    ordered = sorted(values)
    for p in (50, 90, 95, 99):
        assert row[f"p{p}"] == ordered[min(int(137 * p / 100), 136)]
    assert (row["count"], row["min"], row["max"]) == (137, ordered[0], ordered[-1])


def test_adjacency_pieces_hold_every_edge_once(spark):
    edges = [("hub", f"n{i:03d}", 1.0 + i % 3) for i in range(100)] + [("a", "b", 2.0)]
    weighted = subgraph.weighted_edges(spark.createDataFrame(edges, "s string, d string, w double"), "s", "d", "w", "none")
    pieces = subgraph.adjacency(weighted, chunk_rows=10).collect()
    seen = Counter((p.cur, n.dst) for p in pieces for n in p.nbrs)
    assert seen == Counter((s, d) for s, d, _ in edges)
    assert max(len(p.nbrs) for p in pieces) < 40
    for p in pieces:
        assert p.total == sum(n.w for n in p.nbrs) == p.nbrs[-1].upto
    assert weighted.select(F.sum("w")).first()[0] == sum(int(w * 1_000_000) for *_, w in edges)


def test_sketch_finds_every_crowded_bucket(spark, monkeypatch):
    """Whatever collides in the sketch, crowded buckets are counted exactly."""
    rows = random_flows(3, 300, span=400, hot=0.7)
    windows = {"CR": 50, "PR": 50, "DHR": 50, "SHR": 50}
    want = got_edges(tcg.edges(frame(spark, rows), windows, cell_rows=10**6))
    for least, most in ((4, 4), (64, 64), (4096, 4096)):
        monkeypatch.setattr(tcg, "SKETCH_LEAST", least)
        monkeypatch.setattr(tcg, "SKETCH_MOST", most)
        bands = tcg._bands(list(PRIORITY), windows)
        tcg._find_hot_cells(frame(spark, rows), bands, 5)
        by_host = {}
        for r in rows:
            by_host.setdefault((r[4], r[10] // 50), []).append(r)
        (dhr,) = [b for b in bands if b.name == "DHR"]
        # A bucket's own flows on one side, those and the ones of the bucket before on the other.
        sizes = {(h, t): (len(m) + len(by_host.get((h, t - 1), [])), len(m)) for (h, t), m in by_host.items()}
        crowded = {key: (-(-a // 5), -(-b // 5)) for key, (a, b) in sizes.items() if max(a, b) > 5 and min(a, b) > 0}
        assert {(r["k0"], r["bucket"]): (r["na"], r["nb"]) for r in dhr.hot.collect()} == crowded
        assert got_edges(tcg.edges(frame(spark, rows), windows, cell_rows=5)) == want


def test_sketch_sends_bits_to_the_driver(spark, monkeypatch):
    """However many counters are in use, the driver gets a bit for each, and no table of counts."""
    flows = frame(spark, random_flows(4, 60, span=4000, hot=0.3))

    def refused(self):
        raise AssertionError("counts sent to the driver")

    monkeypatch.setattr(type(flows), "toPandas", refused)
    bands = tcg._bands(["SHR"], {"CR": 50, "PR": 50, "DHR": 50, "SHR": 50})
    monkeypatch.setattr(tcg, "SKETCH_LEAST", 1 << 16)
    tcg._find_hot_cells(flows, bands, 1)
    bits = tcg._sketch(flows, bands, 1 << 16, 1)
    assert any(bits) and len(bits) == tcg.SKETCH_ROWS * (1 << 16) // 8
