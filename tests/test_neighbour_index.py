"""The inverted-list index against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import knn
from flowloom.operators import neighbour_index as ni
from flowloom.session import in_steps


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(11)
    centre = rng.normal(size=(12, 8)) * 4
    # A third of all rows crowds around one centre; some rows are equal.
    of = np.where(np.arange(900) % 3 == 0, 0, rng.integers(0, 12, 900))
    v = np.round(centre[of] + rng.normal(size=(900, 8)), 2)
    v[10:20] = v[10]
    return {f"p{i:04d}": x for i, x in enumerate(v)}


def plain(points, names, k, cosine):
    ids = sorted(points)
    table = np.stack([points[i] for i in ids])
    out = {}
    for n in names:
        a = points[n]
        if cosine:
            value = np.round(-(table @ a) / np.linalg.norm(table, axis=1) / np.linalg.norm(a), 6)
        else:
            value = np.round(((table - a) ** 2).sum(1), 6)
        near = sorted((x, i) for x, i in zip(value, ids) if i != n)[:k]
        out[n] = [(i, x) for x, i in near]
    return out


@pytest.mark.parametrize("cosine", [False, True])
@pytest.mark.parametrize("part_rows", [40, 4096])
def test_all_lists_are_exact_and_few_lists_reach_the_recall(spark, points, cosine, part_rows):
    table = spark.createDataFrame([(i, v.tolist()) for i, v in points.items()] + [(None, [0.0] * 8), ("none", None)], "id string, v array<double>").repartition(4)
    index = ni.build(table, cosine, part_rows=part_rows)
    assert index.rows.count() == 900 and len(index.centres) == 30
    assert max(r["count"] for r in index.rows.groupBy("list", "part").count().collect()) < 3 * part_rows
    queries = table.filter(F.substring("id", 2, 4).try_cast("int") % 50 == 0)
    got = ni.exact_search(index, queries, 5).collect()
    want = plain(points, [f"p{i:04d}" for i in range(0, 900, 50)], 5, cosine)
    for n, near in want.items():
        mine = sorted((r["value"], r["id"]) for r in got if r["query_id"] == n)
        assert [x for x, _ in mine] == pytest.approx([x for _, x in near], abs=2e-6) and len({i for _, i in mine} & {i for i, _ in near}) >= 4
    lists, share = ni.tuned(index, queries, 5)
    assert share >= 0.9 and lists < 30
    found = ni.search(index, queries, 5, lists).collect()
    hits = sum(len({r["id"] for r in found if r["query_id"] == n} & {i for i, _ in near}) for n, near in want.items())
    assert hits / (5 * len(want)) >= 0.85  # equal rows may stand for one another


def test_block_rows(spark, points):
    table = spark.createDataFrame([(i, v.tolist()) for i, v in points.items()], "id string, v array<double>")
    index = ni.build(table, lists=5, part_rows=100)
    one = {(r["query_id"], r["id"], r["value"]) for r in ni.search(index, table, 3, 2).collect()}
    assert one == {(r["query_id"], r["id"], r["value"]) for r in ni.search(index, table, 3, 2, block_rows=37).collect()}
    assert len(one) == 2700


def test_vote_through_the_index(spark, points):
    """Classes of well parted groups are found, as with the exact search."""
    rows = [(i, v.tolist(), "left" if v[0] < 0 else "right") for i, v in points.items()]
    train = spark.createDataFrame([r for r in rows if int(r[0][1:]) % 5], "id string, v array<double>, label string")
    queries = spark.createDataFrame([r[:2] for r in rows if int(r[0][1:]) % 5 == 0], "id string, v array<double>")
    exact = {r["query_id"]: r["prediction"] for r in knn.predict(train, queries, 5).collect()}
    fast = {r["query_id"]: r["prediction"] for r in knn.predict_indexed(train, queries, 5, measured=queries).collect()}
    assert set(fast) == set(exact) and np.mean([fast[q] == exact[q] for q in exact]) > 0.95


def test_empty(spark):
    empty = spark.createDataFrame([], "id string, v array<double>")
    index = ni.build(empty)
    assert ni.search(index, empty, 3, 1).count() == 0 and ni.tuned(index, empty, 3) == (1, 1.0)
    one = spark.createDataFrame([("a", [1.0, 2.0])], "id string, v array<double>")
    assert ni.search(ni.build(one), one, 3, 1).count() == 0


@pytest.mark.parametrize("cosine", [False, True])
def test_search_in_steps(spark, monkeypatch, cosine):
    """Few visits at a time give the same neighbours, and no more of them are ever laid out at once."""
    rng = np.random.default_rng(6)
    rows = [(f"r{i:03d}", [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    table = spark.createDataFrame(rows, "id string, v array<double>")
    index = ni.build(table, cosine=cosine, lists=6)
    want = sorted(map(tuple, ni.search(index, table, 3, 4).collect()))
    exact = sorted(map(tuple, ni.exact_search(index, table, 3).collect()))
    steps = []
    monkeypatch.setattr(ni, "MOST_VISITS", 200)
    monkeypatch.setattr(ni, "in_steps", lambda slices, step, width: steps.append((slices, width)) or in_steps(slices, step, width))
    assert sorted(map(tuple, ni.search(index, table, 3, 4).collect())) == want
    assert steps == [(3, 1)]
    assert sorted(map(tuple, ni.exact_search(index, table, 3).collect())) == exact
    points = np.array([v for _, v in rows])
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    value = np.round(-unit @ unit.T if cosine else ((points[:, None] - points[None]) ** 2).sum(2), 6)
    np.fill_diagonal(value, np.inf)
    assert {(a, b) for a, b, _ in exact} == {(rows[i][0], rows[j][0]) for i in range(120) for j in np.argsort(value[i], kind="stable")[:3]}
