"""Inputs that the query tables do not hold: quotes, grouped digits, one-digit times, IPv6 forms."""

from __future__ import annotations

import csv
import ipaddress
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from flowloom import session
from flowloom.functions import net, text
from flowloom.operators import checks, features, tcg
from flowloom.sources import flows as sources
from flowloom.sources import tables


def test_quoted_csv_round_trip(spark, tmp_path):
    rows = [("1", 'say "hi", ok', "plain"), ("2", "a,b", 'ends with "')]
    path = tmp_path / "in.csv"
    with path.open("w", newline="") as f:
        csv.writer(f).writerows([("id", "a", "b"), *rows])
    read = sources.read_flows_csv(spark, str(path))
    assert sorted(map(tuple, read.collect())) == rows
    tables.write_csv(read.coalesce(1), str(tmp_path / "out"), ["id", "a", "b"])
    (part,) = (tmp_path / "out").glob("part-*.csv")
    with part.open(newline="") as f:
        assert sorted(map(tuple, list(csv.reader(f))[1:])) == rows


def test_line_breaks_in_fields(spark, tmp_path):
    path = tmp_path / "in.csv"
    with path.open("w", newline="") as f:
        csv.writer(f).writerows([("id", "a"), ("1", "two\nlines"), ("2", "one")])
    read = sources.read_flows_csv(spark, str(path), multi_line=True)
    assert sorted(map(tuple, read.collect())) == [("1", "two\nlines"), ("2", "one")]


@pytest.mark.parametrize(("value", "want"), [("1_000", 1000), ("1__0", 0), ("_1", 0), ("1_", 0), ("12", 12), ("-7.9", -7), ("x", 0)])
def test_parse_int(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(text.parse_int(F.col("v"))).first()[0] == want


@pytest.mark.parametrize(("value", "moment"), [("6/4/2017 1:02:03", (2017, 4, 6, 1, 2, 3)), ("26/04/2017 1:2:3", (2017, 4, 26, 1, 2, 3)), ("26/04/201711:11:17", (2017, 4, 26, 11, 11, 17))])
def test_parse_timestamp(spark, value, moment):
    iso, epoch = text.parse_timestamp(F.col("v"))
    got = spark.createDataFrame([(value,)], "v string").select(iso, epoch).first()
    want = datetime(*moment, tzinfo=timezone.utc)
    assert tuple(got) == (want.strftime("%Y-%m-%d %H:%M:%S"), int(want.timestamp()))


def test_private_ipv6(spark):
    ips = ["2001:db8::1.2.3.4", "0:0:0:0:0:ffff:10.0.0.1", "fe80::1%eth0", "fc00::192.168.0.1", "2606:4700::1", "::ffff:8.8.8.8", "2606:4700::1.2.3.4", "::1", "10.0.0.1"]
    got = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", net.is_private_ip(F.col("ip")).alias("p")).collect()
    assert {r["ip"]: r["p"] for r in got} == {i: ipaddress.ip_address(i).is_private for i in ips}


def test_unlimited_capped_edges(spark):
    flows = spark.createDataFrame([(f"r{i}", "a", 1, 1000 * i) for i in range(4)], "record_id string, src_ip string, src_port long, timestamp_epoch long")
    assert tcg.capped_shr_edges(flows, k=2, window=0).count() == 5


def test_five_metrics_make_a_result_complete(spark):
    metrics = ", ".join(f"{m} double" for m in checks.REQUIRED_METRICS)
    results = spark.createDataFrame([("A", "m", "ok", 1.0, 1.0, 1.0, 1.0, 1.0)], f"feature_group string, model_name string, status string, {metrics}")
    assert [r["value"] for r in checks.check_results(results, ["A"], ["m"]).collect()] == [0.0]


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.shared_folder(Session())


def test_features_take_no_grouped_digits(spark):
    """A coercing column parser reads `1_000` as no number, unlike the parser of single fields."""
    raw = spark.createDataFrame([("1_000", "1_000", "nan"), ("x", "2", "-inf"), (None, "", "1e3")], "a string, b string, c string")
    got = raw.select(*[text.finite_number(F.col(c)) for c in raw.columns], text.parse_float(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0, 0.0, 1000.0), (0.0, 2.0, 0.0, 2.0), (0.0, 0.0, 1000.0, 0.0)]
    assert features.numeric_source_columns(raw) == ["b", "c"]
