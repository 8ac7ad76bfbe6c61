from __future__ import annotations

import ipaddress
import math

from pyspark.sql import functions as F

from flowloom.functions import net, text
from flowloom.sources import flows as sources
from flowloom.sources import tables


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_numbers_follow_python(spark):
    values = ["12", "12.9", "-3.7", "1e3", "", None, "x", "nan", "inf", "1d", "2f", "0x10", " 7 ", "+5"]

    def expected(value):
        try:
            return int(float(value))
        except (TypeError, ValueError, OverflowError):
            return 0

    rows = column(spark, values).select(
        "v", text.parse_int(F.col("v")).alias("i"), text.parse_float(F.col("v")).alias("f"), text.finite_number(F.col("v")).alias("n")
    )
    for row in rows.collect():
        assert row.i == expected(row.v), row
        assert row.n is not None and math.isfinite(row.n), row
    by_text = {row.v: row.f for row in rows.collect()}
    assert math.isnan(by_text["nan"]) and by_text["inf"] == math.inf and by_text["1d"] == 0.0


def test_timestamps(spark):
    iso, epoch = text.parse_timestamp(F.col("v"))
    rows = {
        r.v: (r.iso, r.epoch)
        for r in column(spark, ["26/04/201711:11:17", "6/4/2017 01:02:03", "junk", ""])
        .select("v", iso.alias("iso"), epoch.alias("epoch"))
        .collect()
    }
    assert rows["26/04/201711:11:17"] == ("2017-04-26 11:11:17", 1493205077)
    assert rows["6/4/2017 01:02:03"] == ("2017-04-06 01:02:03", 1491440523)
    assert rows["junk"] == ("junk", 0) and rows[""] == ("", 0)


def test_private_addresses_follow_the_standard_library(spark):
    values = [
        "10.0.0.1", "172.31.255.255", "172.32.0.0", "192.0.0.9", "192.0.0.11", "192.0.0.170", "198.19.1.1", "198.20.1.1",
        "100.64.0.1", "255.255.255.255", "256.1.1.1", "01.2.3.4", "1.2.3", "", "abc", "::1", "::", "::ffff:10.0.0.1",
        "::ffff:8.8.8.8", "::ffff:a00:1", "::ffff:808:808", "64:ff9b:1::5", "64:ff9b::1", "100::1", "2001::1", "2001:1::1",
        "2001:3::9", "2001:20::1", "2001:db8::1", "2002::1", "2001:200::1", "fc00::1", "fe80::1", "fec0::1", "2606:4700::1",
        "g::1", "1:2:3", "1::2::3", "1:2:3:4:5:6:7:8:9", ":1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::",
    ]
    for row in column(spark, values).select("v", net.is_private_ip(F.col("v")).alias("p")).collect():
        try:
            expected = ipaddress.ip_address(row.v).is_private
        except ValueError:
            expected = False
        assert row.p == expected, row


def test_endpoint_parts(spark):
    rows = column(spark, ["1.2.3.4:80", "fe80::1:443", "plain", "host:x", ""]).select(
        "v", net.endpoint_ip(F.col("v")).alias("ip"), net.endpoint_port(F.col("v")).alias("port")
    )
    found = {r.v: (r.ip, r.port) for r in rows.collect()}
    assert found == {
        "1.2.3.4:80": ("1.2.3.4", 80), "fe80::1:443": ("fe80::1", 443), "plain": ("plain", 0), "host:x": ("host", 0), "": ("", 0),
    }


def test_csv_scan_keeps_file_order(spark, tmp_path):
    for part, (first, last) in enumerate([(0, 700), (700, 1500)]):
        with open(tmp_path / f"part{part}.csv", "wb") as out:
            out.write(b"src_endpoint,dst_ip,Destination.Port,Timestamp,Protocol,n\n")
            for i in range(first, last):
                out.write(b"10.0.0.1:8%d,h\xff,%d,26/04/201711:11:17,6.0,%d\n" % (i % 10, i, i))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        raw = sources.with_file_row_number(sources.read_flows_csv(spark, str(tmp_path)))
        got = raw.select("row_number", "n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.row_number, int(r.n)) for r in got) == [(i + 1, i) for i in range(1500)]
    first = sources.normalize_flows(sources.first_rows(raw, 2)).orderBy("record_id").collect()
    assert [r.record_id for r in first] == ["rec_0000000001", "rec_0000000002"]
    assert (first[1].src_ip, first[1].src_port, first[1].dst_ip, first[1].dst_port) == ("10.0.0.1", 81, "h�", 1)
    assert first[0].protocol == 6 and first[0].timestamp_epoch == 1493205077


def test_order_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = sources.with_order_row_number(df, "k", partitions=5).collect()
    assert all(r.row_number == r.k + 1 for r in rows) and len(rows) == 1000


def test_sinks_and_sources(spark, tmp_path):
    edges = spark.createDataFrame(
        [("a", "b", "CR", 1, 3, False), ("a", "c", "SHR", 4, 0, True), ("b", "c", "SHR", 4, 9, False)],
        "src_record_id string, dst_record_id string, relation_type string, relation_priority long, delta_seconds long, same_timestamp boolean",
    )
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        tables.write_edges(edges, path, chunk_size=1, fmt=fmt)
        back = tables.read_edges(spark, path).select(edges.columns)
        assert sorted(back.collect()) == sorted(edges.collect())
    tables.write_csv(edges.withColumn("gone", F.lit(None).cast("string")), str(tmp_path / "flat"), ["gone", "src_record_id"])
    assert spark.read.csv(str(tmp_path / "flat"), header=True).columns == ["gone", "src_record_id"]
    (tmp_path / "walks.txt").write_text("a  b\n\n   \nc\td e\nf\n")
    assert [r.tokens for r in tables.read_walks(spark, str(tmp_path / "walks.txt")).collect()] == [["a", "b"], ["c", "d", "e"], ["f"]]
    assert tables.read_walks(spark, str(tmp_path / "walks.txt"), max_lines=4).count() == 2
    (tmp_path / "map.csv").write_text('vid,token\n0,"a"\n1,"b"\n')
    assert tables.read_id_map(spark, str(tmp_path / "map.csv")).count() == 2
