import datetime

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from peerscope.functions.ip import int_to_ip, ip_to_int, is_ipv4, pad_ip
from peerscope.operators import enrich
from peerscope.sources import loaders, sinks
from peerscope.sources.views import view

RANGES = [(10, 19, "a_b"), (30, 30, "single"), (100, 299, "wide, inc"), (4294967290, 4294967295, "last")]


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_address_forms(spark):
    frame = spark.createDataFrame([("0.0.0.0",), ("255.255.255.255",), ("8.34.208.1",), ("fe80::1",), ("",), (None,), ("1.2.3",), ("1.2.3.256",), ("1.2.3.4.",)], "ip string")
    found = {r[0]: tuple(r[1:]) for r in frame.select("ip", ip_to_int(F.col("ip")), pad_ip(F.col("ip")), int_to_ip(ip_to_int(F.col("ip"))), is_ipv4(F.col("ip"))).collect()}
    assert found["0.0.0.0"] == (0, "000.000.000.000", "0.0.0.0", True)
    assert found["255.255.255.255"] == (4294967295, "255.255.255.255", "255.255.255.255", True)
    assert found["8.34.208.1"] == (136499201, "008.034.208.001", "8.34.208.1", True)
    for bad in ("fe80::1", "", None, "1.2.3", "1.2.3.256", "1.2.3.4."):
        assert found[bad] == (None, None, None, False)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_interval_edges(spark, how):
    ranges = spark.createDataFrame(RANGES, "ip_start bigint, ip_end bigint, as_name string")
    probes = [9, 10, 15, 19, 20, 29, 30, 31, 99, 100, 299, 300, 4294967295, None]
    probe = spark.createDataFrame([(x,) for x in probes], "ip bigint")
    want = {x: next((n for a, b, n in RANGES if x is not None and a <= x <= b), None) for x in probes}
    got = dict(enrich.interval_join(probe, ranges, "ip", how).select("ip", "as_name").collect())
    assert got == {k: v for k, v in want.items() if how == "left" or v}
    assert rows(enrich.interval_join_between(probe, ranges, "ip", how).select("ip", "as_name")) == rows(enrich.interval_join(probe, ranges, "ip", how).select("ip", "as_name"))


def test_interval_join_equals_between_on_fixture(spark):
    flows, ranges = view(spark, DATA, "flows").select("intipto"), view(spark, DATA, "as_ranges")
    a = enrich.counted(enrich.interval_join(flows, ranges, "intipto"), "as_name")
    b = enrich.counted(enrich.interval_join_between(flows, ranges, "intipto"), "as_name")
    assert rows(a) == rows(b)


def test_interval_blow_up_is_bounded(spark):
    ranges = spark.createDataFrame([(k * 1000, k * 1000 + 5, "x") for k in range(1000)] + [(1 << 31, (1 << 32) - 1, "y")], "ip_start bigint, ip_end bigint, as_name string")
    _, cut, _ = enrich.bucket_bits(ranges)
    assert cut <= enrich.BLOW_UP * 1001
    assert enrich.bucket_bits(ranges.limit(0))[1] == 0
    assert enrich.interval_join(spark.createDataFrame([(5,)], "ip bigint"), ranges.limit(0), "ip").select("as_name").first()[0] is None


def test_overlapping_ranges_are_refused(spark):
    good = spark.createDataFrame(RANGES, "ip_start bigint, ip_end bigint, as_name string")
    assert loaders.checked_ranges(good) is good
    for extra in [(19, 25, "x"), (0, 4294967295, "x"), (50, 40, "x")]:
        with pytest.raises(ValueError):
            loaders.checked_ranges(spark.createDataFrame([*RANGES, extra], good.schema))


def test_server_classes(spark):
    flows = spark.createDataFrame([(1, 2), (1, 9), (9, 2), (9, 8), (None, 2)], "intipfrom bigint, intipto bigint")
    servers = spark.createDataFrame([(1,), (2,), (2,), (None,)], "intip bigint")
    got = {(r.intipfrom, r.intipto): r.server_class for r in enrich.classified(flows, servers).collect()}
    assert got == {(1, 2): "DARK", (1, 9): "TX_SRV", (9, 2): "RX_SRV", (9, 8): "UNK_S2S", (None, 2): "RX_SRV"}


def test_pair_text(spark):
    frame = spark.createDataFrame([("a", "b"), (None, "b"), (None, None)], "a string, b string")
    assert [r[0] for r in frame.select(enrich.pair_text(F.col("a"), F.col("b"))).collect()] == ["a b", "null b", "null null"]


def test_loaders(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    flows = loaders.read_flows(spark, put("flows", "8.34.208.1 136499201 10.0.0.5 167772165 6 1024 443 1500 2024-01-15\nfe80::1 0 10.0.0.5 167772165 6 1 2 3 2024-01-15\n"))
    assert rows(flows) == [("8.34.208.1", 136499201, "10.0.0.5", 167772165, 6, 1024, 443, 1500, datetime.date(2024, 1, 15))]
    assert rows(loaders.read_as_ranges(spark, put("as", '136499200,136499455,"AS64512 Ex_ample, Inc"\n'))) == [(136499200, 136499455, "AS64512 Ex_ample, Inc")]
    put("GeoIPASNum2_01.csv", '1,2,"a"\n')
    put("GeoIPASNum2_12.csv", '1,2,"b"\n')
    assert rows(loaders.read_monthly_as_ranges(spark, str(tmp_path))) == [(1, 2, 1, "a"), (1, 2, 12, "b")]
    assert rows(loaders.read_country_ranges(spark, put("c", '"8.34.208.0","8.34.208.255","136499200","136499455","XA","Exampleland"\n'))) == [(136499200, 136499455, "XA", "Exampleland")]
    assert rows(loaders.read_locations(spark, put("l", '1,"XA","Example City","x"\n'))) == [(1, "XA", "Example City")]
    assert rows(loaders.read_dns(spark, put("d", "8.34.208.1,host1.example\n8.34.208.2,\n8.34.208.3,a,b\nx,y\n"))) == [("8.34.208.1", 136499201, "host1.example")]
    assert rows(loaders.read_servers(spark, put("s", "8.34.208.1 srv1\n8.34.208.2\n"))) == [("8.34.208.1", 136499201, "srv1"), ("8.34.208.2", 136499202, None)]


def test_sorted_load_and_tsv(spark, tmp_path):
    names = view(spark, DATA, "dns").select("intip", "dnsname")
    loaders.load_sorted(names, str(tmp_path / "dns"), "intip")
    back = spark.read.parquet(str(tmp_path / "dns"))
    assert rows(back) == rows(names)
    sinks.write_tsv(names, str(tmp_path / "tsv"), "gzip")
    assert rows(spark.read.schema("intip bigint, dnsname string").option("sep", "\t").csv(str(tmp_path / "tsv"))) == rows(names)


def test_partition_overwrite_is_dynamic(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_partitioned(spark.createDataFrame([(1, 1), (2, 2)], "x int, part int"), path)
    sinks.write_partitioned(spark.createDataFrame([(9, 2)], "x int, part int"), path)
    assert rows(spark.read.parquet(path).select("x", "part")) == [(1, 1), (9, 2)]


def test_whole_ranges_are_exploded(spark):
    rows = [(3, 3, "one"), (10, 57, "wide"), (64, 127, "whole pieces"), (130, 129, "none"), (4294967290, 4294967295, "last"), (None, 5, "null")]
    frame = spark.createDataFrame(rows, "ip_start long, ip_end long, name string")
    want = sorted((ip, name) for a, b, name in rows if a is not None for ip in range(a, b + 1))
    for piece in (16, 1 << 16):
        assert sorted((r.ip, r.name) for r in enrich.exploded(frame.where("ip_end < 1000 or ip_start > 1000"), piece).select("ip", "name").collect()) == want


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    names = spark.createDataFrame([(1, "x" * 1000), (2, None)], "intip bigint, dnsname string")
    assert 2000 < enrich.measured(names) < 3000 and enrich.measured(names.limit(0)) == 0
    plan = lambda: sinks.explained(enrich.sized(names).join(names, "intip"), "simple")
    assert "Broadcast" in plan()
    monkeypatch.setattr(enrich, "BROADCAST_BYTES", 1000)
    assert "ResolvedHint" not in enrich.sized(names)._jdf.queryExecution().logical().toString()


def test_names_joined_part_by_part(spark):
    counts = spark.createDataFrame([(1, 10, 5), (2, 10, 7), (2, 11, 1)], "cell bigint, intipto bigint, n bigint")
    names = spark.createDataFrame([(10, "a"), (11, "b"), (12, "c")], "intip bigint, dnsname string")
    members = spark.createDataFrame([(1, 10), (2, 10)], "cell bigint, intip bigint")
    assert rows(enrich.partition_join(counts, names, members, "cell", "intipto")) == [(1, 10, 5, "a"), (2, 10, 7, "a"), (2, 11, 1, None)]


def test_staging_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from peerscope import staging

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(SimpleNamespace(conf={}, sparkContext=context))
