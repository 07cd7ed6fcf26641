import time

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from peerscope.operators import layout
from peerscope.operators.kdtree import KdTree
from peerscope.sources.views import view
from peerscope.streaming import ingest


def wait(done, seconds=20.0):
    until = time.time() + seconds
    while not done() and time.time() < until:
        time.sleep(0.2)


def rows(frame):
    return sorted(map(repr, frame.collect()))


def table_of(spark, path, **more):
    return ingest.LeafTable(spark, f"file://{path}", KdTree(3, 500), **more)


def test_batches_equal_one_batch_and_splits_keep_every_row(spark, tmp_path):
    flows = view(spark, DATA, "flows")
    table = table_of(spark, tmp_path / "t", split_rows=700)
    for k in range(3):
        table.append(flows.where(f"srcport % 3 = {k}"), k)
    now = table.manifest()
    assert now.batch == 2 and len(now.tree.leaves()) > 4 and max(now.rows.values()) < 700
    assert rows(table.read().drop("part").select(flows.columns)) == rows(flows)
    routed = layout.with_leaf(flows, now.tree).groupBy("part").count()
    assert {r["part"]: r["count"] for r in routed.collect()} == now.rows
    box = layout.Box({"intipto": 1 << 31}, {"flow_date": "1998-01-01"})
    assert rows(table.read(box).select(flows.columns)) == rows(flows.where(box.condition()))


def test_mapping_and_dropped_leaf(spark, tmp_path):
    flows = view(spark, DATA, "flows")
    table = table_of(spark, tmp_path / "t", split_rows=2000)
    table.append(flows, 0)
    leaf, rows_, folders = table.mapping()[0]
    assert sum(x[1] for x in table.mapping()) == flows.count() and folders
    table.drop(leaf)
    table.drop(10**9)
    assert table.read().count() == flows.count() - rows_ and leaf not in [x[0] for x in table.mapping()]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    flows = view(spark, DATA, "flows").limit(50)
    table = table_of(spark, tmp_path / "t")
    table.append(flows, 0)
    table.append(flows, 0)
    assert table.read().count() == 50 and table.manifest().version == 1


def test_equal_points_do_not_split(spark, tmp_path):
    flows = spark.createDataFrame([(1, 2, "2024-01-01")] * 30, "intipfrom bigint, intipto bigint, d string").selectExpr("intipfrom", "intipto", "cast(d as date) as flow_date")
    table = table_of(spark, tmp_path / "t", split_rows=10)
    table.append(flows, 0)
    assert table.manifest().rows == {1: 30} and table.read().count() == 30


def test_empty_table_and_empty_batch(spark, tmp_path):
    table = table_of(spark, tmp_path / "t")
    assert table.read() is None
    table.append(view(spark, DATA, "flows").limit(0), 0)
    assert table.read() is None and table.manifest().batch == 0


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    flows = view(spark, DATA, "flows").limit(300).cache()
    ingest.replay_files(flows, str(tmp_path / "in"), 3)
    (tmp_path / "in" / "junk.txt").write_text("not a flow\nfe80::1 1 2\n")
    table = table_of(spark, tmp_path / "t")
    meter = ingest.Throughput()
    spark.streams.addListener(meter)
    for expected in (300, 300):  # the second run finds nothing new
        source = ingest.parsed(spark.readStream.option("maxFilesPerTrigger", 2).text(str(tmp_path / "in")))
        ingest.drained(table.start(source, str(tmp_path / "checkpoint")))
        assert table.read().count() == expected
    assert table.manifest().version == 2
    assert rows(table.read().select(flows.columns)) == rows(flows)
    wait(lambda: sum(x[1] for x in meter.batches) >= 302)
    assert sum(x[1] for x in meter.batches) == 302 and all(x[2] > 0 for x in meter.batches if x[1])  # the lines that are no flows count as read
    spark.streams.removeListener(meter)
    flows.unpersist()


def test_ingest_that_writes_nothing_shows(spark, monkeypatch):
    from peerscope.plans.queries import QUERIES

    monkeypatch.setattr(ingest.LeafTable, "append", lambda self, batch, batch_id: None)
    assert QUERIES["stream_leaf_counts"](spark, DATA).count() == 0
    assert QUERIES["stream_split_totals"](spark, DATA).count() == 0


def test_leaves_in_many_folders_are_joined_and_old_versions_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "MOST_FOLDERS", 3)
    monkeypatch.setattr(ingest, "VERSIONS", 4)
    flows = view(spark, DATA, "flows").limit(800).cache()
    table = table_of(spark, tmp_path / "t", split_rows=300)
    for k in range(9):
        table.append(flows.where(f"srcport % 9 = {k}"), k)
        assert max(len(x) for x in table.manifest().folders.values()) <= 3
    assert rows(table.read().select(flows.columns)) == rows(flows)
    table.expire(1)
    assert rows(table.read().select(flows.columns)) == rows(flows)
    assert len(list((tmp_path / "t/manifest").glob("v*"))) == 1
    held = {(x, leaf) for leaf, own in table.manifest().folders.items() for x in own}
    for kind in ("data", "sample"):
        found = {(p.parent.name, int(p.name[5:])) for p in (tmp_path / "t" / kind).glob("*/part=*")}
        assert found <= held and (kind == "sample" or found == held)
    flows.unpersist()


def test_two_writers_of_one_version(spark, tmp_path):
    table, other = (table_of(spark, tmp_path / "t") for _ in range(2))
    now = other.manifest()
    table.append(view(spark, DATA, "flows").limit(10), 0)
    now.version += 1
    with pytest.raises(RuntimeError):
        other.publish(now)


def test_late_events_are_left_out_and_hours_close_once(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, event_type string, value double"
    batches = [
        [(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 03:30:00", "a", 1.0)],
        [(3, "2024-01-01 00:20:00", "a", 1.0), (4, "2024-01-01 03:10:00", "a", 2.0), (5, "2024-01-01 09:00:00", "b", 1.0)],
    ]
    out = str(tmp_path / "out")
    for batch in batches:  # a run per file, so that the watermark of one holds in the next
        spark.createDataFrame(batch, "event_id int, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        sink = ingest.hourly(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
        ingest.drained(sink.outputMode("append").trigger(availableNow=True).start())
    got = sorted((str(r.hour), r.event_type, r.n, r.total) for r in spark.read.parquet(out).collect())
    # the event of 00:20 came when that hour was closed; 09:00 is still open
    assert got == [("2024-01-01 00:00:00", "a", 1, 1.0), ("2024-01-01 03:00:00", "a", 2, 3.0)]


def test_load_generator_and_meter(spark, tmp_path):
    meter = ingest.Throughput()
    spark.streams.addListener(meter)
    table = table_of(spark, tmp_path / "t")
    query = table.start(ingest.generated_flows(spark, 500), str(tmp_path / "c"), processingTime="1 second")
    wait(lambda: sum(x[1] for x in meter.batches) >= 1000, 40)
    query.stop()
    spark.streams.removeListener(meter)
    found = table.read()
    assert found.count() >= 1000 and found.where("ipfrom is null or intipto < 0").isEmpty()
    assert sum(x[1] for x in meter.batches) >= 1000 and max(x[2] for x in meter.batches) > 100
