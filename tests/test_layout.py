import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peerscope.operators import knn, layout
from peerscope.operators.kdtree import KdTree, nearest
from peerscope.plans.queries import BOX, TREE
from peerscope.sources.sinks import explained
from peerscope.sources.views import view

points_of = st.lists(st.tuples(*[st.integers(0, 12)] * 3), min_size=1, max_size=80).map(lambda x: np.array(x, float))


def walk(tree, point):
    node = 1
    while node in tree.splits:
        dim, value = tree.splits[node]
        node = 2 * node if point[dim] > value else 2 * node + 1
    return node


@settings(max_examples=60, deadline=None)
@given(points_of, st.integers(2, 9))
def test_tree_routes_and_survives_its_text_forms(points, capacity):
    tree = KdTree.build(points, capacity)
    leaves = tree.route(points)
    assert leaves.tolist() == [walk(tree, p) for p in points]
    assert set(leaves.tolist()) <= set(tree.leaves()) and all(map(tree.is_leaf, tree.leaves()))
    for again in (KdTree.from_text(tree.to_text()), KdTree.from_json(tree.to_json())):
        assert again.splits == tree.splits and again.route(points).tolist() == leaves.tolist()
    for leaf in set(leaves.tolist()):
        own = points[leaves == leaf]
        assert len(own) < capacity or (own == own[0]).all()
        for dim, (low, high) in enumerate(tree.bounds(leaf)):
            assert ((own[:, dim] > low) | (low < 1e-300)).all() and (own[:, dim] <= high).all()


@settings(max_examples=60, deadline=None)
@given(points_of, st.integers(2, 9), st.tuples(*[st.integers(-1, 13)] * 6))
def test_boxes_lose_no_point(points, capacity, edges):
    tree = KdTree.build(points, capacity)
    low, high = np.minimum(edges[:3], edges[3:]), np.maximum(edges[:3], edges[3:])
    inside = ((points >= low) & (points <= high)).all(axis=1)
    assert set(tree.route(points)[inside].tolist()) <= set(tree.boxed(list(low), list(high)))


def test_equal_points_never_split():
    assert KdTree.build(np.ones((50, 3)), 4).leaves() == [1]


def test_split_rule():
    # both extents are 4: the first dimension wins; the median is the maximum, so the minimum splits
    tree = KdTree.build(np.array([[0.0, 0.0], [4.0, 1.0], [4.0, 2.0], [4.0, 4.0]]), 4)
    assert tree.splits[1] == (0, 0.0)


def test_conditions_equal_function(spark):
    flows = view(spark, DATA, "flows")
    tree = layout.build_tree(flows, 400)
    both = flows.select(layout.leaf_condition(tree, layout.TREE_COLUMNS).alias("a"), layout.leaf_function(tree, layout.TREE_COLUMNS).alias("b"))
    assert both.where("a <> b").isEmpty()
    assert both.select("a").distinct().count() == len(tree.leaves())


def test_large_tree_is_a_function(spark):
    flows = view(spark, DATA, "flows")
    tree = layout.build_tree(flows, 40)
    assert len(tree.splits) >= layout.CONDITION_LEAVES
    assert layout.with_leaf(flows, tree).select("part").distinct().count() <= len(tree.leaves())


def test_pruned_scan_reads_few_folders_and_loses_nothing(spark, tmp_path):
    flows = view(spark, DATA, "flows")
    layout.write_layout(flows, str(tmp_path / "t"), TREE)
    table = spark.read.parquet(str(tmp_path / "t"))
    pruned = layout.prune(table, TREE, BOX)
    assert pruned.count() == flows.where(BOX.condition()).count() > 0
    assert "part#" in explained(pruned).split("PartitionFilters")[1].split("\n")[0]
    assert len(TREE.boxed(*BOX.limits(layout.TREE_COLUMNS))) < len(TREE.leaves())
    nowhere = layout.Box({"intipfrom": 5}, {"intipfrom": 4})
    assert layout.prune(table, TREE, nowhere).count() == 0
    assert layout.predicate_text(TREE, BOX).startswith("WHERE part='")


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "America/New_York", "Pacific/Kiritimati"])
def test_boxes_of_days_lose_no_row_in_any_zone(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        flows = view(spark, DATA, "flows")
        tree = layout.build_tree(flows, 300)
        layout.write_layout(flows, str(tmp_path / "t"), tree)
        table = spark.read.parquet(str(tmp_path / "t"))
        edges = [v for d, v in tree.splits.values() if d == 2][:6]
        assert edges and all(v % layout.DAY == 0 for v in edges)
        for value in edges:
            day = str(np.datetime64(int(value // layout.DAY), "D"))
            box = layout.Box({"flow_date": day}, {"flow_date": day})
            assert layout.prune(table, tree, box).count() == flows.where(box.condition()).count() > 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_the_week_opens_few_folders(spark):
    from peerscope.plans.queries import dns_ingoing_week, kd_pruned_scan, laid_out, sorted_names

    filters = explained(dns_ingoing_week(spark, DATA)).split("PartitionFilters: [")[1].split("]")[0]
    assert "part#" in filters and "IN" in filters
    assert "part#" in explained(kd_pruned_scan(spark, DATA)).split("PartitionFilters")[1].split("\n")[0]
    assert laid_out(spark, DATA, TREE, "layout").inputFiles()[0] == laid_out(spark, DATA, TREE, "layout").inputFiles()[0]
    names = sorted_names(spark, DATA).where("intip between 5 and 10")
    assert "GreaterThanOrEqual(intip,5)" in explained(names).split("PushedFilters")[1].split("\n")[0]


def test_sorted_loads_prune_files(spark, tmp_path):
    """Each file of a dimension in key order holds a range of its own, which the footer's bounds show."""
    import pyarrow.parquet as pq

    from peerscope.sources.loaders import load_sorted

    load_sorted(view(spark, DATA, "dns").select("intip", "dnsname").repartition(3), str(tmp_path / "dns"), "intip")
    bounds = sorted((x.min, x.max) for f in (tmp_path / "dns").glob("*.parquet") if (m := pq.read_metadata(f)).num_rows for x in [m.row_group(0).column(0).statistics])
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:])) and bounds


def test_even_grid_is_arithmetic(spark):
    points = layout.even_points()
    ips = sorted({0, 1, (1 << 32) - 1, *points, *(p + 1 for p in points), *(p - 1 for p in points)})
    frame = spark.createDataFrame([(x,) for x in ips], "ip bigint")
    got = frame.select(layout.grid_index(F.col("ip")).alias("a"), layout.grid_index(F.col("ip"), points).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_grid_edges(spark):
    flows = spark.createDataFrame([(10, 20), (20, 10), (11, 25), (9, 9), (21, 21)], "intipfrom bigint, intipto bigint")
    got = [r.cell for r in layout.with_cell(flows, [10, 20]).collect()]
    # an address equal to a point belongs to the part that ends there; the last part has no end
    assert got == [0 * 3 + 1, 0 * 3 + 1, 1 * 3 + 2, 0, 2 * 3 + 2]


def test_samples_are_bounded_and_alike(spark):
    flows = view(spark, DATA, "flows")
    a, b = (layout.sampled_points(x, layout.TREE_COLUMNS, 500) for x in (flows, flows.repartition(7)))
    assert np.array_equal(a, b) and 250 < len(a) < 1000
    assert 0 < layout.sampled(flows, 0.05).count() < flows.count() / 10


def test_address_box():
    box = layout.address_box(("0.0.0.1", "0.0.1.0"), None, ("2024-01-01", "2024-01-02"))
    assert box.low == {"intipfrom": 1, "flow_date": "2024-01-01"} and box.high["intipfrom"] == 256


@pytest.mark.parametrize("blocks", [3, 7, 2048])
def test_nearest_neighbours(spark, monkeypatch, blocks):
    monkeypatch.setattr(knn, "BLOCK_QUERIES", blocks)
    monkeypatch.setattr(knn, "PASS_BLOCKS", 2)
    random = np.random.default_rng(2)
    vectors = random.integers(0, 4, (120, 3)).astype(float)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(500, None)], "vec_id long, embedding array<double>").repartition(3)
    got = knn.nearest_neighbours(frame, frame.where("vec_id % 6 = 0"), 4).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour_id"))).alias("x")).collect()
    assert len(got) == 20
    for row in got:
        want = [int(k) for k in nearest(vectors, vectors[row.query_id], 120) if k != row.query_id][:4]
        assert [x.neighbour_id for x in row.x] == want
    assert knn.nearest_neighbours(frame, frame.limit(0), 4).count() == 0
