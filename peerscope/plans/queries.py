"""The query catalogue as DataFrame plans. Each query takes (spark, sf_dir)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerscope.functions.ip import int_to_ip, ip_to_int, is_ipv4, pad_ip
from peerscope.operators import enrich, kdtree, knn, layout
from peerscope.operators.kdtree import KdTree
from peerscope.sources import loaders
from peerscope.sources.sinks import write_partitioned, write_tsv
from peerscope.sources.views import view
from peerscope.staging import work_folder
from peerscope.streaming import ingest

TOP = 20
WEEK = ("1998-03-02", "1998-03-08")
#: The literal tree of the layout queries: split dimension (source, target, date) and value by node id.
TREE = KdTree(3, 2, {1: (0, 2147483648.0), 2: (1, 2147483648.0), 3: (1, 1073741824.0), 4: (2, 883612800000.0), 5: (2, 915148800000.0), 6: (0, 1073741824.0), 7: (2, 852076800000.0)})
BOX = layout.Box({"intipfrom": 1200000000, "flow_date": "1998-02-01"}, {"intipfrom": 3000000000, "intipto": 2500000000, "flow_date": "1998-11-30"})
IP_RANGE = (1 << 31, (1 << 31) + (1 << 29))
NEIGHBOURS = 10


def ordered(frame: DataFrame) -> DataFrame:
    """Largest counts first; the names break ties."""
    return frame.orderBy(F.desc("n"), *(c for c in frame.columns if c != "n"))


def interval_counts(flows: DataFrame, ranges: DataFrame, ip: str, name: str, how: str = "left", keys: tuple[str, ...] = ()) -> DataFrame:
    """Flows per name of the interval that holds one end. They are counted by address first: an address is looked up once."""
    return enrich.totalled(enrich.interval_join(enrich.counted(flows, ip, *keys), ranges, ip, how, keys), name)


def interval_pair_counts(flows: DataFrame, ranges: DataFrame, how: str = "left", keys: tuple[str, ...] = ()) -> DataFrame:
    """Flows per pair of addresses with the intervals of both, counted before the joins."""
    return enrich.interval_pair_join(enrich.counted(flows, "intipfrom", "intipto", *keys), ranges, how, keys)


def as_counts(spark: SparkSession, sf_dir: str, ip: str, how: str) -> DataFrame:
    return ordered(interval_counts(view(spark, sf_dir, "flows"), view(spark, sf_dir, "as_ranges"), ip, "as_name", how))


def as_ingoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per target AS; flows without one stay, as null."""
    return as_counts(spark, sf_dir, "intipto", "left")


def as_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per source AS; flows without one stay, as null."""
    return as_counts(spark, sf_dir, "intipfrom", "left")


def as_ingoing_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per target AS; flows without one are left out."""
    return as_counts(spark, sf_dir, "intipto", "inner")


def as_pair_counts(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    pairs = interval_pair_counts(view(spark, sf_dir, "flows"), view(spark, sf_dir, "as_ranges"), how)
    return ordered(enrich.totalled(pairs, "src_as_name", "dst_as_name"))


def as_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per source and target AS; either side may be null."""
    return as_pair_counts(spark, sf_dir, "left")


def as_pairs_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per source and target AS where both are known."""
    return as_pair_counts(spark, sf_dir, "inner")


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country ranges with one name ``CODE_Name``."""
    return view(spark, sf_dir, "country_ranges").select("ip_start", "ip_end", F.concat_ws("_", "country_code", "country_name").alias("country"))


def country_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per source country; unknown ones stay, as null."""
    return ordered(interval_counts(view(spark, sf_dir, "flows"), countries(spark, sf_dir), "intipfrom", "country"))


def country_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per source and target country; either side may be null."""
    pairs = interval_pair_counts(view(spark, sf_dir, "flows"), countries(spark, sf_dir))
    return ordered(enrich.totalled(pairs, "src_country", "dst_country"))


def city_counts(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    located = interval_counts(view(spark, sf_dir, "flows"), view(spark, sf_dir, "city_blocks"), "intipfrom", "loc_id", how)
    places = view(spark, sf_dir, "locations").select("loc_id", "city")
    return ordered(enrich.totalled(located.join(places, "loc_id", how), "city"))


def city_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per source city, by block and then location; unknown ones are left out."""
    return city_counts(spark, sf_dir, "inner")


def city_outgoing_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per source city; unknown ones stay, as null."""
    return city_counts(spark, sf_dir, "left")


def dns_counts(flows: DataFrame, names: DataFrame) -> DataFrame:
    """Flows per target address and name. They are counted by the join's key, so the join needs no further shuffle of them."""
    named = enrich.name_join(enrich.counted(flows, "intipto"), names, "intipto")
    return ordered(named.select(int_to_ip(F.col("intipto")).alias("ipto"), "dnsname", "n"))


def dns_ingoing_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per target address and its name, null where it has none."""
    return dns_counts(view(spark, sf_dir, "flows"), view(spark, sf_dir, "dns"))


def dns_ingoing_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per grid cell: each cell's counts are joined with the names of the cell's own addresses."""
    flows = layout.with_cell(view(spark, sf_dir, "flows").select("intipfrom", "intipto"))
    members = layout.unique_addresses(flows, "cell")
    named = enrich.partition_join(enrich.counted(flows, "cell", "intipto"), view(spark, sf_dir, "dns"), members, "cell", "intipto")
    return ordered(enrich.totalled(named.withColumn("ipto", int_to_ip(F.col("intipto"))), "ipto", "dnsname"))


def dns_ingoing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on the table tagged with tree leaves, with the leaf's rank as an integer."""
    flows = layout.with_leaf(view(spark, sf_dir, "flows"), TREE).withColumn("part", layout.leaf_rank(F.col("part"), TREE).cast("int"))
    named = enrich.name_join(enrich.counted(flows, "part", "intipto"), view(spark, sf_dir, "dns"), "intipto")
    return ordered(named.select("part", int_to_ip(F.col("intipto")).alias("ipto"), "dnsname", "n"))


_layouts: dict[tuple, str] = {}


def laid_out(spark: SparkSession, sf_dir: str, tree: KdTree, name: str) -> DataFrame:
    """The flow table in one folder per leaf of ``tree``, laid out once in an application and read from then on.

    A table whose files have changed is laid out anew.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/lineitem.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (spark.sparkContext.applicationId, sf_dir, status.getModificationTime(), status.getLen(), tree.to_json())
    if key not in _layouts:
        target = work_folder(spark, name)
        layout.write_layout(view(spark, sf_dir, "flows"), target, tree)
        _layouts[key] = target
    return spark.read.parquet(_layouts[key])


def dns_ingoing_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for one week, from the laid-out table: folders of leaves that miss it are not opened, the date filter does the rest."""
    week = layout.Box({"flow_date": WEEK[0]}, {"flow_date": WEEK[1]})
    return dns_counts(layout.prune(laid_out(spark, sf_dir, TREE, "layout"), TREE, week), view(spark, sf_dir, "dns"))


def dns_pair_rows(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    names = view(spark, sf_dir, "dns")
    pairs = enrich.counted(view(spark, sf_dir, "flows"), "intipfrom", "intipto")
    return enrich.name_join(enrich.name_join(pairs, names, "intipfrom", how, as_name="src_name"), names, "intipto", how, as_name="dst_name")


def dns_pairs_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per source and target name where both are known."""
    return ordered(enrich.totalled(dns_pair_rows(spark, sf_dir, "inner"), "src_name", "dst_name"))


def dns_pairs_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per source and target name; either side may be null."""
    return ordered(enrich.totalled(dns_pair_rows(spark, sf_dir, "left"), "src_name", "dst_name"))


def dns_pairs_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per pair of names as one text; a missing side is the text ``null``."""
    pairs = dns_pair_rows(spark, sf_dir, "left").select(enrich.pair_text(F.col("src_name"), F.col("dst_name")).alias("names"), "n")
    return ordered(enrich.totalled(pairs, "names"))


def dns_pairs_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names as one text per tree leaf, without an order."""
    names = view(spark, sf_dir, "dns")
    pairs = enrich.counted(layout.with_leaf(view(spark, sf_dir, "flows"), TREE), "part", "intipfrom", "intipto")
    both = enrich.name_join(enrich.name_join(pairs, names, "intipfrom", as_name="a"), names, "intipto", as_name="b")
    return enrich.totalled(both.select("part", enrich.pair_text(F.col("a"), F.col("b")).alias("names"), "n"), "part", "names")


def server_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per class of known servers."""
    pairs = enrich.counted(view(spark, sf_dir, "flows"), "intipfrom", "intipto")
    return enrich.totalled(enrich.classified(pairs, view(spark, sf_dir, "servers")), "server_class")


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "flows").select("intipfrom", "intipto", F.month("flow_date").alias("mon"))


def as_ingoing_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per target AS as it was named in the flow's month."""
    return ordered(interval_counts(dated(spark, sf_dir), view(spark, sf_dir, "as_ranges_monthly"), "intipto", "as_name", keys=("mon",)))


def as_pairs_monthly_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per pair of AS names of the month as one text; a missing side is the text ``null``."""
    pairs = interval_pair_counts(dated(spark, sf_dir), view(spark, sf_dir, "as_ranges_monthly"), keys=("mon",))
    both = enrich.totalled(pairs, "src_as_name", "dst_as_name")  # before texts are made
    return ordered(enrich.totalled(both.select(enrich.pair_text(F.col("src_as_name"), F.col("dst_as_name")).alias("names"), "n"), "names"))


def dns_ingoing_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per target address and its name in the flow's month."""
    counts = enrich.counted(dated(spark, sf_dir), "intipto", "mon")
    named = enrich.name_join(counts, enrich.bounded(view(spark, sf_dir, "dns_monthly")), "intipto", keys=("mon",))
    return ordered(enrich.totalled(named.withColumn("ipto", int_to_ip(F.col("intipto"))), "ipto", "dnsname"))


def dns_pairs_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per pair of names of the month as one text."""
    names = enrich.bounded(view(spark, sf_dir, "dns_monthly"))
    counts = enrich.counted(dated(spark, sf_dir), "intipfrom", "intipto", "mon")
    both = enrich.name_join(enrich.name_join(counts, names, "intipfrom", keys=("mon",), as_name="a"), names, "intipto", keys=("mon",), as_name="b")
    return ordered(enrich.totalled(both.select(enrich.pair_text(F.col("a"), F.col("b")).alias("names"), "n"), "names"))


def topk_as_pairs_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The AS pairs with most flows in one week."""
    flows = view(spark, sf_dir, "flows").where(F.col("flow_date").between(*(F.lit(d).cast("date") for d in WEEK)))
    pairs = interval_pair_counts(flows, view(spark, sf_dir, "as_ranges"))
    return ordered(enrich.totalled(pairs, "src_as_name", "dst_as_name")).limit(TOP)


def topk_dns_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names with most outgoing bytes."""
    sizes = view(spark, sf_dir, "flows").groupBy("intipfrom").agg(F.sum("ipsize").alias("bytes"))
    named = enrich.name_join(sizes, view(spark, sf_dir, "dns"), "intipfrom", "inner")
    totals = named.groupBy("dnsname").agg(F.sum("bytes").cast("bigint").alias("bytes"))
    return totals.orderBy(F.desc("bytes"), "dnsname").limit(TOP)


def daily_server_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows and bytes to known servers per day."""
    servers = view(spark, sf_dir, "servers").select("intip").distinct()
    flows = view(spark, sf_dir, "flows").join(enrich.sized(servers), F.col("intipto") == F.col("intip"), "left_semi")
    return flows.groupBy("flow_date").agg(F.count(F.lit(1)).alias("n"), F.sum("ipsize").cast("bigint").alias("bytes"))


def grid_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per grid cell."""
    return enrich.counted(layout.with_cell(view(spark, sf_dir, "flows").select("intipfrom", "intipto")), "cell")


def unique_ips_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct padded addresses of either side of each grid cell."""
    found = layout.unique_addresses(layout.with_cell(view(spark, sf_dir, "flows").select("intipfrom", "intipto")), "cell")
    return found.select("cell", pad_ip(int_to_ip(F.col("intip"))).alias("padded"))


def kd_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per tree leaf and its rank."""
    flows = layout.with_leaf(view(spark, sf_dir, "flows"), TREE)
    return enrich.counted(flows, "part").withColumn("rank", layout.leaf_rank(F.col("part"), TREE).cast("int"))


def unique_ips_per_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct addresses of either side of each leaf."""
    return layout.unique_addresses(layout.with_leaf(view(spark, sf_dir, "flows"), TREE), "part")


def unique_ip_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves' sorted address lists, written and read back: size and bounds of each, and addresses out of order in a file."""
    path = work_folder(spark, "addresses")
    layout.write_unique_addresses(layout.with_leaf(view(spark, sf_dir, "flows"), TREE), path, "part")
    rows = spark.read.parquet(path).select(F.col("part").cast("long").alias("part"), "intip", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    before = F.lag("intip").over(Window.partitionBy("file", "block").orderBy("place"))
    checked = rows.withColumn("wrong", F.coalesce((F.col("intip") <= before).cast("long"), F.lit(0)))
    return checked.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("intip").alias("low"), F.max("intip").alias("high"), F.sum("wrong").cast("bigint").alias("out_of_order"))


def kd_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of a box, read from a table laid out by leaves: other leaves' folders are not opened."""
    table = layout.prune(laid_out(spark, sf_dir, TREE, "layout"), TREE, BOX)
    return table.select("intipfrom", "intipto", "flow_date", "ipsize", F.col("part").cast("long").alias("part"))


def kd_built_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows and bytes per day of a box, from a table laid out by a tree that was built from the table's own sample.

    The tree has over 64 leaves where there are flows enough, so that rows are routed by the Arrow function.
    """
    flows = view(spark, sf_dir, "flows")
    tree = layout.build_tree(flows, max(2, min(flows.count(), layout.SAMPLE_POINTS) // 100))
    found = layout.prune(laid_out(spark, sf_dir, tree, "built"), tree, BOX)
    return found.groupBy("flow_date").agg(F.count(F.lit(1)).alias("n"), F.sum("ipsize").cast("bigint").alias("bytes"))


def kd_built_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for any built tree: its leaves tile the points, each row is inside its leaf's bounds, the text form routes alike."""
    flows = view(spark, sf_dir, "flows")
    rows = flows.count()
    tree = layout.build_tree(flows, max(2, min(rows, layout.SAMPLE_POINTS) // 100))
    again = KdTree.from_text(tree.to_text())
    bounds = spark.createDataFrame([(x, *(float(v) for pair in tree.bounds(x) for v in pair)) for x in tree.leaves()], "part long, " + ", ".join(f"low{k} double, high{k} double" for k in range(tree.dims)))
    routed = layout.with_leaf(flows, tree).withColumn("other", layout.leaf_function(again, layout.TREE_COLUMNS))
    tagged = routed.join(enrich.sized(bounds), "part", "left")
    lowest = F.lit(kdtree.LOWEST)
    inside = F.lit(True)
    for k, c in enumerate(layout.TREE_COLUMNS):
        inside &= ((F.col(f"low{k}") == lowest) | (layout.coordinate(c) > F.col(f"low{k}"))) & (layout.coordinate(c) <= F.col(f"high{k}"))
    good = F.coalesce(inside & (F.col("part") == F.col("other")), F.lit(False))
    return tagged.groupBy("protocol").agg(F.count(F.lit(1)).alias("n"), F.sum(good.cast("long")).cast("bigint").alias("inside"), F.lit(len(tree.leaves()) > 64).alias("many"))


def partitioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows and bytes per partition of the partitioned table, read back from its folders."""
    rows = laid_out(spark, sf_dir, TREE, "layout").withColumn("part", F.col("part").cast("long"))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("ipsize").cast("bigint").alias("bytes"))


def replaced_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dynamic-partition insert: the table is written, then one protocol's partition again, with doubled sizes; the others stay."""
    path = work_folder(spark, "table")
    flows = view(spark, sf_dir, "flows").select("intipto", "ipsize", F.col("protocol").alias("part"))
    write_partitioned(flows, path)
    write_partitioned(flows.where("part = 17").withColumn("ipsize", F.col("ipsize") * 2), path)
    return spark.read.parquet(path).groupBy(F.col("part").cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("ipsize").cast("bigint").alias("bytes"))


def loaded_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows written as text lines, with lines that hold no IPv4 addresses among them, read back by the loader."""
    path = work_folder(spark, "lines")
    flows = view(spark, sf_dir, "flows")
    odd = flows.where("srcport % 100 = 0").withColumn("ipfrom", F.lit("fe80::1"))
    ingest.write_lines(flows.union(odd), path)
    return loaders.read_flows(spark, path).groupBy("protocol", "dstport").agg(F.count(F.lit(1)).alias("n"), F.sum("ipsize").cast("bigint").alias("bytes"), F.min("ipto").alias("low"), F.max("flow_date").alias("latest"))


def loaded_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dimension files, written in their own formats and read by their loaders, as one list of addresses and names."""
    folder = work_folder(spark, "dimensions")
    quoted = lambda frame, name: frame.coalesce(1).write.option("quoteAll", "true").csv(f"{folder}/{name}")
    ranges = view(spark, sf_dir, "as_ranges").select("ip_start", "ip_end", F.concat("as_name", F.lit(" Ex_ample, Inc")).alias("as_name"))
    quoted(ranges, "as")
    lands = view(spark, sf_dir, "country_ranges")
    quoted(lands.select(int_to_ip(F.col("ip_start")), int_to_ip(F.col("ip_end")).alias("last"), "ip_start", "ip_end", "country_code", "country_name"), "country")
    names = view(spark, sf_dir, "dns")
    odd = [F.concat_ws(",", "ip", "dnsname"), F.concat("ip", F.lit(",")), F.concat_ws(",", "ip", "dnsname", F.lit("x"))]
    names.select(F.explode(F.array(*odd)).alias("value")).write.text(f"{folder}/dns")
    view(spark, sf_dir, "servers").select(F.concat("ip", F.lit(" srv")).alias("value")).write.text(f"{folder}/servers")
    parts = [
        loaders.checked_ranges(loaders.read_as_ranges(spark, f"{folder}/as")).select(F.lit("as").alias("kind"), F.col("ip_start").alias("low"), F.col("ip_end").alias("high"), F.col("as_name").alias("name")),
        loaders.read_country_ranges(spark, f"{folder}/country").select(F.lit("country"), "ip_start", "ip_end", F.concat_ws(" ", "country_code", "country_name")),
        loaders.read_dns(spark, f"{folder}/dns").select(F.lit("dns"), "intip", "intip", "dnsname"),
        loaders.read_servers(spark, f"{folder}/servers").select(F.lit("server"), "intip", "intip", "name"),
    ]
    return functools.reduce(DataFrame.union, parts)


def loaded_monthly_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges by month, one file for each, read with the month from the file's name."""
    folder = work_folder(spark, "monthly")
    ranges = view(spark, sf_dir, "as_ranges_monthly")
    for month in range(1, 13):
        ingest.write_file(ranges.where(F.col("mon") == month).select("ip_start", "ip_end", "as_name"), f"{folder}/GeoIPASNum2_{month:02}.csv")
    return loaders.read_monthly_as_ranges(spark, folder)


def tsv_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow counts with and without a name, written as gzip'd tab-separated text and read back."""
    path = work_folder(spark, "tsv")
    write_tsv(dns_ingoing_left(spark, sf_dir), path, "gzip")
    return spark.read.schema("ipto string, dnsname string, n bigint").option("sep", "\t").option("nullValue", "\\N").csv(path)


def dns_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a range of addresses, from the dimension stored in key order: other row groups are not read."""
    return sorted_names(spark, sf_dir).where(F.col("intip").between(*IP_RANGE)).select("intip", "dnsname")


def sorted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "names")
    loaders.load_sorted(view(spark, sf_dir, "dns").select("intip", "dnsname"), path, "intip")
    return spark.read.parquet(path)


def ip_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in all their forms."""
    ips = view(spark, sf_dir, "flows").select("ipto").distinct()
    number = ip_to_int(F.col("ipto"))
    return ips.select("ipto", number.alias("number"), pad_ip(F.col("ipto")).alias("padded"), int_to_ip(number).alias("back"), is_ipv4(F.col("ipto")).alias("valid"))


def as_range_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per address of every range of small autonomous systems."""
    return enrich.exploded(view(spark, sf_dir, "small_as_ranges"))


def country_range_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per address of every small country range, with code and name."""
    return enrich.exploded(view(spark, sf_dir, "small_country_ranges"))


def as_range_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, bounds and sum of all addresses of each autonomous system, from one row per address of its ranges."""
    return address_totals(view(spark, sf_dir, "as_ranges"), "as_name")


def country_range_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per country."""
    return address_totals(view(spark, sf_dir, "country_ranges"), "country_code", "country_name")


def address_totals(ranges: DataFrame, *names: str) -> DataFrame:
    """Totals of the exploded addresses, by range first: addresses go with a number instead of names."""
    start = F.col("ip_start").alias("range")
    own = enrich.exploded(ranges.select("ip_start", "ip_end", start)).groupBy("range")
    found = own.agg(F.count(F.lit(1)).alias("n"), F.min("ip").alias("low"), F.max("ip").alias("high"), F.sum("ip").alias("total"))
    named = found.join(ranges.select(start, *names), "range")
    return named.groupBy(*names).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"))


def city_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations after writing them quoted and reading them with the cleaning reader."""
    path = work_folder(spark, "locations")
    rows = view(spark, sf_dir, "locations").select("loc_id", F.concat(F.lit("R"), "n_regionkey").alias("country_code"), "city")
    rows.write.mode("overwrite").option("quoteAll", "true").csv(path)
    return loaders.read_locations(spark, path)


def knn_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every vector whose id is divisible by 20."""
    points = view(spark, sf_dir, "embeddings")
    found = knn.nearest_neighbours(points, points.where("vec_id % 20 = 0"), NEIGHBOURS)
    return found.select("query_id", "rank", "neighbour_id", F.round("distance", 4).alias("distance"))


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible one-in-twenty sample of flows, by the draw that trees are built from."""
    flows = layout.sampled(view(spark, sf_dir, "flows"), 0.05)
    return flows.groupBy("protocol", "dstport").agg(F.count(F.lit(1)).alias("n"), F.min("intipto").alias("low"), F.max("intipto").alias("high"))


def stream_leaf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per leaf after they were ingested as a stream."""
    return ingest.replayed(spark, sf_dir, TREE)


def stream_split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows and bytes per year of a table that grew by a stream of several files while its leaves split, and how it split."""
    return ingest.grown(spark, sf_dir)


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their value per hour and type, by a stream: the hours that are closed when its watermark has passed them."""
    return ingest.event_windows(spark, sf_dir)


def stream_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transport smoke test: every event type with an exclamation mark, through a stream."""
    return ingest.exclaimed(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        as_ingoing, as_outgoing, as_pairs, as_ingoing_inner, as_pairs_inner, country_outgoing, country_pairs, city_outgoing, city_outgoing_left,
        dns_ingoing_left, dns_ingoing_grid, dns_ingoing_tree, dns_ingoing_week, dns_pairs_inner, dns_pairs_left, dns_pairs_concat, dns_pairs_tree, server_class,
        as_ingoing_monthly, as_pairs_monthly_concat, dns_ingoing_monthly, dns_pairs_monthly, topk_as_pairs_week, topk_dns_bytes, daily_server_traffic,
        grid_assign, unique_ips_per_cell, kd_assign, unique_ips_per_leaf, unique_ip_lists, kd_pruned_scan, kd_built_scan, kd_built_leaves, partitioned_table, replaced_partitions,
        loaded_flows, loaded_dimensions, loaded_monthly_ranges, tsv_totals, dns_range, ip_functions, as_range_explode, country_range_explode,
        as_range_addresses, country_range_addresses, city_names,
        knn_embeddings, hash_sample, stream_leaf_counts, stream_split_totals, stream_event_windows, stream_marked,
    )
}
