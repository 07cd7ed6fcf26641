"""Text inputs: flow records and the dimension files, cleaned on the way in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerscope.functions.ip import ip_to_int, is_ipv4

FLOW_SCHEMA = "ipfrom string, intipfrom bigint, ipto string, intipto bigint, protocol int, srcport int, dstport int, ipsize bigint, flow_date date"


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated flow records; rows whose addresses are not IPv4 are dropped."""
    rows = spark.read.schema(FLOW_SCHEMA).option("sep", " ").option("dateFormat", "yyyy-MM-dd").csv(path)
    return rows.where(is_ipv4(F.col("ipfrom")) & is_ipv4(F.col("ipto")))


def read_as_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``start,end,"name"``: the reader honours quotes, so names may hold commas and underscores."""
    return spark.read.schema("ip_start bigint, ip_end bigint, as_name string").csv(path)


def read_monthly_as_ranges(spark: SparkSession, folder: str, stem: str = "GeoIPASNum2") -> DataFrame:
    """One file ``<stem>_MM.csv`` per month; the month comes from the file's name."""
    rows = read_as_ranges(spark, f"{folder}/{stem}_*.csv")
    month = F.regexp_extract(F.col("_metadata.file_name"), r"_([0-9]{2})[.]csv$", 1).cast("int")
    return rows.select("ip_start", "ip_end", month.alias("mon"), "as_name")


def read_country_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Six quoted fields: first and last address as text, as numbers, then code and name."""
    schema = "first string, last string, ip_start bigint, ip_end bigint, country_code string, country_name string"
    return spark.read.schema(schema).csv(path).drop("first", "last")


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """Quoted fields: id, country, city, then others that are not used."""
    return spark.read.schema("loc_id int, country_code string, city string").csv(path)


def read_dns(spark: SparkSession, path: str) -> DataFrame:
    """``ip,name`` lines; lines with another number of fields, an empty one or no IPv4 address are dropped."""
    parts = F.split(F.col("value"), ",")
    rows = spark.read.text(path).where((F.size(parts) == 2) & (parts[1] != ""))
    return rows.select(parts[0].alias("ip"), ip_to_int(parts[0]).alias("intip"), parts[1].alias("dnsname")).where("intip is not null")


def read_servers(spark: SparkSession, path: str) -> DataFrame:
    """``ip name`` lines of known servers."""
    parts = F.split(F.col("value"), " ")
    return spark.read.text(path).select(parts[0].alias("ip"), ip_to_int(parts[0]).alias("intip"), F.get(parts, F.lit(1)).alias("name")).where("intip is not null")


def load_sorted(frame: DataFrame, path: str, key: str) -> None:
    """A dimension as Parquet in key order: range filters on the key read few row groups."""
    frame.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def overlapping(ranges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The ranges that begin at or before the end of another one of the same keys that starts earlier.

    Only neighbours in start order are compared, one range of starts per task: a running maximum inside each,
    and the maxima of the tasks before it, one row per task.
    """
    by = [F.col(k) for k in keys]
    slice_of = F.shiftright("ip_start", 24)  # 256 slices of the address space
    rows = ranges.withColumn("__slice", slice_of)
    tops = rows.groupBy(*by, "__slice").agg(F.max("ip_end").alias("__top"))
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*by, "__slice", F.max("__top").over(before).alias("__before"))
    inside = Window.partitionBy(*by, "__slice").orderBy("ip_start", "ip_end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.max("ip_end").over(inside), "__before")
    return rows.join(tops, [*keys, "__slice"]).withColumn("__reach", reach).where("ip_start <= __reach").select(*ranges.columns)


def checked_ranges(ranges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``ranges``, after making sure that they are disjoint and not reversed."""
    if not ranges.where("ip_end < ip_start").isEmpty():
        raise ValueError("a range ends before it starts")
    if not overlapping(ranges, keys).isEmpty():
        raise ValueError("ranges overlap")
    return ranges
