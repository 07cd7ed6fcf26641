"""Enrichment of addresses: interval, temporal and equi joins.

Intervals are disjoint. They are cut at multiples of 2**k addresses, so an address finds its interval by an
equi-join on its multiple, with the interval's bounds as a residual filter. k is the smallest for which the
cut intervals stay within a few times their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cut intervals may be this many times as many as the intervals.
BLOW_UP = 4
#: Bytes of a dimension up to which it is broadcast; above, the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Addresses of a piece of a range that is exploded.
PIECE = 1 << 16
DARK, RX_SRV, TX_SRV, UNK_S2S = "DARK", "RX_SRV", "TX_SRV", "UNK_S2S"


def row_bytes(frame: DataFrame) -> Column:
    """An upper estimate of a row's bytes in a hash table: 16 for each column and 32 for the row, and its texts twice."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in frame.schema if f.dataType.typeName() == "string"]
    return sum((2 * t for t in texts), F.lit(32 + 16 * len(frame.columns)))


def measured(dimension: DataFrame) -> int:
    """The bytes of a dimension, counted."""
    return int(dimension.agg(F.coalesce(F.sum(row_bytes(dimension)), F.lit(0))).first()[0])


def bucket_bits(ranges: DataFrame, blow_up: int = BLOW_UP) -> tuple[int, int, int]:
    """Bits of the bucket width, the number of cut intervals, and about how many bytes they have."""
    widths = [F.sum(F.shiftright("ip_end", k) - F.shiftright("ip_start", k) + 1).alias(f"k{k}") for k in range(33)]
    sums = ranges.agg(F.count(F.lit(1)).alias("n"), F.max(row_bytes(ranges)).alias("widest"), *widths).first()
    if not sums["n"]:
        return 32, 0, 0
    bits = next((k for k in range(33) if sums[f"k{k}"] <= blow_up * sums["n"]), 32)
    return bits, int(sums[f"k{bits}"]), int(sums[f"k{bits}"] * sums["widest"])


def exploded(ranges: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row ``ip`` with the other columns for every address of every range.

    Ranges are first split into pieces at multiples of ``piece`` addresses, which are dealt out anew: no row holds more
    than ``2**32 / piece`` or ``piece`` numbers, and a wide range is not the work of one task. A range that ends before
    it starts, or has a null bound, has no address.
    """
    rest = [c for c in ranges.columns if c not in ("ip_start", "ip_end")]
    number = lambda c: F.floor(F.col(c) / piece) if piece & (piece - 1) else F.shiftright(c, piece.bit_length() - 1)
    pieces = ranges.where("ip_start <= ip_end").select("*", F.explode(F.sequence(number("ip_start"), number("ip_end"))).alias("__piece"))
    low, high = F.greatest("ip_start", F.col("__piece") * piece), F.least("ip_end", F.col("__piece") * piece + (piece - 1))
    dealt = pieces.select(low.alias("__low"), high.alias("__high"), *rest).repartition(4 * ranges.sparkSession.sparkContext.defaultParallelism, "__low")
    return dealt.select(F.explode(F.sequence("__low", "__high")).alias("ip"), *rest)


def sized(dimension: DataFrame, size: int | None = None) -> DataFrame:
    """``dimension`` marked for broadcast if its counted bytes are few enough."""
    return F.broadcast(dimension) if (measured(dimension) if size is None else size) <= BROADCAST_BYTES else dimension


def bounded(dimension: DataFrame) -> DataFrame:
    """``dimension`` marked for broadcast if its counted bytes are few enough, else for a shuffle.

    Without the second mark Catalyst goes by its own estimate, which leaves out the rows that ``explode`` adds.
    """
    return F.broadcast(dimension) if measured(dimension) <= BROADCAST_BYTES else dimension.hint("merge")


def interval_join(probe: DataFrame, ranges: DataFrame, ip: str, how: str = "left", keys: tuple[str, ...] = (), prefix: str = "", width: tuple[int, int, int] | None = None) -> DataFrame:
    """``probe`` with the columns of the interval that holds the address in column ``ip``.

    ``keys`` are further columns that must be equal, as the month of a temporal join. ``prefix`` goes before the
    names of the added columns. ``width`` is the result of ``bucket_bits`` where it is known. A null address has
    no interval.
    """
    bits, _, size = width or bucket_bits(ranges)
    added = [c for c in ranges.columns if c not in ("ip_start", "ip_end", *keys)]
    cut = ranges.select(
        F.col("ip_start").alias("__start"), F.col("ip_end").alias("__end"), *(F.col(k).alias(f"__{k}") for k in keys), *(F.col(c).alias(prefix + c) for c in added),
        F.explode(F.sequence(F.shiftright("ip_start", bits), F.shiftright("ip_end", bits))).alias("__bucket"),
    )
    match = (F.shiftright(ip, bits) == F.col("__bucket")) & F.col(ip).between(F.col("__start"), F.col("__end"))
    for k in keys:
        match &= F.col(k) == F.col(f"__{k}")
    return probe.join(sized(cut, size), match, how).drop("__start", "__end", "__bucket", *(f"__{k}" for k in keys))


def interval_pair_join(flows: DataFrame, ranges: DataFrame, how: str = "left", keys: tuple[str, ...] = ()) -> DataFrame:
    """``flows`` with the intervals of both ends, their columns prefixed with ``src_`` and ``dst_``."""
    width = bucket_bits(ranges)
    source = interval_join(flows, ranges, "intipfrom", how, keys, "src_", width)
    return interval_join(source, ranges, "intipto", how, keys, "dst_", width)


def interval_join_between(probe: DataFrame, ranges: DataFrame, ip: str, how: str = "left") -> DataFrame:
    """The same result as a plain BETWEEN join, a nested loop, for small dimensions and as a check."""
    return probe.join(sized(ranges), F.col(ip).between(F.col("ip_start"), F.col("ip_end")), how).drop("ip_start", "ip_end")


def name_join(probe: DataFrame, names: DataFrame, ip: str, how: str = "left", keys: tuple[str, ...] = (), as_name: str = "dnsname") -> DataFrame:
    """``probe`` with the name of the address in column ``ip``, by a plain equi-join."""
    side = names.select(F.col("intip").alias("__ip"), *(F.col(k).alias(f"__{k}") for k in keys), F.col("dnsname").alias(as_name))
    match = F.col(ip) == F.col("__ip")
    for k in keys:
        match &= F.col(k) == F.col(f"__{k}")
    return probe.join(side, match, how).drop("__ip", *(f"__{k}" for k in keys))


def partition_join(counts: DataFrame, names: DataFrame, members: DataFrame, part: str, ip: str) -> DataFrame:
    """``counts`` of addresses by ``part`` with their names, each part joined with the names of its own addresses only.

    ``members`` has the addresses ``intip`` of each part. Both sides are dealt by part and address, so that neither a
    part's names nor a name that many parts need is held whole by a task.
    """
    own = name_join(members, names, "intip", "inner").select(F.col(part).alias("__part"), F.col("intip").alias("__ip"), "dnsname")
    return counts.join(own, (F.col(part) == F.col("__part")) & (F.col(ip) == F.col("__ip")), "left").drop("__part", "__ip")


def counted(frame: DataFrame, *columns: str) -> DataFrame:
    """Rows per combination of columns, as ``n``."""
    return frame.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def totalled(frame: DataFrame, *columns: str) -> DataFrame:
    """Sums of ``n`` per combination of columns."""
    return frame.groupBy(*columns).agg(F.sum("n").cast("bigint").alias("n"))


def pair_text(a: Column, b: Column) -> Column:
    """Two names as one text; a missing one is the text ``null``."""
    return F.concat_ws(" ", F.coalesce(a, F.lit("null")), F.coalesce(b, F.lit("null")))


def server_class(source_known: Column, target_known: Column) -> Column:
    """The class of a flow by which of its ends is a known server."""
    return F.when(source_known & target_known, DARK).when(target_known, RX_SRV).when(source_known, TX_SRV).otherwise(UNK_S2S)


def classified(flows: DataFrame, servers: DataFrame) -> DataFrame:
    """``flows`` with ``server_class``, by the numbers of the addresses."""
    known = servers.select("intip").dropna().distinct()
    size = measured(known)
    source = sized(known.select(F.col("intip").alias("__from")), size)
    target = sized(known.select(F.col("intip").alias("__to")), size)
    joined = flows.join(source, F.col("intipfrom") == F.col("__from"), "left").join(target, F.col("intipto") == F.col("__to"), "left")
    return joined.withColumn("server_class", server_class(F.col("__from").isNotNull(), F.col("__to").isNotNull())).drop("__from", "__to")
