"""IPv4 addresses as SQL expressions: text to number and back, padding, validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUAD = r"^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}$"


def is_ipv4(ip: Column) -> Column:
    """Whether a text is a dotted quad with octets up to 255; null counts as no."""
    octets = F.transform(F.split(ip, "[.]"), lambda x: x.try_cast("int") <= 255)
    return F.coalesce(ip.rlike(QUAD) & F.forall(octets, lambda x: x), F.lit(False))


def ip_to_int(ip: Column) -> Column:
    """The 32-bit number of a dotted quad as bigint; null for any other text."""
    number = F.aggregate(F.split(ip, "[.]"), F.lit(0).cast("bigint"), lambda s, x: s * 256 + x.try_cast("bigint"))
    return F.when(is_ipv4(ip), number)


def int_to_ip(number: Column) -> Column:
    """The dotted quad of a number from 0 to 2**32 - 1; null for any other."""
    octets = [F.shiftright(number, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)]
    return F.when((number >= 0) & (number < 1 << 32), F.concat_ws(".", *octets))


def pad_ip(ip: Column) -> Column:
    """The quad with every octet padded to three digits, so that text order is numeric order; null for other text."""
    return F.when(is_ipv4(ip), F.array_join(F.transform(F.split(ip, "[.]"), lambda x: F.lpad(x, 3, "0")), "."))
