"""IPv4 addresses and subnets as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _octets(text: Column, strict: bool) -> Column:
    """Octets as longs, null where one isn't a number from 0 to 255."""
    parts = F.transform(F.split(text, r"\."), lambda p: F.when(p.rlike(r"^\+?[0-9]{1,9}$"), p.cast("long")))
    ok = F.forall(parts, lambda p: F.coalesce(p <= 255, F.lit(False)))
    size = F.size(parts) == 4 if strict else F.size(parts) <= 4
    return F.when(ok & size, parts)


def ip_to_long(ip: Column, strict: bool = True) -> Column:
    """Address as a number, or null. Without ``strict``, one to three octets are taken as they come."""
    return F.aggregate(_octets(ip, strict), F.lit(0).cast("long"), lambda acc, p: acc * 256 + p)


def prefix_length(mask: Column) -> Column:
    """Bits set in a mask; parts that aren't octets count nothing."""
    parts = F.transform(F.split(mask, r"\."), lambda p: F.when(p.rlike(r"^[0-9]{1,3}$"), p.cast("int")))
    return F.aggregate(F.filter(parts, lambda p: p.isNotNull() & (p <= 255)), F.lit(0), lambda acc, p: acc + F.bit_count(p))


def dotted(address: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(address, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def subnet(ip: Column, mask: Column, strict: bool = True) -> Column:
    """Network/prefix, or null where either address is none."""
    network = ip_to_long(ip, strict).bitwiseAND(ip_to_long(mask, strict))
    return F.when(network.isNotNull(), F.concat(dotted(network), F.lit("/"), prefix_length(mask).cast("string")))
