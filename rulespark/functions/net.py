"""IP addresses: version 4 as BIGINT, version 6 as 32 hexadecimal digits, either
as a struct (v4, v6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions.std import col, python_function

LOCALHOST, UNSPECIFIED, BROADCAST = 0x7F000001, 0, 0xFFFFFFFF


def iPV4_LOCALHOST() -> Column:  # noqa: N802
    return F.lit(LOCALHOST).cast("long")


def iPV4_UNSPECIFIED() -> Column:  # noqa: N802
    return F.lit(0).cast("long")


def iPV4_BROADCAST() -> Column:  # noqa: N802
    return F.lit(BROADCAST).cast("long")


def ipv4_new(a, b, c, d) -> Column:
    return ((col(a).cast("long") * 256 + col(b)) * 256 + col(c)) * 256 + col(d)


def ipv4_from_octet_vec(v) -> Column:
    return F.when(F.size(col(v)) == 4, ipv4_new(*(F.get(col(v), F.lit(i)) for i in range(4))))


def ipv4_from_u32(x) -> Column:
    return col(x).cast("long")


ipv4_to_u32 = ipv4_from_u32


def ipv4_from_str(s) -> Column:
    parts = F.transform(F.split(col(s), r"\."), lambda p: p.try_cast("int"))
    good = col(s).rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$") & F.forall(parts, lambda p: p < 256)
    return F.when(good, ipv4_from_octet_vec(parts))


def ipv4_octet_vec(x) -> Column:
    return F.array(*(F.shiftright(col(x).cast("long"), n).bitwiseAND(F.lit(255).cast("long")).cast("int") for n in (24, 16, 8, 0)))


ipv4_octets = ipv4_octet_vec


def ipv4Addr2string(x) -> Column:  # noqa: N802
    return F.array_join(ipv4_octet_vec(x), ".")


def _inside(x, prefix: int, length: int) -> Column:
    return F.shiftright(col(x).cast("long"), 32 - length) == prefix >> (32 - length)


def ipv4_is_unspecified(x) -> Column:
    return col(x) == 0


def ipv4_is_loopback(x) -> Column:
    return _inside(x, 0x7F000000, 8)


def ipv4_is_private(x) -> Column:
    return _inside(x, 0x0A000000, 8) | _inside(x, 0xAC100000, 12) | _inside(x, 0xC0A80000, 16)


def ipv4_is_link_local(x) -> Column:
    return _inside(x, 0xA9FE0000, 16)


def ipv4_is_multicast(x) -> Column:
    return _inside(x, 0xE0000000, 4)


def ipv4_is_broadcast(x) -> Column:
    return col(x) == BROADCAST


def ipv4_is_documentation(x) -> Column:
    return _inside(x, 0xC0000200, 24) | _inside(x, 0xC6336400, 24) | _inside(x, 0xCB007100, 24)


def ipv4_to_ipv6_compatible(x) -> Column:
    return F.lower(F.lpad(F.hex(col(x).cast("long")), 32, "0"))


def ipv4_to_ipv6_mapped(x) -> Column:
    return F.lower(F.concat(F.lit("00000000000000000000FFFF"), F.lpad(F.hex(col(x).cast("long")), 8, "0")))


# -- version 6 ---------------------------------------------------------------
def ipv6_new(*segments) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(col(s).cast("int")), 4, "0") for s in segments)))


def ipv6_from_segment_vec(v) -> Column:
    return F.when(F.size(col(v)) == 8, F.lower(F.array_join(F.transform(col(v), lambda s: F.lpad(F.hex(s), 4, "0")), "")))


def ipv6_from_octet_vec(v) -> Column:
    return F.when(F.size(col(v)) == 16, F.lower(F.array_join(F.transform(col(v), lambda s: F.lpad(F.hex(s), 2, "0")), "")))


def ipv6_from_octets(*octets) -> Column:
    return ipv6_from_octet_vec(F.array(*map(col, octets)))


def iPV6_LOCALHOST() -> Column:  # noqa: N802
    return F.lit("0" * 31 + "1")


def iPV6_UNSPECIFIED() -> Column:  # noqa: N802
    return F.lit("0" * 32)


@python_function("string")
def ipv6_from_u128(x):
    """From decimal text."""
    return None if x is None else format(int(x), "032x")


@python_function("string")
def ipv6_to_u128(x):
    return None if x is None else str(int(x, 16))


@python_function("string")
def ipv6_from_str(s):
    import ipaddress

    try:
        return None if s is None else format(int(ipaddress.IPv6Address(s)), "032x")
    except ValueError:
        return None


@python_function("string")
def ipv6Addr2string(x):  # noqa: N802
    import ipaddress

    return None if x is None else str(ipaddress.IPv6Address(int(x, 16)))


def ipv6_segment_vec(x) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(col(x), i * 4 + 1, F.lit(4)), 16, 10).cast("int"))


def ipv6_octet_vec(x) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(col(x), i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


ipv6_segments, ipv6_octets = ipv6_segment_vec, ipv6_octet_vec


def ipv6_is_unspecified(x) -> Column:
    return col(x) == "0" * 32


def ipv6_is_loopback(x) -> Column:
    return col(x) == "0" * 31 + "1"


def ipv6_is_multicast(x) -> Column:
    return F.startswith(col(x), F.lit("ff"))


def ipv6_to_ipv4(x) -> Column:
    some = F.startswith(col(x), F.lit("0" * 24)) | F.startswith(col(x), F.lit("0" * 20 + "ffff"))
    return F.when(some, F.conv(F.substring(col(x), 25, 8), 16, 10).cast("long"))


# -- either --------------------------------------------------------------------
def ipaddr_from_ipv4addr(x) -> Column:
    return F.struct(col(x).cast("long").alias("v4"), F.lit(None).cast("string").alias("v6"))


def ipaddr_from_ipv6addr(x) -> Column:
    return F.struct(F.lit(None).cast("long").alias("v4"), col(x).alias("v6"))


def ipaddr_is_ipv4(a: Column) -> Column:
    return a["v4"].isNotNull()


def ipaddr_is_ipv6(a: Column) -> Column:
    return a["v6"].isNotNull()


def _either(f4, f6):
    return lambda a: F.when(a["v4"].isNotNull(), f4(a["v4"])).otherwise(f6(a["v6"]))


ipaddr_is_unspecified = _either(ipv4_is_unspecified, ipv6_is_unspecified)
ipaddr_is_loopback = _either(ipv4_is_loopback, ipv6_is_loopback)
ipaddr_is_multicast = _either(ipv4_is_multicast, ipv6_is_multicast)
ipaddr_to_string = _either(ipv4Addr2string, ipv6Addr2string)
