"""Endpoint, port and address expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.text import parse_int

# Ports the data model flags.
COMMON_SERVICE_PORTS = [20, 21, 22, 23, 25, 53, 80, 110, 143, 443, 993, 995, 3128, 8080]
PROXY_PORTS = [3128, 8000, 8080, 8888]
PORT_BUCKET_CODES = {"invalid": 0, "well_known": 1, "registered": 2, "dynamic": 3}

# IANA special-purpose IPv4 blocks that are not globally reachable.
PRIVATE_V4 = [
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
]
PUBLIC_V4_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]

# The same for IPv6, as (first eight groups, prefix length).
PRIVATE_V6 = [
    ("0:0:0:0:0:0:0:0", 128),
    ("0:0:0:0:0:0:0:1", 128),
    ("64:ff9b:1:0:0:0:0:0", 48),
    ("100:0:0:0:0:0:0:0", 64),
    ("2001:0:0:0:0:0:0:0", 23),
    ("2001:db8:0:0:0:0:0:0", 32),
    ("2002:0:0:0:0:0:0:0", 16),
    ("fc00:0:0:0:0:0:0:0", 7),
    ("fe80:0:0:0:0:0:0:0", 10),
]
PUBLIC_V6_EXCEPTIONS = [
    ("2001:1:0:0:0:0:0:1", 128),
    ("2001:1:0:0:0:0:0:2", 128),
    ("2001:3:0:0:0:0:0:0", 32),
    ("2001:4:112:0:0:0:0:0", 48),
    ("2001:20:0:0:0:0:0:0", 28),
    ("2001:30:0:0:0:0:0:0", 28),
]

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_MAPPED_V4 = r"(?i)^::ffff:([0-9.]+)$"


def endpoint_id(ip: Column, port: Column) -> Column:
    return F.concat_ws(":", ip, port.cast("string"))


def endpoint_ip(endpoint: Column) -> Column:
    """Part before the last colon; the whole text when there is none."""
    cut = F.length(endpoint) - F.length(F.substring_index(endpoint, ":", -1)) - 1
    return F.when(endpoint.contains(":"), F.substring(endpoint, F.lit(1), cut)).otherwise(endpoint)


def endpoint_port(endpoint: Column) -> Column:
    """Port after the last colon, 0 without a colon or when it is not a number."""
    return F.when(endpoint.contains(":"), parse_int(F.substring_index(endpoint, ":", -1))).otherwise(
        F.lit(0).cast("bigint")
    )


def port_bucket(port: Column) -> Column:
    return (
        F.when(port.between(0, 1023), "well_known")
        .when(port.between(1024, 49151), "registered")
        .when(port.between(49152, 65535), "dynamic")
        .otherwise("invalid")
    )


def port_bucket_code(port: Column) -> Column:
    bucket = port_bucket(port)
    code = F.lit(None).cast("int")
    for name, value in PORT_BUCKET_CODES.items():
        code = F.when(bucket == name, F.lit(value)).otherwise(code)
    return code


def is_common_service_port(port: Column) -> Column:
    return port.isin(COMMON_SERVICE_PORTS)


def is_proxy_port(port: Column) -> Column:
    return port.isin(PROXY_PORTS)


def ipv4_number(ip: Column) -> Column:
    """BIGINT of a dotted quad, NULL for anything else (leading zeros are rejected)."""
    octets = F.split(ip, r"\.")
    value = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, octet: acc * 256 + octet.cast("bigint"))
    return F.when(ip.rlike(_V4), value)


def _v4_block(cidr: str) -> tuple[int, int]:
    address, prefix = cidr.split("/")
    first = 0
    for octet in address.split("."):
        first = first * 256 + int(octet)
    return first, first + 2 ** (32 - int(prefix)) - 1


def _once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with `value` computed once per row, however often fn uses it."""
    return F.transform(F.array(value), fn)[0]


def _private_v4_number(number: Column) -> Column:
    inside = F.lit(False)
    for cidr in PRIVATE_V4:
        inside = inside | number.between(*_v4_block(cidr))
    for cidr in PUBLIC_V4_EXCEPTIONS:
        inside = inside & ~number.between(*_v4_block(cidr))
    return F.coalesce(inside, F.lit(False))


def ipv6_groups(ip: Column) -> Column:
    """The eight 16-bit groups of an IPv6 text, NULL when it is malformed."""
    def pieces(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))

    compressed = ip.contains("::")
    head = pieces(F.when(compressed, F.substring_index(ip, "::", 1)).otherwise(ip))
    tail = pieces(F.when(compressed, F.substring_index(ip, "::", -1)).otherwise(F.lit("")))
    gap = F.lit(8) - F.size(head) - F.size(tail)
    groups = F.concat(head, F.array_repeat(F.lit("0"), gap), tail)
    well_formed = (
        ip.contains(":")
        & ip.rlike(r"^[0-9a-fA-F:]+$")
        & ~ip.rlike(r"::.*::|:::")
        & F.forall(groups, lambda g: g.rlike(r"^[0-9a-fA-F]{1,4}$"))
        & F.when(compressed, gap >= 1).otherwise(F.size(head) == 8)
    )
    return F.when(well_formed, F.transform(groups, lambda g: F.conv(g, 16, 10).cast("int")))


def _plain_v6(ip: Column) -> Column:
    """An IPv6 text without its scope id, a dotted tail written as two groups."""
    bare = F.regexp_replace(ip, r"%[^%]+$", "")
    tail = F.regexp_extract(bare, r":([0-9.]+)$", 1)
    number = ipv4_number(F.when(tail.contains("."), tail))
    groups = F.concat(F.lower(F.hex(F.shiftright(number, 16))), F.lit(":"), F.lower(F.hex(number.bitwiseAND(F.lit(0xFFFF)))))
    return F.when(number.isNotNull(), F.concat(F.regexp_replace(bare, r"[0-9.]+$", ""), groups)).otherwise(bare)


def _in_v6_block(groups: Column, block: tuple[str, int]) -> Column:
    address, prefix = block
    inside = F.lit(True)
    for i, text in enumerate(address.split(":")):
        bits = min(16, max(0, prefix - 16 * i))
        if bits:
            mask = (0xFFFF << (16 - bits)) & 0xFFFF
            inside = inside & (groups[i].bitwiseAND(F.lit(mask)) == (int(text, 16) & mask))
    return inside


def _private_v6(ip: Column) -> Column:
    def inside_a_block(groups: Column) -> Column:
        inside = F.lit(False)
        for block in PRIVATE_V6:
            inside = inside | _in_v6_block(groups, block)
        for block in PUBLIC_V6_EXCEPTIONS:
            inside = inside & ~_in_v6_block(groups, block)
        mapped = _in_v6_block(groups, ("0:0:0:0:0:ffff:0:0", 96))
        v4 = groups[6].cast("bigint") * 65536 + groups[7]
        return F.coalesce(F.when(mapped, _private_v4_number(v4)).otherwise(inside), F.lit(False))

    return _once(ipv6_groups(ip), inside_a_block)


def is_private_ip(ip: Column) -> Column:
    """True for an address that is not globally reachable; a malformed one is not private."""
    mapped = F.regexp_extract(ip, _MAPPED_V4, 1)
    quad = F.when(mapped != "", mapped).otherwise(ip)
    return F.when(quad.contains(":"), _private_v6(_plain_v6(ip))).otherwise(
        _once(ipv4_number(quad), _private_v4_number)
    )
