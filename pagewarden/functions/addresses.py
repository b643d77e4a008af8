"""Internet addresses as 32 hex digits, in whose order they compare, and joins with ranges of them.

An address of version 4 is that of version 6 which maps it, so that both kinds, shortened and mapped forms fall into one order.
Ranges are few blocks each, aligned at hex digits; an address is in a block if it begins with the block's digits. So a join
with any number of ranges is an equi-join on (number of digits, digits), with as many keys an address as there are
lengths of blocks.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Destinations that no public host has (fixed values): private, loopback, link-local, documentation, benchmarking, reserved.
RESERVED = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
    "::/96", "64:ff9b:1::/48", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001:db8::/32", "2002::/16", "3fff::/20", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10",
)
_BYTE = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_FOUR = rf"{_BYTE}(?:\.{_BYTE}){{3}}"
MAPPED = "00000000000000000000ffff"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _quad(text: Column, sign: str = "") -> Column:
    """Hex digits of a dotted quad; with a sign between both halves if there is one."""
    parts = F.transform(F.split(text, r"\."), lambda p: F.lpad(F.lower(F.hex(p.cast("bigint"))), 2, "0"))
    return _let(F.array_join(parts, ""), lambda h: F.concat(F.substring(h, 1, 4), F.lit(sign), F.substring(h, 5, 4)))


def canonical(host: Column) -> Column:
    """32 hex digits of an address as text, with or without brackets and zone; null if it is none."""

    def six(x: Column) -> Column:
        plain = F.when(x.rlike(rf":{_FOUR}$"), F.concat(F.regexp_replace(x, rf"{_FOUR}$", ""), _quad(F.regexp_extract(x, rf"({_FOUR})$", 1), ":"))).otherwise(x)

        def whole(y: Column) -> Column:
            halves = F.split(y, "::", -1)
            groups = lambda half: F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))
            a, b = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
            n, short = F.size(a) + F.size(b), F.size(halves) == 2
            fine = F.forall(F.concat(a, b), lambda g: g.rlike(r"^[0-9a-f]{1,4}$")) & F.when(short, n <= 7).otherwise((F.size(halves) == 1) & (n == 8))
            return F.when(fine, F.array_join(F.transform(F.concat(a, F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), b), lambda g: F.lpad(g, 4, "0")), ""))

        return F.when(x.rlike(r"^[0-9a-f:.]*:[0-9a-f:.]*$"), _let(plain, whole))

    text = F.regexp_replace(F.lower(F.trim(host)), r"^\[|\]$|%.*$", "")
    return _let(text, lambda x: F.when(x.rlike(rf"^{_FOUR}$"), F.concat(F.lit(MAPPED), _quad(x))).otherwise(six(x)))


def blocks(networks: Iterable[str]) -> list[str]:
    """Digits that addresses of the networks begin with: of each network the blocks that end at a hex digit."""
    out = []
    for n in map(ipaddress.ip_network, networks):
        first, bits = int(n.network_address), n.prefixlen
        if n.version == 4:
            first, bits = first | 0xFFFF << 32, bits + 96
        digits = -(-bits // 4)
        out += [f"{(first >> 4 * (32 - digits)) + i:0{digits}x}" if digits else "" for i in range(1 << 4 * digits - bits)]
    return sorted(set(out))


def inside(address: Column, networks: Iterable[str]) -> Column:
    """Whether a canonical address is in one of a few fixed networks."""
    by_length: dict[int, list[str]] = {}
    for b in blocks(networks):
        by_length.setdefault(len(b), []).append(b)
    out = F.lit(False)
    for n, many in by_length.items():
        out = out | F.substring(address, 1, n).isin(many)
    return F.coalesce(out, F.lit(False))


def ranged(addresses: DataFrame, ranges: DataFrame, address: str = "address") -> DataFrame:
    """Rows of addresses with each range (first, last: canonical, and its other columns) that holds them.

    A range becomes aligned blocks, some 30 at most for each hex digit in which its ends differ; keys are even, and AQE splits a block that holds most addresses.
    """

    def cut(first: str, last: str) -> list[str]:
        a, b, out = int(first, 16), int(last, 16), []
        while a <= b:
            digits = 0
            while digits < 32 and a % (16 << 4 * digits) == 0 and a + (16 << 4 * digits) - 1 <= b:
                digits += 1
            out.append(f"{a >> 4 * digits:0{32 - digits}x}" if digits < 32 else "")
            a += 1 << 4 * digits
        return out

    @F.udf("array<string>")
    def pieces(first, last):
        return cut(first, last) if first and last else []

    keyed = ranges.withColumn("_block", F.explode(pieces("first", "last"))).withColumn("_n", F.length("_block"))
    lengths = sorted(r[0] for r in keyed.select("_n").distinct().collect())  # 33 numbers at most
    rows = addresses.withColumn("_n", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>"))).withColumn("_block", F.substring(F.col(address), F.lit(1), F.col("_n")))
    return rows.join(keyed, ["_n", "_block"]).drop("_n", "_block")
