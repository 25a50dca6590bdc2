"""Is an address in one of the allowed ranges?

The list becomes sorted disjoint intervals of addresses, one structure for
IPv4 and IPv6 and for any length of the list. An address is parsed to a key
(version, upper and lower 64 bits) by expressions, and the key's interval is
found by halving, within the row: no join, no Python, no second look at the
rows. The list is configuration, so the driver holds it; it travels as one
folded literal.
"""

from __future__ import annotations

import ipaddress
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywatch.functions.scalars import ipv4_to_long

_KEYS = "array<struct<v:int,hi:bigint,lo:bigint>>"
_SIGN = -(1 << 63)


def intervals(ranges: list[str]) -> list[tuple[int, int, int]]:
    """(version, first, last) of the ranges, in order, none touching another; a bare address is a range of one."""
    nets = [ipaddress.ip_network(r.strip(), strict=False) for r in ranges]
    out: list[tuple[int, int, int]] = []
    for v, a, b in sorted((n.version, int(n.network_address), int(n.broadcast_address)) for n in nets):
        if out and out[-1][0] == v and a <= out[-1][2] + 1:
            out[-1] = (v, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((v, a, b))
    return out


def _hex(n: Column) -> Column:
    return F.lower(F.hex(n))


def ipv6_digits(ip: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address text; NULL if it is none.

    A zone (``%eth0``) is left out, a dotted tail is read as two groups, ``::`` stands for one group or more."""
    text = F.when(~ip.contains("%"), ip).when(ip.rlike("^[^%]+%[^%]+$"), F.substring_index(ip, "%", 1))
    # the dotted tail as two groups; without one, the text as it is
    tail = F.substring_index(text, ":", -1)
    number = ipv4_to_long(tail)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
    text = F.when(~tail.contains("."), text).otherwise(F.concat(head, _hex(F.shiftright(number, 16)), F.lit(":"), _hex(number.bitwiseAND(0xFFFF))))
    sides = F.split(text, "::")
    groups = lambda i: F.when(F.get(sides, F.lit(i)) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(sides, F.lit(i)), ":"))
    left, right = groups(0), F.when(F.size(sides) == 2, groups(1)).otherwise(F.array().cast("array<string>"))
    n = F.size(left) + F.size(right)
    whole = F.when(F.size(sides) == 1, n == 8).otherwise((F.size(sides) == 2) & (n <= 7))
    all_groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - n, F.lit(0))), right)
    fine = whole & F.forall(all_groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
    return F.when(fine, F.lower(F.array_join(F.transform(all_groups, lambda g: F.lpad(g, 4, "0")), "")))


def _bits(digits: Column, at: int) -> Column:
    """16 hexadecimal digits from ``at`` as the long that sorts like the unsigned number."""
    half = lambda k: F.conv(F.substring(digits, k, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(at), 32).bitwiseOR(half(at + 8)).bitwiseXOR(F.lit(_SIGN).cast("bigint"))


def _key(version: int, hi: Column, lo: Column) -> Column:
    return F.struct(F.lit(version).alias("v"), hi.alias("hi"), lo.alias("lo"))


def address_key(ip: Column) -> Column:
    """(v, hi, lo) of an address text; NULL if it is none. An IPv4 address written as IPv6 (``::ffff:…``) counts as IPv4."""
    v4 = lambda n: F.when(n.isNotNull(), _key(4, F.lit(0).cast("bigint"), n))

    def of_digits(digits: Column) -> Column:
        mapped = F.when(F.startswith(digits, F.lit("0" * 20 + "ffff")), F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint"))
        return F.when(mapped.isNotNull(), v4(mapped)).when(digits.isNotNull(), _key(6, _bits(digits, 1), _bits(digits, 17)))

    # bound as the variable of a one-element array, so that the text is parsed once
    v6 = F.element_at(F.transform(F.array(ipv6_digits(ip)), of_digits), 1)
    return F.when(ip.contains(":"), v6).otherwise(v4(ipv4_to_long(ip)))


def _literal(bounds: list[tuple[int, int]]) -> Column:
    """Keys of (version, address) pairs as one constant."""
    rows = [{"v": v, "hi": 0, "lo": n} if v == 4 else {"v": v, "hi": (n >> 64) + _SIGN, "lo": (n & ((1 << 64) - 1)) + _SIGN} for v, n in bounds]
    return F.from_json(F.lit(json.dumps(rows)), _KEYS)


def in_ranges(ip: Column, ranges: list[str]) -> Column:
    """Whether the address lies in one of the ranges; false for texts that are no address and for NULL."""
    known = intervals(ranges)
    if not known:
        return F.lit(False)
    firsts, lasts = _literal([(v, a) for v, a, _ in known]), _literal([(v, b) for v, _, b in known])

    def found(key: Column) -> Column:
        # below: an interval that starts at or before the key (-1: none yet); above: one that starts after it
        def halved(state: Column, _: Column) -> Column:
            middle = F.floor((state["below"] + state["above"]) / 2).cast("int")
            inside = (middle >= 0) & (F.get(firsts, middle) <= key)
            return F.struct(F.when(inside, middle).otherwise(state["below"]).alias("below"), F.when(inside, state["above"]).otherwise(F.greatest(middle, F.lit(0))).alias("above"))

        start = F.struct(F.lit(-1).alias("below"), F.lit(len(known)).alias("above"))
        at = F.aggregate(F.sequence(F.lit(1), F.lit(len(known).bit_length())), start, halved, lambda s: s["below"])
        return F.coalesce(key <= F.get(lasts, at), F.lit(False))

    return F.coalesce(F.element_at(F.transform(F.array(address_key(ip)), found), 1), F.lit(False))


def outside_ranges(df: DataFrame, ip_col: str, ranges: list[str]) -> DataFrame:
    """Rows whose address is in none of the ranges. A text that is no address (a service host name) is in no range,
    so its row stays; an empty list keeps every row."""
    return df.where(~in_ranges(F.col(ip_col), ranges)) if ranges else df
