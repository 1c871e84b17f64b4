"""Internet addresses of both families as one kind of text that sorts as the addresses do: 32 hex digits, IPv4 mapped into IPv6."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks that count as internal unless told otherwise.
INTERNAL_NETWORKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "fc00::/7", "fe80::/10", "::1/128")

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = rf"(?:{OCTET}\.){{3}}{OCTET}"
MAPPED = "0" * 20 + "ffff"


def _dotted_hex(c: Column) -> Column:
    """Eight hex digits of a dotted IPv4 address."""
    return F.lower(F.array_join(F.transform(F.split(c, r"\."), lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))


def _groups(c: Column) -> Column:
    """Groups of one side of a "::" as four digits each; no text has none."""
    return F.transform(F.array_remove(F.split(c, ":"), ""), lambda g: F.lpad(g, 4, "0"))


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def address(c: Column) -> Column:
    """The 32 hex digits of an IPv4 or IPv6 address (its zone left out), null for other text, padded text among it."""

    def six(low: Column) -> Column:
        shaped = low.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$")
        sides = F.struct(_groups(F.split(low, "::")[0]).alias("left"), F.coalesce(_groups(F.get(F.split(low, "::"), F.lit(1))), F.array().cast("array<string>")).alias("right"), low.contains("::").alias("gap"))
        return F.when(shaped, let(sides, whole))

    def whole(s: Column) -> Column:
        missing = 8 - F.size(s["left"]) - F.size(s["right"])
        zeros = F.array_repeat(F.lit("0000"), F.greatest(missing, F.lit(0)))
        return F.when(F.when(s["gap"], missing >= 1).otherwise(missing == 0), F.array_join(F.concat(s["left"], zeros, s["right"]), ""))

    def either(t: Column) -> Column:
        mixed = let(_dotted_hex(F.regexp_extract(t, rf":({DOTTED})$", 1)), lambda d: F.concat(F.regexp_replace(t, rf"{DOTTED}$", ""), F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4)))
        low = F.lower(F.when(t.rlike(rf":{DOTTED}$"), mixed).otherwise(t))
        return F.when(t.rlike(rf"^{DOTTED}$"), F.concat(F.lit(MAPPED), _dotted_hex(t))).when(t.contains(":"), let(low, six))

    return let(F.regexp_replace(c, "^([^%]*:[^%]*)%[^%]+$", "$1"), either)


def plain(digits: Column) -> Column:
    """The usual spelling of ``address``: dotted where it is IPv4, else the shortest form of IPv6."""

    def spelled(d: Column) -> Column:
        octets = [F.conv(F.substring(d, 25 + 2 * i, 2), 16, 10) for i in range(4)]
        groups = F.concat_ws(":", *[F.regexp_replace(F.substring(d, 1 + 4 * i, 4), "^0{1,3}", "") for i in range(8)])
        return F.when(d.startswith(MAPPED), F.concat_ws(".", *octets)).when(d.isNotNull(), let(groups, short))

    def short(groups: Column) -> Column:
        # the first of the longest runs of zero groups, two at least, is left out
        zeros = lambda n: rf"(^|:)0(?::0){{{n - 1}}}(?=:|$)"
        out = F.coalesce(*[F.when(groups.rlike(zeros(n)), F.regexp_replace(groups, f"^((?:(?!{zeros(n)}).)*){zeros(n)}", "$1::")) for n in range(8, 1, -1)], groups)
        return F.regexp_replace(out, ":{3,}", "::")

    return let(digits, spelled)


def inside(digits: Column, networks: Sequence[str]) -> Column:
    """Whether an address lies in one of ``networks``, which become intervals, joined where they overlap."""
    spans = []
    for n in (ipaddress.ip_network(x, strict=False) for x in networks):
        text = lambda a, v=n.version: f"{(0xFFFF << 32 | int(a)) if v == 4 else int(a):032x}"
        spans.append((text(n.network_address), text(n.broadcast_address)))
    out = F.lit(False)
    for lo, hi in _merged(spans):
        out = out | digits.between(lo, hi)
    return out


def _merged(spans: list[tuple[str, str]]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def kind(c: Column, networks: Sequence[str] = INTERNAL_NETWORKS) -> Column:
    """internal, external or invalid, of either family; IPv4 also where it is mapped into IPv6."""
    return let(address(c), lambda d: F.when(d.isNull(), "invalid").when(inside(d, networks), "internal").otherwise("external"))
