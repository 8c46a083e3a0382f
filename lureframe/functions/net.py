"""IPv4/IPv6 expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from lureframe.functions.bind import bind

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"

# --- fixed values: address blocks that are not globally reachable, and the exceptions inside them ---
NOT_GLOBAL = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4",
)
GLOBAL_EXCEPTIONS = ("192.0.0.9/32", "192.0.0.10/32")
NOT_GLOBAL_V6 = (
    "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20",
    "fc00::/7", "fe80::/10",
)
GLOBAL_EXCEPTIONS_V6 = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
)
# --- end of fixed values ---


def is_ipv4(ip: str | Column) -> Column:
    return (F.col(ip) if isinstance(ip, str) else ip).rlike(IPV4)


def ipv4_long(ip: str | Column) -> Column:
    """Dotted quad to its number; null for anything else."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    part = lambda i: F.split(ip, r"\.").getItem(i).cast("long")
    value = part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3)
    return F.when(is_ipv4(ip), value)


def _within(value: Column, blocks: tuple[str, ...]) -> Column:
    nets = [ipaddress.ip_network(b) for b in blocks]
    hit = F.lit(False)
    for n in nets:
        hit = hit | value.between(int(n.network_address), int(n.broadcast_address))
    return hit


def ipv6_hex(ip: str | Column) -> Column:
    """Any IPv6 spelling to its 32 hex digits; null for anything else. Comparable as text."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    groups = lambda part: F.filter(F.split(part, ":", -1), lambda g: g != "")
    shaped = lambda full: F.forall(full, lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z"))
    padded = lambda full: F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), "")

    def unfold_quad(bare):
        # A dotted-quad tail is two more groups.
        two = lambda n: F.concat(F.substring(n, 1, 4), F.lit(":"), F.substring(n, 5, 4))
        tail = F.lpad(F.lower(F.hex(ipv4_long(F.substring_index(bare, ":", -1)))), 8, "0")
        return F.when(F.contains(bare, F.lit(".")), F.concat(F.regexp_replace(bare, r"[^:]*\z", ""), bind(tail, two))).otherwise(bare)

    def expand(plain):
        return bind(F.split(plain, "::", -1), lambda halves: bind(
            F.struct(
                groups(F.element_at(halves, 1)).alias("l"),
                F.when(F.size(halves) == 2, groups(F.element_at(halves, -1))).otherwise(F.array().cast("array<string>")).alias("r"),
                F.size(halves).alias("n"), plain.alias("p"),
            ),
            fill,
        ))

    def fill(h):
        have = F.size(h["l"]) + F.size(h["r"])
        complete = ((h["n"] == 1) & (have == 8)) | ((h["n"] == 2) & (have <= 7))
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - have, F.lit(0)))
        spelled = ~h["p"].rlike(r":::|\A:[^:]|[^:]:\z")
        return bind(F.concat(h["l"], zeros, h["r"]), lambda full: F.when(complete & spelled & shaped(full), padded(full)))

    bare = F.lower(F.regexp_replace(ip, "%.*", ""))
    return F.when(F.contains(ip, F.lit(":")), bind(bind(bare, unfold_quad), expand))


def _within_hex(value: Column, blocks: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for n in (ipaddress.ip_network(b) for b in blocks):
        hit = hit | value.between(f"{int(n.network_address):032x}", f"{int(n.broadcast_address):032x}")
    return hit


def is_global(ip: str | Column) -> Column:
    """Whether an address is globally reachable; null for text that is no address."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    v4_global = lambda n: ~_within(n, NOT_GLOBAL) | _within(n, GLOBAL_EXCEPTIONS)

    def v6_global(h):
        mapped = F.conv(F.substring(h, 25, 8), 16, 10).cast("long")
        return F.when(h.startswith("0" * 20 + "ffff"), bind(mapped, v4_global)).otherwise(
            ~_within_hex(h, NOT_GLOBAL_V6) | _within_hex(h, GLOBAL_EXCEPTIONS_V6)
        )

    return F.when(is_ipv4(ip), bind(ipv4_long(ip), v4_global)).when(
        F.contains(ip, F.lit(":")), bind(ipv6_hex(ip), v6_global)
    )
