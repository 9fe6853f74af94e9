"""Which URLs may be fetched: private and local addresses are blocked."""

from __future__ import annotations

import ipaddress
import re
import socket
import urllib.parse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Blocked networks (fixed values).
BLOCKED = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16",
    "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4",
    "::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8",
)
_NETWORKS = [ipaddress.ip_network(x) for x in BLOCKED]


def _number(part: str) -> int:
    """A part of an IPv4 host: decimal, octal after 0, hexadecimal after 0x."""
    if part.startswith("0x"):
        return int(part[2:] or "0", 16)
    return int(part, 8) if part.startswith("0") and len(part) > 1 else int(part)


def address(host: str | None) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    """The address that a host spells in any form that resolvers take: fewer than
    four parts, octal and hexadecimal parts, IPv6 in brackets, with IPv4 inside."""
    if not host:
        return None
    try:
        if host.startswith("["):
            found = ipaddress.IPv6Address(host.strip("[]").partition("%")[0])
            inner = found.ipv4_mapped or found.sixtofour or (found.teredo or (None, None))[1]
            if inner is None and int(found) >> 32 in (0, 0x64FF9B0000000000000000):  # compatible, NAT64
                inner = ipaddress.IPv4Address(int(found) & 0xFFFFFFFF) if int(found) > 1 else None
            return inner or found
        if not re.fullmatch(r"(0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]+)){0,3}\.?", host):
            return None
        *first, last = map(_number, host.rstrip(".").split("."))
        if any(x > 255 for x in first) or last >= 1 << 8 * (4 - len(first)):
            return None
        return ipaddress.IPv4Address(sum(x << 8 * (3 - k) for k, x in enumerate(first)) + last)
    except ValueError:
        return None


@F.pandas_udf(StructType().add("ip", "long").add("literal", "boolean").add("blocked", "boolean"))
def _told(hosts: pd.Series) -> pd.DataFrame:
    """The number of a literal IPv4 host, whether the host is an address (or
    looks like one), and whether it must not be fetched from."""

    def one(host):
        found = address(host)
        if found is None:
            looks = bool(host and (host.startswith("[") or re.fullmatch(r"[0-9.]+|0x.*", host)))
            return None, looks, looks  # what looks like an address and is none is blocked
        return (int(found) if found.version == 4 else None), True, any(found in n for n in _NETWORKS if n.version == found.version)

    return pd.DataFrame([one(h) for h in hosts], columns=["ip", "literal", "blocked"]).astype({"ip": "Int64"})


def safe(urls: DataFrame, url: str = "url", allow: tuple[str, ...] = ()) -> DataFrame:
    """``urls`` plus host, ip (number of a literal IPv4 host) and safe."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)", 1)), F.lit(""))
    scheme = F.lower(F.regexp_extract(url, r"(?i)^([a-z][a-z0-9+.-]*):", 1)).isin("http", "https")
    rows = urls.withColumn("host", host).withColumn("_told", _told("host"))
    named = F.col("host").isNotNull() & ~F.col("host").isin("localhost") & ~F.col("host").rlike(r"\.(local|localhost|internal)\.?$")
    allowed = F.col("host").isin(*allow) if allow else F.lit(False)
    told = F.coalesce(scheme, F.lit(False)) & (F.coalesce(allowed, F.lit(False)) | F.coalesce(named & ~F.col("_told.blocked"), F.lit(False)))
    return rows.withColumn("ip", F.col("_told.ip")).withColumn("safe", told).drop("_told")


def outside(url: str) -> bool:
    """Whether every address that a URL's host resolves to may be fetched from."""
    parts = urllib.parse.urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        return False
    try:
        found = socket.getaddrinfo(parts.hostname, None, proto=socket.IPPROTO_TCP)
    except OSError:
        return False
    spelled = [f"[{x[4][0]}]" if x[0] == socket.AF_INET6 else x[4][0] for x in found]
    return all((a := address(s)) is not None and not any(a in n for n in _NETWORKS if n.version == a.version) for s in spelled)
