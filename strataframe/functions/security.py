"""Which image sources may be read: addresses, domains, paths."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IPv4 ranges that aren't public, and names of this machine.
PRIVATE = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
)
LOCAL_NAMES = ("localhost", "localhost.localdomain", "0.0.0.0", "::1")
IPV4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"


def ipv4(host: Column) -> Column:
    """An address as a number; null for anything else."""
    parts = [F.regexp_extract(host, IPV4, k).cast("bigint") for k in range(1, 5)]
    number = parts[0] * 2**24 + parts[1] * 2**16 + parts[2] * 2**8 + parts[3]
    return F.when(host.rlike(IPV4) & (F.greatest(*parts) < 256), number)


def _bounds(block: str) -> tuple[int, int]:
    address, bits = block.split("/")
    low = sum(int(p) << 8 * k for k, p in zip((3, 2, 1, 0), address.split(".")))
    return low, low + 2 ** (32 - int(bits)) - 1


def is_private(host: Column) -> Column:
    def inside(number: Column) -> Column:
        return reduce(or_, (number.between(*_bounds(b)) for b in PRIVATE))

    return F.coalesce(F.exists(F.array(ipv4(host)), inside), F.lit(False)) | F.lower(host).isin(*LOCAL_NAMES)


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), HOST, 1)


def domain_allowed(host: Column, patterns: Sequence[str]) -> Column:
    """Whether a host is on the list; ``*.base`` is the base and what ends in a dot and the base."""
    allowed = F.lit(False)
    for p in patterns:
        base = p.lower().removeprefix("*.")
        allowed = allowed | (F.lower(host) == base)
        if p.startswith("*."):
            allowed = allowed | F.lower(host).endswith("." + base)
    return allowed


def source_verdict(src: Column, patterns: Sequence[str] = (), remote: bool = False) -> Column:
    """``ok`` or the reason why a source is refused, in the order of the tests."""
    host = host_of(src)
    return (
        F.when(F.coalesce(F.trim(src), F.lit("")) == "", "empty")
        .when(F.lower(src).startswith("data:image/"), "ok")
        .when(F.lower(src).startswith("data:"), "not an image")
        .when(F.lower(src).startswith("asset://"), "ok")
        .when(F.lower(src).startswith("file:"), "file urls are refused")
        .when(~src.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(src.rlike(r"(^|/)\.\.(/|$)") | src.startswith("/"), "outside the root").otherwise("ok"))
        .when(~F.lower(src).rlike(r"^https?://"), "unknown scheme")
        .when(F.lit(not remote), "remote sources are off")
        .when(is_private(host), "private address")
        .when(F.lit(bool(patterns)) & ~domain_allowed(host, patterns), "domain not allowed")
        .otherwise("ok")
    )


def contained(path: str, root: str) -> bool:
    """Whether a path stays below a root once dots are resolved."""
    root = posixpath.normpath(root)
    full = posixpath.normpath(posixpath.join(root, path.replace("\\", "/")))
    return full == root or full.startswith(root.rstrip("/") + "/")


def verified(path: str, pins: Mapping[str, str]) -> bool:
    """Whether a model file has the SHA-256 that is pinned for its name; files without a pin are trusted."""
    name = posixpath.basename(path)
    if name not in pins:
        return True
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest() == pins[name].lower()
