"""Addresses and prefixes.

A prefix has a key: the family and the network's bits as text, such as "4:11000001" for 193.0.0.0/8. Equal
prefixes have equal keys, and one contains the other exactly if its key starts the other's, so
matching needs string functions only, for both families.
"""

from __future__ import annotations

import ipaddress
import socket
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4, IPV6 = 1, 2
PREFIX = "struct<afi:int,safi:int,path_id:bigint,len:int,net:binary,key:string,text:string>"


def ip_text(raw: bytes) -> str:
    """Text of 4 or 16 bytes. IPv6: the run of zero groups that is longest as written is left out; one group alone stays."""
    if len(raw) == 4:
        return socket.inet_ntoa(raw)
    text = socket.inet_ntop(socket.AF_INET6, raw)
    return _ipv6_text(raw) if text.startswith(("::", "0:0")) or ":0:0" in text else text  # only these can be written otherwise


@lru_cache(1 << 12)
def _ipv6_text(raw: bytes) -> str:
    if raw[:12] == b"\0" * 10 + b"\xff\xff":
        return "::ffff:" + ".".join(map(str, raw[12:]))
    groups = [int.from_bytes(raw[k : k + 2], "big") for k in range(0, 16, 2)]
    best, cut, k = 0, (0, 0), 0
    while k < 8:
        if groups[k]:
            k += 1
            continue
        end = k
        while end < 8 and not groups[end]:
            end += 1
        written = 2 * (end - k) + (k > 0) + (end < 8) - 1
        if end - k > 1 and written > best:
            best, cut = written, (k, end)
        k = end
    show = lambda part: ":".join(f"{g:x}" for g in part)
    return f"{show(groups[: cut[0]])}::{show(groups[cut[1] :])}" if best else show(groups)


def ip_bytes(text: str) -> bytes:
    """4 or 16 bytes of an address; ValueError if it isn't one."""
    try:
        return socket.inet_pton(socket.AF_INET6 if ":" in text else socket.AF_INET, text)
    except (OSError, TypeError, ValueError):  # zones, numbers, and what is no address
        return ipaddress.ip_address(text).packed


def masked(raw: bytes, length: int) -> bytes:
    bits = 8 * len(raw)
    return (int.from_bytes(raw, "big") >> (bits - length) << (bits - length)).to_bytes(len(raw), "big")


def key_of(raw: bytes, length: int) -> str:
    bits = 8 * len(raw)
    return f"{'4' if bits == 32 else '6'}:{f'{int.from_bytes(raw, 'big'):0{bits}b}'[:length]}"


@dataclass(frozen=True)
class Net:
    """A prefix literal."""

    raw: bytes
    length: int

    @property
    def key(self) -> str:
        return key_of(self.raw, self.length)

    def __str__(self) -> str:
        return f"{ip_text(self.raw)}/{self.length}"


def parse_net(text: str) -> Net:
    """addr[/len]; without a length that of the whole address; host bits are ignored."""
    addr, slash, size = text.partition("/")
    raw = ip_bytes(addr)
    if slash and not (size.isascii() and size.isdigit()):
        raise ValueError(f"bad prefix: {text!r}")
    length = int(size) if slash else 8 * len(raw)
    if length > 8 * len(raw):
        raise ValueError(f"bad prefix length: {text!r}")
    return Net(masked(raw, length), length)


# -- columns


def ipv4_text(number: Column) -> Column:
    """Dotted text of an IPv4 address held in a long."""
    return F.concat_ws(".", *[(F.shiftright(number, k) % 256).cast("string") for k in (24, 16, 8, 0)])


def ipv4_prefix(number: Column, length: Column, path_id: Column | None = None) -> Column:
    """A prefix struct (see PREFIX) from an address in a long, built in the JVM."""
    bits = (F.lit(32) - length).cast("int")
    net = F.call_function("shiftleft", F.call_function("shiftright", number.cast("long"), bits), bits)
    return F.struct(
        F.lit(IPV4).alias("afi"), F.lit(1).alias("safi"), (F.lit(None) if path_id is None else path_id).cast("long").alias("path_id"), length.cast("int").alias("len"),
        F.unhex(F.lpad(F.hex(net), 8, "0")).alias("net"), F.concat(F.lit("4:"), F.substring(F.lpad(F.bin(net), 32, "0"), F.lit(1), length.cast("int"))).alias("key"),
        F.concat(ipv4_text(net), F.lit("/"), length.cast("string")).alias("text"),
    )


def with_path_id(prefix: Column) -> Column:
    """A prefix as text, after its path id if it has one."""
    return F.concat_ws(" ", prefix["path_id"].cast("string"), prefix["text"])


def is_v4_mapped(addr: Column) -> Column:
    """Whether an address in bytes is an IPv4 address within IPv6 (::ffff:0:0/96)."""
    return (F.length(addr) == 16) & (F.substring(addr, 1, 12) == F.lit(bytes(10) + b"\xff\xff"))


def is_multicast(addr: Column) -> Column:
    """Whether an address in bytes is one of 224.0.0.0/4 or ff00::/8."""
    first = F.conv(F.hex(F.substring(addr, 1, 1)), 16, 10).cast("int")
    return F.when(F.length(addr) == 4, first.between(224, 239)).otherwise(first == 255)


def key_column(net: Column, length: Column) -> Column:
    """The key of a network in 4 or 16 bytes."""
    bits = lambda start, n: F.lpad(F.conv(F.hex(F.substring(net, start, n)), 16, 2), 8 * n, "0")
    four = F.concat(F.lit("4:"), F.substring(bits(1, 4), F.lit(1), length))
    six = F.concat(F.lit("6:"), F.substring(F.concat(bits(1, 8), bits(9, 8)), F.lit(1), length))
    return F.when(F.length(net) == 4, four).otherwise(six)
