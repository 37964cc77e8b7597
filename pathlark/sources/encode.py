"""An encoder of MRT records and BGP messages, for tests and synthetic dumps (RFC 6396, 4271, 8050)."""

from __future__ import annotations

import struct
from collections.abc import Iterable

from ..functions.net import ip_bytes, parse_net


def nlri(text: str, path_id: int | None = None) -> bytes:
    net = parse_net(text)
    head = b"" if path_id is None else struct.pack(">I", path_id)
    return head + bytes([net.length]) + net.raw[: (net.length + 7) // 8]


def attr(code: int, value: bytes, flags: int = 0x40) -> bytes:
    if len(value) > 255:
        return struct.pack(">BBH", flags | 0x10, code, len(value)) + value
    return bytes([flags, code, len(value)]) + value


def path(*segs: list[int] | tuple[int, ...], wide: bool = True, code: int = 2) -> bytes:
    """AS_PATH: sequences as lists, sets as tuples."""
    out = b""
    for asns in segs:
        out += bytes([1 if isinstance(asns, tuple) else 2, len(asns)]) + struct.pack(f">{len(asns)}{'I' if wide else 'H'}", *asns)
    return attr(code, out)


def communities(*pairs: tuple[int, int]) -> bytes:
    return attr(8, b"".join(struct.pack(">HH", *p) for p in pairs), 0xC0)


def large(*triples: tuple[int, int, int]) -> bytes:
    return attr(32, b"".join(struct.pack(">III", *t) for t in triples), 0xC0)


def reach(hops: list[str], nets: list[str], afi: int = 2, safi: int = 1, ids: list[int] | None = None) -> bytes:
    raw = b"".join(map(ip_bytes, hops))
    body = b"".join(nlri(n, None if ids is None else ids[k]) for k, n in enumerate(nets))
    return attr(14, struct.pack(">HBB", afi, safi, len(raw)) + raw + b"\0" + body, 0x80)


def unreach(nets: list[str], afi: int = 2, safi: int = 1) -> bytes:
    return attr(15, struct.pack(">HB", afi, safi) + b"".join(map(nlri, nets)), 0x80)


def bgp(kind: int, body: bytes = b"") -> bytes:
    return b"\xff" * 16 + struct.pack(">HB", 19 + len(body), kind) + body


def update_body(announced: Iterable[bytes] = (), withdrawn: Iterable[bytes] = (), attrs: Iterable[bytes] = ()) -> bytes:
    w, a = b"".join(withdrawn), b"".join(attrs)
    return struct.pack(">H", len(w)) + w + struct.pack(">H", len(a)) + a + b"".join(announced)


def open_body(caps: Iterable[int], asn: int = 65001) -> bytes:
    raw = b"".join(bytes([c, 0]) for c in caps)
    params = bytes([2, len(raw)]) + raw
    return struct.pack(">BHH4sB", 4, asn, 180, b"\x0a\0\0\1", len(params)) + params


def record(secs: int, kind: int, sub: int, body: bytes) -> bytes:
    return struct.pack(">IHHI", secs, kind, sub, len(body)) + body


def session(secs: int, inner: bytes, peer: str = "10.0.0.2", asn: int = 65001, sub: int = 4, micros: int | None = None) -> bytes:
    """A BGP4MP (or, with micros, BGP4MP_ET) record; inner: a BGP message, or two states for subtypes 0 and 5."""
    wide, addr = sub in (4, 5, 7, 9, 11), ip_bytes(peer)
    head = struct.pack(">IIHH" if wide else ">HHHH", asn, 64512, 0, 1 if len(addr) == 4 else 2) + addr + bytes(len(addr))
    if micros is None:
        return record(secs, 16, sub, head + inner)
    return record(secs, 17, sub, struct.pack(">I", micros) + head + inner)


def zebra(secs: int, sub: int, inner: bytes, peer: str = "10.0.0.2", asn: int = 65001) -> bytes:
    local = b"" if sub == 3 else struct.pack(">H", 64512) + ip_bytes("10.0.0.1")
    return record(secs, 5, sub, struct.pack(">H", asn) + ip_bytes(peer) + local + inner)


def peer_table(peers: Iterable[tuple[str, int]], secs: int = 0, name: str = "", count: int | None = None) -> bytes:
    out = b""
    peers = list(peers)
    for addr, asn in peers:
        raw = ip_bytes(addr)
        out += bytes([(len(raw) == 16) | (asn > 0xFFFF) << 1]) + b"\x0a\0\0\x09" + raw + asn.to_bytes(4 if asn > 0xFFFF else 2, "big")
    return record(secs, 13, 1, b"\x0a\0\0\x01" + struct.pack(">H", len(name)) + name.encode() + struct.pack(">H", len(peers) if count is None else count) + out)


def rib(net: str, entries: Iterable[tuple], secs: int = 0, sub: int = 2, seq: int = 0) -> bytes:
    """A TABLE_DUMPV2 table record; entries: (peer index, originated, attribute bytes[, path id]). Generic subtypes name the family."""
    entries = list(entries)
    family = struct.pack(">HB", 1 if len(parse_net(net).raw) == 4 else 2, 1) if sub in (6, 12) else b""
    body = struct.pack(">I", seq) + family + nlri(net) + struct.pack(">H", len(entries))
    for idx, originated, attrs, *path_id in entries:
        body += struct.pack(">HI", idx, originated) + (struct.pack(">I", path_id[0]) if path_id else b"") + struct.pack(">H", len(attrs)) + attrs
    return record(secs, 13, sub, body)


def table_dump(net: str, attrs: bytes, peer: str = "10.0.0.2", asn: int = 65001, originated: int = 0, secs: int = 0) -> bytes:
    n, addr = parse_net(net), ip_bytes(peer)
    body = struct.pack(">HH", 0, 0) + n.raw + bytes([n.length, 1]) + struct.pack(">I", originated) + addr + struct.pack(">HH", asn, len(attrs)) + attrs
    return record(secs, 12, 1 if len(n.raw) == 4 else 2, body)
