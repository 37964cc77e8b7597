"""Decoding of BGP messages and path attributes, from bytes to plain values (RFC 4271, 4760, 6793, 7606, 7911)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from ..functions.names import AS_TRANS
from ..functions.net import IPV4, IPV6, ip_text

OPEN, UPDATE, NOTIFICATION, KEEPALIVE, ROUTE_REFRESH = 1, 2, 3, 4, 5
MARKER = b"\xff" * 16
WIDTH = {IPV4: 4, IPV6: 16}
SETS = (1,)


class BgpError(Exception):
    """Malformed data; its text is the error code of the row."""


def split_messages(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, body) of each message of a raw BGP stream."""
    at = 0
    while at < len(data):
        kind, body = message(data, at)
        yield kind, body
        at += 19 + len(body)


def message(data: bytes, at: int | None = None) -> tuple[int, bytes]:
    """(type, body) of one message of up to 65535 bytes: the whole of data, or that at a position."""
    left = len(data) - (at or 0)
    if left < 19:
        raise BgpError("TRUNCATED_MESSAGE")
    if not data.startswith(MARKER, at or 0):
        raise BgpError("BAD_MARKER")
    size, kind = struct.unpack_from(">HB", data, (at or 0) + 16)
    if size < 19 or size > left or at is None and size != left:
        raise BgpError("BAD_MESSAGE_LENGTH")
    return kind, data[(at or 0) + 19 : (at or 0) + size]


def prefixes(data: bytes, afi: int, safi: int, add_path: bool) -> list[dict]:
    """All prefixes of a field."""
    if afi not in WIDTH or safi not in (1, 2):
        raise BgpError("UNSUPPORTED_AFI_SAFI")
    width, at, out = WIDTH[afi], 0, []
    while at < len(data):
        path_id = None
        if add_path:
            if at + 4 > len(data):
                raise BgpError("TRUNCATED_PREFIX")
            path_id = int.from_bytes(data[at : at + 4], "big")
            at += 4
            if at >= len(data):
                raise BgpError("TRUNCATED_PREFIX")
        length = data[at]
        size = (length + 7) // 8
        if length > 8 * width:
            raise BgpError("BAD_PREFIX_WIDTH")
        if at + 1 + size > len(data):
            raise BgpError("TRUNCATED_PREFIX")
        out.append(prefix(data[at + 1 : at + 1 + size].ljust(width, b"\0"), length, safi, path_id))
        at += 1 + size
    return out


def prefix(raw: bytes, length: int, safi: int = 1, path_id: int | None = None) -> dict:
    width = len(raw)
    number, rest = int.from_bytes(raw, "big") >> 8 * width - length, 8 * width - length
    net, bits = (number << rest).to_bytes(width, "big"), f"{number:0{length}b}" if length else ""
    if width == 4:
        return {"afi": IPV4, "safi": safi, "path_id": path_id, "len": length, "net": net, "key": "4:" + bits, "text": f"{ip_text(net)}/{length}"}
    return {"afi": IPV6, "safi": safi, "path_id": path_id, "len": length, "net": net, "key": "6:" + bits, "text": f"{ip_text(net)}/{length}"}


def attributes(data: bytes) -> dict[int, bytes]:
    """Attributes by code, in order. Of a repeated one the first counts; repeated MP attributes are an error."""
    found: dict[int, bytes] = {}
    at = 0
    while at < len(data):
        if at + 3 > len(data):
            raise BgpError("TRUNCATED_ATTRIBUTE")
        flags, code, head = data[at], data[at + 1], 4 if data[at] & 0x10 else 3
        if at + head > len(data):
            raise BgpError("TRUNCATED_ATTRIBUTE")
        size = int.from_bytes(data[at + 2 : at + head], "big")
        if at + head + size > len(data):
            raise BgpError("TRUNCATED_ATTRIBUTE")
        if code in found and code in (14, 15):
            raise BgpError("DUPLICATE_MP_ATTRIBUTE")
        found.setdefault(code, data[at + head : at + head + size])
        at += head + size
    return found


def segments(data: bytes, wide: bool) -> list[dict]:
    """Segments of an AS path."""
    size, at, out = 4 if wide else 2, 0, []
    while at < len(data):
        if at + 2 > len(data) or at + 2 + data[at + 1] * size > len(data):
            raise BgpError("BAD_AS_PATH")
        n = data[at + 1]
        out.append({"type": data[at], "asns": list(struct.unpack_from(f">{n}{'I' if wide else 'H'}", data, at + 2))})
        at += 2 + n * size
    return out


def merged_path(attrs: dict[int, bytes], wide: bool) -> list[dict]:
    """AS_PATH, its end replaced by AS4_PATH where both aggregators and the latter exist. A set counts as one."""
    own = segments(attrs.get(2, b""), wide)
    if not {7, 18, 17} <= attrs.keys():
        return own
    if len(attrs[18]) != 8:
        raise BgpError("BAD_AGGREGATOR")
    new = segments(attrs[17], True)
    units = lambda segs: sum(1 if s["type"] in SETS else len(s["asns"]) for s in segs)
    left = units(own) - units(new)
    if left < 0:
        return own
    out = []
    for s in own:
        if left <= 0:
            break
        if s["type"] in SETS:
            out.append(s)
            left -= 1
        else:
            out.append({"type": s["type"], "asns": s["asns"][:left]})
            left -= len(s["asns"])
    return out + new


def aggregator(attrs: dict[int, bytes], wide: bool) -> dict | None:
    """AGGREGATOR, or AS4_AGGREGATOR if the former only has AS_TRANS."""
    raw = attrs.get(7)
    if raw is None:
        return None
    if len(raw) != (8 if wide else 6):
        raise BgpError("BAD_AGGREGATOR")
    asn = int.from_bytes(raw[:-4], "big")
    if asn == AS_TRANS and 18 in attrs:
        raw = attrs[18]
        if len(raw) != 8:
            raise BgpError("BAD_AGGREGATOR")
        asn = int.from_bytes(raw[:4], "big")
    return {"asn": asn, "addr": ip_text(raw[-4:])}


def _addresses(raw: bytes, afi: int) -> list[str]:
    """Next hops; a route distinguisher before an address isn't expected for unicast and multicast."""
    width = WIDTH.get(afi, 0)
    if not width or not raw or len(raw) % width or len(raw) > 2 * width:
        raise BgpError("BAD_NEXT_HOP")
    return [ip_text(raw[k : k + width]) for k in range(0, len(raw), width)]


def reach(value: bytes, add_path: bool) -> tuple[list[str], list[dict]]:
    """(next hops, prefixes) of MP_REACH_NLRI."""
    if len(value) < 5 or 5 + value[3] > len(value):
        raise BgpError("BAD_MP_REACH")
    afi, safi, n = struct.unpack_from(">HBB", value)
    return _addresses(value[4 : 4 + n], afi), prefixes(value[5 + n :], afi, safi, add_path)


def unreach(value: bytes, add_path: bool) -> list[dict]:
    """Prefixes of MP_UNREACH_NLRI."""
    if len(value) < 3:
        raise BgpError("BAD_MP_UNREACH")
    return prefixes(value[3:], int.from_bytes(value[:2], "big"), value[2], add_path)


def _strides(raw: bytes | None, size: int) -> list[bytes]:
    if raw is None:
        return []
    if len(raw) % size:
        raise BgpError("BAD_COMMUNITIES")
    return [raw[k : k + size] for k in range(0, len(raw), size)]


def _numbers(raw: bytes, n: int) -> Iterator[tuple[int, ...]]:
    """Groups of n 32-bit numbers."""
    if len(raw) % (4 * n):
        raise BgpError("BAD_COMMUNITIES")
    return struct.iter_unpack(f">{n}I", raw)


def _origin(attrs: dict[int, bytes]) -> int | None:
    if 1 not in attrs:
        return None
    if len(attrs[1]) != 1 or attrs[1][0] > 2:
        raise BgpError("BAD_ORIGIN")
    return attrs[1][0]


#: What each column from path attributes is made of.
VALUES = {
    "origin": lambda attrs, wide: _origin(attrs),
    "aggregator": aggregator,
    "communities": lambda attrs, wide: [x for x, in _numbers(attrs.get(8, b""), 1)],
    "large_communities": lambda attrs, wide: [{"global": a, "local1": b, "local2": c} for a, b, c in _numbers(attrs.get(32, b""), 3)],
    "ext_communities": lambda attrs, wide: _strides(attrs.get(16), 8),
}


def route_columns(attrs: dict[int, bytes], wide: bool, want: set[str] | None) -> dict:
    """The columns that come from path attributes; only the wanted ones are decoded. A value that can't be read is null,
    and `error` has the code of the first such one."""
    row: dict = {"attr_codes": list(attrs), "atomic": 6 in attrs}
    try:
        if want is None or "as_path" in want or "as_path_segs" in want:
            row["as_path_segs"] = merged_path(attrs, wide)
            row["as_path"] = [a for s in row["as_path_segs"] for a in s["asns"]]
    except BgpError as e:
        row["error"] = str(e)
    for name, make in VALUES.items():
        if want is None or name in want:
            try:
                row[name] = make(attrs, wide)
            except BgpError as e:
                row.setdefault("error", str(e))
    return row


def _next_hop(attrs: dict[int, bytes], row: dict) -> list[str]:
    """The addresses of NEXT_HOP; none, and an error of the row, if it can't be read."""
    try:
        return _addresses(attrs[3], IPV4) if 3 in attrs else []
    except BgpError as e:
        row.setdefault("error", str(e))
        return []


def update(body: bytes, wide: bool, add_path: bool, want: set[str] | None = None) -> dict:
    """Columns of an UPDATE."""
    if len(body) < 4:
        raise BgpError("TRUNCATED_UPDATE")
    n = int.from_bytes(body[:2], "big")
    if 4 + n > len(body):
        raise BgpError("BAD_WITHDRAWN_LENGTH")
    m = int.from_bytes(body[2 + n : 4 + n], "big")
    if 4 + n + m > len(body):
        raise BgpError("BAD_ATTRIBUTES_LENGTH")
    attrs = attributes(body[4 + n : 4 + n + m])
    row = route_columns(attrs, wide, want)
    row["withdrawn"] = prefixes(body[2 : 2 + n], IPV4, 1, add_path)
    row["announced"] = prefixes(body[4 + n + m :], IPV4, 1, add_path)
    hops = _next_hop(attrs, row)
    if 14 in attrs:
        more, new = reach(attrs[14], add_path)
        hops, row["announced"] = hops + more, row["announced"] + new
    if 15 in attrs:
        row["withdrawn"] = row["withdrawn"] + unreach(attrs[15], add_path)
    return row | {"next_hops": hops}


def rib_entry(net: dict, attr_data: bytes, wide: bool, want: set[str] | None = None, drop_foreign: bool = False) -> dict:
    """Columns of a table entry, as an UPDATE that announces its one prefix.

    MP_REACH_NLRI may be in its short form (next hop only) or whole; MP_UNREACH_NLRI has no effect
    but stays a known attribute. drop_foreign: an MP_REACH_NLRI of another family is left out.
    """
    attrs = attributes(attr_data)
    hops, value = [], attrs.get(14)
    if value is not None:
        afi, raw = net["afi"], None
        if value and value[0] == len(value) - 1:
            raw = value[1:]
        elif len(value) >= 5 and 4 + value[3] <= len(value):
            afi, raw = int.from_bytes(value[:2], "big"), value[4 : 4 + value[3]]
        else:
            raise BgpError("BAD_MP_REACH")
        if afi != net["afi"] and drop_foreign:
            del attrs[14]
        else:
            hops = _addresses(raw, afi)
    if net["afi"] == IPV6 and 14 not in attrs:
        raise BgpError("MISSING_MP_REACH")
    row = route_columns(attrs, wide, want)
    return row | {"announced": [net], "withdrawn": [], "next_hops": _next_hop(attrs, row) + hops}


def open_capabilities(body: bytes) -> list[int]:
    """Codes of the capabilities of an OPEN."""
    if len(body) < 10 or 10 + body[9] > len(body):
        raise BgpError("TRUNCATED_OPEN")
    at, end, out = 10, 10 + body[9], []
    while at < end:
        if at + 2 > end or at + 2 + body[at + 1] > end:
            raise BgpError("BAD_OPEN_PARAMETER")
        kind, stop = body[at], at + 2 + body[at + 1]
        at += 2
        while kind == 2 and at < stop:
            if at + 2 > stop or at + 2 + body[at + 1] > stop:
                raise BgpError("BAD_CAPABILITY")
            out.append(body[at])
            at += 2 + body[at + 1]
        at = stop
    return out


def any_message(kind: int, body: bytes, wide: bool, add_path: bool, want: set[str] | None = None) -> dict:
    """Columns of a message of any type."""
    if kind == UPDATE:
        return update(body, wide, add_path, want)
    if kind == OPEN:
        return {"capabilities": open_capabilities(body)}
    if kind == NOTIFICATION:
        if len(body) < 2:
            raise BgpError("TRUNCATED_NOTIFICATION")
        return {"notify_code": body[0], "notify_subcode": body[1]}
    return {}
