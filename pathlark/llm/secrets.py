r"""Secret scans with a recursive decoding worklist.

Every text is scanned by the base rules (assignments, access keys, long hex runs). Then parts
that decode (lines with URL escapes; lines with \\u, \\x or &# escapes; base64; gzip, zlib, bz2 or xz, all members, inside base64 or escaped) become new
layers on a worklist, are scanned by the same rules and unwrapped again, until nothing new comes
out. A layer whose text came out of the same part of the document before isn't taken again (cycle
detection). Every
decoded character knows the part of the document that it comes from, so spans of any layer are
spans of the document, in code points; what lies within compressed data maps to the whole blob.

Base64 that goes on over line breaks is taken as one blob, and each of its lines alone. A stream that isn't whole
is reported as ``truncated``; what came out of it is scanned.

A stream that inflates to more than ``max_layer_chars`` bytes is reported as ``oversized``, and inflated, scanned and
unwrapped in pieces of that many bytes that overlap by ``OVERLAP``, so memory stays bounded. All its spans are those of the whole
blob; what is longer than the overlap and crosses from piece to piece is seen in parts. Kinds of spans in layers are written
``kind@layer+layer``. Bytes are read as UTF-8, with replacement of what is not, and as UTF-16 if a mark or zero bytes say so; they
are left out only if they have no run of 12 ASCII characters, as no rule matches less. A layer's span is left out if the same kind already has that very span.

Nulls: a null text is empty and has no spans. Each row stands alone: repeated rows, ties, null ids and
empty tables need no rule. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

KINDS = ("assign", "access", "hex", "oversized", "truncated")
MAX_LAYER_CHARS, OVERLAP, LARGE = 16 << 20, 1 << 16, 1 << 20
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long"

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_URL = re.compile(r"^.*%[0-9A-Fa-f]{2}.*$", re.MULTILINE)
_PERCENT, _PERCENT_PLUS = re.compile(r"(?:%[0-9A-Fa-f]{2})+"), re.compile(r"(?:%[0-9A-Fa-f]{2})+|\+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_ESCAPED = re.compile(r"^.*(?:\\[uUx]|&#).*$", re.MULTILINE)
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
# runs that go on over line breaks: up to the last line, each is the whole rest of its line
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{1,15}[ \t]*+\r?\n[ \t]*+)?[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+={0,2}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]+")
_MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\0")
_BYTE = re.compile(_ESCAPE.pattern + r"|\\([abfnrtv0\\'\"])")
_SHORT = dict(zip("abfnrtv0", "\a\b\f\n\r\t\v\0"))
# no rule and no encoding is shorter; each is ASCII
_RULE_RUN = re.compile(r"[\t\n\r\x20-\x7e]{12}")
_UTF16_LE, _UTF16_BE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){12}"), re.compile(rb"(?:\0[\t\n\r\x20-\x7e]){12}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base rules, leftmost and non-overlapping for each kind."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def _engine(raw: bytes):
    """(layer, decompressor) of what bytes begin with, or None."""
    if raw[:2] == b"\x1f\x8b":
        return "gzip", zlib.decompressobj(31)
    if raw[:1] == b"\x78" and len(raw) > 2 and not int.from_bytes(raw[:2], "big") % 31:
        return "zlib", zlib.decompressobj()
    if raw[:3] == b"BZh":
        return "bz2", bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\0":
        return "xz", lzma.LZMADecompressor()
    return None


class _All:
    """Maps every position to the same one."""

    __slots__ = ("at",)

    def __init__(self, at: int):
        self.at = at

    def __getitem__(self, k: int) -> int:
        return self.at


def _in_pieces(raw: bytes, size: int):
    """What a stream of compressed bytes inflates to, all members of its kind, in overlapping pieces of `size` bytes."""
    kind, found, tail = None, _engine(raw), b""
    while found is not None and kind in (None, found[0]):
        kind, engine = found
        while not engine.eof:
            try:
                data = engine.decompress(raw, size)
            except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                return
            raw = engine.unconsumed_tail if hasattr(engine, "unconsumed_tail") else b""
            if not data and not engine.eof:
                return
            yield tail + data
            tail = (tail + data)[-OVERLAP:]
        raw = engine.unused_data.lstrip(b"\0")
        found = _engine(raw)


def _inflate(raw: bytes, limit: int) -> tuple[str, bytes, str | None, bytes] | None:
    """(layer, data, mark, what follows) of compressed bytes, all members of one kind; the mark says why data isn't
    all of it; None if they aren't compressed."""
    name, parts, size, mark = None, [], 0, None
    while mark is None and (found := _engine(raw)) is not None and name in (None, found[0]):
        engine = found[1]
        try:
            data = engine.decompress(raw, limit - size + 1)
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            break
        if len(data) > limit - size:
            name, mark, raw = found[0], "oversized", b""
            break
        if not data and not engine.eof:
            break
        name, mark = found[0], None if engine.eof else "truncated"
        parts.append(data)
        size += len(data)
        raw = engine.unused_data.lstrip(b"\0") if engine.eof else b""
    return (name, b"".join(parts), mark, raw) if name else None


def _unwrapped(raw: bytes, name: str, limit: int):
    """What bytes hold: (layers, bytes, mark). Streams are inflated again and again, and what follows a stream is taken by itself."""
    work, seen = deque([(raw, name)]), set()
    while work:
        raw, name = work.popleft()
        if (key := hashlib.sha1(raw).digest()) in seen:
            continue
        seen.add(key)
        if (inner := _inflate(raw, limit)) is None:
            yield name, raw, None
            continue
        kind, data, mark, rest = inner
        if mark:
            yield f"{name}+{kind}", b"", mark
        if mark == "oversized":
            for piece in _in_pieces(raw, limit):
                yield f"{name}+{kind}", piece, None
            continue
        work += [x for x in ((data, f"{name}+{kind}"), (rest, name)) if x[0]]


def _streams(line: str, at: int, pattern: re.Pattern, decode, name: str, limit: int):
    """Layers of compressed bytes that stand escaped in a line."""
    new, starts, ends = _replaced(line, at, pattern, decode)
    raw, done = new.encode("latin-1", "replace"), 0
    for m in _MAGIC.finditer(raw):
        if m.start() < done or (inner := _inflate(raw[m.start() :], limit)) is None:
            continue
        done = len(raw) - len(inner[3])
        begin, end = starts[m.start()], ends[done - 1]
        for names, part, why in _unwrapped(raw[m.start() : done], name, limit):
            if why:
                yield f"{why}@{names}", None, _All(begin), _All(end)
            for plain in _readable(part):
                yield names, plain, _All(begin), _All(end)


def _readable(data: bytes) -> list[str]:
    """The texts that bytes may stand for; none if no run in them is long enough for a rule."""
    found = []
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        found.append(data.decode("utf-16", "replace"))
    elif b"\0" in data:
        little, big = _UTF16_LE.search(data), _UTF16_BE.search(data)
        if little and (not big or little.start() < big.start()):
            found.append(data[little.start() % 2 :].decode("utf-16-le", "replace"))
        elif big:
            found.append(data[big.start() % 2 :].decode("utf-16-be", "replace"))
    found.insert(0, data.decode("utf-8", "replace"))
    if found[0].isprintable() and "\ufffd" not in found[0]:
        return found if data else []
    return [x for x in found if _RULE_RUN.search(x)]


def _unescape(m: re.Match) -> str:
    k = m.lastindex
    code = int(m[k], 10 if k == 5 else 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


def _percent_bytes(m: re.Match) -> str:
    return m[0] if m[0] == "+" else bytes.fromhex(m[0].replace("%", "")).decode("latin-1")


def _form_bytes(m: re.Match) -> str:
    return " " if m[0] == "+" else _percent_bytes(m)


def _escaped_byte(m: re.Match) -> str:
    return _SHORT.get(m[7], m[7]) if m.lastindex == 7 else _unescape(m)


def _replaced(part: str, at: int, pattern: re.Pattern, decode) -> tuple[str, list[int], list[int]]:
    """part with each match decoded, and for each character of it where it starts and ends in the layer above."""
    out, starts, ends, done = [], [], [], 0
    for m in pattern.finditer(part):
        out.append(part[done : m.start()])
        starts += range(at + done, at + m.start())
        ends += range(at + done + 1, at + m.start() + 1)
        new = decode(m)
        out.append(new)
        starts += [at + m.start()] * len(new)
        ends += [at + m.end()] * len(new)
        done = m.end()
    out.append(part[done:])
    starts += range(at + done, at + len(part))
    ends += range(at + done + 1, at + len(part) + 1)
    return "".join(out), starts, ends


def _candidates(text: str):
    """Base64 candidates as lists of runs (start, end) without padding: those over line breaks, then each run alone."""
    found = []
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            runs = [(m.start() + x.start(), m.start() + x.end()) for x in _RUN.finditer(m[0])]
            if len(runs) > 1:
                found.append(runs)
                size = [e - s for s, e in runs]
                # a line of another width may begin or end a blob of its own
                at = [0, *(k for k in range(1, len(runs)) if size[k] != size[k - 1]), len(runs)]
                for k in range(len(at) - 1):
                    end = at[k + 1] + (at[k + 1] < len(runs) and size[at[k + 1]] < size[at[k]])
                    if end - at[k] > 1 and end - at[k] < len(runs):
                        found.append(runs[at[k] : end])
    for runs in found:
        yield runs
    for m in _BASE64.finditer(text):
        yield [(m.start(), m.start() + len(m[0].rstrip("=")))]


def layers(text: str, limit: int = MAX_LAYER_CHARS):
    """What can be unwrapped in a text: (layer name, decoded text, starts, ends); without a text the name is mark@name."""
    if "%" in text:
        for m in _URL.finditer(text):
            yield "url", *_replaced(m[0], m.start(), _PERCENT, lambda x: bytes.fromhex(x[0].replace("%", "")).decode("utf-8", "replace"))
            for decode in (_percent_bytes, _form_bytes) if "+" in m[0] else (_percent_bytes,):
                yield from _streams(m[0], m.start(), _PERCENT_PLUS, decode, "url", limit)
    if "\\" in text or "&#" in text:
        for m in _ESCAPED.finditer(text):
            yield from _streams(m[0], m.start(), _BYTE, _escaped_byte, "unicode", limit)
            if (new := _replaced(m[0], m.start(), _ESCAPE, _unescape))[0] != m[0]:
                yield "unicode", *new
    inside: set[int] = set()  # where the lines of wrapped blobs start that are streams to their very end
    for runs in _candidates(text):
        if all(s in inside for s, _ in runs):
            continue
        body = "".join(text[s:e] for s, e in runs).replace("-", "+").replace("_", "/")
        begin, end = runs[0][0], runs[-1][1]
        while text[end : end + 1] == "=" and end < runs[-1][1] + 2:
            end += 1
        if len(body) % 4 == 1:
            continue
        try:
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
        except (binascii.Error, ValueError):
            continue
        size, whole = len(raw), True
        for names, part, mark in _unwrapped(raw, "base64", limit):
            whole = whole and "+" in names and not mark
            if mark:
                yield f"{mark}@{names}", None, _All(begin), _All(end)
            for plain in _readable(part) if part else ():
                if "+" in names or len(plain) != size:  # positions inside are not those of the base64 text
                    yield names, plain, _All(begin), _All(end)
                else:
                    at = [k for s, e in runs for k in range(s, e)] + [end]
                    yield names, plain, [at[k * 4 // 3] for k in range(size)], [min(end, at[min(-(-(k + 1) * 4 // 3), len(at) - 1) - 1] + 1) for k in range(size)]
        if len(runs) > 1 and whole:
            inside.update(s for s, _ in runs)


def scan(text: str | None, limit: int = MAX_LAYER_CHARS) -> tuple[list, list, int]:
    """(base spans, all spans, number of layers); spans are (kind, start, end), sorted."""
    text = text or ""
    rank = {k: i for i, k in enumerate(KINDS)}
    order = lambda x: (x[1], rank[x[0].partition("@")[0]], x[2], x[0])
    base = sorted(base_spans(text), key=order)
    every, have, marks = list(base), set(base), set()
    work, seen, n = deque([(text, None, None, "")]), set(), 0

    def unwrap(above: str, up_start, up_end, path: str) -> None:
        nonlocal n
        for name, new, starts, ends in layers(above, limit):
            if isinstance(up_start, _All):
                starts, ends = up_start, up_end
            elif up_start is not None and isinstance(starts, _All):
                starts, ends = _All(up_start[starts.at]), _All(up_end[ends.at - 1])
            elif up_start is not None:
                starts, ends = [up_start[k] for k in starts], [up_end[k - 1] for k in ends]
            if new is None:
                mark, _, name = name.partition("@")
            trail = f"{path}+{name}" if path else name
            if new is None:
                if (found := (f"{mark}@{trail}", starts[0], ends[0])) not in marks:
                    marks.add(found)
                    every.append(found)
                continue
            if not new:
                continue
            key = (hashlib.sha1(new.encode("utf-8", "surrogatepass")).digest(), starts[0], ends[-1])
            if key in seen:
                continue
            seen.add(key)
            n += 1
            for kind, s, e in base_spans(new):
                if (span := (kind, starts[s], ends[e - 1])) not in have:
                    have.add(span)
                    every.append((f"{kind}@{trail}", *span[1:]))
            if len(new) >= LARGE:  # at once, so that not all pieces of a stream wait
                unwrap(new, starts, ends, trail)
            else:
                work.append((new, starts, ends, trail))

    while work:
        unwrap(*work.popleft())
    return base, sorted(every, key=order), n


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(documents: DataFrame) -> DataFrame:
    """One row per document; see SCHEMA."""

    def run(batches):
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        for b in common.portions(batches):
            rows = []
            for text in b.column("text"):
                base, every, n = scan(text.as_py())
                kinds = [x[0] for x in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), n))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
