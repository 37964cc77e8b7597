"""The predicate tree, and its simplification."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Const:
    value: bool


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class MessageType:
    code: int


@dataclass(frozen=True)
class HasAttribute:
    code: int


@dataclass(frozen=True)
class PathMatches:
    pattern: str


@dataclass(frozen=True)
class PathLoops:
    pass


@dataclass(frozen=True)
class BogonAsn:
    pass


@dataclass(frozen=True)
class PeerItem:
    """Conditions that hold together; None: no condition."""

    addr: bytes | None = None
    addr_not: bool = False
    asn: int | None = None
    asn_not: bool = False


@dataclass(frozen=True)
class Peers:
    items: tuple[PeerItem, ...]


@dataclass(frozen=True)
class Prefixes:
    """mode: exact, subnet, supernet or related. Keys of prefixes to look for among announced and withdrawn ones."""

    mode: str
    announced: tuple[str, ...]
    withdrawn: tuple[str, ...]


@dataclass(frozen=True)
class Moment:
    op: str  # < <= = >= > !
    micros: int


@dataclass(frozen=True)
class Community:
    """hi:lo; None stands for any."""

    hi: int | None
    lo: int | None


@dataclass(frozen=True)
class Communities:
    every: bool
    patterns: tuple[Community, ...]


@dataclass(frozen=True)
class Term:
    """A term that was registered by name."""

    name: str
    args: tuple[str, ...]


def covers(a: Community, b: Community) -> bool:
    """Whether all communities that b takes are also taken by a."""
    return (a.hi is None or a.hi == b.hi) and (a.lo is None or a.lo == b.lo)


def simplify(e):
    """An equal tree: nested AND/OR flattened, constants and double negation removed, lists reduced."""
    if isinstance(e, Not):
        part = simplify(e.part)
        if isinstance(part, Const):
            return Const(not part.value)
        return part.part if isinstance(part, Not) else Not(part)
    if isinstance(e, (And, Or)):
        kind, neutral = type(e), isinstance(e, And)
        parts: list = []
        for p in map(simplify, e.parts):
            parts += p.parts if isinstance(p, kind) else [p]
        if any(p == Const(not neutral) for p in parts):
            return Const(not neutral)
        parts = list(dict.fromkeys(p for p in parts if p != Const(neutral)))
        return parts[0] if len(parts) == 1 else kind(tuple(parts)) if parts else Const(neutral)
    if isinstance(e, Peers) and not e.items:
        return Const(False)
    if isinstance(e, Prefixes):
        if not e.announced and not e.withdrawn:
            return Const(False)
        return Prefixes(e.mode, _least(e.announced, e.mode), _least(e.withdrawn, e.mode))
    if isinstance(e, Communities):
        if not e.patterns:
            return Const(e.every)
        keep = []
        for k, p in enumerate(e.patterns):
            # any: what a wider pattern takes is superfluous; all: what a narrower one implies
            wider = lambda q, p=p: covers(p, q) if e.every else covers(q, p)
            if not any(wider(q) and (q != p or j < k) for j, q in enumerate(e.patterns) if j != k):
                keep.append(p)
        return Communities(e.every, tuple(keep))
    return e


def _least(keys: tuple[str, ...], mode: str) -> tuple[str, ...]:
    """The keys that decide: for subnets, one within another is superfluous; for supernets, one that holds another."""
    keys = tuple(sorted(set(keys)))
    if mode == "subnet":
        keep: list[str] = []
        for k in keys:  # what contains k sorts before it
            if not keep or not k.startswith(keep[-1]):
                keep.append(k)
        return tuple(keep)
    if mode == "supernet":
        return tuple(k for k, n in zip(keys, (*keys[1:], "")) if not n.startswith(k))
    return keys


def leaves(e) -> list:
    """All terms, from left to right."""
    if isinstance(e, Not):
        return leaves(e.part)
    if isinstance(e, (And, Or)):
        return [x for p in e.parts for x in leaves(p)]
    return [e]


def show(e, depth: int = 0) -> str:
    """The tree as indented text."""
    pad = "  " * depth
    if isinstance(e, Not):
        return f"{pad}NOT\n{show(e.part, depth + 1)}"
    if isinstance(e, (And, Or)):
        return "\n".join([f"{pad}{type(e).__name__.upper()}", *(show(p, depth + 1) for p in e.parts)])
    return f"{pad}{e}"
