"""The predicate language, from arguments to a tree.

    expression := and { (-o | -or) and }
    and        := unary { [-a | -and] unary }
    unary      := (! | -not) unary | ( expression ) | term
"""

from __future__ import annotations

import re
import shlex
from collections.abc import Callable, Sequence

from ..functions import aspath, moments, names, net
from ..sources.lists import expand
from . import expr as E

#: Terms added by `register_term`: name to (number of arguments, arguments to a boolean Column).
REGISTERED: dict[str, tuple[int, Callable]] = {}


class ExpressionError(ValueError):
    """A predicate that can't be read."""


def register_term(name: str, make: Callable, n_args: int = 0) -> None:
    """Adds the term -name: make(*arguments) gives a boolean Column over a message row."""
    REGISTERED[name.lstrip("-")] = (n_args, make)


def peer_item(text: str) -> E.PeerItem:
    """[!]addr, [!]asn or both."""
    addr = asn = None
    addr_not = asn_not = False
    parts = text.split()
    if not 1 <= len(parts) <= 2:
        raise ExpressionError(f"bad peer: {text!r}")
    for p in parts:
        negated, p = p.startswith("!"), p.removeprefix("!")
        if p.isascii() and p.isdigit():
            if asn is not None or int(p) > 0xFFFFFFFF:
                raise ExpressionError(f"bad peer: {text!r}")
            asn, asn_not = int(p), negated
        else:
            if addr is not None:
                raise ExpressionError(f"bad peer: {text!r}")
            try:
                addr, addr_not = net.ip_bytes(p), negated
            except ValueError:
                raise ExpressionError(f"bad peer: {text!r}") from None
    return E.PeerItem(addr, addr_not, asn, asn_not)


def community(text: str) -> E.Community:
    """A name, 0x code, hi:lo, hi:* or *:lo."""
    code = names.COMMUNITIES.get(text.upper())
    if code is None and re.fullmatch(r"0[xX][0-9A-Fa-f]{1,8}", text):
        code = int(text, 16)
    if code is not None:
        return E.Community(code >> 16, code & 0xFFFF)
    m = re.fullmatch(r"(\d{1,5}|\*):(\d{1,5}|\*)", text)
    hi, lo = (None if x == "*" else int(x) for x in m.groups()) if m else (None, None)
    if hi is None and lo is None or max(hi or 0, lo or 0) > 0xFFFF:
        raise ExpressionError(f"bad community: {text!r}")
    return E.Community(hi, lo)


def prefixes(mode: str, items: Sequence[str]) -> E.Prefixes:
    """Items p, +p (announced only) and -p (withdrawn only)."""
    sides: tuple[list, list] = ([], [])
    for text in items:
        try:
            key = net.parse_net(text.lstrip("+-") if text[:1] in "+-" else text).key
        except ValueError:
            raise ExpressionError(f"bad prefix: {text!r}") from None
        for side, sign in zip(sides, "-+"):
            if text[:1] != sign:
                side.append(key)
    return E.Prefixes(mode, tuple(sides[0]), tuple(sides[1]))


def moment(text: str) -> E.Moment:
    op = re.match(r"[<>]=?|=|!|", text)[0]
    return E.Moment(op or "=", moments.parse(text[len(op) :].strip()))


def parse(expression: str | Sequence[str]):
    """The simplified tree of an expression; a string is split as a shell would. Empty: all pass."""
    args = shlex.split(expression) if isinstance(expression, str) else list(expression)
    if not args:
        return E.Const(True)
    try:
        tree, at = _either(args, 0)
    except ExpressionError:
        raise
    except ValueError as e:
        raise ExpressionError(str(e)) from e
    if at < len(args):
        raise ExpressionError(f"unexpected {args[at]!r}")
    return E.simplify(tree)


def _either(args: list[str], at: int):
    part, at = _both(args, at)
    parts = [part]
    while at < len(args) and args[at] in ("-o", "-or"):
        part, at = _both(args, at + 1)
        parts.append(part)
    return (parts[0] if len(parts) == 1 else E.Or(tuple(parts))), at


def _both(args: list[str], at: int):
    part, at = _unary(args, at)
    parts = [part]
    while at < len(args) and args[at] not in ("-o", "-or", ")"):
        part, at = _unary(args, at + (args[at] in ("-a", "-and")))
        parts.append(part)
    return (parts[0] if len(parts) == 1 else E.And(tuple(parts))), at


def _unary(args: list[str], at: int):
    if at >= len(args):
        raise ExpressionError("a term is missing at the end")
    token = args[at]
    if token in ("!", "-not"):
        part, at = _unary(args, at + 1)
        return E.Not(part), at
    if token == "(":
        part, at = _either(args, at + 1)
        if at >= len(args) or args[at] != ")":
            raise ExpressionError("missing )")
        return part, at + 1
    name = token[1:] if token.startswith("-") else ""
    if name == "loops":
        return E.PathLoops(), at + 1
    if name == "bogon-asn":
        return E.BogonAsn(), at + 1
    if name in ("peer", "exact", "subnet", "supernet", "related", "communities", "all-communities"):
        items, end = expand(args, at + 1)
        if name == "peer":
            return E.Peers(tuple(map(peer_item, items))), end
        if name.endswith("communities"):
            return E.Communities(name[0] == "a", tuple(map(community, items))), end
        return prefixes(name, items), end
    if name in REGISTERED:
        end = at + 1 + REGISTERED[name][0]
        if end > len(args):
            raise ExpressionError(f"-{name}: an argument is missing")
        return E.Term(name, tuple(args[at + 1 : end])), end
    if name not in ("type", "attr", "aspath", "timestamp"):
        raise ExpressionError(f"unknown term {token!r}")
    if at + 1 >= len(args):
        raise ExpressionError(f"-{name}: an argument is missing")
    value = args[at + 1]
    if name == "type":
        return E.MessageType(names.code_of(value, names.MESSAGE_TYPES, "message type")), at + 2
    if name == "attr":
        return E.HasAttribute(names.code_of(value, names.ATTRIBUTES | names.ATTRIBUTE_ALIASES, "attribute")), at + 2
    if name == "aspath":
        aspath.parse(value)
        return E.PathMatches(value), at + 2
    return moment(value), at + 2
