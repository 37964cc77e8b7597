"""The older option set, as arguments of the predicate language.

Options of one kind are alternatives; the kinds combine with AND, in the order peers, attributes,
communities, prefixes, loops, paths.
"""

from __future__ import annotations

import getopt
import os
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from ..sources.lists import template_tokens

_PREFIX = {"e": "exact", "s": "subnet", "u": "supernet", "r": "related"}


@dataclass
class Command:
    """What a legacy command line asks for."""

    files: list[str] = field(default_factory=list)
    expression: list[str] = field(default_factory=list)
    output: str | None = None
    peers_only: bool = False
    show_plan: bool = False


class UsageError(ValueError):
    """Options that don't exist or don't go together."""


def path_pattern(text: str) -> str:
    """The older path syntax: ? is any ASN, a * that stands alone any number of ASNs."""
    return " ".join(".*" if t == "*" else t for t in re.findall(r"\*|[^\s*]+", text.replace("?", "."))) if re.search(r"(?:^|\s)\*", text) else text.replace("?", ".")


def _tokens(path: str) -> list[str]:
    if not os.path.isfile(path):
        raise UsageError(f"no such file: {path}")
    with open(path, encoding="utf-8") as f:
        return template_tokens(f.read())


def _any(terms: list[list[str]]) -> list[str]:
    out: list[str] = []
    for t in terms:
        out += ["-or", *t] if out else t
    return ["(", *out, ")"] if out else []


def parse(argv: Sequence[str]) -> Command:
    """A legacy command line, without the program's name."""
    try:
        opts, files = getopt.getopt(list(argv), "a:A:cde:E:fi:I:lLm:M:o:p:P:r:R:s:S:t:T:u:U:")
    except getopt.GetoptError as e:
        raise UsageError(str(e)) from e
    cmd = Command(files=files)
    peers: list[str] = []
    attrs, comms, loops, paths = [], [], [], []
    nets: dict[str, list[str]] = {}
    for opt, value in opts:
        o = opt[1]
        if o in "ai":
            peers.append(value)
        elif o in "AI":
            peers += _tokens(value)
        elif o == "t":
            attrs.append(["-attr", value])
        elif o == "m":
            comms.append(["-all-communities", "(", *value.split(), ")"])
        elif o == "M":
            comms.append(["-not", "-communities", "(", *value.split(), ")"])
        elif o in "esur":
            nets.setdefault(_PREFIX[o], []).append(value)
        elif o in "ESUR":
            nets.setdefault(_PREFIX[o.lower()], []).extend(_tokens(value))
        elif o in "lL":
            loops.append(["-loops"] if o == "l" else ["-not", "-loops"])
        elif o in "pP":
            paths.append(([] if o == "p" else ["-not"], path_pattern(value)))
        elif o == "f":
            cmd.peers_only = True
        elif o == "d":
            cmd.show_plan = True
        elif o == "o":
            cmd.output = value
        else:
            raise UsageError(f"-{o} is not supported")
    if len(nets) > 1:
        raise UsageError("only one kind of prefix option can be given")
    e = cmd.expression
    if peers:
        e += ["-peer", "(", *peers, ")"]
    e += _any(attrs) + _any(comms)
    for mode, items in nets.items():
        e += [f"-{mode}", "(", *items, ")"]
    e += _any(loops)
    wanted, unwanted = [p for n, p in paths if not n], [p for n, p in paths if n]
    alternatives = ([["-aspath", "|".join(wanted)]] if wanted else []) + ([["-not", "-aspath", "|".join(unwanted)]] if unwanted else [])
    e += _any(alternatives)
    if cmd.peers_only and e:
        raise UsageError("-f takes no filters")
    return cmd
