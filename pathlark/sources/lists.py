"""List arguments: tokens in parentheses, a file of tokens, or one literal.

Files hold tokens apart by white space; // and /* */ comments are skipped and quotes keep blanks.
Template files of the older option set have # comments.
"""

from __future__ import annotations

import os
import re

_PART = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"([^"]*)"|'([^']*)'|((?:(?!//|/\*)[^\s"'])+)|\s+|(.)""", re.DOTALL)


def tokens_of(text: str) -> list[str]:
    """The tokens of a list file."""
    found = []
    for m in _PART.finditer(text):
        if m[4]:
            raise ValueError(f"unbalanced {m[4]} in a list")
        found += [t for t in m.group(1, 2, 3) if t is not None]
    return found


def read_list(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return tokens_of(f.read())


def template_tokens(text: str) -> list[str]:
    """The tokens of a template file: # comments, quoted tokens."""
    found = []
    for m in re.finditer(r"""#[^\n]*|"([^"]*)"|([^\s"#]+)""", text):
        found += [t for t in m.groups() if t is not None]
    return found


def expand(args: list[str], at: int) -> tuple[list[str], int]:
    """The list that starts at args[at], and where what follows it starts."""
    if at >= len(args):
        raise ValueError("a list is missing")
    if args[at] == "()":
        return [], at + 1
    if args[at] == "(":
        if ")" not in args[at:]:
            raise ValueError("missing ) after a list")
        end = args.index(")", at)
        return args[at + 1 : end], end + 1
    return (read_list(args[at]) if os.path.isfile(args[at]) else [args[at]]), at + 1
