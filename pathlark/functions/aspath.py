r"""Regular expressions over AS paths.

A pattern is parsed into a small tree and simplified. Only the ASNs that it names matter, so a path is first written with
one letter for each of them and one for all others. Then it is one of

* a Java regular expression over those letters, where repetition is over single ASNs only and at most twice in a row, so
  neither the stack nor backtracking beyond the square of a path is needed;
* a deterministic automaton, folded over the path by built-in functions: linear, whatever the pattern and length;
* a nondeterministic automaton over Arrow batches, linear too, where the deterministic one would be very large.

Grammar: numbers, ``!N`` (one ASN that isn't N), ``.`` (any ASN), ``^`` and ``$`` (ends of the path),
sequence, ``|``, groups, and ``* + ?`` after an ASN, a dot or a group. Matching is unanchored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class One:
    """A single ASN: asn None is any; negated: any but asn."""

    asn: int | None
    negated: bool = False


@dataclass(frozen=True)
class Edge:
    """The start (True) or the end of the path."""

    start: bool


@dataclass(frozen=True)
class Cat:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Rep:
    part: object
    op: str  # * + ?


class PatternError(ValueError):
    """A pattern that can't be read."""


_TOKEN = re.compile(r"\s*(?:(\d+)|([!.^$|()*+?]))")


def parse(pattern: str):
    """The tree of a pattern."""
    tokens, at, text = [], 0, pattern.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PatternError(f"bad character {text[at:].lstrip()[:1]!r} in {pattern!r}")
        if m[1] and int(m[1]) > 0xFFFFFFFF:
            raise PatternError(f"ASN out of range: {m[1]}")
        tokens.append(int(m[1]) if m[1] else m[2])
        at = m.end()
    if not tokens:
        raise PatternError("empty pattern")
    tree, rest = _alternatives(tokens, 0, 0)
    if rest < len(tokens):
        raise PatternError(f"stray ) in {pattern!r}")
    return tree


def _alternatives(tokens: list, at: int, depth: int):
    options, parts = [], []
    while at < len(tokens):
        t = tokens[at]
        if t == ")":
            if not depth:
                raise PatternError("stray )")
            break
        if t == "|":
            options.append(Cat(tuple(parts)))
            parts = []
        elif t == "(":
            inner, at = _alternatives(tokens, at + 1, depth + 1)
            if at >= len(tokens):
                raise PatternError("missing )")
            parts.append(inner)
        elif t in ("*", "+", "?"):
            if not parts or isinstance(parts[-1], Edge):
                raise PatternError(f"nothing to repeat before {t}")
            parts[-1] = repeated(parts[-1], t)
        elif t == "!":
            negated = True
            while at + 1 < len(tokens) and tokens[at + 1] == "!":
                negated, at = not negated, at + 1
            at += 1
            if at >= len(tokens) or not isinstance(tokens[at], int):
                raise PatternError("! must stand before an ASN")
            parts.append(One(tokens[at], negated))
        elif t == ".":
            parts.append(One(None))
        elif t in ("^", "$"):
            parts.append(Edge(t == "^"))
        else:
            parts.append(One(t))
        at += 1
    options.append(Cat(tuple(parts)))
    return (options[0] if len(options) == 1 else Alt(tuple(options))), at


def repeated(part, op: str):
    """part op, without nested repetition, which would make a backtracking matcher slow."""
    while isinstance(part, Cat) and len(part.parts) == 1:
        part = part.parts[0]
    if isinstance(part, Rep):
        return Rep(part.part, op if op == part.op else "*")
    return Rep(part, op)


def named(node) -> list[int]:
    """The ASNs that a pattern names, ascending."""
    if isinstance(node, One):
        return [] if node.asn is None else [node.asn]
    parts = (node.part,) if isinstance(node, Rep) else getattr(node, "parts", ())
    return sorted({x for p in parts for x in named(p)})


def _letter(k: int) -> str:
    """The letter of class k; class 0 is every ASN that isn't named."""
    return chr(0x4E00 + k)


def to_java(node, asns: list[int]) -> str:
    """Part of a Java regular expression over the letters of a path."""
    if isinstance(node, One):
        if node.asn is None:
            return "."
        return ("[^%s]" if node.negated else "%s") % _letter(asns.index(node.asn) + 1)
    if isinstance(node, Edge):
        return r"\A" if node.start else r"\z"
    if isinstance(node, Rep):
        one = _single(node.part)
        if one is None:
            return f"(?:{to_java(node.part, asns)}){node.op}"
        choices = "".join(to_java(x, asns) for x in one)
        return (choices if len(one) == 1 else f"[{choices}]") + node.op
    if isinstance(node, Alt):
        return "(?:" + "|".join(to_java(p, asns) for p in node.parts) + ")"
    return "".join(to_java(p, asns) for p in node.parts)


def _single(node) -> list[One] | None:
    """The choices of a node that always takes one ASN: any one, or named ones."""
    while isinstance(node, Cat) and len(node.parts) == 1:
        node = node.parts[0]
    if isinstance(node, One):
        return [node]
    if isinstance(node, Alt):
        found = [_single(p) for p in node.parts]
        if all(f is not None and all(x.asn is not None and not x.negated for x in f) for f in found):
            return [x for f in found for x in f]
    return None


def path_letters(as_path: Column, asns: list[int]) -> Column:
    """array<long> to one letter for each ASN."""
    known = [v for k, n in enumerate(asns) for v in (F.lit(n).cast("long"), F.lit(_letter(k + 1)))]

    def letter(x: Column) -> Column:
        return F.coalesce(F.element_at(F.create_map(*known), x), F.lit(_letter(0))) if known else F.lit(_letter(0))

    return F.array_join(F.transform(as_path, letter), "")


def is_safe(node) -> bool:
    """Whether a backtracking matcher needs neither deep recursion nor more than the square of a path: repetition of single ASNs, two in a row at most."""

    def repeats(n) -> int:
        if isinstance(n, Rep):
            if n.op == "?":
                return repeats(n.part)
            return 1 if _single(n.part) is not None else 99
        if isinstance(n, Alt):
            return max(map(repeats, n.parts), default=0)
        return sum(map(repeats, n.parts)) if isinstance(n, Cat) else 0

    def anchored(n) -> bool:
        if isinstance(n, Alt):
            return all(map(anchored, n.parts))
        return isinstance(n, Edge) and n.start or isinstance(n, Cat) and bool(n.parts) and anchored(n.parts[0])

    return repeats(node) + (not anchored(node)) <= 2


class Machine:
    """A nondeterministic automaton; its steps are (kind, value, next states)."""

    def __init__(self, node):
        self.steps: list[list] = []
        self.final = self._new("final")
        self.start = self._build(node, self.final)

    def _new(self, kind, value=None, to=()) -> int:
        self.steps.append([kind, value, list(to)])
        return len(self.steps) - 1

    def _build(self, node, to: int) -> int:
        if isinstance(node, One):
            return self._new("one", node, [to])
        if isinstance(node, Edge):
            return self._new("edge", node.start, [to])
        if isinstance(node, Alt):
            return self._new("split", None, [self._build(p, to) for p in node.parts])
        if isinstance(node, Rep):
            if node.op == "?":
                return self._new("split", None, [self._build(node.part, to), to])
            loop = self._new("split", None, [to])
            inner = self._build(node.part, loop)
            self.steps[loop][2].append(inner)
            return inner if node.op == "+" else loop
        for part in reversed(node.parts):
            to = self._build(part, to)
        return to

    def search(self, path: Sequence[int]) -> bool:
        """Whether the pattern matches anywhere, in time linear in the path."""
        now: set[int] = set()
        for at in range(len(path) + 1):
            seen, work = set(), [*now, self.start]
            while work:
                k = work.pop()
                if k in seen:
                    continue
                seen.add(k)
                kind, value, to = self.steps[k]
                if kind == "split" or kind == "edge" and at == (0 if value else len(path)):
                    work += to
            if self.final in seen:
                return True
            if at < len(path):
                x = int(path[at])
                now = {self.steps[k][2][0] for k in seen if self.steps[k][0] == "one" and (self.steps[k][1].asn is None or (x == self.steps[k][1].asn) != self.steps[k][1].negated)}
        return False


#: States times classes of a deterministic automaton at most; beyond, the nondeterministic one runs.
MAX_TABLE = 4096
#: ASNs that a pattern over letters names at most.
LETTERS = 20_000


def table(node, limit: int = MAX_TABLE) -> tuple[list[int], list[int], list[bool]] | None:
    """(ASNs named, next state by state * classes + class, whether a path that ends in a state matches), None beyond the limit.

    State 0 is the start, 1 is "has matched". Classes are 0 for all other ASNs and then one for each named ASN.
    """
    machine, asns = Machine(node), named(node)

    def closure(now: frozenset, start: bool, end: bool) -> set[int]:
        seen, work = set(), [*now, machine.start]
        while work:
            k = work.pop()
            if k not in seen:
                seen.add(k)
                kind, value, to = machine.steps[k]
                if kind == "split" or kind == "edge" and (start if value else end):
                    work += to
        return seen

    width = len(asns) + 1
    states: dict = {(frozenset(), True): 0, "matched": 1}
    moves, ends, queue = [[], [1] * width], [False, True], [(frozenset(), True)]
    while queue:
        now, start = queue.pop()
        at = states[now, start]
        ends[at] = machine.final in closure(now, start, True)
        seen = closure(now, start, False)
        if machine.final in seen:
            moves[at] = [1] * width
            continue
        for c in range(width):
            x = asns[c - 1] if c else None
            to = frozenset(machine.steps[k][2][0] for k in seen if machine.steps[k][0] == "one" and (machine.steps[k][1].asn is None or (machine.steps[k][1].asn == x) != machine.steps[k][1].negated))
            if machine.final in closure(to, False, False):
                moves[at].append(1)
                continue
            if (to, False) not in states:
                states[to, False] = len(moves)
                moves.append([])
                ends.append(False)
                queue.append((to, False))
                if len(moves) * width > limit:
                    return None
            moves[at].append(states[to, False])
    return asns, [x for row in moves for x in row], ends


def anchored_table(node) -> tuple[list[int], list[int], list[bool], list[bool]]:
    """(ASNs named, moves, whether a state matches, whether it does at the end of the path), for matches that start where
    the automaton does: in state 0 at the start of the path, in state 1 elsewhere. State 2 is dead."""
    machine, asns = Machine(node), named(node)

    def closure(now: frozenset, start: bool, end: bool) -> set[int]:
        seen, work = set(), list(now)
        while work:
            k = work.pop()
            if k not in seen:
                seen.add(k)
                kind, value, to = machine.steps[k]
                if kind == "split" or kind == "edge" and (start if value else end):
                    work += to
        return seen

    begin = frozenset([machine.start])
    queue = [(begin, True), (begin, False), (frozenset(), False)]
    states = {key: k for k, key in enumerate(queue)}
    moves, here, ends = [], [], []
    for now, start in queue:  # grows as it goes
        seen = closure(now, start, False)
        here.append(machine.final in seen)
        ends.append(machine.final in closure(now, start, True))
        for x in (None, *asns):
            to = frozenset(machine.steps[k][2][0] for k in seen if machine.steps[k][0] == "one" and (machine.steps[k][1].asn is None or (machine.steps[k][1].asn == x) != machine.steps[k][1].negated))
            if (to, False) not in states:
                states[to, False] = len(queue)
                queue.append((to, False))
                if len(queue) * (len(asns) + 1) > MAX_TABLE:
                    raise PatternError("a pattern of too many states for spans")
            moves.append(states[to, False])
    return asns, moves, here, ends


def span(as_path: Column, pattern: str) -> Column:
    """struct<start:int,length:int> of the leftmost match, the longest of those there; null if there is none. Built-ins only;
    the time is the square of a path at worst."""
    asns, moves, here, ends = anchored_table(parse(pattern))
    width, n = len(asns) + 1, F.size(as_path)
    place = (lambda x: F.array_position(_numbers(asns), x)) if asns else (lambda x: F.lit(0))
    flag = lambda values, state: F.get(_numbers(values), state.cast("int")) == 1
    state = lambda number, at, best: F.struct(number.cast("long").alias("state"), at.cast("int").alias("at"), best.cast("int").alias("best"))

    def step(acc: Column, x: Column) -> Column:
        to = F.get(_numbers(moves), (acc["state"] * width + place(x)).cast("int"))
        return state(to, acc["at"] + 1, F.when(flag(here, to), acc["at"] + 1).otherwise(acc["best"]))

    def longest(start: Column) -> Column:
        first = F.when(start == 0, 0).otherwise(1)
        empty = F.when(flag(here, first), 0).otherwise(-1)
        size = F.aggregate(F.slice(as_path, start + 1, F.greatest(n, F.lit(1))), state(first, F.lit(0), empty), step, lambda acc: F.when(flag(ends, acc["state"]), acc["at"]).otherwise(acc["best"]))
        return F.struct(start.alias("start"), size.alias("length"))

    return F.get(F.filter(F.transform(F.sequence(F.lit(0), n), longest), lambda m: m["length"] >= 0), 0)


def captured(as_path: Column, pattern: str) -> Column:
    """The ASNs of `span`, null if the path doesn't match."""
    found = span(as_path, pattern)
    return F.when(found.isNotNull(), F.slice(as_path, found["start"] + 1, found["length"]))


def _numbers(values: Sequence[int]) -> Column:
    """An array literal of longs, from one string that is folded when the query is planned."""
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<bigint>")


def matches(as_path: Column, pattern: str, engine: str = "auto") -> Column:
    """Whether a path (array<long>) matches; null for a null path.

    engine: "java", "table" (deterministic, built-ins), "linear" (nondeterministic, Arrow batches), or "auto".
    """
    node = parse(pattern)
    asns = named(node)
    if engine == "java" or engine == "auto" and is_safe(node) and len(asns) < LETTERS:
        return path_letters(as_path, asns).rlike(f"(?s)(?:{to_java(node, asns)})")
    found = table(node) if engine in ("auto", "table") else None
    if found is not None:
        asns, moves, ends = found
        width = len(asns) + 1
        place = (lambda x: F.array_position(_numbers(asns), x).cast("int")) if asns else (lambda x: F.lit(0))
        last = F.aggregate(as_path, F.lit(0).cast("long"), lambda state, x: F.get(_numbers(moves), (state * width + place(x)).cast("int")))
        return F.get(_numbers(ends), last.cast("int")) == 1
    machine = Machine(node)

    @F.pandas_udf("boolean")
    def run(paths):
        return paths.map(lambda p: None if p is None else machine.search(p))

    return run(as_path)
