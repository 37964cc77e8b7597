"""Predicates to Spark: boolean Columns that stay in the JVM, and joins for very long prefix lists.

Every term is two-valued: what needs an UPDATE is false, not null, for other messages, so negation
keeps them. A filter gets the bare comparisons wherever null and false mean the same, as Parquet can skip by those. Long literal lists become hash sets (Catalyst's InSet), looked up per prefix length, so
a filter never shuffles. Lists held in a table go through `matching_keys`, an equi-join on key prefixes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aspath, names
from ..sources import mrt
from . import expr as E
from .parser import REGISTERED, parse

#: Keys of a message row.
ROW = ("file", "rec_no", "entry_no")

#: What each term reads of a message row.
READS = {
    E.MessageType: {"msg_type"}, E.HasAttribute: {"msg_type", "attr_codes"}, E.PathMatches: {"msg_type", "as_path"}, E.PathLoops: {"msg_type", "as_path"},
    E.BogonAsn: {"msg_type", "as_path"}, E.Peers: {"peer_addr_bin", "peer_asn"}, E.Prefixes: {"announced", "withdrawn"}, E.Moment: {"ts_secs", "ts_micros"},
    E.Communities: {"msg_type", "communities"}, E.Const: set(),
}


def columns_read(tree) -> set[str] | None:
    """The columns a predicate needs; None if a registered term may need any."""
    found: set[str] = set()
    for leaf in E.leaves(tree):
        if type(leaf) not in READS:
            return None
        found |= READS[type(leaf)]
    return found


def loops(as_path: Column) -> Column:
    """The same ASN twice, with something else between. AS_TRANS never loops but parts others."""
    runs = F.filter(as_path, lambda x, i: (i == 0) | (F.get(as_path, i - 1) != x))
    real = F.filter(runs, lambda x: x != names.AS_TRANS)
    return F.size(real) > F.size(F.array_distinct(real))


def is_bogon(asn: Column) -> Column:
    # -- fixed values: 0, AS_TRANS, documentation and private ranges, reserved ASNs
    return (asn == 0) | (asn == 23456) | asn.between(64496, 131071) | asn.between(4200000000, 4294967295)


def _peer(items: tuple[E.PeerItem, ...]) -> Column:
    plain_asn = [i.asn for i in items if i.addr is None and not i.asn_not]
    plain_addr = [i.addr for i in items if i.asn is None and not i.addr_not]
    tests = []
    if plain_asn:
        tests.append(F.col("peer_asn").isin(plain_asn))
    if plain_addr:
        tests.append(F.col("peer_addr_bin").isin([F.lit(a) for a in plain_addr]))
    for i in items:
        if i.addr is None and not i.asn_not or i.asn is None and not i.addr_not:
            continue
        both = []
        if i.addr is not None:
            same = F.col("peer_addr_bin") == F.lit(i.addr)
            both.append(~same if i.addr_not else same)
        if i.asn is not None:
            same = F.col("peer_asn") == i.asn
            both.append(~same if i.asn_not else same)
        tests.append(reduce(Column.__and__, both))
    return reduce(Column.__or__, tests)


def _by_length(keys: tuple[str, ...]) -> dict[int, list[str]]:
    found: dict[int, list[str]] = {}
    for k in keys:
        found.setdefault(len(k), []).append(k)
    return found


def _ancestors(keys) -> set[str]:
    return {k[:n] for k in keys for n in range(2, len(k) + 1)}


def _prefix(mode: str, keys: tuple[str, ...], key: Column) -> Column:
    """Whether one prefix, by its key, matches one of the listed ones."""
    if mode == "exact":
        return key.isin(list(keys))
    if mode == "supernet":
        return key.isin(sorted(_ancestors(keys)))
    if mode == "subnet":
        # the keys of one length are a hash set; a longer key than the prefix can't equal its start
        return reduce(Column.__or__, [F.substring(key, 1, n).isin(of) for n, of in sorted(_by_length(keys).items())])
    return _prefix("subnet", E._least(keys, "subnet"), key) | _prefix("supernet", E._least(keys, "supernet"), key)


def _prefix_test(mode: str, keys: tuple[str, ...]):
    return lambda p: _prefix(mode, keys, p["key"])


def _community_test(p: E.Community):
    return lambda c: _community(p, c)


def _community(p: E.Community, c: Column) -> Column:
    if p.hi is not None and p.lo is not None:
        return c == p.hi * 65536 + p.lo
    return F.shiftright(c, 16) == p.hi if p.lo is None else c % 65536 == p.lo


def _any_community(patterns: tuple[E.Community, ...], c: Column) -> Column:
    exact = [p.hi * 65536 + p.lo for p in patterns if p.hi is not None and p.lo is not None]
    highs, lows = [p.hi for p in patterns if p.lo is None], [p.lo for p in patterns if p.hi is None]
    tests = [x.isin(of) for x, of in ((c, exact), (F.shiftright(c, 16), highs), (c % 65536, lows)) if of]
    return reduce(Column.__or__, tests)


def _moment(op: str, micros: int) -> Column:
    """A comparison of (ts_secs, ts_micros), in terms of either column alone."""
    s, u = F.col("ts_secs"), F.coalesce("ts_micros", F.lit(0))
    secs, part = divmod(micros, 1_000_000)
    if op == "=":
        return (s == secs) & (u == part)
    if op == "!":
        return (s != secs) | (u != part)
    if op in ("<", "<="):
        return (s <= secs) & ((s < secs) | (u < part if op == "<" else u <= part))
    return (s >= secs) & ((s > secs) | (u > part if op == ">" else u >= part))


def leaf_column(e, engine: str = "auto") -> Column:
    """One term, never null."""
    return F.coalesce(_leaf(e, engine), F.lit(False))


def _leaf(e, engine: str) -> Column:
    """One term; null stands for false."""
    col = F.col
    update = col("msg_type") == names.UPDATE
    if isinstance(e, E.Const):
        return F.lit(e.value)
    if isinstance(e, E.MessageType):
        test = col("msg_type") == e.code
    elif isinstance(e, E.HasAttribute):
        test = update & F.array_contains("attr_codes", e.code)
    elif isinstance(e, E.PathMatches):
        test = update & aspath.matches(col("as_path"), e.pattern, engine)
    elif isinstance(e, E.PathLoops):
        test = update & loops(col("as_path"))
    elif isinstance(e, E.BogonAsn):
        test = update & F.exists("as_path", is_bogon)
    elif isinstance(e, E.Peers):
        test = _peer(e.items)
    elif isinstance(e, E.Prefixes):
        sides = [F.coalesce(F.exists(side, _prefix_test(e.mode, keys)), F.lit(False)) for side, keys in (("announced", e.announced), ("withdrawn", e.withdrawn)) if keys]
        test = reduce(Column.__or__, sides)
    elif isinstance(e, E.Moment):
        test = _moment(e.op, e.micros)
    elif isinstance(e, E.Communities) and e.every:
        test = update & reduce(Column.__and__, [F.exists("communities", _community_test(p)) for p in e.patterns])
    elif isinstance(e, E.Communities):
        test = update & F.exists("communities", lambda c: _any_community(e.patterns, c))
    elif isinstance(e, E.Term):
        test = REGISTERED[e.name][1](*e.args)
    else:
        raise TypeError(f"no such term: {e!r}")
    return test


def to_filter(tree, engine: str = "auto") -> Column:
    """A whole predicate as a condition; null stands for false."""
    if isinstance(tree, (str, list, tuple)):
        tree = parse(tree)
    if isinstance(tree, E.Not):
        return ~F.coalesce(to_filter(tree.part, engine), F.lit(False))
    if isinstance(tree, (E.And, E.Or)):
        join = Column.__and__ if isinstance(tree, E.And) else Column.__or__
        return reduce(join, [to_filter(p, engine) for p in tree.parts])
    return _leaf(tree, engine)


def to_column(tree, engine: str = "auto") -> Column:
    """A whole predicate as a Column that is never null."""
    return F.coalesce(to_filter(tree, engine), F.lit(False))


def early_test(tree):
    """What a decoder can tell before it decodes a message: a function of (message type, seconds, microseconds, peer's
    address in bytes, its ASN) that is false only if the predicate is, and may go to workers; None if there is no such term."""
    if isinstance(tree, (str, list, tuple)):
        tree = parse(tree)
    tests = [t for t in (tree.parts if isinstance(tree, E.And) else [tree]) if all(isinstance(x, (E.MessageType, E.Peers, E.Moment)) for x in E.leaves(t))]
    if not tests:
        return None

    def holds(e, kind: int, when: int, addr: bytes, asn: int) -> bool:
        if isinstance(e, E.Not):
            return not holds(e.part, kind, when, addr, asn)
        if isinstance(e, (E.And, E.Or)):
            return (all if isinstance(e, E.And) else any)(holds(p, kind, when, addr, asn) for p in e.parts)
        if isinstance(e, E.MessageType):
            return kind == e.code
        if isinstance(e, E.Moment):
            return {"<": when < e.micros, "<=": when <= e.micros, "=": when == e.micros, ">=": when >= e.micros, ">": when > e.micros, "!": when != e.micros}[e.op]
        return any((i.addr is None or (i.addr == addr) != i.addr_not) and (i.asn is None or (i.asn == asn) != i.asn_not) for i in e.items)

    return lambda kind, secs, micros, addr, asn: all(holds(t, kind, secs * 1_000_000 + micros, addr, asn) for t in tests)


def select(messages: DataFrame, expression, engine: str = "auto") -> DataFrame:
    """The messages that pass a predicate (text, arguments or a tree)."""
    return messages.where(to_filter(expression, engine))


def scan(spark: SparkSession, paths, expression=(), columns: set[str] | None = None, engine: str = "auto") -> DataFrame:
    """The messages of dumps that pass. The decoder skips what type, peer or time rule out, and attributes that neither the
    predicate nor `columns` (default: all) needs."""
    tree = parse(expression) if isinstance(expression, (str, list, tuple)) else expression
    needs = columns_read(tree)
    want = None if columns is None or needs is None else columns | needs
    return select(mrt.read(spark, paths, columns=want, keep=early_test(tree)), tree, engine)


def explain_matches(messages: DataFrame, expression, engine: str = "auto") -> DataFrame:
    """The messages with one boolean column match_<k> for each term, in order, and `passed`."""
    tree = parse(expression) if isinstance(expression, (str, list, tuple)) else expression
    marks = {f"match_{k}": leaf_column(leaf, engine) for k, leaf in enumerate(E.leaves(tree))}
    return messages.withColumns(marks | {"passed": to_column(tree, engine)})


#: A list table is broadcast up to so many rows; they are counted first.
BROADCAST_ROWS = 1_000_000


def matching_keys(messages: DataFrame, nets: DataFrame, mode: str, side: str = "both", row: tuple[str, ...] = ROW) -> DataFrame:
    """The distinct row keys of messages with a prefix that matches one in nets(key), whatever the list's size.

    Containment is an equi-join: a prefix looks up the starts of its key in the list (subnet), or its key
    among the starts of the listed ones (supernet). A list of up to BROADCAST_ROWS rows is broadcast.
    """
    listed = nets.select(F.col("key").alias("_net")).where("_net IS NOT NULL").distinct()
    whole = F.concat("announced", "withdrawn") if side == "both" else F.col(side)
    if side == "both":
        whole = F.concat(F.coalesce("announced", F.array().cast(messages.schema["announced"].dataType)), F.coalesce("withdrawn", F.array().cast(messages.schema["withdrawn"].dataType)))
    starts = lambda key: F.transform(F.sequence(F.lit(2), F.length(key)), lambda n: F.substring(key, F.lit(1), n))
    keys = F.array_distinct(F.transform(whole, lambda p: p["key"]))
    parts = []
    if mode in ("subnet", "related"):
        lengths = [r[0] for r in listed.select(F.length("_net")).distinct().collect()]  # at most 33 + 129
        if lengths:
            at = F.array(*[F.lit(n) for n in sorted(lengths)])
            probe = F.array_distinct(F.flatten(F.transform(keys, lambda k: F.transform(F.filter(at, lambda n: n <= F.length(k)), lambda n: F.substring(k, F.lit(1), n)))))
            parts.append((probe, listed))
    if mode in ("supernet", "related"):
        parts.append((keys, listed.select(F.explode(starts(F.col("_net"))).alias("_net")).distinct()))
    if mode == "exact":
        parts.append((keys, listed))
    found = None
    for probe, table in parts:
        small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        one = messages.select(*row, F.explode(probe).alias("_key")).join(F.broadcast(table) if small else table, F.col("_key") == F.col("_net"), "left_semi").select(*row)
        found = one if found is None else found.unionByName(one)
    return messages.select(*row).limit(0) if found is None else found.distinct()


def select_by_table(messages: DataFrame, nets: DataFrame, mode: str, side: str = "both", row: tuple[str, ...] = ROW) -> DataFrame:
    """The messages with a prefix that matches one in the table nets(key)."""
    return messages.join(matching_keys(messages, nets, mode, side, row), list(row), "left_semi")
