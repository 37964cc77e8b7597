"""Queries over dumps: rows become the bytes of a dump each, are decoded again and printed, next to their DuckDB SQL.

The bytes are made by `sources.encode` from integers of the table `events`; SQL computes what must come out from the
same integers.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lines, peers
from ..sources import encode as X
from ..sources import mrt
from . import lower, relation

QUERIES: dict = {}
ORACLES: dict = {}


def _dot(n: int) -> str:
    return f"{n >> 24 & 255}.{n >> 16 & 255}.{n >> 8 & 255}.{n & 255}"


def _net(x: int) -> str:
    size = 8 + x % 25
    return f"{_dot((167772160 + x * 7919 % 16777216) >> 32 - size << 32 - size)}/{size}"


def _peer(u: int) -> str:
    return _dot(167837696 + u % 65536)


def _attrs(k: int, u: int, wide: bool = True) -> list[bytes]:
    """Attributes of event k of user u."""
    out = [X.attr(1, bytes([k % 3])), X.path([100 + u % 9, 100 + k % 9], (7, 8) if k % 4 else (9,), wide=wide), X.attr(3, X.ip_bytes(_peer(u)))]
    out += [X.attr(6, b"")] if k % 7 == 0 else []
    out += [X.attr(7, (64400 + u % 200).to_bytes(4 if wide else 2, "big") + X.ip_bytes(_peer(k)))] if k % 5 == 0 else []
    return out + [X.communities((u % 60000, k % 65536)), X.large((k, u, 1))]


def _sides(k: int, ids: bool = False) -> dict:
    """What event k announces and withdraws."""
    at = lambda x: X.nlri(_net(x), x % 3 if ids else None)
    return {"announced": [at(k), at(k + 1)] if k % 3 else [], "withdrawn": [at(k + 2)] if k % 5 < 2 else []}


# -- SQL of the same
_IP = lambda n: f"(({n} >> 24) % 256 || '.' || ({n} >> 16) % 256 || '.' || ({n} >> 8) % 256 || '.' || {n} % 256)"
_TEXT = lambda x: f"{_IP(f'(((167772160 + ({x} * 7919) % 16777216) >> (24 - {x} % 25)::INT) << (24 - {x} % 25)::INT)')} || '/' || (8 + {x} % 25)"
_PEER = lambda u: _IP(f"(167837696 + {u} % 65536)")
_EVENTS = f"e AS (SELECT event_id AS k, user_id AS u, {_PEER('user_id')} AS peer, 64400 + user_id % 200 AS asn FROM events)"
_fields = lambda hops: f"""(100 + u % 9) || ' ' || (100 + k % 9) || CASE WHEN k % 4 > 0 THEN ' {{7,8}}' ELSE ' {{9}}' END || '|' || {hops} || '|' || substr('ie?', (k % 3 + 1)::INT, 1) || '|' || CASE WHEN k % 7 = 0 THEN 'AT' ELSE '' END || '|' ||
 CASE WHEN k % 5 = 0 THEN asn || ' ' || {_PEER("k")} ELSE '' END || '|' || (u % 60000) || ':' || (k % 65536) || ' ' || k || ':' || u || ':1'"""  # noqa: E731
_FIELDS = _fields("peer")
_WIDE = "CASE WHEN k % 2 = 0 THEN '1' ELSE '0' END"
_UPDATES = lambda tail: f"""SELECT k AS msg_id, 0 AS line_no, '-|' || {_TEXT("(k + 2)")} || '|' || {_FIELDS} || '|' || {tail} AS line FROM e WHERE k % 5 < 2
UNION ALL SELECT k, CASE WHEN k % 5 < 2 THEN 1 ELSE 0 END, '+|' || {_TEXT("k")} || ' ' || {_TEXT("(k + 1)")} || '|' || {_FIELDS} || '|' || {tail} FROM e WHERE k % 3 > 0"""  # noqa: E731


#: So many dumps are held at once.
HELD = 512


def dumps(make: Callable):
    """A function for mapInArrow over (k, u) rows that yields (path, content) of a dump for each: make(k, u) gives its bytes, or a pair of its name's ending and its bytes."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, HELD):
                ks, us = (b.column(c).slice(at, HELD).to_pylist() for c in (0, 1))
                made = [m if isinstance(m, tuple) else ("mrt", m) for m in map(make, ks, us)]
                yield pa.RecordBatch.from_arrays([pa.array([f"{k}.{m[0]}" for k, m in zip(ks, made)], pa.string()), pa.array([m[1] for m in made], pa.binary())], ["path", "content"])

    return run


def parts(spark: SparkSession) -> int:
    """Tasks for rows of few bytes but much work for each."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def through(spark: SparkSession, sf_dir: str, make: Callable, decode: Callable, schema) -> DataFrame:
    """The rows that decode (a function over (path, content)) makes of a dump for each event, with msg_id, the event.

    Dumps are made and decoded by the same worker: they don't pass through the JVM, and a task has one worker, not two.
    """
    made = dumps(make)
    events = relation.read(spark, sf_dir, "events").select("event_id", "user_id").repartition(parts(spark))
    rows = events.mapInArrow(lambda batches: decode(made(batches)), schema)
    return rows.withColumn("msg_id", F.substring_index("file", ".", 1).cast("long"))


def decoded(spark: SparkSession, sf_dir: str, make: Callable, relation_name: str = "message", columns=None, keep=None, fields=None) -> DataFrame:
    """A dump for each event as rows of a relation, or some of its columns (`fields`), with msg_id, the event."""
    fields = None if fields is None else {"file", *fields}
    return through(spark, sf_dir, make, mrt.decoder(relation_name, columns, keep, fields), mrt.schema_of(relation_name, fields))


def _lines(name: str, make: Callable, sql: str) -> None:
    QUERIES[name] = lambda spark, d: lines.message_lines(decoded(spark, d, make, fields=lines.FIELDS), ("msg_id",))
    ORACLES[name] = f"WITH {_EVENTS} {sql}"


def _select(name: str, make: Callable, sql: str, *columns, of: str = "message", fields=None, decode=None) -> None:
    """fields: what the columns are made of, decode: those attributes among it; all by default."""
    QUERIES[name] = lambda spark, d: decoded(spark, d, make, of, decode, fields=fields).select("msg_id", *[c() if callable(c) else c for c in columns])
    ORACLES[name] = f"WITH {_EVENTS} {sql}"


# -- sessions
def _bgp4mp(k: int, u: int) -> bytes:
    wide = k % 2 == 0
    body = X.update_body(attrs=_attrs(k, u, wide), **_sides(k))
    return X.session(k * 60, X.bgp(2, body), _peer(u), 64400 + u % 200, 4 if wide else 1)


_lines("decode_bgp4mp", _bgp4mp, _UPDATES(f"peer || ' ' || asn || '|' || k * 60 || '|' || {_WIDE}"))


def _bgp4mp_et(k: int, u: int) -> bytes:
    """With path ids, IPv6 prefixes in MP attributes, microseconds, and an IPv6 session."""
    more = [X.reach(["2001:db8::1", "fe80::1"], [f"2001:db8:{k % 65535 + 1:x}::/48"], ids=[k % 3])]
    body = X.update_body([X.nlri(_net(k), k % 3), X.nlri(_net(k + 1), k % 3 + 1)], attrs=[*_attrs(k, u), *more])
    return X.session(k, X.bgp(2, body), f"2001:db8:1::{u % 65535 + 1:x}", 70000 + u % 200, 9, micros=k % 1_000_000)


_ET = _fields("peer || ' 2001:db8::1 fe80::1'")
_ET_TAIL = "'2001:db8:1::' || printf('%x', u % 65535 + 1) || ' ' || (70000 + u % 200)"
_ET_WHEN = "k || CASE WHEN k % 1000000 > 0 THEN '.' || lpad((k % 1000000)::VARCHAR, 6, '0') ELSE '' END || '|1'"
_lines("decode_bgp4mp_et", _bgp4mp_et, f"""SELECT k AS msg_id, 0 AS line_no, '+|' || {_TEXT("k")} || ' 2001:db8:' || printf('%x', k % 65535 + 1) || '::/48|' || {_ET} || '|' || {_ET_TAIL} || ' ' || k % 3 || '|' || {_ET_WHEN} AS line FROM e
UNION ALL SELECT k, 1, '+|' || {_TEXT("(k + 1)")} || '|' || {_ET} || '|' || {_ET_TAIL} || ' ' || (k % 3 + 1) || '|' || {_ET_WHEN} FROM e""")


def _withdraw_ipv6(k: int, u: int) -> bytes:
    return X.session(k, X.bgp(2, X.update_body(attrs=[X.unreach([f"2001:db8:{k % 65535 + 1:x}::/48", f"2001:db8:{k % 65535 + 1:x}:1::/64"])])), _peer(u), 64400 + u % 200, 4)


_lines("decode_mp_unreach", _withdraw_ipv6, "SELECT k AS msg_id, 0 AS line_no, '-|2001:db8:' || printf('%x', k % 65535 + 1) || '::/48 2001:db8:' || printf('%x', k % 65535 + 1) || ':1::/64|||||||' || peer || ' ' || asn || '|' || k || '|1' AS line FROM e")


def _states(k: int, u: int) -> bytes:
    inner = bytes([0, k % 6 + 1, 0, (k + 1) % 6 + 1])
    if k % 3 == 0:
        return X.zebra(k, 3, inner, _peer(u), 64400 + u % 200)
    return X.session(k, inner, _peer(u), 64400 + u % 200, 5 if k % 3 == 1 else 0)


QUERIES["decode_state_changes"] = lambda spark, d: lines.state_lines(decoded(spark, d, _states, "state_change"), ("msg_id",)).drop("line_no")
ORACLES["decode_state_changes"] = f"WITH {_EVENTS} SELECT k AS msg_id, '#|' || (k % 6 + 1) || '-' || ((k + 1) % 6 + 1) || '|||||||' || peer || ' ' || asn || '|' || k || '|' || CASE WHEN k % 3 = 1 THEN '1' ELSE '0' END AS line FROM e"


def _zebra(k: int, u: int) -> bytes:
    sub = (1, 5, 6, 7)[k % 4]
    body = {1: lambda: X.update_body([X.nlri(_net(k))], attrs=[X.path([100 + u % 9], wide=False)]), 5: lambda: X.open_body([1, 65, 200 + k % 3]), 6: lambda: bytes([k % 6 + 1, k % 11]), 7: bytes}[sub]()
    return X.zebra(k, sub, body, _peer(u), 64400 + u % 200)


_lines("decode_zebra", _zebra, f"SELECT k AS msg_id, 0 AS line_no, CASE k % 4 WHEN 0 THEN '+|' || {_TEXT('k')} || '|' || (100 + u % 9) || '||||||' WHEN 1 THEN '>|MULTIPROTOCOL ASN32BIT ' || (200 + k % 3) || '|||||||' WHEN 2 THEN '!||||||||' ELSE '@||||||||' END || peer || ' ' || asn || '|' || k || '|0' AS line FROM e")


def _open_or_notification(k: int, u: int) -> bytes:
    inner = X.bgp(1, X.open_body([2, 64, 69 + k % 3])) if k % 2 else X.bgp(3, bytes([k % 6 + 1, k % 11]))
    return X.session(k, inner, _peer(u), 64400 + u % 200)


_select("decode_open_notification", _open_or_notification, "SELECT k AS msg_id, CASE WHEN k % 2 = 1 THEN '2 64 ' || (69 + k % 3) END AS caps, CASE WHEN k % 2 = 0 THEN (k % 6 + 1)::INT END AS notify_code, CASE WHEN k % 2 = 0 THEN (k % 11)::INT END AS notify_subcode FROM e", lambda: F.array_join(F.col("capabilities").cast("array<string>"), " ").alias("caps"), "notify_code", "notify_subcode", fields={"capabilities", "notify_code", "notify_subcode"}, decode=())


def _as4(k: int, u: int) -> bytes:
    """Two-octet paths with AS4_PATH: it counts only beside both aggregators, and if it isn't longer."""
    new = [70000 + u % 5, 70001, *([70002, 70003] if k % 3 == 2 else [])]
    attrs = [X.path([100 + u % 9, 23456, 23456], wide=False), X.path(new, code=17)]
    if k % 2 == 0:
        attrs += [X.attr(7, (23456).to_bytes(2, "big") + X.ip_bytes(_peer(u))), X.attr(18, (70001).to_bytes(4, "big") + X.ip_bytes(_peer(k)))]
    return X.session(k, X.bgp(2, X.update_body([X.nlri(_net(k))], attrs=attrs)), _peer(u), 64400 + u % 200, 1)


_select("decode_as4_merge", _as4, f"SELECT k AS msg_id, (100 + u % 9) || CASE WHEN k % 2 = 0 AND k % 3 < 2 THEN ' ' || (70000 + u % 5) || ' 70001' ELSE ' 23456 23456' END AS path, CASE WHEN k % 2 = 0 THEN '70001 ' || {_PEER('k')} END AS aggregator FROM e", lambda: F.array_join(F.col("as_path").cast("array<string>"), " ").alias("path"), lambda: F.when(F.col("aggregator").isNotNull(), F.concat_ws(" ", "aggregator.asn", "aggregator.addr")).alias("aggregator"))

# -- tables
_lines("decode_table_dump", lambda k, u: X.table_dump(_net(k), b"".join(_attrs(k, u, False)), _peer(u), 64400 + u % 200, k, k + 9), f"SELECT k AS msg_id, 0 AS line_no, '=|' || {_TEXT('k')} || '|' || {_FIELDS} || '|' || peer || ' ' || asn || '|' || k || '|0' AS line FROM e")


def _rib_ipv6(k: int, u: int) -> bytes:
    """Next hops in the short form and in the whole one; the peer is the second of its table."""
    hop = X.ip_bytes("2001:db8:ffff::1")
    reach = X.attr(14, bytes([16]) + hop, 0x80) if k % 2 else X.reach(["2001:db8:ffff::1"], ["2001:db8:1::/48"])
    attrs = X.path([100 + u % 9, 4200000000 + k % 7]) + reach
    return X.peer_table([("10.0.0.1", 1), (f"2001:db8:1::{u % 65535 + 1:x}", 70000 + u % 200)]) + X.rib(f"2001:db8:{k % 65535 + 1:x}::/48", [(1, k, attrs)], sub=(4, 5)[k % 3 == 0])


_lines("decode_rib_ipv6", _rib_ipv6, "SELECT k AS msg_id, 0 AS line_no, '=|2001:db8:' || printf('%x', k % 65535 + 1) || '::/48|' || (100 + u % 9) || ' ' || (4200000000 + k % 7) || '|2001:db8:ffff::1|||||2001:db8:1::' || printf('%x', u % 65535 + 1) || ' ' || (70000 + u % 200) || '|' || k || '|1' AS line FROM e")


def _rib_addpath(k: int, u: int) -> bytes:
    """Entries with path ids, in records of a family and in generic ones."""
    entries = [(0, k, X.path([100 + u % 9]), k % 5), (0, k + 1, X.path([100 + k % 9]), k % 5 + 1)]
    return X.peer_table([(_peer(u), 64400 + u % 200)]) + X.rib(_net(k), entries, sub=8 if k % 2 else 12)


QUERIES["decode_rib_addpath"] = lambda spark, d: lines.message_lines(decoded(spark, d, _rib_addpath, fields={"entry_no", *lines.FIELDS}), ("msg_id", "entry_no")).drop("line_no")
ORACLES["decode_rib_addpath"] = f"WITH {_EVENTS} SELECT k AS msg_id, 0 AS entry_no, '=|' || {_TEXT('k')} || '|' || (100 + u % 9) || '||||||' || peer || ' ' || asn || ' ' || k % 5 || '|' || k || '|1' AS line FROM e UNION ALL SELECT k, 1, '=|' || {_TEXT('k')} || '|' || (100 + k % 9) || '||||||' || peer || ' ' || asn || ' ' || (k % 5 + 1) || '|' || (k + 1) || '|1' FROM e"


def _two_tables(k: int, u: int) -> bytes:
    """Two peer tables in a file, of two and of one peer; entries refer to the table before them."""
    rib = X.rib(_net(k), [(0, k, X.path([1]))])
    return X.peer_table([(_peer(u), 64400 + u % 200), (f"2001:db8::{k % 9 + 1}", 70000)]) + rib + X.peer_table([(_peer(k), 1 + k % 9)]) + rib


QUERIES["decode_peer_tables"] = lambda spark, d: peers.listing(decoded(spark, d, _two_tables, "peer_index", fields={"table_no", "peer_idx", "addr", "asn", "asn32"})).select("msg_id", "table_no", "peer_idx", "line")
ORACLES["decode_peer_tables"] = f"WITH {_EVENTS} SELECT k AS msg_id, 0 AS table_no, 0 AS peer_idx, peer || ' ' || asn || '|0' AS line FROM e UNION ALL SELECT k, 0, 1, '2001:db8::' || (k % 9 + 1) || ' 70000|1' FROM e UNION ALL SELECT k, 1, 0, {_PEER('k')} || ' ' || (1 + k % 9) || '|0' FROM e"
_select("decode_peer_refs", _two_tables, "SELECT k AS msg_id, unnest([0, 1]) AS table_no, 0 AS peer_idx FROM e", "table_no", "peer_idx", of="peer_ref")
_select("decode_latest_table", _two_tables, f"SELECT k AS msg_id, 1 AS rec_no, asn AS peer_asn, peer AS peer_addr FROM e UNION ALL SELECT k, 3, 1 + k % 9, {_PEER('k')} FROM e", lambda: F.col("rec_no").cast("int").alias("rec_no"), "peer_asn", "peer_addr", fields={"rec_no", "peer_asn", "peer_addr"}, decode=())


# -- compression, and what is malformed
#: A dictionary no larger than the data needs: that of a preset takes ten times as long to set up as such a dump to pack.
_XZ = [{"id": lzma.FILTER_LZMA2, "preset": 0, "dict_size": 4096}]


def _packed(k: int, u: int) -> tuple[str, bytes]:
    data = b"".join(X.session(k + j, X.bgp(4), _peer(u), 64400 + u % 200) for j in range(k % 4 + 1))
    return (("mrt", data), ("GZ", gzip.compress(data[:40], 1) + gzip.compress(data[40:], 1)), ("bz2", bz2.compress(data, 1)), ("xz", lzma.compress(data, filters=_XZ)))[k % 4]


QUERIES["decode_compressed"] = lambda spark, d: decoded(spark, d, _packed, columns=(), fields={"ts_secs"}).groupBy("msg_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts_secs").alias("last_secs"))
ORACLES["decode_compressed"] = f"WITH {_EVENTS} SELECT k AS msg_id, k % 4 + 1 AS n, k + k % 4 AS last_secs FROM e"

#: Malformed dumps: level, code, bytes.
BROKEN = [
    ("file", "TRUNCATED_HEADER", b"123"), ("file", "TRUNCATED_RECORD", X.session(1, X.bgp(4))[:-1]), ("record", "RIB_BEFORE_PEER_TABLE", X.rib("10.0.0.0/8", [(0, 1, b"")])),
    ("record", "TRUNCATED_BGP4MP", X.record(1, 16, 4, b"\0" * 5)), ("record", "TRUNCATED_PEER_TABLE", X.peer_table([("10.0.0.2", 1)], count=3)), ("message", "BAD_MARKER", X.session(1, b"\0" * 19)),
    ("message", "BAD_PEER_INDEX", X.peer_table([("10.0.0.2", 1)]) + X.rib("10.0.0.0/8", [(3, 1, b"")])), ("message", "MISSING_MP_REACH", X.peer_table([("10.0.0.2", 1)]) + X.rib("2001:db8::/32", [(0, 1, b"")], sub=4)),
    ("message", "TRUNCATED_UPDATE", X.session(1, X.bgp(2, b"\0"))), ("message", "BAD_PREFIX_WIDTH", X.session(1, X.bgp(2, X.update_body([b"\x21\1\1\1\1\1"])))), ("warning", "PEER_COUNT_MISMATCH", X.peer_table([("10.0.0.2", 1), ("10.0.0.3", 1)], count=1)),
    ("warning", "BAD_AGGREGATOR", X.session(1, X.bgp(2, X.update_body(attrs=[X.attr(7, b"\0\1")])))), ("message", "DUPLICATE_MP_ATTRIBUTE", X.session(1, X.bgp(2, X.update_body(attrs=[X.unreach(["2001:db8::/32"])] * 2)))),
]
_select("decode_errors", lambda k, u: BROKEN[k % len(BROKEN)][2], "SELECT k AS msg_id, CASE k % 13 " + " ".join(f"WHEN {n} THEN '{level}'" for n, (level, _, _) in enumerate(BROKEN)) + " END AS level, CASE k % 13 " + " ".join(f"WHEN {n} THEN '{code}'" for n, (_, code, _) in enumerate(BROKEN)) + " END AS code FROM e", "level", "code", of="error_log")


def _corrupt(k: int, u: int) -> bytes:
    bad = (X.attr(1, b"\7"), X.attr(7, b"\0\1"), X.attr(8, b"123"), X.attr(1, b"\0"))[k % 4]
    return X.session(k, X.bgp(2, X.update_body([X.nlri(_net(k))], attrs=[X.path([100 + u % 9]), bad])), _peer(u), 64400 + u % 200)


_lines("decode_corrupted_lines", _corrupt, f"SELECT k AS msg_id, 0 AS line_no, '+|' || {_TEXT('k')} || '|' || (100 + u % 9) || '||' || CASE WHEN k % 4 = 3 THEN 'i' ELSE '' END || '||||' || peer || ' ' || asn || '|' || k || '|1' || CASE WHEN k % 4 < 3 THEN '~CORRUPTED~' ELSE '' END AS line FROM e")

_EARLY = "-type UPDATE -peer ( 64407 64409 ) -timestamp '<300000' -aspath '^. 104'"


def _skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, peer and time are tested before attributes are decoded, and only the path is."""
    rows = decoded(spark, sf_dir, _bgp4mp, columns=lower.columns_read(lower.parse(_EARLY)), keep=lower.early_test(_EARLY))
    return lower.select(rows, _EARLY).select("msg_id", F.array_join(F.col("as_path").cast("array<string>"), " ").alias("path"))


QUERIES["decode_early_skip"] = _skipping
ORACLES["decode_early_skip"] = f"WITH {_EVENTS} SELECT k AS msg_id, (100 + u % 9) || ' 104 ' || CASE WHEN k % 4 > 0 THEN '7 8' ELSE '9' END AS path FROM e WHERE asn IN (64407, 64409) AND k * 60 < 300000 AND k % 9 = 4"
