"""The registered queries and their DuckDB SQL.

Each predicate query returns the numbers of the messages that pass. The SQL is written with list and
integer functions, so it doesn't share the translation that it checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aspath, names
from ..operators import legacy, lines, peers
from ..sources import encode, mrt
from ..streaming import dumps
from . import dump_catalog, lower, relation, surface_catalog

QUERIES: dict = dump_catalog.QUERIES | surface_catalog.QUERIES
ORACLES: dict = dict(dump_catalog.ORACLES)
FLAGSHIP = "flagship"

_NET = lambda x: f"(((167772160 + ({x} * 7919) % 16777216) >> (24 - {x} % 25)::INT) << (24 - {x} % 25)::INT)"
_IP = lambda n: f"(({n} >> 24) % 256 || '.' || ({n} >> 16) % 256 || '.' || ({n} >> 8) % 256 || '.' || {n} % 256)"

_ITEMS = """items AS (SELECT l_orderkey AS k, list(CASE WHEN l_suppkey % 25 = 0 THEN 64500 + l_suppkey WHEN l_suppkey % 41 = 0 THEN 23456 ELSE 100 + l_suppkey % 9 END ORDER BY l_linenumber, l_partkey, l_suppkey)::BIGINT[] AS base,
 list((l_partkey % 65536) * 65536 + l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey)::BIGINT[] AS c FROM lineitem GROUP BY 1)"""
_ROUTES = f"""routes AS (SELECT o_orderkey AS msg_id, o_custkey AS cust, 8 + o_orderkey % 25 AS plen, {_NET("o_orderkey")} AS net, 64400 + o_custkey % 200 AS peer_asn, {_IP("(167772160 + o_custkey % 65536)")} AS peer_addr, epoch_us(o_orderdate) AS us,
 coalesce(base, []) AS base, list_concat(coalesce(base, []), CASE WHEN o_orderkey % 11 = 0 THEN [64400 + o_custkey % 200, 777] ELSE [] END)::BIGINT[] AS path, coalesce(c, []) AS comms FROM orders LEFT JOIN items ON k = o_orderkey),
t AS (SELECT *, ',' || array_to_string(path, ',') || ',' AS txt FROM routes)"""
_SESSIONS = f"""t AS (SELECT event_id AS msg_id, event_type AS kind, CASE WHEN event_type IN ('click', 'purchase') THEN 2 WHEN event_type = 'view' THEN 4 WHEN event_type = 'signup' THEN 1 ELSE 3 END AS msg_type, 64400 + user_id % 200 AS peer_asn, {_IP("(167837696 + user_id % 65536)")} AS peer_addr,
 epoch_us(ts) AS us, CASE WHEN event_type IN ('click', 'purchase') THEN [100 + user_id % 9, 100 + event_id % 9] ELSE [] END AS path, CASE WHEN event_type = 'click' THEN [event_id, event_id + 1] ELSE [] END AS ann, CASE WHEN event_type = 'purchase' THEN [event_id, event_id + 2] ELSE [] END AS wd, event_id % 65535 + 1 AS six FROM events)"""


def _predicate(name: str, expression, where: str, on: str = "routes", paths: bool = True) -> None:
    """Registers a filter over a relation and its SQL condition."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = relation.routes(spark, sf_dir, paths) if on == "routes" else relation.sessions(spark, sf_dir)
        return lower.select(df, expression).select(F.col("rec_no").alias("msg_id"))

    QUERIES[name] = query
    ORACLES[name] = f"WITH {_ITEMS + ', ' + _ROUTES if on == 'routes' else _SESSIONS} SELECT msg_id FROM t WHERE {where}"


def _some(where: str, over: str = "range(1, len(path) + 1)") -> str:
    return f"len(list_filter({over}, lambda i: {where})) > 0"


_RUNS = "list_filter(list_transform(list_filter(range(1, len(path) + 1), lambda i: i = 1 OR path[i - 1] <> path[i]), lambda i: path[i]), lambda x: x <> 23456)"
_LOOP = f"len({_RUNS}) > len(list_distinct({_RUNS}))"
_BOGON = "len(list_filter(path, lambda x: x = 0 OR x = 23456 OR x BETWEEN 64496 AND 131071 OR x BETWEEN 4200000000 AND 4294967295)) > 0"
_US = {"lo": 904608000000000, "hi": 915148800000000}  # 1998-09-01, 1999-01-01


def _inside(x: str, net: int, size: int) -> str:
    """SQL: the prefix of number x lies within net/size."""
    return f"(8 + {x} % 25 >= {size} AND ({_NET(x)} >> {32 - size}) = {net >> (32 - size)})"


# -- message types and attributes
_predicate("type_eq", "-type KEEPALIVE", "msg_type = 4", "sessions")
_predicate("type_number", "-type 1 -or -type NOTIFICATION", "msg_type IN (1, 3)", "sessions")
_predicate("attr_has", "-attr ATOMIC_AGGREGATE", "msg_id % 7 = 0", paths=False)
_predicate("attr_number", "-attr 8 -attr LARGE_COMMUNITY", "len(comms) > 0 AND msg_id % 3 = 0")

# -- AS paths
_predicate("aspath_seq", "-aspath '101 102'", _some("path[i] = 101 AND path[i + 1] = 102"))
_predicate("aspath_anchor_start", "-aspath '^101'", "path[1] = 101")
_predicate("aspath_anchor_end", "-aspath '104$'", "path[len(path)] = 104")
_predicate("aspath_alt_group", "-aspath '101 (102+|103+) 104'", "regexp_matches(txt, ',101,(?:(?:102,)+|(?:103,)+)104,')")
_predicate("aspath_alternatives", "-aspath '^105|106$'", "path[1] = 105 OR path[len(path)] = 106")
_predicate("aspath_repeat", "-aspath '^100* 107? 108+$'", "regexp_matches(txt, '^,(?:100,)*(?:107,)?(?:108,)+$')")
_predicate("aspath_not", "-aspath '101 !102 103'", _some("path[i] = 101 AND path[i + 1] <> 102 AND path[i + 2] = 103"))
_predicate("aspath_not_first", "-aspath '^ !101'", "len(path) > 0 AND path[1] <> 101")
_predicate("aspath_any", "-aspath '101 . 103'", _some("path[i] = 101 AND path[i + 2] = 103"))
_predicate("aspath_empty", "-aspath '^$'", "len(path) = 0")
_predicate("aspath_all", "-aspath '.*'", "true")
_predicate("loops", "-loops", _LOOP)
_predicate("bogon_asn", "-bogon-asn", _BOGON)



def aspath_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where paths match first, and what they match there."""
    df = relation.routes(spark, sf_dir)
    found = aspath.span(F.col("as_path"), "(101|103)+ 105?")
    return df.select(F.col("rec_no").alias("msg_id"), found.alias("at"), "as_path").where("at IS NOT NULL").select("msg_id", "at.start", "at.length", F.array_join(F.slice("as_path", F.col("at.start") + 1, F.col("at.length")).cast("array<string>"), ",").alias("matched"))


QUERIES["aspath_spans"] = aspath_spans
ORACLES["aspath_spans"] = f"""WITH {_ITEMS}, {_ROUTES}, m AS (SELECT msg_id, regexp_extract(txt, '^(.*?),(?:(?:101|103),)+', 1) AS before, regexp_extract(txt, ',((?:(?:101|103),)+(?:105,)?)', 1) AS matched FROM t WHERE regexp_matches(txt, ',(?:101|103),'))
SELECT msg_id, (length(before) - length(replace(before, ',', '')))::INT AS start, (length(matched) - length(replace(matched, ',', '')))::INT AS length, rtrim(matched, ',') AS matched FROM m"""

# -- peers
_predicate("peer_asn", "-peer 64407", "peer_asn = 64407", paths=False)
_predicate("peer_addr", "-peer ( 10.0.0.7 10.0.0.9 )", "peer_addr IN ('10.0.0.7', '10.0.0.9')", paths=False)
_predicate("peer_pair", "-peer ( '10.0.0.7 64407' '10.0.0.8 1' 64410 )", "(peer_addr = '10.0.0.7' AND peer_asn = 64407) OR peer_asn = 64410", paths=False)
_predicate("peer_not", "-peer ( '!10.0.0.7 64407' )", "peer_addr <> '10.0.0.7' AND peer_asn = 64407", paths=False)

# -- prefixes
_predicate("prefix_exact", "-exact ( 10.2.0.0/15 10.0.0.0/8 )", "(net = 167903232 AND plen = 15) OR (net = 167772160 AND plen = 8)", paths=False)
_predicate("prefix_subnet", "-subnet 10.0.0.0/12", "plen >= 12 AND (net >> 20) = 160", paths=False)
_predicate("prefix_supernet", "-supernet 10.10.10.0/24", "plen <= 24 AND (net >> (32 - plen)::INT) = (168430080 >> (32 - plen)::INT)", paths=False)
_predicate("prefix_related", "-related 10.10.0.0/16", "(plen >= 16 AND (net >> 16) = 2570) OR (plen <= 16 AND (net >> (32 - plen)::INT) = (168427520 >> (32 - plen)::INT))", paths=False)
_predicate("prefix_announce_only", "-subnet +10.0.0.0/10", _some(_inside("i", 167772160, 10), "ann"), "sessions")
_predicate("prefix_withdraw_only", "-subnet -10.0.0.0/10", _some(_inside("i", 167772160, 10), "wd"), "sessions")
_predicate("prefix_both_sides", "-subnet 10.0.0.0/10", _some(_inside("i", 167772160, 10), "list_concat(ann, wd)"), "sessions")
_predicate("prefix_ipv6", "-subnet ( 2001:db8:10::/44 2001:db8:ffff::/64 )", "kind = 'click' AND (six >> 4) = 1", "sessions")

# -- times
for _name, _op, _sql in (("lt", "<", "<"), ("le", "<=", "<="), ("eq", "", "="), ("ge", ">=", ">="), ("gt", ">", ">"), ("ne", "!", "<>")):
    _predicate(f"ts_{_name}", ["-timestamp", f"{_op}1998-09-01"], f"us {_sql} {_US['lo']}", paths=False)
_predicate("ts_range", "-timestamp '>=1998-09-01T00:00:00Z' -timestamp '<1999-01-01T02:00+02:00'", f"us >= {_US['lo']} AND us < {_US['hi']}", paths=False)
_predicate("ts_micros", "-timestamp '>=2024-01-10T12:00:00.5'", "us >= 1704888000500000", "sessions")

# -- communities
_predicate("comm_any_full", "-communities ( 7:8 0x00110012 BLACKHOLE )", _some("x IN (7 * 65536 + 8, 17 * 65536 + 18, 4294902426)", "comms").replace("lambda i", "lambda x"))
_predicate("comm_any_partial", "-communities ( 42:* *:17 )", _some("(x >> 16) = 42 OR x % 65536 = 17", "comms").replace("lambda i", "lambda x"))
_predicate("comm_all", "-all-communities ( *:7 *:8 )", _some("x % 65536 = 7", "comms").replace("lambda i", "lambda x") + " AND " + _some("x % 65536 = 8", "comms").replace("lambda i", "lambda x"))
_predicate("comm_all_empty", "-all-communities ()", "true", "sessions")

# -- operators
_predicate("bool_and", "-loops -bogon-asn", f"{_LOOP} AND {_BOGON}")
_predicate("bool_or", "-loops -or -bogon-asn", f"{_LOOP} OR {_BOGON}")
_predicate("bool_not", "! -loops", f"NOT ({_LOOP})")
_predicate("bool_nested", "-not ( -bogon-asn -or -loops ) -aspath '^101' -or -peer 64407 -a -attr AGGREGATOR", f"(NOT ({_BOGON} OR {_LOOP}) AND path[1] = 101) OR (peer_asn = 64407 AND msg_id % 5 = 0)")
_predicate("not_on_non_update", "-not -aspath .", "len(path) = 0", "sessions")
_predicate("empty_list", "-peer () -or -communities () -or -subnet ()", "false", "sessions")
_predicate("empty_expression", "", "true", "sessions")
_predicate("flagship", "-aspath '^101 .* 104$' -not -loops", f"len(path) > 1 AND path[1] = 101 AND path[len(path)] = 104 AND NOT ({_LOOP})")
_predicate("legacy_options", legacy.parse(["-a", "64407", "-i", "10.0.0.9", "-p", "101 ? 103", "-p", "^105", "-L", "-s", "10.0.0.0/9"]).expression, f"(peer_asn = 64407 OR peer_addr = '10.0.0.9') AND plen >= 9 AND (net >> 23) = 20 AND NOT ({_LOOP}) AND ({_some('path[i] = 101 AND path[i + 2] = 103')} OR path[1] = 105)")


# -- lines
_COMM_NAMES = "CASE x " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in names.COMMUNITIES.items()) + " ELSE (x >> 16) || ':' || x % 65536 END"
_LINE = f"""'=|' || {_IP("net")} || '/' || plen || '|' || array_to_string(base, ' ') || CASE WHEN msg_id % 11 = 0 THEN CASE WHEN len(base) > 0 THEN ' ' ELSE '' END || '{{' || peer_asn || ',777}}' ELSE '' END || '|' || peer_addr || '|' || substr('ie?', (msg_id % 3 + 1)::INT, 1) || '|' || CASE WHEN msg_id % 7 = 0 THEN 'AT' ELSE '' END || '|' ||
 CASE WHEN msg_id % 5 = 0 THEN peer_asn || ' ' || peer_addr ELSE '' END || '|' || array_to_string(list_concat(list_transform(comms, lambda x: {_COMM_NAMES}), CASE WHEN msg_id % 3 = 0 THEN [peer_asn || ':' || cust || ':1'] ELSE [] END), ' ') || '|' || peer_addr || ' ' || peer_asn || '|' || us // 1000000 || CASE WHEN us % 1000000 > 0 THEN '.' || lpad((us % 1000000)::VARCHAR, 6, '0') ELSE '' END || '|1'"""


def format_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.message_lines(relation.routes(spark, sf_dir).withColumn("msg_id", F.col("rec_no")), ("msg_id",)).drop("line_no")


QUERIES["format_lines"] = format_lines
ORACLES["format_lines"] = f"WITH {_ITEMS}, {_ROUTES} SELECT msg_id, {_LINE} AS line FROM t"

_WHEN = "us // 1000000 || CASE WHEN us % 1000000 > 0 THEN '.' || lpad((us % 1000000)::VARCHAR, 6, '0') ELSE '' END"
_TEXT = lambda x: f"{_IP(_NET(x))} || '/' || (8 + {x} % 25)"
_MID = "path[1] || ' ' || path[2] || '|' || CASE WHEN kind = 'click' THEN peer_addr || '|i' ELSE '|' END || '||||'"
_TAIL = f"peer_addr || ' ' || peer_asn || coalesce(' ' || pid, '') || '|' || {_WHEN} || '|' || CASE WHEN msg_id % 2 = 0 THEN '1' ELSE '0' END"


def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all message types; announcements split by path id."""
    return lines.message_lines(relation.sessions(spark, sf_dir).withColumn("msg_id", F.col("rec_no")), ("msg_id",))


QUERIES["addpath_split"] = session_lines
ORACLES["addpath_split"] = f"""WITH {_SESSIONS},
n AS (SELECT *, unnest([msg_id % 3, (msg_id + 1) % 3, msg_id % 3]) AS pid, unnest([0, 1, 2]) AS pos, unnest([{_TEXT("msg_id")}, {_TEXT("(msg_id + 1)")}, '2001:db8:' || printf('%x', six) || '::/48']) AS txt FROM t WHERE kind = 'click'),
g AS (SELECT msg_id, kind, peer_addr, peer_asn, us, path, pid, string_agg(txt, ' ' ORDER BY pos) AS nets FROM n GROUP BY ALL),
o AS (SELECT *, NULL::BIGINT AS pid FROM t WHERE kind <> 'click')
SELECT msg_id, (row_number() OVER (PARTITION BY msg_id ORDER BY pid) - 1)::INT AS line_no, '+|' || nets || '|' || {_MID} || {_TAIL} AS line FROM g
UNION ALL SELECT msg_id, 0, CASE WHEN kind = 'purchase' THEN '-|' || {_TEXT("msg_id")} || ' ' || {_TEXT("(msg_id + 2)")} || '|' || {_MID} WHEN kind = 'view' THEN '@||||||||' WHEN kind = 'signup' THEN '>|MULTIPROTOCOL ASN32BIT ' || (200 + msg_id % 3) || '|||||||' ELSE '!||||||||' END || {_TAIL} FROM o"""


def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = relation.sessions(spark, sf_dir).select("peer_addr", "peer_asn", "ts_secs", "ts_micros", "asn32", F.col("rec_no").alias("msg_id"), (F.col("rec_no") % 6 + 1).alias("old_state"), ((F.col("rec_no") + 1) % 6 + 1).alias("new_state"))
    return lines.state_lines(df, ("msg_id",)).drop("line_no")


QUERIES["state_change_lines"] = state_changes
ORACLES["state_change_lines"] = f"WITH {_SESSIONS}, s AS (SELECT *, NULL::BIGINT AS pid FROM t) SELECT msg_id, '#|' || (msg_id % 6 + 1) || '-' || ((msg_id + 1) % 6 + 1) || '|||||||' || {_TAIL} AS line FROM s"


# -- peer tables
_PEERS = f"p AS (SELECT 'f' || c_custkey % 4 AS file, ((c_custkey // 4) % 2)::INT AS table_no, (c_custkey // 8)::INT AS peer_idx, {_IP('(167772160 + c_custkey % 65536)')} || ' ' || (64400 + c_custkey % 200) || '|' || CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '0' END AS line, 64400 + c_custkey % 200 AS asn FROM customer)"
_REFS = "r AS (SELECT 'f' || o_custkey % 4 AS file, ((o_custkey // 4) % 2)::INT AS table_no, (o_custkey // 8 + CASE WHEN o_orderkey % 97 = 0 THEN 1000000 ELSE 0 END)::INT AS peer_idx FROM orders)"
_SHOWN = ("file", "table_no", "peer_idx", "line")
QUERIES["peer_table"] = lambda spark, d: peers.listing(relation.peers(spark, d)).select(*_SHOWN)
ORACLES["peer_table"] = f"WITH {_PEERS} SELECT file, table_no, peer_idx, line FROM p"
QUERIES["peer_refs_only"] = lambda spark, d: peers.listing(relation.peers(spark, d), relation.refs(spark, d)).select(*_SHOWN)
ORACLES["peer_refs_only"] = f"WITH {_PEERS}, {_REFS} SELECT file, table_no, peer_idx, line FROM p SEMI JOIN r USING (file, table_no, peer_idx)"
QUERIES["peer_bad_refs"] = lambda spark, d: peers.bad_references(relation.refs(spark, d), relation.peers(spark, d))
ORACLES["peer_bad_refs"] = f"WITH {_PEERS}, {_REFS} SELECT DISTINCT file, table_no, peer_idx, 'BAD_PEER_INDEX' AS code FROM r ANTI JOIN p USING (file, table_no, peer_idx)"
QUERIES["rib_peer_join"] = lambda spark, d: peers.resolve(relation.refs(spark, d), relation.peers(spark, d)).groupBy("asn").agg(F.count(F.lit(1)).alias("n_entries"))
ORACLES["rib_peer_join"] = f"WITH {_PEERS}, {_REFS} SELECT asn, count(*) AS n_entries FROM r JOIN p USING (file, table_no, peer_idx) GROUP BY asn"
QUERIES["latest_table_asof"] = lambda spark, d: peers.latest_table(relation.read(spark, d, "events").select(F.concat(F.lit("e"), (F.col("user_id") % 16).cast("string")).alias("file"), F.col("event_id").alias("rec_no"), (F.col("event_type") == "signup").alias("is_table")), "is_table").select("file", "rec_no", "table_no")
ORACLES["latest_table_asof"] = "SELECT 'e' || user_id % 16 AS file, event_id AS rec_no, nullif(sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id % 16 ORDER BY event_id) - 1, -1)::INT AS table_no FROM events"

# -- prefix lists in tables
_LIST = "n AS (SELECT DISTINCT 167772160 + ((s_suppkey * 65536 * 3) % 16777216) AS ln, 8 + s_suppkey % 17 AS ll FROM supplier), m AS (SELECT DISTINCT ll, (ln >> (32 - ll)::INT) AS bits FROM n)"


def _by_table(mode: str):
    from ..functions import net

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = F.col("s_suppkey")
        nets = relation.read(spark, sf_dir, "supplier").select(net.ipv4_prefix(F.lit(167772160) + (key * 65536 * 3) % 16777216, (8 + key % 17).cast("int"))["key"].alias("key"))
        return lower.select_by_table(relation.routes(spark, sf_dir, False), nets, mode).select(F.col("rec_no").alias("msg_id"))

    return query


_CONTAINED = {"exact": "plen = ll AND (net >> (32 - ll)::INT) = bits", "subnet": "plen >= ll AND (net >> (32 - ll)::INT) = bits", "supernet": "plen <= ll AND (net >> (32 - plen)::INT) = (bits >> (ll - plen)::INT)"}
_CONTAINED["related"] = f"({_CONTAINED['subnet']}) OR ({_CONTAINED['supernet']})"
for _mode, _where in _CONTAINED.items():
    QUERIES[f"prefix_table_{_mode}"] = _by_table(_mode)
    ORACLES[f"prefix_table_{_mode}"] = f"WITH {_ITEMS}, {_ROUTES}, {_LIST} SELECT msg_id FROM t WHERE EXISTS (SELECT 1 FROM m WHERE {_where})"


# -- matches of each term, windows, and the decoder
def explain_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lower.explain_matches(relation.routes(spark, sf_dir), "-loops -or -bogon-asn -peer 64407")
    return df.select(F.col("rec_no").alias("msg_id"), "match_0", "match_1", "match_2", "passed")


QUERIES["explain_matches"] = explain_matches
ORACLES["explain_matches"] = f"WITH {_ITEMS}, {_ROUTES} SELECT msg_id, {_LOOP} AS match_0, {_BOGON} AS match_1, peer_asn = 64407 AS match_2, {_LOOP} OR ({_BOGON} AND peer_asn = 64407) AS passed FROM t"


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dumps.counts(relation.sessions(spark, sf_dir), "1 day", by=("msg_type",))
    return out.select(F.unix_seconds("window.start").alias("day_start"), "msg_type", "n_messages")


QUERIES["window_counts"] = window_counts
ORACLES["window_counts"] = f"WITH {_SESSIONS} SELECT us // 86400000000 * 86400 AS day_start, msg_type, count(*) AS n_messages FROM t GROUP BY ALL"


def _route_dump(r: dict) -> bytes:
    """A peer table and a table entry of a route."""
    segs = [tuple(asns) if kind == 1 else asns for kind, asns in r["as_path_segs"]]
    attrs = [encode.attr(1, bytes([r["origin"]])), encode.path(*segs), encode.attr(3, encode.ip_bytes(r["peer_addr"]))]
    attrs += [encode.attr(6, b"")] if r["atomic"] else []
    attrs += [encode.attr(7, r["aggregator"][0].to_bytes(4, "big") + encode.ip_bytes(r["aggregator"][1]))] if r["aggregator"] else []
    attrs += [encode.communities(*[(c >> 16, c & 0xFFFF) for c in r["communities"]])] if r["communities"] else []
    attrs += [encode.large(*r["large_communities"])] if r["large_communities"] else []
    return encode.peer_table([(r["peer_addr"], r["peer_asn"])]) + encode.rib(r["net"], [(0, r["ts_secs"], b"".join(attrs))])


def _values(c) -> list:
    """The values of an Arrow column, structs as tuples; for nested ones far faster than to_pylist."""
    import pyarrow as pa

    if pa.types.is_list(c.type):
        at = c.offsets.to_pylist()
        inner = _values(c.values.slice(at[0], at[-1] - at[0])) if at else []
        out = [inner[a - at[0] : b - at[0]] for a, b in zip(at, at[1:])]
    elif pa.types.is_struct(c.type):
        out = list(zip(*[_values(c.field(k)) for k in range(c.type.num_fields)]))
    elif c.null_count == 0 and pa.types.is_integer(c.type):
        return c.to_numpy().tolist()
    else:
        return c.to_pylist()
    return [x if ok else None for x, ok in zip(out, c.is_valid().to_pylist())] if c.null_count else out


def route_dumps(batches):
    """(path, content) of a dump for each route, few at a time, as their values take much more memory than their bytes."""
    import pyarrow as pa

    for b in batches:
        for at in range(0, b.num_rows, dump_catalog.HELD):
            held = b.slice(at, dump_catalog.HELD)
            rows = [dict(zip(held.schema.names, r)) for r in zip(*map(_values, held.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([str(r["rec_no"]) for r in rows], pa.string()), pa.array(list(map(_route_dump, rows)), pa.binary())], ["path", "content"])


def mrt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every route as an MRT table dump in memory, decoded again and printed."""
    fields = {"file", *lines.FIELDS}
    decode = mrt.decoder("message", fields=fields)
    # few bytes, but much work for each: not to be left in the one task that their size would make
    src = relation.routes(spark, sf_dir, parts=dump_catalog.parts(spark)).select("rec_no", "ts_secs", "peer_addr", "peer_asn", "as_path_segs", "origin", "atomic", "aggregator", "communities", "large_communities", F.col("announced")[0]["text"].alias("net"))
    decoded = src.mapInArrow(lambda batches: decode(route_dumps(batches)), mrt.schema_of("message", fields)).withColumn("msg_id", F.col("file").cast("long"))
    return lines.message_lines(decoded, ("msg_id",)).drop("line_no")


QUERIES["mrt_round_trip"] = mrt_round_trip
ORACLES["mrt_round_trip"] = f"WITH {_ITEMS}, {_ROUTES} SELECT msg_id, {_LINE} AS line FROM t"
ORACLES |= surface_catalog.oracles(f"{_ITEMS}, {_ROUTES}")
