"""Queries over the parts around filters: list files, option letters, literals, text output, bare messages, with their SQL."""

from __future__ import annotations

import os
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..functions import moments, net
from ..operators import legacy, lines
from ..sources import encode as X
from ..sources import lists, mrt, shared
from . import dump_catalog as D
from . import expr, lower, parser, relation

QUERIES: dict = {}
ORACLES: dict = {}
_E = f"WITH {D._EVENTS} "


def _literals(name: str, rows, schema: str, sql: str) -> None:
    """A query of what the driver makes of literals."""
    QUERIES[name] = lambda spark, d: spark.createDataFrame(rows(), schema)
    ORACLES[name] = sql


# -- bare messages
def _stream(k: int, u: int) -> bytes:
    """An UPDATE, a message of a type without a name, a KEEPALIVE, and for some the head of one more."""
    return X.bgp(2, X.update_body([X.nlri(D._net(k))], attrs=[X.path([100 + u % 9])])) + X.bgp(9) + X.bgp(4) + (b"\xff" * 7 if k % 3 == 0 else b"")


def bare_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of BGP messages without records around them; what is cut off at the end is a row with its error."""
    fields = ("file", "rec_no", "msg_type", "as_path", "error")
    rows = D.through(spark, sf_dir, _stream, mrt.message_decoder(fields=fields), mrt.schema_of("message", fields))
    return rows.select("msg_id", F.col("rec_no").cast("int").alias("rec_no"), "msg_type", F.element_at("as_path", 1).alias("first_asn"), "error")


QUERIES["bare_messages"] = bare_messages
ORACLES["bare_messages"] = _E + "SELECT k AS msg_id, 0 AS rec_no, 2 AS msg_type, 100 + u % 9 AS first_asn, NULL AS error FROM e UNION ALL SELECT k, 1, 9, NULL, NULL FROM e UNION ALL SELECT k, 2, 4, NULL, NULL FROM e UNION ALL SELECT k, 3, NULL, NULL, 'TRUNCATED_MESSAGE' FROM e WHERE k % 3 = 0"
QUERIES["unknown_type_lines"] = lambda spark, d: lines.message_lines(D.decoded(spark, d, lambda k, u: X.session(k, X.bgp(6 + k % 200), D._peer(u), 64400 + u % 200)), ("msg_id",)).drop("line_no")
ORACLES["unknown_type_lines"] = _E + "SELECT k AS msg_id, '?|' || printf('%x', 6 + k % 200) || '|||||||' || peer || ' ' || asn || '|' || k || '|1' AS line FROM e"
QUERIES["route_refresh_close_lines"] = lambda spark, d: lines.message_lines(D.decoded(spark, d, lambda k, u: X.session(k, X.bgp(5 if k % 2 else 255), D._peer(u), 64400 + u % 200)), ("msg_id",)).drop("line_no")
ORACLES["route_refresh_close_lines"] = _E + "SELECT k AS msg_id, CASE WHEN k % 2 = 1 THEN '^' ELSE '<' END || '||||||||' || peer || ' ' || asn || '|' || k || '|1' AS line FROM e"


# -- text output
def _written(compression: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared.scratch(spark, "lines")
        made = D.decoded(spark, sf_dir, lambda k, u: X.session(k, X.bgp(4), D._peer(u), 64400 + u % 200))
        lines.write(lines.message_lines(made), path, compression)
        return spark.read.text(path).select(F.col("value").alias("line"))

    return query


for _how in ("none", "gzip", "bzip2"):
    QUERIES[f"text_sink_{_how}"] = _written(_how)
    ORACLES[f"text_sink_{_how}"] = _E + "SELECT '@||||||||' || peer || ' ' || asn || '|' || k || '|1' AS line FROM e"


# -- list files and template files, which stand on the driver
def _with_file(text: str, make):
    """make(path of a file with this text)."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "list")
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return make(path)


_PREFIXES = "// prefixes\n10.0.0.0/12 /* and */ +10.64.0.0/10\n-10.128.0.0/9 2001:db8::/32"
_PEERS = "# peers\n64407\n\"10.0.0.9\"  # and\n64410"
_INSIDE = lambda net_, size: f"(plen >= {size} AND (net >> {32 - size}) = {net_ >> (32 - size)})"


def _from_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _with_file(_PREFIXES, lambda path: parser.parse(["-subnet", path]))
    return lower.select(relation.routes(spark, sf_dir, False), tree).select(F.col("rec_no").alias("msg_id"))


def _from_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _with_file(_PEERS, lambda path: parser.parse(legacy.parse(["-A", path]).expression))
    return lower.select(relation.routes(spark, sf_dir, False), tree).select(F.col("rec_no").alias("msg_id"))


QUERIES["list_file"] = _from_lists
QUERIES["template_file"] = _from_templates


def _legacy(name: str, argv: list[str]) -> None:
    QUERIES[name] = lambda spark, d: lower.select(relation.routes(spark, d), legacy.parse(argv).expression).select(F.col("rec_no").alias("msg_id"))


#: Option letters of the older set, and what they ask of a route in SQL.
LEGACY = {
    "legacy_attr": (["-t", "6", "-t", "AGGREGATOR"], "msg_id % 7 = 0 OR msg_id % 5 = 0"),
    "legacy_communities": (["-m", "*:7 *:8", "-M", "*:9"], "(len(list_filter(comms, lambda x: x % 65536 = 7)) > 0 AND len(list_filter(comms, lambda x: x % 65536 = 8)) > 0) OR len(list_filter(comms, lambda x: x % 65536 = 9)) = 0"),
    "legacy_paths": (["-P", "101"], "len(list_filter(path, lambda x: x = 101)) = 0"),
    "legacy_supernet": (["-u", "10.10.10.0/24"], "plen <= 24 AND (net >> (32 - plen)::INT) = (168430080 >> (32 - plen)::INT)"),
    "legacy_related": (["-r", "10.10.0.0/16"], "(plen >= 16 AND (net >> 16) = 2570) OR (plen <= 16 AND (net >> (32 - plen)::INT) = (168427520 >> (32 - plen)::INT))"),
    "legacy_exact": (["-e", "10.2.0.0/15", "-e", "10.0.0.0/8"], "(net = 167903232 AND plen = 15) OR (net = 167772160 AND plen = 8)"),
}
for _name, (_argv, _where) in LEGACY.items():
    _legacy(_name, _argv)


def oracles(routes: str) -> dict[str, str]:
    """All SQL; routes: that of the relation t of routes."""
    where = {name: test for name, (_, test) in LEGACY.items()}
    where |= {"list_file": f"{_INSIDE(167772160, 12)} OR {_INSIDE(171966464, 10)}", "template_file": "peer_asn IN (64407, 64410) OR peer_addr = '10.0.0.9'"}
    return ORACLES | {name: f"WITH {routes} SELECT msg_id FROM t WHERE {test}" for name, test in where.items()}


# -- literals, as the driver reads them
_TIMES = {
    "1622725323": "1622725323000000", "1622725323.00003": "1622725323000030", "-1": "-1000000", "2021-06-03": "epoch_us(TIMESTAMP '2021-06-03 00:00:00')", "2021-06-03T13:02": "epoch_us(TIMESTAMP '2021-06-03 13:02:00')",
    "2021-06-03t13:02:03z": "epoch_us(TIMESTAMP '2021-06-03 13:02:03')", "1985-04-12T23:20:50.52Z": "epoch_us(TIMESTAMP '1985-04-12 23:20:50.52')", "2021-06-03T15:02:03+02:00": "epoch_us(TIMESTAMP '2021-06-03 13:02:03')", "2021-01-01T24:00:00Z": "epoch_us(TIMESTAMP '2021-01-02 00:00:00')",
    "2021-02-30": "NULL", "2021-01-01T00:00:60": "NULL", "24:00:01": "NULL", "00:00": "epoch_us(date_trunc('day', (now() AT TIME ZONE 'UTC')))",
}


def _time(text: str) -> int | None:
    try:
        return moments.parse(text)
    except ValueError:
        return None


_literals("time_literals", lambda: [(t, _time(t)) for t in _TIMES], "text string, micros long", " UNION ALL ".join(f"SELECT '{t}' AS text, ({sql})::BIGINT AS micros" for t, sql in _TIMES.items()))
_literals("list_tokens", lambda: list(enumerate(lists.tokens_of("a // b c\n'd e' /* f\n g */ h \"//i\" j"))), "place int, token string", "SELECT * FROM (VALUES (0, 'a'), (1, 'd e'), (2, 'h'), (3, '//i'), (4, 'j')) AS v(place, token)")
_literals("template_tokens", lambda: list(enumerate(lists.template_tokens("a # b\n\"c d\" e#f"))), "place int, token string", "SELECT * FROM (VALUES (0, 'a'), (1, 'c d'), (2, 'e')) AS v(place, token)")
_literals("arguments_split", lambda: [("files", " ".join(cli.split_arguments(["x", "-", "y", "!", "-loops"])[0])), ("expression", " ".join(cli.split_arguments(["x", "-", "y", "!", "-loops"])[1]))], "part string, arguments string", "SELECT * FROM (VALUES ('files', 'x - y'), ('expression', '! -loops')) AS v(part, arguments)")
_literals("plan_text", lambda: list(enumerate(expr.show(parser.parse("! ( -loops -or -bogon-asn ) -type OPEN")).split("\n"))), "place int, line string", "SELECT * FROM (VALUES (0, 'AND'), (1, '  NOT'), (2, '    OR'), (3, '      PathLoops()'), (4, '      BogonAsn()'), (5, '  MessageType(code=1)')) AS v(place, line)")
QUERIES["number_texts"] = lambda spark, d: relation.read(spark, d, "orders").select("o_orderkey", F.conv(F.col("o_orderkey").cast("string"), 10, 36).alias("base36"), F.lower(F.hex("o_orderkey")).alias("hex"), F.conv(F.hex("o_orderkey"), 16, 10).cast("long").alias("back"), F.expr("try_cast(concat('4294967295', o_orderkey) AS INT)").alias("overflow"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".5e1")).cast("double").alias("number"))
ORACLES["number_texts"] = "SELECT o_orderkey, to_base(o_orderkey, 36) AS base36, printf('%x', o_orderkey) AS hex, o_orderkey AS back, NULL::INT AS overflow, (o_orderkey || '.5e1')::DOUBLE AS number FROM orders"


# -- addresses
def address_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers of several kinds of addresses, and prefixes after their path ids."""
    kinds = ("224.{}.0.1", "10.{}.0.1", "ff02::{:x}", "2001:db8::{:x}", "::ffff:10.0.0.{}")
    rows = D.decoded(spark, sf_dir, lambda k, u: X.session(k, X.bgp(2, X.update_body([X.nlri(D._net(k), k % 3)])), kinds[k % 5].format(k % 200 + 1), 1, 9))
    addr = F.col("peer_addr_bin")
    return rows.select("msg_id", net.is_multicast(addr).alias("multicast"), net.is_v4_mapped(addr).alias("mapped"), net.with_path_id(F.col("announced")[0]).alias("net"), net.key_column(addr, F.length(addr) * 8).endswith(F.lit("1")).alias("odd"))


QUERIES["address_kinds"] = address_kinds
ORACLES["address_kinds"] = _E + f"SELECT k AS msg_id, k % 5 IN (0, 2) AS multicast, k % 5 = 4 AS mapped, k % 3 || ' ' || {D._TEXT('k')} AS net, CASE WHEN k % 5 < 2 THEN true ELSE (k % 200 + 1) % 2 = 1 END AS odd FROM e"
