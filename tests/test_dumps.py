"""MRT dumps from bytes to lines: formats, compression, errors, filters, streaming, the command line."""

import bz2
import gzip
import lzma

import pytest

from pathlark import cli
from pathlark.functions import aspath
from pathlark.operators import lines, peers
from pathlark.plans import lower, parser
from pathlark.sources import encode as X
from pathlark.sources import mrt
from pathlark.streaming import dumps

ATTRS = b"".join([X.attr(1, b"\0"), X.path([174, 3356], (3333, 65001)), X.attr(3, bytes([10, 0, 0, 1])), X.attr(6, b""), X.attr(7, (3333).to_bytes(4, "big") + bytes([10, 0, 0, 9])), X.communities((65535, 65281), (1, 2)), X.large((1, 2, 3))])
PLAIN = X.attr(1, b"\2") + X.path([1, 2]) + X.attr(3, bytes([10, 0, 0, 1]))
DATA = b"".join([
    X.peer_table([("10.0.0.2", 174), ("2001:db8::1", 70000)]), X.rib("193.0.0.0/16", [(0, 1622725323, ATTRS)]),
    X.session(1622725323, X.bgp(2, X.update_body([X.nlri("10.1.0.0/16", 7), X.nlri("10.2.0.0/16", 7), X.nlri("10.9.0.0/16", 3)], attrs=[PLAIN])), sub=9, micros=30),
    X.session(1622725323, X.bgp(2, X.update_body(withdrawn=[X.nlri("10.3.0.0/16")])), sub=1), X.session(1622725323, b"\0\6\0\1", sub=5),
    X.session(1622725323, X.bgp(1, X.open_body([1, 65]))), X.session(1622725323, X.bgp(4)), X.rib("2001:db8:5::/48", [(1, 5, X.path([1, 2]) + X.attr(14, b"\x10" + bytes(15) + b"\x01"))], sub=4),
])
LINES = [
    "=|193.0.0.0/16|174 3356 {3333,65001}|10.0.0.1|i|AT|3333 10.0.0.9|NO_EXPORT 1:2 1:2:3|10.0.0.2 174|1622725323|1",
    "+|10.9.0.0/16|1 2|10.0.0.1|?||||10.0.0.2 65001 3|1622725323.000030|1",
    "+|10.1.0.0/16 10.2.0.0/16|1 2|10.0.0.1|?||||10.0.0.2 65001 7|1622725323.000030|1",
    "-|10.3.0.0/16|||||||10.0.0.2 65001|1622725323|0",
    "#|6-1|||||||10.0.0.2 65001|1622725323|1",
    ">|MULTIPROTOCOL ASN32BIT|||||||10.0.0.2 65001|1622725323|1",
    "@||||||||10.0.0.2 65001|1622725323|1",
    "=|2001:db8:5::/48|1 2|::1|||||2001:db8::1 70000|5|1",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("dumps")
    for ext, pack in (("mrt", bytes), ("MRT.GZ", lambda x: gzip.compress(x[:90]) + gzip.compress(x[90:])), ("bz2", bz2.compress), ("xz", lzma.compress)):
        (d / f"a.{ext}").write_bytes(pack(DATA))
    return d


@pytest.mark.parametrize("name", ["a.mrt", "a.MRT.GZ", "a.bz2", "a.xz"])
def test_lines(spark, folder, name):
    assert [r.line for r in cli.filtered_lines(spark, [str(folder / name)]).collect()] == LINES
    assert all(x.count("|") == 10 for x in LINES)


def test_files_in_argument_order(spark, folder):
    got = cli.filtered_lines(spark, [str(folder / "a.xz"), str(folder / "a.bz2")], "-type OPEN").select("line", "file").collect()
    assert [r.file.rsplit(".", 1)[1] for r in got] == ["xz", "xz", "bz2", "bz2"] and got[0].line == LINES[4]  # state changes aren't filtered


@pytest.mark.parametrize("expression,want", [("-aspath '3356 3333'", [0]), ("-subnet 10.0.0.0/12 -peer 65001", [1, 2, 3]), ("-communities NO_EXPORT -attr LARGE_COMMUNITY", [0]), ("-not -aspath .", [3, 5, 6]), ("-related 2001:db8::/32", [7]), ("-exact -10.3.0.0/16", [3]), ("-timestamp 1622725323.00003", [1, 2]), ("-all-communities ( *:2 1:* )", [0]), ("-all-communities ()", [0, 1, 2, 3, 5, 6, 7])])
def test_filters(spark, folder, expression, want):
    got = [r.line for r in cli.filtered_lines(spark, [str(folder / "a.mrt")], expression).collect()]
    assert [x for x in got if x[0] != "#"] == [LINES[k] for k in want]


def test_engines_agree(spark, folder):
    df = mrt.read(spark, str(folder / "a.mrt"))
    for e in ("-aspath '(1|2)+'", "-aspath '^174 .* 65001$'", "-aspath '(1 2|3)+ $'"):
        one, *rest = ({r.rec_no for r in lower.select(df, e, engine).collect()} for engine in ("java", "linear", "table", "auto"))
        assert all(x == one for x in rest)


def test_very_long_paths(spark):
    """Patterns that would need deep recursion or much backtracking, on paths of 20,000 ASNs."""
    rows = [("odd", [1, 3] * 10_000), ("pairs", [1, 2] * 10_000), ("ones", [1] * 20_000), ("last", [1] * 19_999 + [5]), ("none", None), ("empty", [])]
    df = spark.createDataFrame(rows, "name string, as_path array<bigint>")
    wants = {"^ (1|3)* $": {"odd", "ones", "empty"}, "^ (1 2)+ $": {"pairs"}, ".* .* .* 5": {"last"}, "^ (1|3 1)* $": {"ones", "empty"}, "^ 1 (. .)* 5 $": {"last"}, "(1? 1?)* 7": set(), "1" + " ." * 13 + " 5": {"last"}}
    for pattern, want in wants.items():
        assert {r.name for r in df.where(aspath.matches(df.as_path, pattern)).collect()} == want, pattern


def test_spans(spark):
    """The leftmost match and the longest there, against all ways to match."""
    paths = [[], [1], [1, 2], [3, 1, 2, 1, 2, 9], [1, 1, 1], [2, 1, 3], [5, 1, 2, 3, 4]]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(paths)] + [(99, None)], "k int, p array<bigint>")
    for pattern in ("1 2|1", "1|1 2", "(1 2)+", "^1", "1*", "2$", "^$", ". 2 .", "1 (2|2 3|2 3 4)", "!1 1"):
        bare = aspath.parse(pattern)
        got = {r.k: r.s for r in df.select("k", aspath.span(df.p, pattern).alias("s")).collect()}
        assert got[99] is None
        for k, p in enumerate(paths):
            want = None
            for start in range(len(p) + 1):
                sizes = [n for n in range(len(p) - start + 1) if whole(bare, p, start, n)]
                if sizes:
                    want = (start, max(sizes))
                    break
            assert (got[k] and tuple(got[k])) == want, (pattern, p)
    assert df.select(aspath.captured(df.p, "1 2").alias("c")).collect()[3].c == [1, 2]


def whole(node, path, start, size):
    """Whether a node can match exactly path[start : start + size]."""
    if isinstance(node, aspath.One):
        return size == 1 and (node.asn is None or (path[start] == node.asn) != node.negated)
    if isinstance(node, aspath.Edge):
        return size == 0 and start == (0 if node.start else len(path))
    if isinstance(node, aspath.Alt):
        return any(whole(p, path, start, size) for p in node.parts)
    if isinstance(node, aspath.Rep):
        if size == 0:
            return node.op != "+" or whole(node.part, path, start, 0)
        return any(whole(node.part, path, start, n) and (n == size or node.op != "?" and whole(aspath.Rep(node.part, "*"), path, start + n, size - n)) for n in range(1, size + 1))
    if not node.parts:
        return size == 0
    return any(whole(node.parts[0], path, start, n) and whole(aspath.Cat(node.parts[1:]), path, start + n, size - n) for n in range(size + 1))


def codes(data, name="x"):
    return [(r["level"], r["code"]) for r in mrt.from_bytes(data, name, "error_log")]


def test_errors():
    table = X.peer_table([("10.0.0.2", 174)])
    ok = X.rib("10.0.0.0/8", [(0, 1, PLAIN)])
    assert codes(DATA[:-5]) == [("file", "TRUNCATED_RECORD")] and codes(DATA + b"123") == [("file", "TRUNCATED_HEADER")]
    assert codes(gzip.compress(DATA)[:-30], "x.gz") == [("file", "READ_ERROR")]
    assert codes(ok) == [("record", "RIB_BEFORE_PEER_TABLE")]
    assert codes(table + X.rib("10.0.0.0/8", [(3, 1, PLAIN)]) + ok) == [("message", "BAD_PEER_INDEX")]
    assert codes(table + X.rib("2001:db8::/32", [(0, 1, PLAIN)], sub=4)) == [("message", "MISSING_MP_REACH")]
    assert codes(X.peer_table([("10.0.0.2", 174), ("10.0.0.3", 1)], count=1)) == [("warning", "PEER_COUNT_MISMATCH")]
    assert codes(X.session(1, b"\0" * 19)) == [("message", "BAD_MARKER")] and codes(X.session(1, X.bgp(2, b"\0"))) == [("message", "TRUNCATED_UPDATE")]
    twice = X.reach(["2001:db8::1"], ["2001:db8::/32"])
    assert codes(X.session(1, X.bgp(2, X.update_body(attrs=[twice, twice])))) == [("message", "DUPLICATE_MP_ATTRIBUTE")]
    assert codes(X.session(1, X.bgp(2, X.update_body([b"\x21\1\1\1\1\1"])))) == [("message", "BAD_PREFIX_WIDTH")]
    assert codes(X.session(1, X.bgp(2, X.update_body(attrs=[X.reach(["10.0.0.1"], ["10.0.0.0/8"], 1, 5)])))) == [("message", "UNSUPPORTED_AFI_SAFI")]
    assert codes(X.record(1, 11, 0, b"ospf") + X.record(1, 13, 7, b"")) == []


def test_decoding():
    one = lambda data: mrt.from_bytes(data)[0]
    r = one(X.session(1, X.bgp(2, X.update_body(attrs=[X.path([1, 2]), X.path([3])])), micros=2_000_003))
    assert r["as_path"] == [1, 2] and (r["ts_secs"], r["ts_micros"]) == (3, 3)
    old = [X.path([7, 23456, 23456], wide=False), X.path([70000, 70001], code=17)]
    ags = [X.attr(7, (23456).to_bytes(2, "big") + bytes(4)), X.attr(18, (70001).to_bytes(4, "big") + bytes(4))]
    assert one(X.session(1, X.bgp(2, X.update_body(attrs=old + ags)), sub=1))["as_path"] == [7, 70000, 70001]
    assert one(X.session(1, X.bgp(2, X.update_body(attrs=old + ags)), sub=1))["aggregator"]["asn"] == 70001
    assert one(X.session(1, X.bgp(2, X.update_body(attrs=old)), sub=1))["as_path"] == [7, 23456, 23456]
    r = one(X.session(1, X.bgp(2, X.update_body([X.nlri("10.0.0.0/8")], attrs=[X.attr(3, bytes(4)), X.reach(["2001:db8::1", "fe80::1"], ["2001:db8::/32"])]))))
    assert [p["text"] for p in r["announced"]] == ["10.0.0.0/8", "2001:db8::/32"] and r["next_hops"] == ["0.0.0.0", "2001:db8::1", "fe80::1"]
    r = one(X.session(1, X.bgp(2, X.update_body(attrs=[X.unreach(["2001:db8::/32"])])), "2001:db8::9"))
    assert r["withdrawn"][0]["key"].startswith("6:") and r["peer_addr"] == "2001:db8::9"
    assert one(X.zebra(5, 7, b""))["msg_type"] == 4 and one(X.zebra(5, 1, X.update_body([X.nlri("10.0.0.0/8")])))["announced"][0]["len"] == 8
    r = one(X.table_dump("10.0.0.1/32", X.path([1], wide=False), originated=9))
    assert r["kind"] == "TABLE_DUMP" and r["ts_secs"] == 9 and not r["asn32"] and r["announced"][0]["text"] == "10.0.0.1/32"
    assert mrt.from_bytes(X.zebra(5, 3, b"\0\1\0\2"), relation="state_change")[0]["new_state"] == 2
    two = X.peer_table([("10.0.0.2", 1)]) + X.rib("10.0.0.0/8", [(0, 1, PLAIN)]) + X.peer_table([("10.0.0.3", 2)]) + X.rib("10.0.0.0/8", [(0, 1, PLAIN)])
    assert [r["peer_asn"] for r in mrt.from_bytes(two)] == [1, 2]
    full = X.peer_table([("10.0.0.2", 1)]) + X.rib("2001:db8::/32", [(0, 1, X.reach(["2001:db8::1"], []), 5)], sub=10)
    assert mrt.from_bytes(full)[0]["next_hops"] == ["2001:db8::1"] and mrt.from_bytes(full)[0]["path_id"] == 5


def test_peer_listing(spark, folder):
    table, refs = (mrt.read(spark, str(folder / "a.xz"), r) for r in ("peer_index", "peer_ref"))
    assert [r.line for r in peers.listing(table).orderBy("peer_idx").collect()] == ["10.0.0.2 174|0", "2001:db8::1 70000|1"]
    assert peers.listing(table, refs).count() == 2 and peers.bad_references(refs, table).count() == 0


def test_parquet_and_column_pruning(spark, folder, tmp_path):
    mrt.save(spark, str(folder / "a.mrt"), str(tmp_path / "out"))
    saved = spark.read.parquet(str(tmp_path / "out/message"))
    assert sorted(r.line for r in lines.message_lines(saved).collect()) == sorted(x for x in LINES if x[0] != "#")
    slim = lower.scan(spark, str(folder / "a.mrt"), "-aspath '1 2'", columns=set())
    assert slim.count() == 2 and slim.where("communities is not null").count() == 0
    assert sorted(d.name for d in (tmp_path / "out").iterdir()) == ["error_log", "message", "peer_index", "peer_ref", "state_change"]
    assert spark.read.parquet(str(tmp_path / "out/state_change")).count() == 1 and spark.read.parquet(str(tmp_path / "out/peer_index")).count() == 2


@pytest.mark.parametrize("expression,column", [("-type KEEPALIVE", "msg_type"), ("-timestamp '>=2021-06-03'", "ts_secs"), ("-timestamp '=1622725323.000030'", "ts_secs"), ("-peer 65001", "peer_asn"), ("-peer 2001:db8::1", "peer_addr_bin"), ("-type UPDATE -loops -peer ( '!10.0.0.9 65001' )", "msg_type")])
def test_filters_reach_the_scan(spark, folder, tmp_path, expression, column):
    mrt.save(spark, str(folder / "a.mrt"), str(tmp_path / "out"))
    saved = spark.read.parquet(str(tmp_path / "out/message"))
    found = lower.select(saved, expression)
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters: [") :].split("ReadSchema")[0]
    assert column in pushed.replace(f"IsNotNull({column})", ""), pushed
    whole = {tuple(r) for r in saved.where(lower.to_column(expression)).select("rec_no", "entry_no").collect()}
    assert {tuple(r) for r in found.select("rec_no", "entry_no").collect()} == whole
    assert {tuple(r) for r in lower.scan(spark, str(folder / "a.mrt"), expression).select("rec_no", "entry_no").collect()} == whole


def test_decoder_skips_early(monkeypatch):
    made = []
    whole = mrt.bgp.route_columns
    monkeypatch.setattr(mrt.bgp, "route_columns", lambda *a: made.append(1) or whole(*a))
    import io

    for expression, n in (("-type OPEN", 0), ("-peer 174", 1), ("-timestamp '<1970-01-02'", 1), ("-peer 174 -or -loops", 4), ("-not -peer 65001 -timestamp '>1970-01-02' -loops", 1)):
        made.clear()
        list(mrt.Dump("x", {"message"}, None, lower.early_test(expression)).rows(io.BytesIO(DATA)))
        assert len(made) == n, expression


def test_bad_values_are_kept(spark, tmp_path):
    bad = [X.attr(1, b"\7"), X.path([1, 2]), X.attr(3, b"\1\2"), X.attr(7, b"\0\1"), X.communities((1, 2)), X.attr(32, b"123")]
    (tmp_path / "bad.mrt").write_bytes(X.session(5, X.bgp(2, X.update_body([X.nlri("10.0.0.0/8")], attrs=bad))) + X.session(6, X.bgp(4)))
    assert [r.line for r in cli.filtered_lines(spark, [str(tmp_path / "bad.mrt")]).collect()] == ["+|10.0.0.0/8|1 2||||||10.0.0.2 65001|5|1~CORRUPTED~".replace("||||||", "|||||1:2|"), "@||||||||10.0.0.2 65001|6|1"]
    assert cli.filtered_lines(spark, [str(tmp_path / "bad.mrt")], "-type UPDATE", True).first().line.endswith("|1~\x1b[7mCORRUPTED\x1b[27m~")
    assert codes((tmp_path / "bad.mrt").read_bytes()) == [("warning", "BAD_ORIGIN")]
    assert mrt.from_bytes((tmp_path / "bad.mrt").read_bytes())[0]["error"] == "BAD_ORIGIN"


def test_equal_names_and_repeats(spark, tmp_path):
    for k, folder in enumerate(("x", "y")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.mrt").write_bytes(X.session(k, X.bgp(4)))
    (tmp_path / "y" / "my-a.mrt").write_bytes(X.session(2, X.bgp(4)))
    x, y, my = (str(tmp_path / p) for p in ("x/a.mrt", "y/a.mrt", "y/my-a.mrt"))
    seconds = lambda files: [r.line.split("|")[9] for r in cli.filtered_lines(spark, files).collect()]
    assert seconds([y, x, my]) == ["1", "0", "2"] and seconds([my, x, my]) == ["2", "0", "2"] and seconds([str(tmp_path / "y"), x]) == ["1", "2", "0"]


def test_session_settings_stay(spark, folder):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    mrt.read(spark, str(folder / "a.mrt")).count()
    dumps.read_stream(spark, str(folder))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_splitting_is_linear():
    import time

    data = X.bgp(4) * 400_000
    began = time.time()
    assert sum(1 for _ in mrt.bgp.split_messages(data)) == 400_000 and time.time() - began < 10


def test_address_functions(spark):
    from pyspark.sql import functions as F

    from pathlark.functions import net

    rows = [(net.ip_bytes(a),) for a in ("224.0.0.1", "10.0.0.1", "239.1.1.1", "ff02::1", "2001:db8::1", "::ffff:10.0.0.1")]
    got = spark.createDataFrame(rows, "a binary").select(net.is_multicast(F.col("a")).alias("m"), net.is_v4_mapped(F.col("a")).alias("v")).collect()
    assert [r.m for r in got] == [True, False, True, True, False, False] and [r.v for r in got] == [False] * 5 + [True]
    p = spark.sql("SELECT named_struct('path_id', 7L, 'text', '10.0.0.0/8') p UNION ALL SELECT named_struct('path_id', NULL, 'text', '::/0')")
    assert {r[0] for r in p.select(net.with_path_id(F.col("p"))).collect()} == {"7 10.0.0.0/8", "::/0"}


def test_bare_messages(spark, tmp_path):
    (tmp_path / "m.bgp").write_bytes(X.bgp(4) + X.bgp(2, X.update_body([X.nlri("10.0.0.0/8")])) + b"junk")
    got = mrt.read_messages(spark, str(tmp_path / "m.bgp")).orderBy("rec_no").collect()
    assert [(r.msg_type, r.error) for r in got] == [(4, None), (2, None), (None, "TRUNCATED_MESSAGE")]


def test_stream(spark, folder, tmp_path):
    df = lower.select(dumps.read_stream(spark, str(folder)), "-type UPDATE")
    q = dumps.counts(df).writeStream.format("memory").queryName("seen").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").groupBy().sum("n_messages").first()[0] == 16


def test_registered_term(spark, folder):
    from pyspark.sql import functions as F

    parser.register_term("-min-hops", lambda n: F.size("as_path") >= int(n), 1)
    assert lower.select(mrt.read(spark, str(folder / "a.mrt")), "-min-hops 3").count() == 1


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    out = tmp_path / "lines"
    assert cli.main(["grep", "-o", str(out), "--explain", str(folder / "a.mrt"), "-loops"], spark) == 0
    assert out.read_text().splitlines() == [LINES[4]] and "PathLoops" in capsys.readouterr().err
    assert cli.main(["legacy", "-f", str(folder / "a.bz2")], spark) == 0 and "10.0.0.2 174|0" in capsys.readouterr().out
    (tmp_path / "bad.mrt").write_bytes(DATA[:-5])
    assert cli.main(["peers", str(tmp_path / "bad.mrt")], spark) == 1 and cli.main(["grep", "-bad"], spark) == 2
    assert "truncated record (TRUNCATED_RECORD)" in capsys.readouterr().err
    assert cli.main(["grep", "--help"], spark) == 0 and cli.main(["-h"], spark) == 0 and "grep [-o FILE]" in capsys.readouterr().out
    assert cli.main(["grep", f"--output={out}", "--", str(folder / "a.mrt"), "-type", "OPEN"], spark) == 0 and out.read_text().splitlines() == [LINES[4], LINES[5]]
    assert cli.options(["-ro", "x", "f"]) == ({"refs": True, "output": "x"}, ["f"]) and cli.options(["-loops"]) == ({}, ["-loops"])
    assert cli.main(["grep", "-o"], spark) == 2 and cli.main(["peers", "--explain=1", "f"], spark) == 2
    monkeypatch.setenv("PRETEND", "1")
    assert cli.main(["legacy", "-p", "1 * 2", "a b"], spark) == 0 and capsys.readouterr().out == "pathlark grep 'a b' '(' -aspath '1 .* 2' ')'\n"
    monkeypatch.setattr("sys.stdin", type("In", (), {"buffer": __import__("io").BytesIO(DATA)})())
    assert cli.main(["grep", "-", "-type", "OPEN"], spark) == 0 and capsys.readouterr().out.splitlines() == [LINES[4], LINES[5]]
    assert cli.split_arguments(["a", "-", "!", "-loops"]) == (["a", "-"], ["!", "-loops"])


def test_small_files_share_batches(spark):
    import pyarrow as pa

    small = pa.RecordBatch.from_pydict({"path": [f"{k}.bgp" for k in range(500)], "content": [X.bgp(4) + b"junk"] * 500})
    got = [b.num_rows for b in mrt.message_decoder()(iter([small, small]))]
    assert sum(got) == 2000 and len(got) <= 3


@pytest.mark.parametrize("name", ["bare_messages", "decode_compressed", "decode_bgp4mp_et", "decode_rib_ipv6", "decode_latest_table", "decode_bgp4mp", "decode_peer_tables", "decode_open_notification", "decode_rib_addpath"])
def test_made_dumps_take_one_worker_a_task(spark, name):
    from helpers import SF

    from pathlark.plans import catalog

    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("make,relation", [("_bgp4mp", "message"), ("_two_tables", "peer_index"), ("_open_or_notification", "message")])
def test_memory_does_not_grow_with_events(spark, make, relation):
    import tracemalloc

    import pyarrow as pa

    from pathlark.plans import dump_catalog as D

    decode = mrt.decoder(relation, fields={"file", *lines.FIELDS, "addr"})
    peaks = []
    for n in (4000, 40000):
        batch = pa.RecordBatch.from_pydict({"k": range(n), "u": range(n)})
        before = pa.total_allocated_bytes()
        tracemalloc.start()
        held = 0
        for b in decode(D.dumps(getattr(D, make))([batch])):
            held = max(held, b.nbytes, pa.total_allocated_bytes() - before)
        peaks.append((tracemalloc.get_traced_memory()[1], held))
        tracemalloc.stop()
    assert peaks[1][0] < 1.3 * peaks[0][0] and peaks[1][1] < 1.3 * peaks[0][1], peaks


def test_packed_dumps_need_little_memory():
    from pathlark.plans import dump_catalog

    ending, data = dump_catalog._packed(3, 5)
    assert ending == "xz" and len(lzma.decompress(data, memlimit=150_000)) == 4 * len(X.session(3, X.bgp(4)))


def test_only_fields_asked_for(spark):
    import pyarrow as pa

    dump = pa.RecordBatch.from_pydict({"path": ["a"], "content": [DATA]})
    whole, some = (pa.Table.from_batches(mrt.decoder("message", fields=f)([dump])) for f in (None, {"rec_no", "announced", "as_path", "error"}))
    assert some.schema.names == ["rec_no", "announced", "as_path", "error"] and some.to_pylist() == whole.select(some.schema.names).to_pylist()
    assert mrt.schema_of("message", {"error", "file"}).names == ["file", "error"]


def test_rows_of_other_relations_are_not_made(monkeypatch):
    import io

    data = DATA + X.rib("10.0.0.0/8", [(9, 1, b""), (0, 2, PLAIN)]) + X.zebra(5, 3, b"\0\1\0\2") + X.session(1, b"\0", sub=5) + b"123"
    every = list(mrt.Dump("x", set(mrt.SCHEMAS)).rows(io.BytesIO(data)))
    assert {rel for rel, _ in every} == set(mrt.SCHEMAS)
    for relation in mrt.SCHEMAS:
        got = list(mrt.Dump("x", {relation}).rows(io.BytesIO(data)))
        assert [r for rel, r in got if rel == relation] == [r for rel, r in every if rel == relation]
        assert {rel for rel, _ in got} <= {relation, "error_log"} or relation == "error_log"
    texts = []
    whole = mrt.ip_text
    monkeypatch.setattr(mrt, "ip_text", lambda raw: texts.append(raw) or whole(raw))
    assert len(mrt.from_bytes(X.peer_table([("10.0.0.2", 1)] * 50) + X.rib("10.0.0.0/8", [(0, 1, PLAIN)]))) == 1 and len(texts) == 1


def test_peer_tables_leave_other_records_alone(monkeypatch):
    def never(*a):
        raise AssertionError("a record that no peer table needs")

    for name in ("_rib", "_session", "_zebra", "_table"):
        monkeypatch.setattr(mrt.Dump, name, never)
    assert [r["addr"] for r in mrt.from_bytes(DATA, relation="peer_index")] == ["10.0.0.2", "2001:db8::1"]


def test_only_members_asked_for(spark):
    import pyarrow as pa

    fields = {"rec_no", "announced.path_id", "announced.text", "aggregator.asn"}
    dump = pa.RecordBatch.from_pydict({"path": ["a"], "content": [DATA]})
    whole, some = (pa.Table.from_batches(mrt.decoder("message", fields=f)([dump])).to_pylist() for f in (None, fields))
    cut = lambda x, names: None if x is None else {n: x[n] for n in names}
    assert some == [{"rec_no": r["rec_no"], "announced": None if r["announced"] is None else [cut(p, ("path_id", "text")) for p in r["announced"]], "aggregator": cut(r["aggregator"], ("asn",))} for r in whole]
    assert mrt.schema_of("message", {"announced.text", "announced"})["announced"] == mrt.schema_of("message")["announced"]
    kinds = mrt.schema_of("message", lines.FIELDS)
    assert all(kinds[c].dataType.elementType.names == ["path_id", "text"] for c in ("announced", "withdrawn"))


def test_route_dumps_come_few_at_a_time(spark):
    import pyarrow as pa

    from pathlark.plans import catalog, dump_catalog

    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.list_(pa.int64()))]))
    c = pa.array([[(1, [2, 3]), (4, [])], [], None, [(5, None)], [(6, [7])]], kind)
    want = [[(1, [2, 3]), (4, [])], [], None, [(5, None)], [(6, [7])]]
    assert all(catalog._values(c.slice(a, n)) == want[a : a + n] for a in range(5) for n in range(1, 6 - a)) and catalog._values(c.slice(0, 0)) == []
    row = {"rec_no": 1, "ts_secs": 5, "peer_addr": "10.0.0.2", "peer_asn": 174, "as_path_segs": [{"type": 2, "asns": [1, 2]}, {"type": 1, "asns": [3]}], "origin": 0, "atomic": True, "aggregator": {"asn": 9, "addr": "10.0.0.9"}, "communities": [65536 + 2], "large_communities": [{"global": 1, "local1": 2, "local2": 3}], "net": "10.0.0.0/8"}
    types = pa.schema([next((f for f in mrt._arrow(mrt.SCHEMAS["message"]) if f.name == name), pa.field(name, pa.string())) for name in row])
    made = list(catalog.route_dumps([pa.RecordBatch.from_pylist([row, row | {"aggregator": None}] * 1000, types)]))
    assert sum(b.num_rows for b in made) == 2000 and max(b.num_rows for b in made) <= dump_catalog.HELD
    assert [r["aggregator"] for r in mrt.from_bytes(made[0]["content"][0].as_py())] == [{"asn": 9, "addr": "10.0.0.9"}]


def test_texts_of_addresses():
    from pathlark.functions import net

    for text in ("::", "::1", "::ffff:10.0.0.1", "::10.0.0.1", "::1:2:3", "1::", "1:0:2::", "0:0:1:2::", "1:2::3:0:0:4", "0:1:2:3:4:5:6:7", "2001:db8:0:1::5", "10.0.0.255"):
        assert net.ip_bytes(net.ip_text(net.ip_bytes(text))) == net.ip_bytes(text)
    assert [net.ip_text(net.ip_bytes(x)) for x in ("0:0:0:0:0:0:102:304", "1:0:0:2:0:0:0:0", "0:0:1:0:0:1:1:1", "1:0:2:3:4:5:6:7")] == ["::102:304", "1:0:0:2::", "0:0:1::1:1:1", "1:0:2:3:4:5:6:7"]
    for bad in ("01.2.3.4", "1.2.3", "1:2", "00001::", "1.2.3.4 ", ""):
        with pytest.raises(ValueError):
            net.ip_bytes(bad)
