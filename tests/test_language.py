"""The predicate language without Spark: parsing, simplification, patterns, times, networks, legacy options."""

import re
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathlark.functions import aspath, moments, net
from pathlark.operators import legacy
from pathlark.plans import expr as E
from pathlark.plans import parser
from pathlark.sources.lists import template_tokens, tokens_of

PATHS = [[], [1], [432, 1], [7, 432], [121, 19819, 172, 1111], [1174, 3356], [174, 3356], [1921, 202, 397], [2431, 1111, 5439, 79], [174, 2603, 2603, 3356]]
CASES = [
    ("19819 172", [4]), ("174 3356", [6]), ("( 202 397 | 1111 5439 )", [7, 8]), ("174 (2603+|202+|303+) 3356", [9]), ("^ !432", [1, 3, 4, 5, 6, 7, 8, 9]),
    (".*", list(range(10))), ("^$", [0]), ("^1$|79$", [1, 8]), ("!!432", [2, 3]), ("1 ^", []), ("(2603*)+ 3356$", [5, 6, 9]),
]


def by_java(node, path):
    asns = aspath.named(node)
    text = "".join(aspath._letter(asns.index(x) + 1 if x in asns else 0) for x in path)
    return bool(re.search(f"(?s)(?:{aspath.to_java(node, asns)})".replace(r"\z", r"\Z"), text))


def by_table(node, path):
    asns, moves, ends = aspath.table(node)
    state = 0
    for x in path:
        state = moves[state * (len(asns) + 1) + (asns.index(x) + 1 if x in asns else 0)]
    return ends[state]


@pytest.mark.parametrize("pattern,hits", CASES)
def test_patterns(pattern, hits):
    node = aspath.parse(pattern)
    machine = aspath.Machine(node)
    for engine in (machine.search, lambda p: by_java(node, p), lambda p: by_table(node, p)):
        assert [k for k, p in enumerate(PATHS) if engine(p)] == hits


@pytest.mark.parametrize("bad", ["", "!", "!.", "! (1)", "(1", "1)", "*", "^*", "|+", "4294967296", "a", "1 !^"])
def test_bad_patterns(bad):
    with pytest.raises(aspath.PatternError):
        aspath.parse(bad)


_atom = st.sampled_from(["1", "2", "!1", ".", "3"])
_pattern = st.recursive(_atom, lambda p: st.one_of(st.tuples(p, p).map(" ".join), st.tuples(p, p).map(lambda t: f"({t[0]}|{t[1]})"), st.tuples(p, st.sampled_from("*+?")).map(lambda t: f"({t[0]}){t[1]}"), p.map(lambda x: f"^{x}"), p.map(lambda x: f"{x}$")), max_leaves=5)


@settings(max_examples=300, deadline=None)
@given(_pattern, st.lists(st.integers(1, 4), max_size=6))
def test_engines_agree(pattern, path):
    node = aspath.parse(pattern)
    assert aspath.Machine(node).search(path) == by_java(node, path) == by_table(node, path)


def test_engines_by_pattern():
    safe = lambda p: aspath.is_safe(aspath.parse(p))
    assert all(map(safe, ["^1 .* 2$", "1 (2+|3+) 4", "^(1|3)* $", "1* 2", "^100* 107? 108+$"]))
    assert not any(map(safe, ["(1 2)+", ".* .* .* 5", "(1? 1?)*", "(1|2 3)*", "1+ 2+"]))
    assert aspath.table(aspath.parse("1" + " ." * 12)) is None  # 2^12 states


def test_nested_repetition_is_flattened():
    assert aspath.parse("((1+)+)*") == aspath.Cat((aspath.Rep(aspath.One(1), "*"),))


@pytest.mark.parametrize("text,micros", [("1622725323", 1622725323000000), ("1622725323.000030", 1622725323000030), ("2021-06-03T13:02:03Z", 1622725323000000), ("1985-04-12T23:20:50.52Z", 482196050520000), ("2012-10-01", 1349049600000000), ("2021-01-01T24:00:00Z", 1609545600000000), ("2021-06-03t15:02:03+02:00", 1622725323000000), ("-1", -1000000)])
def test_times(text, micros):
    assert moments.parse(text) == micros


def test_clock_of_today():
    assert moments.parse("00:01", today=date(1970, 1, 2)) == 86_460_000_000


@pytest.mark.parametrize("bad", ["2021-02-30", "2021-01-01T00:00:60", "2021-01-01T24:00:01", "noon", "2021-1-1", "99999999999999999999"])
def test_bad_times(bad):
    with pytest.raises(ValueError):
        moments.parse(bad)


@pytest.mark.parametrize("text", ["::", "::1", "1::", "2001:db8::1", "1::2:0:0:3:4", "0:0:1::2:3:4", "1:0:2:3:4:5:6:7", "::ffff:1.2.3.4", "10.0.0.1"])
def test_address_text(text):
    assert net.ip_text(net.ip_bytes(text)) == text


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=16, max_size=16), st.integers(0, 128), st.integers(0, 128))
def test_keys_tell_containment(raw, a, b):
    import ipaddress

    one, two = net.parse_net(f"{ipaddress.ip_address(raw)}/{a}"), net.parse_net(f"{ipaddress.ip_address(raw)}/{b}")
    assert one.key.startswith(two.key) == ipaddress.ip_network(str(one)).subnet_of(ipaddress.ip_network(str(two)))


def test_precedence_and_simplification():
    loops, bogon, asn = E.PathLoops(), E.BogonAsn(), E.HasAttribute(8)
    assert parser.parse("-loops -o -bogon-asn -attr 8") == E.Or((loops, E.And((bogon, asn))))
    assert parser.parse("! -loops -bogon-asn") == E.And((E.Not(loops), bogon))
    assert parser.parse("-not -not -loops") == loops
    assert parser.parse("( -loops -or ( -bogon-asn -or -loops ) )") == E.Or((loops, bogon))
    assert parser.parse("-peer () -or -loops") == loops
    assert parser.parse("") == E.Const(True) and parser.parse("-all-communities ()") == E.Const(True) and parser.parse("-subnet ( )") == E.Const(False)
    assert parser.parse("-communities ( 65535:666 65535:* )") == E.Communities(False, (E.Community(65535, None),))
    assert parser.parse("-all-communities ( 65535:666 65535:* )") == E.Communities(True, (E.Community(65535, 666),))
    assert parser.parse("-subnet ( 10.0.0.0/8 10.1.0.0/16 )") == parser.parse("-subnet 10.0.0.0/8")
    assert parser.parse("-exact 10.0.0.1") == parser.parse("-exact 10.0.0.1/32")
    assert parser.parse("-attr LOCAL_PREFI") == parser.parse("-attr local_pref") == parser.parse("-attr 0x5")


@pytest.mark.parametrize("bad", ["-x", "-type", "-type 256", "( -loops", "-loops )", "-peer 1:2:3", "-peer ( 1", "-communities *:*", "-communities 65536:1", "-exact 10.0.0.0/33", "-loops -or", "!", "-aspath (", "-timestamp >", "-attr x"])
def test_bad_expressions(bad):
    with pytest.raises(parser.ExpressionError):
        parser.parse(bad)


def test_list_files(tmp_path):
    assert tokens_of('199036 !173.2.2.1 "173.2.2.1 7566" // x\n/* y */ +193.0.0.0/16') == ["199036", "!173.2.2.1", "173.2.2.1 7566", "+193.0.0.0/16"]
    assert template_tokens('a # b\n"c d" e') == ["a", "c d", "e"]
    (tmp_path / "list").write_text("0:* // reserved\n65535:* NO_EXPORT 0xFFFFFF01")
    assert parser.parse(["-communities", str(tmp_path / "list")]) == E.Communities(False, (E.Community(0, None), E.Community(65535, None)))


def test_legacy(tmp_path):
    (tmp_path / "as").write_text("3 # three\n4")
    cmd = legacy.parse(["-a", "1", "-A", str(tmp_path / "as"), "-M", "1:2 3:4", "-p", "1 * 2", "-P", "9", "-l", "-o", "out", "f.gz"])
    assert cmd.files == ["f.gz"] and cmd.output == "out"
    assert parser.parse(cmd.expression) == parser.parse("-peer ( 1 3 4 ) -not -communities ( 1:2 3:4 ) -loops ( -aspath '1 .* 2' -or -not -aspath 9 )")
    for bad in (["-c"], ["-T"], ["-e", "1.2.3.4", "-s", "1.2.3.4"], ["-f", "-l"], ["-A", "/no/file"]):
        with pytest.raises(legacy.UsageError):
            legacy.parse(bad)
