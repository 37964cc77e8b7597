"""The command line.

    grep [-o FILE] [--explain] [--colour] FILES... [EXPRESSION]   messages that pass, as lines
    peers [-r] [-o FILE] FILES...                                 peer tables; -r: only the peers referred to
    legacy OPTIONS FILES...                                       the older option set; with PRETEND set, says what it would run

Options: -o, --output FILE; -r, --only-refs; --explain; -h, --help. -- ends them, and values may follow =. FILES may be - for
uncompressed standard input, which is also read without FILES; a file that is given twice is read twice. What is
malformed is told on standard error, and the exit status is then 1.
"""

from __future__ import annotations

import os
import shlex
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names
from .operators import legacy, lines, peers
from .plans import expr, lower, parser
from .sources import mrt, shared


COMMANDS = ("grep", "peers", "legacy")
#: Options to (name, whether they take a value).
OPTIONS = {"-o": ("output", True), "--output": ("output", True), "-r": ("refs", False), "--only-refs": ("refs", False), "--explain": ("explain", False), "--colour": ("colour", False)}


def split_arguments(args: Sequence[str]) -> tuple[list[str], list[str]]:
    """(files, expression): the expression starts at the first argument that is ( or ! or starts with a dash and more."""
    for k, a in enumerate(args):
        if a in ("(", "!") or a.startswith("-") and a != "-":
            return list(args[:k]), list(args[k:])
    return list(args), []


def options(args: Sequence[str]) -> tuple[dict[str, str | bool], list[str]]:
    """(options, rest). Options stand before the first file; flags of one letter may be joined, and -- ends the options."""
    found, args = {}, list(args)
    while args and args[0].startswith("-") and args[0] != "-":
        name, eq, value = args[0].partition("=")
        flags = [name] if name.startswith("--") else [f"-{c}" for c in name[1:]]
        if name == "--":
            return found, args[1:]
        if not all(f in OPTIONS for f in flags):
            break  # the expression
        args.pop(0)
        for k, f in enumerate(flags):
            name, takes = OPTIONS[f]
            if takes:
                if k < len(flags) - 1:
                    raise ValueError(f"{f} takes a value")
                if not eq and not args:
                    raise ValueError(f"{f}: a value is missing")
                found[name] = value if eq else args.pop(0)
            else:
                if eq:
                    raise ValueError(f"{f} takes no value")
                found[name] = True
    return found, args


def _spooled(spark: SparkSession, files: list[str]) -> list[str]:
    """The files, with standard input copied to one that all executors can read: in the shared folder."""
    out, spool = [], None
    for f in files or ["-"]:
        if f == "-":
            if spool is None:
                sc = spark.sparkContext
                at = sc._jvm.org.apache.hadoop.fs.Path(f"{shared.scratch(spark, 'stdin')}.mrt")
                to = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at)
                while piece := sys.stdin.buffer.read(1 << 20):
                    to.write(piece)
                to.close()
                spool = at.toString()
            f = spool
        out.append(f)
    return out


def filtered_lines(spark: SparkSession, files: Sequence[str], expression: Sequence[str] | str = (), colour: bool = False) -> DataFrame:
    """Lines of the messages that pass, and of all state changes, in file and record order."""
    keep = ("file", "rec_no", "entry_no")
    passed = lines.message_lines(lower.scan(spark, files, expression, lines.READS), keep, colour)
    states = mrt.read(spark, files, "state_change").withColumn("entry_no", F.lit(0))
    both = mrt.by_argument(passed.unionByName(lines.state_lines(states, keep)), files)
    return both.orderBy("file_no", *keep, "line_no")


def _emit(rows, output: str | None) -> None:
    to = open(output, "w", encoding="utf-8") if output else sys.stdout
    for r in rows:
        print(r[0], file=to)
    if output:
        to.close()


def _errors(spark: SparkSession, files: Sequence[str]) -> int:
    found = 0
    for r in mrt.in_order(mrt.read(spark, files, "error_log"), files).toLocalIterator():
        found += r["level"] != "warning"
        print(f"{r['file']}: record {r['rec_no']}: {r['level']}: {names.error_text(r['code'])} ({r['code']})", file=sys.stderr)
    return found


def main(argv: Sequence[str], spark: SparkSession | None = None) -> int:
    if argv and argv[0] in ("-h", "--help") or len(argv) > 1 and argv[0] in COMMANDS and argv[1] in ("-h", "--help"):
        print(__doc__)
        return 0
    if not argv or argv[0] not in COMMANDS:
        print(__doc__, file=sys.stderr)
        return 2
    name, args = argv[0], list(argv[1:])
    try:
        if name == "legacy":
            cmd = legacy.parse(args)
            files, expression, found = cmd.files, cmd.expression, {"output": cmd.output, "explain": cmd.show_plan, "refs": cmd.peers_only}
            name = "peers" if cmd.peers_only else "grep"
            if os.environ.get("PRETEND"):
                print(shlex.join(["pathlark", name, *(["-o", cmd.output] if cmd.output else []), *(["-r"] if cmd.peers_only else []), *files, *expression]))
                return 0
        else:
            found, args = options(args)
            files, expression = split_arguments(args) if name == "grep" else (args, [])
        tree = parser.parse(expression)
    except ValueError as e:
        print(f"pathlark: {e}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.getOrCreate()
    files = _spooled(spark, files)
    if found.get("explain"):
        print(expr.show(tree), file=sys.stderr)
    if name == "peers":
        table = mrt.read(spark, files, "peer_index")
        rows = mrt.by_argument(peers.listing(table, mrt.read(spark, files, "peer_ref") if found.get("refs") else None), files)
        rows = rows.orderBy("file_no", "file", "table_no", "peer_idx").select("line")
    else:
        rows = filtered_lines(spark, files, expression, bool(found.get("colour"))).select("line")
    _emit(rows.toLocalIterator(), found.get("output"))
    return int(_errors(spark, files) > 0)
