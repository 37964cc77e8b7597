r"""Messages as text: 11 fields parted by |, all from built-in functions.

    TYPE|PREFIXES|AS_PATH|NEXT_HOP|ORIGIN|ATOMIC_AGGREGATE|AGGREGATOR|COMMUNITIES|PEER|TIMESTAMP|ASN32BIT

An UPDATE gives a line for what it withdraws and one for what it announces; with path ids, one for each id.
A side without prefixes gives none. Lines of one row are exploded where they stand, nothing is shuffled.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names

RIB_KINDS, CORRUPT = ("TABLE_DUMP", "TABLE_DUMPV2"), "~CORRUPTED~"
#: In inverse video.
COLOURED = "~\x1b[7mCORRUPTED\x1b[27m~"
#: The columns from path attributes that lines show.
READS = {"as_path_segs", "origin", "aggregator", "communities", "large_communities"}
#: All columns of messages that lines show, of prefixes only the members that they do.
FIELDS = READS | {"kind", "msg_type", "ts_secs", "ts_micros", "peer_addr", "peer_asn", "asn32", "announced.path_id", "announced.text", "withdrawn.path_id", "withdrawn.text", "next_hops", "atomic", "capabilities", "error"}


def _named(code: Column, table: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable((v, k) for k, v in table.items())]), code)


def community_text(c: Column) -> Column:
    pair = F.concat(F.shiftright(c, 16).cast("string"), F.lit(":"), (c % 65536).cast("string"))
    return F.coalesce(_named(c, names.COMMUNITIES), pair)


def path_text(segs: Column) -> Column:
    """Segments with blanks between; sets in braces."""
    seg = lambda s: F.when(s["type"] == 1, F.concat(F.lit("{"), F.array_join(s["asns"].cast("array<string>"), ","), F.lit("}"))).otherwise(F.array_join(s["asns"].cast("array<string>"), " "))
    return F.array_join(F.transform(segs, seg), " ")


def time_text(secs: Column, micros: Column) -> Column:
    """Seconds, and microseconds if there are any."""
    return F.concat(secs.cast("string"), F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""))


def _empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def attribute_fields() -> list[Column]:
    """The fields AS_PATH to COMMUNITIES."""
    large = F.transform("large_communities", lambda x: F.concat_ws(":", x["global"].cast("string"), x["local1"].cast("string"), x["local2"].cast("string")))
    both = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in (F.transform("communities", community_text), large)])
    return [
        _empty(path_text(F.col("as_path_segs"))), _empty(F.array_join("next_hops", " ")), _empty(F.get(F.array(F.lit("i"), F.lit("e"), F.lit("?")), F.col("origin"))),
        F.when(F.col("atomic"), "AT").otherwise(""), _empty(F.concat_ws(" ", F.col("aggregator.asn").cast("string"), F.col("aggregator.addr"))), F.array_join(both, " "),
    ]


def _tail(path_id: Column | None = None) -> list[Column]:
    peer = F.concat_ws(" ", "peer_addr", F.col("peer_asn").cast("string"), *([] if path_id is None else [path_id.cast("string")]))
    return [peer, time_text(F.col("ts_secs"), F.coalesce("ts_micros", F.lit(0))), F.when(F.col("asn32"), "1").otherwise("0")]


def _by_path_id(prefixes: Column) -> Column:
    """array<prefix> to array<struct<path_id, text>>, a row for each path id, ascending."""
    ids = F.array_sort(F.array_distinct(F.transform(prefixes, lambda p: p["path_id"])))
    texts = lambda i: F.array_join(F.transform(F.filter(prefixes, lambda p: p["path_id"].eqNullSafe(i)), lambda p: p["text"]), " ")
    return F.transform(ids, lambda i: F.struct(i.alias("path_id"), texts(i).alias("text")))


def message_lines(messages: DataFrame, keep: tuple[str, ...] = (), colour: bool = False) -> DataFrame:
    """line (and the columns `keep`), in the order of each message's lines in line_no. colour: the mark of bad values stands out on terminals."""
    update = F.col("msg_type") == names.UPDATE
    rib = F.col("kind").isin(*RIB_KINDS)
    side = lambda mark, c: F.transform(_by_path_id(F.coalesce(F.col(c), F.array().cast(messages.schema[c].dataType))), lambda x: F.struct(mark.alias("mark"), x["text"].alias("text"), x["path_id"].alias("id")))
    routes = F.concat(side(F.lit("-"), "withdrawn"), side(F.when(rib, "=").otherwise("+"), "announced"))
    caps = F.array_join(F.transform("capabilities", lambda c: F.coalesce(_named(c, names.CAPABILITIES), c.cast("string"))), " ")
    mark = F.coalesce(_named(F.col("msg_type"), {v: k for k, v in names.MARKERS.items()}), F.lit("?"))
    text = F.when(F.col("msg_type") == 1, _empty(caps)).when(mark == "?", F.lower(F.hex("msg_type"))).otherwise("")
    other = F.array(F.struct(mark.alias("mark"), text.alias("text"), F.lit(None).cast("long").alias("id")))
    rows = messages.select("*", F.posexplode(F.when(update, routes).otherwise(other)).alias("line_no", "_line"))
    attrs = [F.when(update, c).otherwise("") for c in attribute_fields()]
    line = F.concat_ws("|", F.col("_line.mark"), F.col("_line.text"), *attrs, *_tail(F.col("_line.id")))
    line = F.concat(line, F.when(F.col("error").isNotNull(), COLOURED if colour else CORRUPT).otherwise("")) if "error" in messages.columns else line
    return rows.select(*keep, "line_no", line.alias("line"))


def state_lines(changes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines of state changes."""
    states = F.concat_ws("-", F.col("old_state").cast("string"), F.col("new_state").cast("string"))
    return changes.select(*keep, F.lit(0).alias("line_no"), F.concat_ws("|", F.lit("#"), states, *[F.lit("")] * 6, *_tail()).alias("line"))


def write(lines: DataFrame, path: str, compression: str = "none") -> None:
    """Lines into a folder of text files."""
    lines.select("line").write.mode("overwrite").option("compression", compression).text(path)
