"""Peer tables: listings, the peers that table entries refer to, and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["file", "table_no", "peer_idx"]
#: A peer table is broadcast up to so many rows; they are counted first.
BROADCAST_ROWS = 500_000


def listing(peers: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """peer_index rows and `line` ("addr asn|asn32"); with refs, of the peers that an entry refers to.

    Tables that occur twice are listed twice.
    """
    if refs is not None:
        peers = peers.join(refs.select(*KEYS).distinct(), KEYS, "left_semi")
    return peers.withColumn("line", F.concat(F.col("addr"), F.lit(" "), F.col("asn").cast("string"), F.lit("|"), F.when(F.col("asn32"), "1").otherwise("0")))


def resolve(entries: DataFrame, peers: DataFrame) -> DataFrame:
    """Entries with (file, table_no, peer_idx) and their peer's addr, asn; those without one are dropped."""
    small = peers.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return entries.join(F.broadcast(peers) if small else peers, KEYS)


def bad_references(refs: DataFrame, peers: DataFrame) -> DataFrame:
    """References beyond the end of their table, as warnings: file, table_no, peer_idx, code."""
    return refs.select(*KEYS).distinct().join(peers, KEYS, "left_anti").withColumn("code", F.lit("BAD_PEER_INDEX"))


def latest_table(records: DataFrame, is_table: str, file: str = "file", order: str = "rec_no") -> DataFrame:
    """records with table_no: the number of the last table at or before each record of its file, null before the first.

    For records that aren't read by the MRT source, which numbers tables as it reads. A file is read by one
    task there as well.
    """
    run = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("table_no", F.nullif(F.sum(F.col(is_table).cast("int")).over(run) - 1, F.lit(-1)).cast("int"))
