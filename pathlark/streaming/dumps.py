"""New dump files in a folder, as a stream of rows.

All predicates look at one message alone, so the stream has no state, needs no watermark, and everything that
takes a DataFrame of messages takes a streaming one. What a peer table says holds within its file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import mrt

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def read_stream(spark: SparkSession, folder: str, relation: str = "message", columns: Sequence[str] | None = None, files_per_batch: int = 64) -> DataFrame:
    """A relation of all dumps in a folder, also of those that come later."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select("path", "content").mapInArrow(mrt.decoder(relation, columns), mrt.SCHEMAS[relation])


def event_time() -> Column:
    """A message's time as a timestamp."""
    return F.timestamp_micros(F.col("ts_secs") * 1_000_000 + F.coalesce("ts_micros", F.lit(0)))


def counts(messages: DataFrame, window: str = "5 minutes", late: str = "1 hour", by: Sequence[str] = ("peer_asn", "msg_type")) -> DataFrame:
    """Messages per time window and `by`; what comes later than `late` is left out."""
    timed = messages.withColumn("ts", event_time()).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("window"), *by).agg(F.count(F.lit(1)).alias("n_messages"))
