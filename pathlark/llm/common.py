"""What the training-data operators share: reading tables, checkpoints, portions of batches, word rules."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch, shared_dir

__all__ = ["scratch", "shared_dir", "cut", "n_words", "portions", "small_batches", "table"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that Python code handles at a time. A batch from Spark has up to spark.sql.execution.arrow.maxBytesPerBatch.
PORTION_BYTES, PORTION_ROWS = 1 << 20, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def portions(batches: Iterable[pa.RecordBatch], column: str = "text", nbytes: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in batches of about `nbytes` of one column (a longer text stands alone), whatever Spark's batch size."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        start = held = 0
        for k, n in enumerate(size):
            if k > start and (held + n > nbytes or k - start >= PORTION_ROWS):
                yield b.slice(start, k - start)
                start, held = k, 0
            held += n
        if start < b.num_rows:
            yield b.slice(start)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches of few bytes for what is run within; the session's own setting is there again afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def n_words(text: Column) -> Column:
    """Number of words; null counts as the empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
