"""A corpus pipeline of five stages over `documents`.

Line quality rules, line dedup by source, MinHash near-dedup, mixing sources to target weights, and
packing into training sequences. Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of `documents`.

Every stage takes those columns only, so extra ones, whatever their names, are left out; an empty table gives an empty
one; texts are handled whole at any length; each repeated row is a row. What else is odd is settled per stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlark.llm import common, linededup, mixing, neardup, packing, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops failing lines, and the documents that the rules reject.

    Null, empty and blank texts have under 10 words and are rejected. Rows are judged alone: ties, repeated rows and
    nulls in other columns don't matter. n_chars follows the text.
    """
    return quality.clean(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the boilerplate lines of each source, repeats of its longer lines, and documents of which nothing is left.

    Documents that had no word before (null, empty, blank) lose nothing and stay. Rows without a source are one site.
    Of a repeated line the row with the smallest doc_id keeps it, null ids last, ties by a hash of the row; rows equal in
    id, source and text are one place, and all keep it.
    """
    out = linededup.drop_repeats(docs.select(*COLUMNS), "text", F.col("source"), "doc_id")
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(common.WORD))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles) stays: that with the smallest doc_id.

    Texts without a word (null, empty, blank) and rows without a doc_id are in no group and stay. Rows that repeat
    the doc_id that stays all stay.
    """
    return neardup.keep_one(docs.select(*COLUMNS), size=neardup.SIZE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts have size 0; null sources are one source; rows that repeat a doc_id within a source are taken
    equally often; ties of the hash go by doc_id, null first.
    """
    return mixing.apply_mix(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all training sequences.

    Null and empty texts are their end token alone. Rows that repeat are packed as often, null ids are carried through.
    """
    return packing.pack(docs.select(*COLUMNS))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mix sources", mix_sources),
    ("pack sequences", pack_sequences),
]
ORACLE_SQL = None  # a tokenizer and a greedy retrieval order have no SQL form; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written as Parquet to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    base = common.scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
