r"""Threshold-scaled document fingerprints, from built-in functions only.

A fingerprint holds every distinct shingle hash below a fixed fraction 1/``SCALE`` of the hash range
(64 leading bits of MD5; shingles are five words, a shorter text is one shingle). As the fraction is
fixed, sketches of parts merge by union, and |A & B| / min(|A|, |B|) estimates how far the smaller
text is contained in the larger, however unequal they are. Written as sorted 16-digit hex numbers.

The next document stands in ascending doc_id order (rows that repeat an id: in order of text), after
the last comes the first. It is found without a global sort: a window per block of 1,024 ids, and for
the last row of each block the head of the next block that isn't empty, found by windows over ever
coarser blocks. Windows and block ends read the same shuffle of the texts.

Nulls: a null text is the empty text. Rows without a doc_id have no place in the order: they come
after nobody, and their next document is the empty text. Two empty sketches are alike (1.0) only if the
texts are equal. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHINGLE, SCALE, BLOCK_BITS = 5, 4, 10


def sketch(words: Column, size: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct hashes (16 hex digits) below the fraction, of an array of words."""
    top = f"{(1 << 64) // scale:016x}"
    many = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.md5(F.array_join(F.slice(words, i, size), " ")))
    one = F.array(F.md5(F.array_join(words, " ")))
    hashes = F.when(F.size(words) >= size, many).when(F.size(words) > 0, one).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.transform(F.filter(hashes, lambda h: h < top), lambda h: F.substring(h, 1, 16))))


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    words = df.withColumn("_fp_words", F.regexp_extract_all(F.col(text), F.lit(common.WORD), F.lit(0)))
    return words.withColumn(name, sketch(F.col("_fp_words"))).drop("_fp_words")


def containment(a: Column, b: Column, same: Column) -> Column:
    """Estimated containment of the smaller set in the larger; `same` decides for two empty sketches."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).when((F.size(a) == 0) & (F.size(b) == 0) & same, 1.0).otherwise(0.0).cast("double")


def jaccard(a: Column, b: Column, same: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).when(same, 1.0).otherwise(0.0).cast("double")


def _next_block(heads: DataFrame) -> DataFrame:
    """(block) to (block, next_block): the next one that occurs; after the last the first. No window sees more than 2^20 rows."""
    low = heads.select("block", F.shiftright("block", 14).alias("b2"))
    mid = low.groupBy("b2").agg(F.min("block").alias("head2")).withColumn("b3", F.shiftright("b2", 20))
    top = mid.groupBy("b3").agg(F.min("head2").alias("head3"))
    first = Window.orderBy("b3")
    top = top.select("b3", F.coalesce(F.lead("head3").over(first), F.min("head3").over(Window.partitionBy())).alias("next3"))
    mid = mid.withColumn("next2", F.lead("head2").over(Window.partitionBy("b3").orderBy("b2"))).join(top, "b3")
    mid = mid.select("b2", F.coalesce("next2", "next3").alias("next2"))
    low = low.withColumn("next1", F.lead("block").over(Window.partitionBy("b2").orderBy("block"))).join(mid, "b2")
    return low.select(F.col("block").alias("of_block"), F.coalesce("next1", "next2").alias("next_block"))


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, text, fp and the next document's next_text, next_fp."""
    src = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # the condition on block stands here so that both readers of the shuffle have the same plan, and Spark shuffles once
    placed = src.where("doc_id IS NOT NULL").withColumn("block", F.shiftright("doc_id", BLOCK_BITS)).where("block IS NOT NULL").repartition("block")
    order = Window.partitionBy("block").orderBy("doc_id", "text")
    seen = with_sketch(placed, "text", "fp").withColumn("next", F.lead(F.struct("text", "fp")).over(order))
    inner = seen.where("next IS NOT NULL").select("doc_id", "text", "fp", F.col("next.text").alias("next_text"), F.col("next.fp").alias("next_fp"))
    # the first and last row of each block, from the same shuffle
    row = F.struct("doc_id", "text")
    ends = placed.groupBy("block").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    edge = src.where("doc_id IS NOT NULL").select(F.shiftright("doc_id", BLOCK_BITS).alias("block")).distinct()
    turn = ends.select("block", "last.doc_id", "last.text").join(_next_block(edge), F.col("block") == F.col("of_block"))
    turn = turn.join(ends.select(F.col("block").alias("head_block"), F.col("first.text").alias("next_text")), F.col("next_block") == F.col("head_block"))
    turn = with_sketch(with_sketch(turn.select("doc_id", "text", "next_text"), "text", "fp"), "next_text", "next_fp")
    lost = with_sketch(src.where("doc_id IS NULL"), "text", "fp").select("doc_id", "text", "fp", F.lit("").alias("next_text"), F.array().cast("array<string>").alias("next_fp"))
    return inner.unionByName(turn).unionByName(lost)


def fingerprints(documents: DataFrame) -> DataFrame:
    """The query of the operator: each text, its edited text, and how alike the sketches are."""
    df = with_next(documents).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    df = with_sketch(df.withColumn("edited", edited), "edited", "efp")
    same_e, same_n = F.col("text") == F.col("edited"), F.col("text") == F.col("next_text")
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("fp", "").alias("fingerprint"), F.array_join("efp", "").alias("edited_fingerprint"),
        containment(F.col("fp"), F.col("efp"), same_e).alias("near_edited"), containment(F.col("fp"), F.col("next_fp"), same_n).alias("near_next"),
        jaccard(F.col("fp"), F.col("efp"), same_e).alias("jaccard_edited"), jaccard(F.col("fp"), F.col("next_fp"), same_n).alias("jaccard_next"),
    )


def _sql_near(a: str, b: str, same: str, kind: str) -> str:
    both = f"len(list_intersect({a}, {b}))::DOUBLE"
    if kind == "c":
        return f"CASE WHEN least(len({a}), len({b})) > 0 THEN {both} / least(len({a}), len({b})) WHEN len({a}) = 0 AND len({b}) = 0 AND {same} THEN 1.0 ELSE 0.0 END::DOUBLE"
    return f"CASE WHEN len({a}) + len({b}) > 0 THEN {both} / (len({a}) + len({b}) - {both}) WHEN {same} THEN 1.0 ELSE 0.0 END::DOUBLE"


SQL = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS rid, doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT rid, doc_id, text, coalesce(lead(text) OVER k, first_value(text) OVER k) AS next_text, coalesce(lead(rid) OVER k, first_value(rid) OVER k) AS next_rid FROM d WINDOW k AS (ORDER BY rid)),
e AS MATERIALIZED (SELECT *, length(text) AS n_chars, substr(text, 1, length(text) - length(text) // 4) || substr(next_text, 1, length(text) // 4) AS edited FROM n),
t AS (SELECT rid, 0 AS kind, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM e UNION ALL SELECT rid, 1, regexp_extract_all(edited, '[^\x20\x09-\x0D]+') FROM e),
w AS (SELECT rid, kind, unnest(words) AS w0, unnest(range(len(words))) AS pos, len(words) AS n FROM t),
g AS (SELECT rid, kind, pos, n, w0, lead(w0, 1) OVER k AS w1, lead(w0, 2) OVER k AS w2, lead(w0, 3) OVER k AS w3, lead(w0, 4) OVER k AS w4 FROM w WINDOW k AS (PARTITION BY rid, kind ORDER BY pos)),
h AS (SELECT rid, kind, md5(concat_ws(' ', w0, w1, w2, w3, w4)) AS h FROM g WHERE w4 IS NOT NULL OR (n < 5 AND pos = 0)),
s AS (SELECT rid, kind, list(DISTINCT substr(h, 1, 16) ORDER BY substr(h, 1, 16)) AS fp FROM h WHERE h < '4000000000000000' GROUP BY ALL),
f AS (SELECT e.*, coalesce(s0.fp, []) AS fp, coalesce(s1.fp, []) AS efp, coalesce(s2.fp, []) AS nfp FROM e
      LEFT JOIN s AS s0 ON s0.rid = e.rid AND s0.kind = 0 LEFT JOIN s AS s1 ON s1.rid = e.rid AND s1.kind = 1 LEFT JOIN s AS s2 ON s2.rid = e.next_rid AND s2.kind = 0)
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(fp, '') AS fingerprint, array_to_string(efp, '') AS edited_fingerprint,
       {_sql_near("fp", "efp", "text = edited", "c")} AS near_edited, {_sql_near("fp", "nfp", "text = next_text", "c")} AS near_next,
       {_sql_near("fp", "efp", "text = edited", "j")} AS jaccard_edited, {_sql_near("fp", "nfp", "text = next_text", "j")} AS jaccard_next FROM f
"""
