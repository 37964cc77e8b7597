"""Mixing sources to target weights by capped water-filling.

Every source gets the share of the mix that its weight asks for, but none more than
``max_epochs`` times its own size. What a clamped source leaves over goes to the others in
proportion to their weights, until no target is above its clamp. The sorted prefix form used
here reaches that fixpoint at once: with the sources ordered by clamp / weight, a source is
clamped exactly if its clamp is below what the level of the remaining ones would give it.

Documents are then taken floor(target / size) whole times each, and those that come first by a
seeded hash once more, until the fraction left is used up (to the nearest document). The cut-off
is found by a histogram over hash buckets, so a source with a third of all rows is summed in
partial aggregates; only the documents of its one boundary bucket are put in order. What is taken once more is a start
of each source in that order, so its last unit, one row a source, decides for all documents.

Nulls: a null text has size 0; null sources form one source, last in order; null ids hash as ''.
Rows that repeat a doc_id within a source are one unit of the fractional sample. An empty table
gives an empty mix. Extra columns are ignored by `slim` and kept by `apply_mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, MAX_EPOCHS, SEED, BUCKETS = (5, 2, 1), 3, "mix-1", 4096
#: Sources that are broadcast at most, as counted.
BROADCAST_SOURCES = 500_000


def _hash(doc_id: Column, seed: str) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size) rows, one per document, to one row per source: (mix_source, source_size, target).

    The windows here see one row per source, already summed: one task is enough for millions of sources.
    """
    by = sizes.groupBy(F.col("source").alias("mix_source")).agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int"))
    level = Window.orderBy(F.col("source_size") / F.col("w"), F.col("mix_source").asc_nulls_last())
    below = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    dec = lambda c: c.cast("decimal(38,0)")
    by = by.withColumn("w", w.cast("long"))
    by = by.withColumn("clamp", F.col("source_size") * max_epochs)
    by = by.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("clamp").over(below), F.lit(0)))
    by = by.withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0)))
    by = by.withColumn("clamped", dec(F.col("left")) * dec(F.col("w")) > dec(F.col("clamp")) * dec(F.col("w_left")))
    # the first source that isn't clamped has the level of all that follow
    first = Window.orderBy(F.col("clamped").desc(), F.col("source_size") / F.col("w"), F.col("mix_source").asc_nulls_last())
    n = F.sum(F.col("clamped").cast("int")).over(everything)
    by = by.withColumn("at", F.row_number().over(first)).withColumn("n", n)
    pick = lambda c: F.max(F.when(F.col("at") == F.col("n") + 1, F.col(c))).over(everything)
    by = by.withColumn("level_left", pick("left")).withColumn("level_w", pick("w_left"))
    share = (F.col("w") * F.col("level_left")).cast("double") / F.col("level_w").cast("double")
    return by.select("mix_source", "source_size", F.when(F.col("clamped"), F.col("clamp").cast("double")).otherwise(share).alias("target"))


def slim(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """A written table of doc_id, source, size (words) and h (the seeded hash): words are counted once."""
    path = common.scratch(documents.sparkSession, "mix")
    cols = documents.select("doc_id", "source", common.n_words(F.col("text")).alias("size"), _hash(F.col("doc_id"), seed).alias("h"))
    cols.write.parquet(path)
    return documents.sparkSession.read.parquet(path)


def plan(units: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source, of `slim` rows: target, whole repetitions, and where the fractional sample ends.

    In the order (h, doc_id) what is taken once more is a start of each source: twice the words before a unit and its
    own, once, only grow. So its last unit in the boundary bucket says it all.
    """
    units = units.withColumn("bucket", F.shiftright("h", 48))
    hist = units.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    goal = targets(hist, weights, max_epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows a source
    cum = hist.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
    cum = cum.join(goal, F.col("source").eqNullSafe(F.col("mix_source")))
    edge = cum.where(F.col("before") < F.col("rest")).groupBy(F.col("source").alias("edge_source")).agg(F.max_by(F.struct("bucket", "before"), F.col("bucket")).alias("edge"))
    goal = goal.join(edge, F.col("mix_source").eqNullSafe(F.col("edge_source")), "left").select("mix_source", "source_size", "target", "whole", "rest", F.coalesce(F.col("edge.bucket"), F.lit(-1)).alias("edge_bucket"), F.coalesce(F.col("edge.before"), F.lit(0)).alias("edge_before"))
    goal = common.cut(goal)
    inside = units.join(_small(goal), F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("bucket") == F.col("edge_bucket")))
    inside = inside.groupBy("source", "h", "doc_id", "rest", "edge_before").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("source").orderBy("h", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("edge_before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    last = F.max(F.struct("h", F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("last")
    more = inside.withColumn("more", 2.0 * before + F.col("size") <= 2.0 * F.col("rest")).where("more").groupBy(F.col("source").alias("more_source")).agg(last)
    ends = goal.join(more, F.col("mix_source").eqNullSafe(F.col("more_source")), "left")
    return common.cut(ends.select("mix_source", "source_size", "target", "whole", "edge_bucket", "last"))


def _small(goal: DataFrame) -> DataFrame:
    """A table of sources, to be broadcast if it has few rows."""
    return F.broadcast(goal) if goal.count() <= BROADCAST_SOURCES else goal


def repetitions(documents: DataFrame, goal: DataFrame, h: Column) -> DataFrame:
    """documents and _mix_source_size, _mix_target, _mix_times: how often the mix takes each row."""
    goal = _small(goal.select(*[F.col(c).alias(f"_mix_{c}") for c in goal.columns]))
    out = documents.withColumn("_mix_at", h).join(goal, F.col("source").eqNullSafe(F.col("_mix_mix_source")), "left")
    unit = F.struct(F.col("_mix_at").alias("h"), F.col("doc_id").isNotNull().alias("known"), "doc_id")
    early = (F.shiftright("_mix_at", 48) < F.col("_mix_edge_bucket")) | F.coalesce(unit <= F.col("_mix_last"), F.lit(False))
    times = F.col("_mix_whole") + F.when(early, 1).otherwise(0)
    return out.select(*[F.col(f"`{c}`") for c in documents.columns], "_mix_source_size", "_mix_target", times.cast("long").alias("_mix_times"))


def taken(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    units = slim(documents, seed)
    return repetitions(units, plan(units), F.col("h")).select("doc_id", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("size") * F.col("_mix_times")).alias("taken"))


def apply_mix(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each row as often as it is taken. Texts aren't shuffled unless there are very many sources."""
    out = repetitions(documents, plan(slim(documents, seed)), _hash(F.col("doc_id"), seed)).where("_mix_times > 0")
    return out.withColumn("_mix_n", F.explode(F.sequence(F.lit(1), F.col("_mix_times").cast("int")))).select(*[F.col(f"`{c}`") for c in documents.columns])


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5,2,1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::BIGINT AS w FROM d GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER k, 0))::HUGEINT AS rem, (sum(w) OVER () - coalesce(sum(w) OVER k, 0))::HUGEINT AS w_rem
      FROM s WINDOW k AS (ORDER BY source_size::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, rem * w > 3 * source_size::HUGEINT * w_rem AS clamped FROM l),
lev AS (SELECT rem AS r, w_rem AS wr FROM c WHERE NOT clamped ORDER BY source_size::DOUBLE / w::DOUBLE, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN clamped THEN (3 * source_size)::DOUBLE ELSE (w * (SELECT r FROM lev))::DOUBLE / (SELECT wr FROM lev)::DOUBLE END AS target FROM c),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS whole FROM t),
u AS (SELECT source, doc_id, h, sum(size)::BIGINT AS size FROM d GROUP BY ALL),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM u)
SELECT d.doc_id, d.size, g.source_size, g.target,
       (d.size * (g.whole + CASE WHEN 2.0 * b.before::DOUBLE + b.size::DOUBLE <= 2.0 * (g.target - (g.whole * g.source_size)::DOUBLE) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.doc_id IS NOT DISTINCT FROM b.doc_id
"""
