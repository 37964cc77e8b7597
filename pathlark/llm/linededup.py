r"""Site-relative line dedup, from built-in functions only.

Pages are grouped by host. A line that stands on more than ``max_ratio`` of a host's pages, and on
at least ``min_pages`` of them, is boilerplate there and is dropped from all of them. Lines are
compared without surrounding white space; blank lines stay.

Per (host, line hash) counts are partial sums before the shuffle, and what is kept of them is
bounded for each host: at most (lines per page) / max_ratio lines can pass. These lists are written and counted; small ones
are broadcast, so no text is shuffled, and others meet the texts in a salted join, so a hot host is dealt over many
tasks. No window or list by host holds pages.

A ratio can't see a line of a few documents in a large site. `drop_repeats` adds an absolute count: a line of
``MIN_WORDS`` words or more on ``MIN_DOCS`` rows of a site stays in the first of them (by id) only. One
place keeps it, so copies of a document don't erase each other. It is matched by joins on (site, line), so its lists grow with no site.

Nulls: a null text stays null with no lines; pages without a host form one site. Repeated rows
count as the pages that they are. An empty table gives an empty result. Other columns stay as
they are, but for ``n_lines`` and ``n_dropped``, which are the result's (working columns start with ``_ld_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MAX_RATIO, MIN_PAGES = 0.1, 5
MIN_DOCS, MIN_WORDS = 5, 5
BREAKS = r"(?i)<(?:/?(?:p|div|ul|ol|li|h[1-6]|nav|footer|header|article|section|table|tr|br|title|body|head|html)\b[^<>]*)>"
#: Lists of hosts are broadcast up to so many lines; they are counted first. Beyond, they meet the pages in a join on host and one of SALTS numbers.
BROADCAST_LINES, SALTS = 500_000, 32


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, null if there is none. Works on any text without failing."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def html_lines(html: Column) -> Column:
    """The text of a page, a line for each block. Each pattern takes time linear in the page, whatever it holds: an open
    script or comment reaches to its end, a tag to the next < or >, and blanks are only taken from where they begin."""
    text = F.regexp_replace(html, r"(?is)<(?:script|style)\b.*?(?:</(?:script|style)>|\z)|<!--.*?(?:-->|\z)", "")
    text = F.regexp_replace(text, BREAKS, "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^<>]*>", ""), r"(?<![\t\n\f\r ])[\t\f\r ]*+\n[\t\n\f\r ]*+", "\n"), F.lit("\n"))


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def _key(line: Column) -> Column:
    return F.xxhash64(_bare(line))


def drop_site_lines(pages: DataFrame, text: str, host: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """pages with `text` cleaned, and n_lines, n_dropped (long, of non-blank lines) in place of any columns of these names."""
    src = pages.withColumn("_ld_host", F.coalesce(host, F.lit("")))
    lines = F.split(F.col(text), "\n", -1)
    shown = F.filter(lines, lambda x: _bare(x) != "")
    keys = F.array_distinct(F.transform(shown, _key))
    seen = src.select("_ld_host", F.explode(keys).alias("_ld_key")).groupBy("_ld_host", "_ld_key").agg(F.count(F.lit(1)).alias("_ld_n")).where(F.col("_ld_n") >= min_pages)
    total = src.groupBy("_ld_host").agg(F.count(F.lit(1)).alias("_ld_total"))
    common_lines = seen.join(total, "_ld_host").where(F.col("_ld_n") > F.col("_ld_total") * F.lit(float(max_ratio)))
    per_host = common.cut(common_lines.groupBy("_ld_host").agg(F.collect_list("_ld_key").alias("_ld_drop")))
    if (per_host.agg(F.sum(F.size("_ld_drop"))).first()[0] or 0) <= broadcast_lines:
        out = src.join(F.broadcast(per_host), "_ld_host", "left")
    else:  # the pages of a host are dealt over SALTS tasks
        salted = per_host.withColumn("_ld_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        out = src.withColumn("_ld_salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")).join(salted, ["_ld_host", "_ld_salt"], "left").drop("_ld_salt")
    kept = F.filter(lines, lambda x: ~((_bare(x) != "") & F.array_contains(F.col("_ld_drop"), _key(x))))
    has = F.col("_ld_drop").isNotNull()
    out = out.withColumn("_ld_all", F.coalesce(F.size(shown), F.lit(0)).cast("long"))
    out = out.withColumn("_ld_kept", F.when(has, kept))
    out = out.withColumn("_ld_text", F.when(has, F.array_join("_ld_kept", "\n")).otherwise(F.col(text)))
    gone = (F.size(lines) - F.size("_ld_kept")).cast("long")
    cols = [F.col("_ld_text").alias(text) if c == text else F.col(f"`{c}`") for c in pages.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*cols, F.when(F.col(text).isNull(), 0).otherwise(F.col("_ld_all")).alias("n_lines"), F.when(F.col(text).isNull() | ~has, 0).otherwise(gone).alias("n_dropped"))


def drop_repeats(docs: DataFrame, text: str, host: Column, doc_id: str, min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS) -> DataFrame:
    """`drop_site_lines`, and lines that repeat across at least `min_docs` rows of a host, all but the first; n_dropped counts both."""
    src = docs.withColumn("_ld_row", F.xxhash64(F.col(doc_id), F.coalesce(host, F.lit("")), F.col(text)))
    long = F.filter(F.split(F.col(text), "\n", -1), lambda x: common.n_words(x) >= min_words)
    seen = src.select(F.coalesce(host, F.lit("")).alias("_ld_site"), F.col(doc_id).alias("_ld_id"), "_ld_row", F.explode(F.array_distinct(F.transform(long, _key))).alias("_ld_key"))
    place = F.struct(F.col("_ld_id").isNull(), F.col("_ld_id"), F.col("_ld_row"))
    many = seen.groupBy("_ld_site", "_ld_key").agg(F.count(F.lit(1)).alias("_ld_n"), F.min(place).getField("_ld_row").alias("_ld_first")).where(F.col("_ld_n") >= min_docs)
    gone = seen.join(many, ["_ld_site", "_ld_key"]).where(F.col("_ld_row") != F.col("_ld_first")).groupBy("_ld_row").agg(F.collect_set("_ld_key").alias("_ld_gone"))
    out = drop_site_lines(src, text, host).join(gone, "_ld_row", "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda x: ~((_bare(x) != "") & F.array_contains(F.col("_ld_gone"), _key(x))))
    out = out.withColumn("_ld_kept", F.when(F.col("_ld_gone").isNotNull(), kept))
    more = F.coalesce(F.size(lines) - F.size("_ld_kept"), F.lit(0))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    cols = [F.coalesce(F.array_join("_ld_kept", "\n"), F.col(text)).alias(text) if c == text else F.col(f"`{c}`") for c in names]
    return out.select(*cols, "n_lines", F.when(F.col("_ld_gone").isNull(), F.col("n_dropped")).otherwise(F.col("n_dropped") + more).alias("n_dropped"))


def of_pages(pages: DataFrame) -> DataFrame:
    """The operator over raw web pages: page_id, host, text, n_lines, n_dropped."""
    spark = pages.sparkSession
    made = common.scratch(spark, "lines")  # the markup is taken off once, and counting reads the lines only
    pages.select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text")).write.parquet(made)
    return drop_site_lines(spark.read.parquet(made), "text", F.col("host"))


SQL = r"""
WITH h AS (SELECT page_id, nullif(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
  regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\b.*?(?:</(?:script|style)>|\z)|<!--.*?(?:-->|\z)', '', 'g'), '(?i)<(?:/?(?:p|div|ul|ol|li|h[1-6]|nav|footer|header|article|section|table|tr|br|title|body|head|html)\b[^<>]*)>', chr(10), 'g') AS t FROM pages),
x AS (SELECT row_number() OVER () AS rid, page_id, host, trim(regexp_replace(regexp_replace(t, '<[^<>]*>', '', 'g'), '[\t\n\f\r ]*\n[\t\n\f\r ]*', chr(10), 'g'), chr(10)) AS text FROM h),
l AS (SELECT rid, coalesce(host, '') AS host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM x),
k AS (SELECT *, regexp_replace(line, '^[ \t\r]+|[ \t\r]+$', '', 'g') AS key, regexp_matches(line, '[^ \t\r]') AS shown FROM l),
n AS (SELECT host, key, count(DISTINCT rid) AS n FROM k WHERE shown GROUP BY ALL),
tot AS (SELECT coalesce(host, '') AS host, count(*) AS total FROM x GROUP BY ALL),
bad AS (SELECT n.host, n.key FROM n JOIN tot USING (host) WHERE n >= 5 AND n > total * 0.1::DOUBLE),
m AS (SELECT k.*, bad.key IS NOT NULL AND shown AS gone FROM k LEFT JOIN bad ON k.host = bad.host AND k.key = bad.key),
r AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) FILTER (shown) AS n_lines, count(*) FILTER (gone) AS n_dropped FROM m GROUP BY rid)
SELECT x.page_id, x.host, CASE WHEN x.text IS NOT NULL THEN coalesce(r.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM x LEFT JOIN r USING (rid)
"""
