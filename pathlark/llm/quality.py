r"""Line-first quality cleaning.

A text is judged line by line (lines end with \n; those without a word don't count):

* punctuation: the last visible character must close a sentence or clause; ``#*$%&|<>`` or
  ``!`` more often than 3 in 10 words fail the line;
* navigation: two or more of ``| › • ·``, at least one for every three words;
* boilerplate: licence, copyright, cookie and script notices.

Failing lines are removed; a document that loses more than ``max_lost`` of its words is rejected.
The base rule comes first: fewer than 10 words, or more than a fifth of the words in 5-word windows
that occur twice, rejects a document whatever its lines are.

Nulls: a null text has no words, so it is rejected (and stays null in `clean`). Each row is judged
alone, so ties, repeated rows, null ids and empty tables need no rule. Extra columns are ignored by
`judge` and kept by `clean`. Texts of any length are judged whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT, WINDOW = 10, 20, 30, 5
SYMBOLS, NAVIGATION = "#*$%&|<>", "|›•·"
#: What may close a sentence or clause, in Latin, CJK, Arabic, Indic, Ethiopic, Armenian and Khmer writing.
ENDS = ".!?…:;\"'”’»)]。！？：；」』）】》〉｡．｣؟؛۔।॥።፧։។៕‽⁇⁈⁉"
BOILERPLATE = r"all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy|cookie policy|enable javascript|click here|lorem ipsum|^[ \t]*copyright"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, kept_words long"
_WORDS, _NOTICE, _BLANK = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(BOILERPLATE), " \t\n\v\f\r"


def line_fails(line: str, words: int) -> bool:
    """Whether a line with a word fails a rule."""
    return (
        line.rstrip(_BLANK)[-1] not in ENDS
        or 10 * sum(map(line.count, SYMBOLS)) > 3 * words
        or 10 * line.count("!") > 3 * words
        or 2 <= (nav := sum(map(line.count, NAVIGATION))) and 3 * nav >= words
        or _NOTICE.search(line.lower()) is not None
    )


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    w = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judge_text(text: str | None, max_lost: int = MAX_LOST_PERCENT) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_words, cleaned text)."""
    if text is None:
        return 0, 0, 0, 0, 0, True, False, 0, None
    words = _WORDS.findall(text)
    n = len(words)
    keep, shown, kept_words = [], [], 0
    for line in text.split("\n"):
        if not line.strip(_BLANK):
            keep.append(line)
            continue
        shown.append(line)
        k = len(_WORDS.findall(line))
        if not line_fails(line, k):
            keep.append(line)
            kept_words += k
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    kept = not failed and 100 * (n - kept_words) <= max_lost * n
    cleaned = text if kept_words == n else "\n".join(keep)
    return n, len(text) - sum(map(text.count, _BLANK)), sum(map(text.count, SYMBOLS)), len(shown) - len(set(shown)), repeats, failed, kept, kept_words, cleaned


def judge(documents: DataFrame, max_lost: int = MAX_LOST_PERCENT) -> DataFrame:
    """One row per document; see SCHEMA."""

    def run(batches):
        for b in common.portions(batches):
            rows = [judge_text(t, max_lost)[:8] for t in b.column("text").to_pylist()]
            cols = list(zip(*rows)) or [()] * 8
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def clean(documents: DataFrame, max_lost: int = MAX_LOST_PERCENT) -> DataFrame:
    """The documents that are kept, without their failing lines; n_chars, if there, follows the text."""

    def run(batches):
        for b in common.portions(batches):
            judged = [judge_text(t, max_lost) for t in b.column("text").to_pylist()]
            for name, value in (("text", lambda x: x[8]), ("n_chars", lambda x: None if x[8] is None else len(x[8]))):
                if name in b.schema.names:
                    k = b.schema.get_field_index(name)
                    b = b.set_column(k, b.schema.field(k), pa.array([value(x) for x in judged], b.schema.field(k).type))
            yield b.filter(pa.array([x[6] for x in judged], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT rid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lf AS (SELECT rid, line, k, len(regexp_extract_all(line, '[|›•·]')) AS nav,
       NOT regexp_matches(line, '[.!?…:;"''”’»)\]。！？：；」』）】》〉｡．｣؟؛۔।॥።፧։។៕‽⁇⁈⁉][\x20\x09-\x0D]*$') OR 10 * len(regexp_extract_all(line, '[#*$%&|<>]')) > 3 * k OR 10 * len(regexp_extract_all(line, '!')) > 3 * k
       OR regexp_matches(lower(line), 'all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy|cookie policy|enable javascript|click here|lorem ipsum|^[ \t]*copyright') AS bad FROM lw),
la AS (SELECT rid, coalesce(sum(k) FILTER (NOT bad AND NOT (nav >= 2 AND 3 * nav >= k)), 0)::BIGINT AS kept_words, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM lf GROUP BY rid),
g AS (SELECT rid, unnest(range(1, len(words) - 3)) AS i, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) AS gram FROM w WHERE len(words) > 5),
gg AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g),
gp AS (SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM gg WHERE c > 1) GROUP BY rid),
a AS (SELECT w.rid, doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(gp.n, 0)::BIGINT AS n_repeat_words, coalesce(kept_words, 0)::BIGINT AS kept_words
      FROM w LEFT JOIN la USING (rid) LEFT JOIN gp USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * (n_words - kept_words) <= 30 * n_words AS kept, kept_words FROM a
"""
