"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import fingerprint, langid, linededup, mixing, neardup, packing, quality, secrets, toxicity, warc
from .common import table

QUERIES = {
    "op1_warc_chunks": lambda spark, d: warc.round_trip(table(spark, d, "pages")),
    "op2_byte_gru_language": lambda spark, d: langid.identify(table(spark, d, "documents")),
    "op3_line_quality": lambda spark, d: quality.judge(table(spark, d, "documents")),
    "op4_attention_gru_toxicity": lambda spark, d: toxicity.score(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_mix_sources": lambda spark, d: mixing.taken(table(spark, d, "documents")),
    "op6_scaled_fingerprints": lambda spark, d: fingerprint.fingerprints(table(spark, d, "documents")),
    "op7_recursive_secrets": lambda spark, d: secrets.find(table(spark, d, "documents")),
    "op8_bbit_minhash": lambda spark, d: neardup.groups(table(spark, d, "documents"), size=neardup.CONTRACT_SIZE),
    "op9_site_line_dedup": lambda spark, d: linededup.of_pages(table(spark, d, "pages")),
    "op10_bm25_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
}

ORACLES = {
    "op1_warc_chunks": warc.SQL,
    "op3_line_quality": quality.SQL,
    "op5_mix_sources": mixing.SQL,
    "op6_scaled_fingerprints": fingerprint.SQL,
    "op9_site_line_dedup": linededup.SQL,
}
