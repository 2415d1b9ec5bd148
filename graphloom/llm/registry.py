"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, exact, imatch, mixing, ngram_join, quality, sharding, substrings, token_counts, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_imatch": imatch.op2_imatch,
    "op3_source_mix": mixing.op3_source_mix,
    "op4_quality": quality.op4_quality,
    "op5_exact_dedup": exact.op5_exact_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_sharding": sharding.op7_sharding,
    "op8_bpe_round_trip": bpe.op8_bpe_round_trip,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_substring_dedup": substrings.op10_substring_dedup,
}

SQL = {
    "op3_source_mix": mixing.OP3_SQL,
    "op5_exact_dedup": exact.OP5_SQL,
    "op7_sharding": sharding.OP7_SQL,
}
