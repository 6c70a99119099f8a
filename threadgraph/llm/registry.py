"""Queries of this subpackage, and SQL for those that DuckDB can express."""

from __future__ import annotations

from . import byte_bpe, exact_dedup, media, merkle, mixing, ngram_join, pii, preference, quality, spelling, suffix_dedup, token_counts, token_files

QUERIES = {
    "op1_byte_bpe": byte_bpe.query,
    "op2_media_flac": media.query,
    "op3_ngram_join": ngram_join.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_token_counts": token_counts.query,
    "op6_mixing": mixing.query,
    "op7_quality": quality.query,
    "op8_pii": pii.query,
    "op9_preference": preference.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "op11_token_files": token_files.query,
    "op12_merkle": merkle.query,
    "op13_spelling": spelling.query,
}

ORACLE = {
    "op3_ngram_join": ngram_join.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op9_preference": preference.SQL,
    "op10_suffix_dedup": suffix_dedup.SQL,
    "op12_merkle": merkle.SQL,
    "op13_spelling": spelling.SQL,
}
