"""Queries of this package for the driver contract, and their SQL."""

from __future__ import annotations

from crawlfold.llm import (archives, chat, fingerprints, line_dedup, mixing, near_dedup, neighbours, packing, repeated_spans,
                           spelling, token_counts, toxicity, whitening)

QUERIES = {
    "op1_template_line_dedup": line_dedup.query,
    "op2_learned_partitions": neighbours.query,
    "op3_minhash_near_dedup": near_dedup.query,
    "op4_vector_packing": packing.query,
    "op5_arc_to_warc": archives.query,
    "op6_soft_mixing": mixing.query,
    "op7_toxic_segments": toxicity.query,
    "op8_chat_round_trip": chat.query,
    "op9_token_counts": token_counts.query,
    "op10_weighted_sampling": fingerprints.query,
    "op11_spelling_variants": spelling.query,
    "op12_repeated_spans": repeated_spans.query,
    "op13_whitening": whitening.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_template_line_dedup": line_dedup.SQL,
    "op5_arc_to_warc": archives.SQL,
    "op8_chat_round_trip": chat.SQL,
}
