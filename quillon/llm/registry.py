"""Queries and SQL of this subpackage."""

from __future__ import annotations

from quillon.llm import chat, exact_dedup, gif, jaccard, language_id, mixing, packing, passages, token_files, toxicity

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_format_chat": chat.op2_format_chat,
    "op3_token_files": token_files.op3_token_files,
    "op4_jaccard_components": jaccard.op4_jaccard_components,
    "op5_gif_media": gif.op5_gif_media,
    "op6_pack": packing.op6_pack,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_strip_repeats": passages.op8_strip_repeats,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
SQL = {
    "op9_mix_sources": mixing.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
