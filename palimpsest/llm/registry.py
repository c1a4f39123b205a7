"""The queries of the operators and the SQL that they are held against."""

from __future__ import annotations

from palimpsest.llm import chat, exact_dedup, langid, mixing, near_dedup, neighbours, packing, pseudonyms, quality, sharding

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_pseudonyms": pseudonyms.op3_pseudonyms,
    "op4_quality": quality.op4_quality,
    "op5_language": langid.op5_language,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_pack": packing.op7_pack,
    "op8_shard": sharding.op8_shard,
    "op9_chat": chat.op9_chat,
    "op10_neighbours": neighbours.op10_neighbours,
}
#: The others are tested against brute force, round trips or held-out labels.
ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op6_mix_sources": mixing.ORACLE,
}
