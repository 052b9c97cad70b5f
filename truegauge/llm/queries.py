"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, embedding_dedup, kneser_ney, language_id, line_dedup, mixing, ngram_join, packing, quality_rules, sharding

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_packing": packing.op4_packing,
    "op5_chat": chat.op5_chat,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_quality_classifier": kneser_ney.op8_quality_classifier,
    "op9_sharding": sharding.op9_sharding,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLE_SQL = {
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op3_ngram_join": ngram_join.OP3_SQL,
    "op5_chat": chat.OP5_SQL,
    "op6_embedding_dedup": embedding_dedup.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op9_sharding": sharding.OP9_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
