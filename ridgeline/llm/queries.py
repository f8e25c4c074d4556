"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, chat, decontaminate, lang_id, line_dedup, lm_score, media, near_dedup, sharding, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_chat": chat.op2_chat,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_lang_id": lang_id.op5_lang_id,
    "op6_sharding": sharding.op6_sharding,
    "op7_bpe": bpe.op7_bpe,
    "op8_media": media.op8_media,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_lm_score": lm_score.op10_lm_score,
}
ORACLES = {
    "op2_chat": chat.ORACLE_SQL,
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op4_decontamination": decontaminate.ORACLE_SQL,
    "op9_near_dedup": near_dedup.ORACLE_SQL,
}
