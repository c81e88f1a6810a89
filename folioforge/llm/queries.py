"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, langid, licences, lmscore, mixing, neardup, ngramjoin, quality, repair, segment, tokenstore, topk, vectorcodes

QUERIES = {
    "op1_quality": quality.query,
    "op2_lm_scoring": lmscore.query,
    "op3_licence_scan": licences.query,
    "op4_chat_rotation": chat.query,
    "op5_near_duplicates": neardup.query,
    "op6_mixing": mixing.query,
    "op7_segmentation": segment.query,
    "op8_token_store": tokenstore.query,
    "op9_exact_top_k": topk.query,
    "op10_language_id": langid.query,
    "op11_vector_codes": vectorcodes.query,
    "op12_ngram_join": ngramjoin.query,
    "op13_conversation_repair": repair.query,
}

ORACLES = {
    "op1_quality": quality.SQL,
    "op4_chat_rotation": chat.SQL,
    "op5_near_duplicates": neardup.SQL,
    "op6_mixing": mixing.SQL,
    "op9_exact_top_k": topk.SQL,
    "op11_vector_codes": vectorcodes.SQL,
    "op12_ngram_join": ngramjoin.SQL,
}
