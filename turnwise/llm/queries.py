"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from turnwise.llm import ann, bpe, chat, decontaminate, divergence, langid, neardup, pii, quality, repeats, tokenalign, treebpe, urlfilter

QUERIES = {
    "op1_urls": urlfilter.op1_urls,
    "op5_pii": pii.op5_pii,
    "op8_chat": chat.op8_chat,
    "op9_neighbours": ann.op9_neighbours,
    "op2_repeats": repeats.op2_repeats,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op7_bpe": bpe.op7_bpe,
    "op4_neardup": neardup.op4_neardup,
    "op3_quality": quality.op3_quality,
    "op6_langid": langid.op6_langid,
    "op11_token_alignment": tokenalign.op11_token_alignment,
    "op12_divergence": divergence.op12_divergence,
    "op13_tree_bpe": treebpe.op13_tree_bpe,
}

ORACLE_SQL = {
    "op1_urls": urlfilter.SQL,
    "op8_chat": chat.SQL,
    "op9_neighbours": ann.SQL,
    "op2_repeats": repeats.SQL,
    "op4_neardup": neardup.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op12_divergence": divergence.SQL,
}
