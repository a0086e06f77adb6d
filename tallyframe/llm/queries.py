"""The operators' registered queries, and the same results in SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, chunk_dedup, cotrain, hard_negatives, langid, lattice, mixing, simhash, spelling, suffix_dedup, toxicity, wu_manber

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1,
    "op2_simhash": simhash.op2,
    "op3_lattice": lattice.op3,
    "op4_chat_format": chat.op4,
    "op5_chunk_dedup": chunk_dedup.op5,
    "op6_toxicity": toxicity.op6,
    "op7_language": langid.op7,
    "op8_decontaminate": wu_manber.op8,
    "op9_quality": cotrain.op9,
    "op10_mixing": mixing.op10,
    "op11_hard_negatives": hard_negatives.op11,
    "op12_spelling": spelling.op12,
    "op13_bpe": bpe.op13,
}

ORACLE = {
    "op1_suffix_dedup": suffix_dedup.ORACLE, "op3_lattice": lattice.ORACLE, "op4_chat_format": chat.ORACLE, "op8_decontaminate": wu_manber.ORACLE, "op10_mixing": mixing.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE, "op12_spelling": spelling.ORACLE,
}
