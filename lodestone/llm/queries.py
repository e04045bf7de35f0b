"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, chat_format, decontaminate, fingerprints, jaccard_join, language_model, sharding, token_files, toxicity, warc

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_token_files": token_files.op3_token_files,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_consistent_hash": sharding.op5_consistent_hash,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_warc_derivatives": warc.op7_warc_derivatives,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_language_model": language_model.op9_language_model,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": chat_format.OP1_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op8_jaccard_join": jaccard_join.OP8_SQL,
}
