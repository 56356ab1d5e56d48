"""The registered corpus queries, opN_<name>, with their DuckDB twins where SQL can express them."""

from __future__ import annotations

from . import align, ann, chat, langid, leaks, licenses, minhash, mixing, negatives, pieces, quality, suffix, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_additive_quantisation": ann.op3_additive_quantisation,
        "op4_suffix_dedup": suffix.op4_suffix_dedup,
        "op5_sentencepiece": pieces.op5_sentencepiece,
        "op6_chat_format": chat.op6_chat_format,
        "op7_language_id": langid.op7_language_id,
        "op8_mixing": mixing.op8_mixing,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_minhash": minhash.op10_minhash,
        "op11_hard_negatives": negatives.op11_hard_negatives,
        "op12_secret_scan": leaks.op12_secret_scan,
        "op13_token_alignment": align.op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": licenses.ORACLE,
        "op9_quality_rules": quality.ORACLE,
        "op11_hard_negatives": negatives.ORACLE,
    }
