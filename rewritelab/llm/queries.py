"""Registered queries of the training-data operators, and the SQL of those that SQL expresses."""

from __future__ import annotations

from . import decontamination, fingerprints, html_text, language, mixing, personal_data, scoring, sharding, simhash, token_counts

QUERIES = {
    "op1_scoring": scoring.op1_scoring,
    "op2_sharding": sharding.op2_sharding,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_personal_data": personal_data.op4_personal_data,
    "op5_simhash": simhash.op5_simhash,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_mixing": mixing.op8_mixing,
    "op9_html_text": html_text.op9_html_text,
    "op10_language": language.op10_language,
}

ORACLES = {"op2_sharding": sharding.OP2_SQL, "op3_decontamination": decontamination.OP3_SQL}
