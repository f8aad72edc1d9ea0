"""The registered ``opN_*`` queries and their DuckDB twins."""

from __future__ import annotations

from . import bpe, dart_minhash, fingerprints, hard_negatives, html_extract, line_dedup, mixing, quality_gbt, quality_rules, surrogates, telephony, url_rules, whitening

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_url_rules": url_rules.op4_url_rules,
    "op5_telephony": telephony.op5_telephony,
    "op6_surrogates": surrogates.op6_surrogates,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_quality_gbt": quality_gbt.op8_quality_gbt,
    "op9_dart_minhash": dart_minhash.op9_dart_minhash,
    "op10_bpe": bpe.op10_bpe,
    "op11_fingerprints": fingerprints.op11_fingerprints,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op4_url_rules": url_rules.ORACLE,
    "op7_mix_sources": mixing.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
