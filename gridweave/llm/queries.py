"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import exact, mixing, ordinal, packing, pii, rules, secret_scan, simhash, substrings, toxicity

QUERIES = {
    "op1_secret_scan": secret_scan.query,
    "op2_best_fit_packing": packing.query,
    "op3_toxicity": toxicity.query,
    "op4_exact_dedup": exact.query,
    "op5_substring_dedup": substrings.query,
    "op6_simhash_dedup": simhash.query,
    "op7_source_mixing": mixing.query,
    "op8_quality_rules": rules.query,
    "op9_pii_pseudonyms": pii.query,
    "op10_quality_classifier": ordinal.query,
}

ORACLE_SQL = {"op4_exact_dedup": exact.ORACLE, "op7_source_mixing": mixing.ORACLE}
