"""Queries of the operators in this subpackage, by the names the driver knows."""

from __future__ import annotations

from . import decontam, license, linededup, packing, passages, puquality, quality, simhash, tokenout, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_decontamination": decontam.query,
    "op3_quality_rules": quality.query,
    "op4_quality_classifier": puquality.query,
    "op5_line_dedup": linededup.query,
    "op6_substring_dedup": passages.query,
    "op7_simhash_near_dedup": simhash.query,
    "op8_token_ids": tokenout.query,
    "op9_license_scan": license.query,
    "op10_toxicity": toxicity.query,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op2_decontamination": decontam.ORACLE,
    "op5_line_dedup": linededup.ORACLE,
}
