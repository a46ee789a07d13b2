"""The queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from veristrata.llm import chat_format, decontaminate, license_scan, near_dedup, oracles, packing, pii, quality_rules, substring_dedup, token_counts, token_files

QUERIES = {
    "op3_chat_format": chat_format.op3_chat_format,
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_token_files": token_files.op2_token_files,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_pii": pii.op5_pii,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op9_proximity": decontaminate.op9_proximity,
    "op10_license_scan": license_scan.op10_license_scan,
}
#: The others need a tokenizer, edit distances, fitted trees, bytes or components; tests hold them against brute force.
ORACLES: dict[str, str] = {"op1_quality_rules": oracles.quality(quality_rules.MAX_DOCS, quality_rules.MIN_DOCS, quality_rules.MAX_SHARE, quality_rules.MIN_LEFT), "op9_decontamination": oracles.DECONTAMINATION}
