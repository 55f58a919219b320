"""Queries of the corpus operators by name, with SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline

from . import decontamination, hmm, licenses, line_dedup, packing, piecewise_hash, quality_classifier, quality_rules, quotation, simhash, toxicity, turn_repair

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_quotation": quotation.op4_quotation,
    "op5_packing": packing.op5_packing,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_simhash": simhash.op8_simhash,
    "op9_lm_scoring": hmm.op9_lm_scoring,
    "op10_license_scans": licenses.op10_license_scans,
    "op11_piecewise_hash": piecewise_hash.op11_piecewise_hash,
    "op12_turn_repair": turn_repair.op12_turn_repair,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_quotation": quotation.OP4_SQL,
    "op6_decontamination": decontamination.OP6_SQL,
    "op10_license_scans": licenses.OP10_SQL,
    "op12_turn_repair": turn_repair.OP12_SQL,
}
