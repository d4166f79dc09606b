"""Registered queries of the pipeline operators and their DuckDB SQL."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_language_id": "language_id",
    "op2_pii_pseudonyms": "pii",
    "op3_exact_dedup": "exact_dedup",
    "op4_license_scan": "license_scan",
    "op5_quality": "quality",
    "op6_mixing": "mixing",
    "op7_url_rules": "url_rules",
    "op8_packing": "packing",
    "op9_topk_search": "topk_search",
    "op10_simhash": "simhash",
    "op11_filter_audit": "filter_audit",
    "op12_lm_scoring": "ngram_lm",
    "op13_periodic_runs": "periodic_runs",
}


def queries() -> dict:
    return {k: importlib.import_module(f"tidings.llm.{m}").query for k, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    mods = {k: importlib.import_module(f"tidings.llm.{m}") for k, m in _MODULES.items()}
    return {k: m.ORACLE for k, m in mods.items() if getattr(m, "ORACLE", None)}
