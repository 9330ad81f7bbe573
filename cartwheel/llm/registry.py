"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib

#: Module and function of each query.
MODULES = {
    "op1_minhash_near_dedup": "minhash",
    "op2_exact_dedup": "exact_dedup",
    "op3_benchmark_decontamination": "decontaminate",
    "op4_substring_dedup": "substring_dedup",
    "op5_secret_scan": "secret_scan",
    "op6_language_id": "language_id",
    "op7_license_scan": "license_scan",
    "op8_suffix_dedup": "suffix_dedup",
    "op9_best_fit_packing": "packing",
    "op10_line_dedup": "line_dedup",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f".{module}", __package__), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
