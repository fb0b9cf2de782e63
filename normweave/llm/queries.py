"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: module, query, whether the module has SQL for it
OPERATORS = [
    ("line_dedup", "op1_line_dedup"),
    ("simhash", "op2_simhash_near_dedup"),
    ("pii", "op3_pii"),
    ("exact_dedup", "op4_exact_dedup"),
    ("topk", "op5_exact_topk"),
    ("packing", "op6_best_fit_packing"),
    ("langid", "op7_language_id"),
    ("bpe", "op8_byte_bpe"),
    ("substring_dedup", "op9_substring_dedup"),
    ("quality", "op10_quality_classifier"),
]


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for module, name in OPERATORS}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for module, name in OPERATORS}
    return {k: v for k, v in found.items() if v}
