"""The queries and SQL of this subpackage, by name."""

from __future__ import annotations

from codegrain.llm import (
    decontaminate,
    fill_middle,
    language_id,
    near_dup,
    packing,
    phrases,
    pii,
    quality_model,
    quality_rules,
    repeats,
    suffix_tree,
    token_counts,
    token_files,
)

MODULES = {
    "op1_language_id": language_id,
    "op2_quality_rules": quality_rules,
    "op3_token_counts": token_counts,
    "op4_decontaminate": decontaminate,
    "op5_quality_model": quality_model,
    "op6_pii": pii,
    "op7_suffix_tree": suffix_tree,
    "op8_packing": packing,
    "op9_near_dup": near_dup,
    "op10_repeats": repeats,
    "op11_token_files": token_files,
    "op12_phrases": phrases,
    "op13_fill_middle": fill_middle,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict:
    return {name: module.ORACLE_SQL for name, module in MODULES.items() if getattr(module, "ORACLE_SQL", None)}
