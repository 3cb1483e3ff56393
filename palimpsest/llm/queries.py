"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Query and the module that holds it; SQL is that module's OPn_SQL where it has one.
WHERE = {
    "op1_mixing": "mixing",
    "op2_quality_rules": "quality",
    "op3_line_dedup": "linededup",
    "op4_suffix_dedup": "suffix",
    "op5_decontamination": "decontaminate",
    "op6_toxicity": "toxicity",
    "op7_token_output": "tokens",
    "op8_html_extraction": "pages",
    "op9_private_surrogates": "private",
    "op10_near_duplicates": "neardup",
    "op11_cross_tokenizer": "crosstok",
    "op12_substring_dedup": "relative",
    "op13_fill_in_middle": "infill",
}


def llm_queries() -> dict[str, Callable]:
    return {name: getattr(import_module(f"palimpsest.llm.{module}"), name) for name, module in WHERE.items()}


def llm_oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"palimpsest.llm.{module}"), f"{name.split('_')[0].upper()}_SQL", None) for name, module in WHERE.items()}
    return {name: sql for name, sql in found.items() if sql}
