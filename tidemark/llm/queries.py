"""The queries of this subpackage, one for each operator, and SQL twins where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module that holds a function of that name.
MODULES = {
    "op1_bpe": "bpe",
    "op2_line_dedup": "line_dedup",
    "op3_mixing": "mixing",
    "op4_language": "language",
    "op5_toxicity": "toxicity",
    "op6_ngram_join": "ngram_join",
    "op7_quality": "quality",
    "op8_substring": "substring_dedup",
    "op9_ann": "ann",
    "op10_html": "html_extract",
    "op11_alignment": "alignment",
    "op12_exact_dedup": "exact_dedup",
    "op13_fill_middle": "fill_middle",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", {}).get(name) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
