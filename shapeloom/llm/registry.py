"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: (module, query, name of its SQL or None)
ENTRIES = (
    ("secret_scan", "op1_secret_scan", "OP1_SQL"),
    ("substring_dedup", "op2_substring_dedup", "OP2_SQL"),
    ("chat_format", "op3_chat_format", "OP3_SQL"),
    ("exact_dedup", "op4_exact_dedup", "OP4_SQL"),
    ("decontaminate", "op5_decontaminate", "OP5_SQL"),
    ("token_files", "op6_token_files", None),
    ("quality_knn", "op7_quality", None),
    ("language_model", "op8_lm_score", None),
    ("jaccard_join", "op9_jaccard_join", "OP9_SQL"),
    ("sentencepiece_fst", "op10_sentencepiece", None),
)


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{mod}"), name) for mod, name, _ in ENTRIES}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"{__package__}.{mod}"), sql) for mod, name, sql in ENTRIES if sql}
