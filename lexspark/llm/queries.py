"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_minhash_dedup": "minhash_dedup",
    "op2_toxicity": "toxicity",
    "op6_quality": "quality",
    "op3_exact_dedup": "exact_dedup",
    "op5_packing": "packing",
    "op10_bpe": "bpe",
    "op4_sharding": "sharding",
    "op7_pii": "pii",
    "op8_embedding_dedup": "embedding_dedup",
    "op9_line_dedup": "line_dedup",
}


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f".{module}", __package__), "SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
