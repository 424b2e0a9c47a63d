"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

NAMES = {"toxicity": "op1_toxicity", "merkle": "op2_merkle", "pieces": "op3_pieces", "simhash": "op4_simhash", "rendezvous": "op5_rendezvous", "decontaminate": "op6_decontaminate", "substrings": "op7_substrings", "rules": "op8_rules", "quality": "op9_quality", "suffixes": "op10_suffixes"}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for module, name in NAMES.items()}


def oracle_sql() -> dict:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE", None) for module, name in NAMES.items()}
    return {k: v for k, v in found.items() if v}
