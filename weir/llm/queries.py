"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, html_text, near_duplicates, piece_lattice, quality, sharding, substrings, token_counts, token_output, toxicity
from .oracles import ORACLES

MODULES = (decontaminate, token_counts, sharding, near_duplicates, toxicity, html_text, quality, token_output, substrings, piece_lattice)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
