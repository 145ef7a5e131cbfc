"""Queries of the training-data operators: name -> callable(spark, sf_dir), and SQL where it exists."""

from __future__ import annotations

import importlib

_MODULES = ("alignment", "answers", "encoding", "lookalikes", "mixing", "names", "scans", "splitting", "truncation")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        module = importlib.import_module(f"lutrin.llm.{name}")
        if attribute == "QUERIES":
            out |= {k: v for k, v in vars(module).items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}
        else:
            out |= getattr(module, attribute, {})
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("SQL")
