"""Every query of the core library: name -> callable(spark, sf_dir), and its equivalent SQL."""

from __future__ import annotations

import importlib

_MODULES: tuple[str, ...] = (
    "lutrin.operators.profiling",
    "lutrin.operators.quality",
    "lutrin.operators.statistics",
    "lutrin.operators.sequences",
    "lutrin.operators.entities",
    "lutrin.operators.glossary",
    "lutrin.operators.marks",
    "lutrin.operators.planning",
    "lutrin.operators.layout",
    "lutrin.operators.spatial",
    "lutrin.operators.cleaning",
    "lutrin.operators.raster",
    "lutrin.operators.restoration",
    "lutrin.operators.documents",
    "lutrin.streaming.progress",
)
FLAGSHIP = "bubble_quality_profile"


def _modules():
    return [importlib.import_module(m) for m in _MODULES]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
