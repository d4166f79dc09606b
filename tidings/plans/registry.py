"""Registry of checked queries: key -> (Spark plan, DuckDB oracle SQL or None).

Keys follow ``<inventory id>_<function>`` in lower case.  Every plan takes
``(spark, sf_dir)``, reads the driver tables under ``sf_dir`` and returns a
lazy DataFrame; the oracle SQL reads the same tables as DuckDB views.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

_PLANS: dict[str, Plan] = {}
_SQL: dict[str, str] = {}

_MODULES = (
    "tidings.plans.checks_relational",
    "tidings.plans.checks_text",
    "tidings.plans.checks_sources",
    "tidings.plans.checks_extract",
    "tidings.plans.checks_graph",
    "tidings.plans.checks_vectors",
    "tidings.plans.checks_cluster",
    "tidings.plans.checks_topics",
    "tidings.plans.checks_queries",
)


def register(key: str, sql: str | None = None):
    def deco(fn: Plan) -> Plan:
        if key in _PLANS:
            raise KeyError(f"duplicate query key {key}")
        _PLANS[key] = fn
        if sql is not None:
            _SQL[key] = sql
        return fn
    return deco


def _load():
    for m in _MODULES:
        try:
            importlib.import_module(m)
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != m:
                raise


def queries() -> dict[str, Plan]:
    _load()
    return dict(_PLANS)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
