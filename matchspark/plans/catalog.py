"""Registry of named queries: ``name -> fn(spark, sf_dir) -> DataFrame`` plus oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

_MODULES = (
    "matchspark.plans.q_search",
    "matchspark.plans.q_rank",
    "matchspark.plans.q_content",
    "matchspark.plans.q_publish",
    "matchspark.plans.q_ingest",
    "matchspark.plans.q_ingest_jobs",
    "matchspark.plans.q_ingest_cvs",
    "matchspark.plans.q_eval",
    "matchspark.plans.q_runs",
)


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load() -> tuple[dict, dict]:
    for m in _MODULES:
        importlib.import_module(m)
    return QUERIES, ORACLE
