"""All queries of the core and their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

MODULES: list[str] = ["multivalue", "pages", "search", "graph", "snapshots", "journal", "reading", "extras"]


def _modules():
    return [importlib.import_module(f"quire.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLE.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["vector_topk"](spark, sf_dir)
