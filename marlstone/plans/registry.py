"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query taking a table reader; oracle is SQL over the same tables."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


for _name in ("heat_queries", "catalog_queries", "analysis_queries", "function_queries", "codec_queries", "state_queries", "helper_queries"):
    importlib.import_module(f"marlstone.plans.{_name}")
