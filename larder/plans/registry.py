"""Named queries with their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.plans.inputs import Inputs, oracle_ctes
from larder.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None, materialized: bool = False):
    """Register a function of ``Inputs``; ``sql`` may open with its own CTEs and refer to ``views``, evaluated once each if ``materialized``."""

    def keep(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(tune(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _assemble(views.split(), sql.strip(), materialized)
        return fn

    return keep


def _assemble(views: list[str], sql: str, materialized: bool) -> str:
    head = oracle_ctes(views, materialized)
    opens_with_cte = re.match(r"\w+\s+as\s*(materialized\s*)?\(", sql, re.IGNORECASE) is not None
    if not head:
        return f"with recursive {sql}" if opens_with_cte else sql
    return f"with recursive {head}{',' if opens_with_cte else ''}\n{sql}"
