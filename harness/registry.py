"""Every registered query with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harness import silver_views as views
from harness.oracle_load import LOAD_SQL
from harness.oracle_marts import MART_SQL
from harness.oracle_serving import SERVING_SQL
from harness.oracle_silver import SILVER_SQL
from harness.oracle_text import TEXT_SQL
from harness.oracle_views import with_views
from harness.queries_load import LOAD_QUERIES
from harness.queries_serving import SERVING_QUERIES
from harness.queries_silver import SILVER_QUERIES
from harness.queries_text import TEXT_QUERIES
from saleslake.plans.marts import MARTS

Query = Callable[[SparkSession, str], DataFrame]


def _mart(name: str) -> Query:
    return lambda spark, sf_dir: MARTS[name](views.silver(spark, sf_dir), views.AS_OF)


QUERIES: dict[str, Query] = {**{name: _mart(name) for name in MARTS}, **TEXT_QUERIES, **SILVER_QUERIES, **LOAD_QUERIES, **SERVING_QUERIES}
ORACLES: dict[str, str] = {name: with_views(sql) for name, sql in {**MART_SQL, **TEXT_SQL, **SILVER_SQL, **LOAD_SQL, **SERVING_SQL}.items()}
