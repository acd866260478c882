"""Where registered queries and their SQL counterparts are kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from contentgauge.plans.views import SQL_VIEWS
from contentgauge.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register a query; ``sql`` may use the domain views and the given CTEs."""

    def keep(build: Query) -> Query:
        @wraps(build)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # the tables hold times without a zone; they are meant as UTC
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship(spark)
            return build(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = "with recursive " + SQL_VIEWS + (",\n" + ctes if ctes else "") + "\n" + sql
        return build

    return keep
