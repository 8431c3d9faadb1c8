"""Named questions over a folder of input tables, each with plain SQL to check it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busvitals.plans.reference_sql import EDGE_SHIFT
from busvitals.plans.workspace import Workspace, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six digits, so two engines print the same value.

    The shift moves exact decimal halves (means of whole microseconds) off the rounding edge, where engines differ.
    """
    return df.select(*[
        F.round(F.col(n) + F.lit(EDGE_SHIFT), digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes
    ])


def question(name: str, sql: str | None = None):
    """Register a function of a workspace as a query; ``sql`` is its check."""

    def add(build: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(build(workspace(spark, folder)))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return build

    return add
