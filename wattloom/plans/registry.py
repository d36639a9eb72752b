"""Name -> query and name -> oracle SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def normal_cdf_sql(z: str) -> str:
    """The same published fit of the normal distribution function, as SQL on a column z."""
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    x = f"(abs({z}) / sqrt(2::double))"
    t = f"(1 / (1 + 0.5 * {x}))"
    terms = " + ".join(f"({c}::double) * pow({t}, {i})" for i, c in enumerate(fit))
    tail = f"({t} * exp(-{x} * {x} + {terms}) / 2)"
    return f"(case when {z} >= 0 then 1 - {tail} else {tail} end)"


def query(name: str, sql: str | None = None):
    """Register ``f(tables)`` under name; sql is the independent DuckDB form."""
    def register(f):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE[name] = sql.strip()
        return f
    return register
