"""Registered queries: a Spark plan and, where SQL can say it, its statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.plans.oracle import statement
from kerbline.plans.workspace import Workspace, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATEMENTS: dict[str, str] = {}


def statements() -> dict[str, str]:
    """DuckDB statements with all relations they need."""
    return {name: statement(sql) for name, sql in STATEMENTS.items()}


# Doubles are compared after rounding; the shift keeps exact decimal halves off
# the rounding boundary, where the two engines differ.
SHIFT = 1e-7


def _columns(spec: str) -> list[tuple[str, int | str | None]]:
    """``a b:3 c:s``: a as it is, b rounded to 3 digits, c as text."""
    out = []
    for item in spec.split():
        name, _, how = item.partition(":")
        out.append((name, int(how) if how.isdigit() else how or None))
    return out


def _spark_column(name: str, how: int | str | None):
    if how is None:
        return F.col(name)
    if how == "s":
        return F.col(name).cast("string").alias(name)
    return (F.round(F.col(name).cast("double") + SHIFT, how) + 0.0).alias(name)


def _sql_column(name: str, how: int | str | None) -> str:
    if how is None:
        return f'"{name}"'
    if how == "s":
        return f'CAST("{name}" AS VARCHAR) AS "{name}"'
    return f'round(CAST("{name}" AS DOUBLE) + {SHIFT}, {how}) + 0.0 AS "{name}"'


def query(name: str, columns: str, sql: str | None = None):
    """Register a plan builder that takes a Workspace and returns a DataFrame."""
    spec = _columns(columns)

    def register(build: Callable[[Workspace], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(workspace(spark, sf_dir))
            return df.select(*[_spark_column(c, how) for c, how in spec])

        QUERIES[name] = run
        if sql is not None:
            picked = ", ".join(_sql_column(c, how) for c, how in spec)
            STATEMENTS[name] = f"SELECT {picked} FROM ({sql}) q"
        return build

    return register
