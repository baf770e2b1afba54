"""All registered queries of the engine with the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Decimals to which both sides round their floating-point columns.
DECIMALS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Floating-point columns rounded, and no negative zero."""
    return df.select(*[(F.round(F.col(f"`{c}`").cast("double"), DECIMALS) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def query(sql: str | None = None, doubles: str = ""):
    """Register a query under its function's name; ``doubles`` are the columns that SQL rounds."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            names = doubles.split()
            replace = f"REPLACE ({', '.join(f'round(CAST({n} AS DOUBLE), {DECIMALS}) + 0.0 AS {n}' for n in names)})" if names else ""
            ORACLE_SQL[f.__name__] = f"SELECT * {replace} FROM ({sql.strip()})"
        return f

    return add


from . import panel_queries, series_queries, source_queries  # noqa: E402, F401
