"""Named queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, text: tuple[str, ...] = ()):
    """Register a function of (spark, folder of tables) under its own name. Columns in text (dates) are given as text."""

    def put(f):
        @wraps(f)
        def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("string") for c in text if c in df.columns})

        QUERIES[f.__name__] = shown
        if sql:
            casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in text)
            ORACLES[f.__name__] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if text else sql
        return f

    return put
