"""Queries by name, each with the SQL that gives its rows in DuckDB where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name. sql may read the stand-in tables series, pose, gait, clips, frame_stats."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            used = any(t in sql for t in ("series", "pose", "gait", "clips", "frame_stats"))
            body = sql.strip()
            if used:
                recursive = "RECURSIVE " if body.startswith("RECURSIVE ") else ""
                body = body.removeprefix("RECURSIVE ")
                body = f"WITH {recursive}{tables.SQL.strip()}" + (f", {body}" if not body.startswith("SELECT") else f" {body}")
            ORACLE_SQL[f.__name__] = body
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed number of digits, as two engines sum in different orders."""
    return df.select(*(F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
