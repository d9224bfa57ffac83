"""Query registry and the rounding both engines share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions.nulls import np_round
from harrow.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ROW = ("record_id", "part_id", "observation_date")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` is its counterpart."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def r6(c: Column | str, name: str | None = None, digits: int = 6) -> Column:
    """Six decimals: floating sums and transcendental functions differ in the last bits."""
    label = name or (c if isinstance(c, str) else None)
    out = np_round(c, digits)
    return out.alias(label) if label else out


def sql_round(expr: str, digits: int = 6) -> str:
    scale = f"{10**digits}e0"
    return f"(round_even(({expr})*{scale},0)/{scale})" if digits else f"round_even({expr},0)"


def sql_r6(*names: str) -> str:
    return ", ".join(f"{sql_round(n)} as {n}" for n in names)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[r6(c, digits=digits) if c in names else F.col(c) for c in df.columns])
