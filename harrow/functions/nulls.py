"""Missing-value and rounding helpers that every other module uses."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Clamp to ``[low, high]``; a missing value stays missing.

    ``greatest``/``least`` skip NULL, so the NULL case is kept apart.
    """
    c = col(c)
    out = c
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    return F.when(c.isNotNull(), out)


def np_round(c: Column | str, digits: int = 0) -> Column:
    """Half-even rounding of the scaled value (numpy / pandas ``round``)."""
    c = col(c)
    if digits == 0:
        return F.rint(c)
    scale = float(10**digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in the sources this library reads; Spark's NaN does not."""
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def row_mean(*cols: Column) -> Column:
    """Mean over the columns of one row, missing ones skipped."""
    total = reduce(add, [F.coalesce(c, F.lit(0.0)) for c in cols])
    present = reduce(add, [c.isNotNull().cast("int") for c in cols])
    return F.when(present > 0, total / present)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
