"""Climate derivations on one row of a (time, latitude, longitude) table.

Each function takes and returns a DataFrame and leaves it alone when an input
column is absent; Catalyst folds the whole chain into one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.nulls import clip, col


def saturation_vapour_pressure(t: Column | str) -> Column:
    t = col(t)
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def _has(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def temperature_mean(df: DataFrame) -> DataFrame:
    if not _has(df, "temperature_min", "temperature_max"):
        return df
    return df.withColumn("temperature_mean", (F.col("temperature_min") + F.col("temperature_max")) / 2.0)


def diurnal_range(df: DataFrame) -> DataFrame:
    if not _has(df, "temperature_min", "temperature_max"):
        return df
    return df.withColumn("diurnal_range", F.col("temperature_max") - F.col("temperature_min"))


def relative_humidity(df: DataFrame) -> DataFrame:
    if not _has(df, "vapor_pressure", "temperature_mean"):
        return df
    rh = 100.0 * F.col("vapor_pressure") / saturation_vapour_pressure("temperature_mean")
    return df.withColumn("relative_humidity", clip(rh, 0, 100))


def solar_radiation(df: DataFrame) -> DataFrame:
    """W/m2 to MJ/m2/day; the raw column goes."""
    if not _has(df, "solar_radiation_raw"):
        return df
    return df.withColumn("solar_radiation", F.col("solar_radiation_raw") * 0.0864).drop("solar_radiation_raw")


def _positive(name: str) -> Column:
    return F.when(F.col(name) > 0, F.col(name))


def aridity_index(df: DataFrame) -> DataFrame:
    if not _has(df, "precipitation_monthly", "potential_evapotranspiration"):
        return df
    ratio = F.try_divide(F.col("precipitation_monthly"), _positive("potential_evapotranspiration"))
    return df.withColumn("aridity_index", ratio)


def water_balance(df: DataFrame) -> DataFrame:
    if not _has(df, "precipitation_monthly", "actual_evapotranspiration"):
        return df
    return df.withColumn("water_balance", F.col("precipitation_monthly") - F.col("actual_evapotranspiration"))


def crop_water_stress(df: DataFrame) -> DataFrame:
    if not _has(df, "actual_evapotranspiration", "potential_evapotranspiration"):
        return df
    met = F.try_divide(F.col("actual_evapotranspiration"), _positive("potential_evapotranspiration"))
    return df.withColumn("crop_water_stress", clip(1.0 - met, 0, 1))


def growing_degrees(df: DataFrame) -> DataFrame:
    if not _has(df, "temperature_mean"):
        return df
    return df.withColumns(
        {f"gdd_base{b}": clip(F.col("temperature_mean") - float(b), low=0) for b in (10, 15)}
    )


def derive_all(df: DataFrame) -> DataFrame:
    """All derivations; the mean temperature comes first because others read it."""
    for step in (
        temperature_mean, diurnal_range, relative_humidity, solar_radiation,
        aridity_index, water_balance, crop_water_stress, growing_degrees,
    ):
        df = step(df)
    return df
