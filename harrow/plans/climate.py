"""Climate grids from raw variables to an export table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.climate import derive_all
from harrow.functions.dates import agricultural_season
from harrow.functions.geo import agroecological_zone
from harrow.operators.cleaning import apply_scale_factors, clamp_climate, drop_all_missing, inside_box
from harrow.operators.grids import concat_parts, daily_to_monthly, merge_variables, monthly_rain_stats, year_span
from harrow.sources.files import save_parquet


def tag_zone_and_season(df: DataFrame, time: str = "time") -> DataFrame:
    """Zone (grids carry no elevation, so it counts as 0) and season of every row."""
    return df.withColumns(
        {
            "agroecological_zone": agroecological_zone("latitude", "longitude", F.lit(0.0)),
            "season": agricultural_season(time, "latitude"),
        }
    )


def monthly_climate(parts: list[DataFrame]) -> DataFrame:
    """Raw one-variable grids -> merged, scaled, derived, clamped, tagged."""
    merged = merge_variables([inside_box(p) for p in parts])
    return tag_zone_and_season(drop_all_missing(clamp_climate(derive_all(apply_scale_factors(merged)))))


def rain_table(parts: list[DataFrame], aggregate_monthly: bool = False, daily_stats: bool = True) -> DataFrame:
    """Yearly rain grids as daily rows, monthly sums, or monthly statistics (which win)."""
    table = concat_parts(parts)
    if daily_stats:
        table = monthly_rain_stats(table).withColumnRenamed("month", "time")
    elif aggregate_monthly:
        table = daily_to_monthly(table).withColumnRenamed("month", "time")
    return tag_zone_and_season(drop_all_missing(table))


def export_climate(df: DataFrame, folder: str, prefix: str) -> str:
    """Write one Parquet table named by its first and last year; returns the path."""
    span = year_span(df).first()
    return save_parquet(df, f"{folder.rstrip('/')}/{prefix}_{span['first_year']}_{span['last_year']}.parquet")
