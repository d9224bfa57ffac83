"""From a cleaned survey table to model-ready features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import features as f
from harrow.functions.constants import CROP_GROUP
from harrow.functions.dates import rainfall_regime_flag
from harrow.operators.cleaning import drop_present, rename_canonical
from harrow.operators.encoding import one_hot
from harrow.operators.lookup import constant_lookup, with_group_stats
from harrow.operators.profiling import column_ranges

SCALED = (
    "organic_carbon", "total_nitrogen", "available_phosphorus",
    "fertilizer_nitrogen", "fertilizer_phosphorus", "organic_fertilizer",
)


def with_crop_group(df: DataFrame) -> DataFrame:
    """Group of each crop, only where the table has none."""
    if "crop_group" in df.columns or "crop_name" not in df.columns:
        return df
    return constant_lookup(df, "crop_name", CROP_GROUP, "crop_group")


def soil_and_inputs(df: DataFrame) -> DataFrame:
    """The two composites that are scaled by table-wide extremes (one extra pass for both)."""
    ranges = column_ranges(df, list(SCALED))
    return df.withColumns(
        {"soil_fertility_index": f.soil_fertility_index(ranges), "input_intensity": f.input_intensity(ranges)}
    )


def with_efficiencies(df: DataFrame) -> DataFrame:
    """Yield per nitrogen, per water, and against the zone mean."""
    df = with_group_stats(df, "agroecological_zone", _zone_mean=F.avg("yield_kg_ha"))
    return df.withColumns(f.efficiencies(F.col("_zone_mean"))).drop("_zone_mean")


def encode(
    df: DataFrame, zones: list[str] | None = None, groups: list[str] | None = None, outside: str | None = None
) -> DataFrame:
    """One-hot blocks of zone, crop group and altitude class.

    ``outside`` names the class of elevations outside the bins; it gets a column
    of its own when given.
    """
    df = one_hot(df, "agroecological_zone", "zone", zones)
    df = one_hot(df, "crop_group", "grp", groups)
    df = df.withColumn("altitude_class", f.altitude_class(outside))
    classes = sorted({name for _, _, name in f.ALTITUDE_CLASSES} | ({outside} if outside else set()))
    return one_hot(df, "altitude_class", "alt", classes)


def engineer(
    df: DataFrame, zones: list[str] | None = None, groups: list[str] | None = None, keep_ids: bool = False
) -> DataFrame:
    """All engineered features.

    Everything row-wise fuses into one projection; the extremes and the zone
    means are the only extra passes over the table.
    """
    df = with_crop_group(rename_canonical(df))
    df = df.withColumns(
        {
            **f.calendar(), **f.thermal(),
            "aridity_index": f.aridity_proxy(),
            "vpd_kpa": f.vapour_pressure_deficit(),
            "temp_altitude_residual": f.altitude_residual(),
            "heavy_rain_day": f.heavy_rain_day(),
            **f.soil_ratios(), **f.mineral_fertiliser(), **f.water_and_disease(),
            "rainfall_regime": rainfall_regime_flag("latitude"),
        }
    )
    df = soil_and_inputs(df).withColumns(f.interactions())
    df = with_efficiencies(encode(df, zones, groups))
    return df if keep_ids else drop_present(df)
