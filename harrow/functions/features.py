"""Engineered survey features. Scalars live here; ``plans.survey`` chains them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions.climate import saturation_vapour_pressure
from harrow.functions.constants import ALTITUDE_CLASSES
from harrow.functions.dates import cyclic, is_rainy_season, season_ordinal
from harrow.functions.nulls import clip, np_round, row_mean


def flag(condition: Column) -> Column:
    """0/1 byte; a missing comparison is 0."""
    return F.coalesce(condition, F.lit(False)).cast("tinyint")


def calendar() -> dict[str, Column]:
    date = F.col("observation_date")
    month_sin, month_cos = cyclic(F.month(date), 12)
    doy_sin, doy_cos = cyclic(F.dayofyear(date), 365)
    return {
        "month": F.month(date), "day_of_year": F.dayofyear(date), "year": F.year(date),
        "month_sin": month_sin, "month_cos": month_cos, "doy_sin": doy_sin, "doy_cos": doy_cos,
        "season_ordinal": season_ordinal("season"), "is_rainy_season": is_rainy_season("season"),
    }


def thermal() -> dict[str, Column]:
    t = F.col("temperature_mean")
    return {
        "gdd_base10": np_round(clip(t - 10, low=0), 1),
        "gdd_base15": np_round(clip(t - 15, low=0), 1),
        "diurnal_range": np_round(F.col("temperature_max") - F.col("temperature_min"), 1),
    }


def aridity_proxy() -> Column:
    """Rain over (temperature + 10); not the P/PET index of the climate grids."""
    return np_round(F.col("precipitation_daily") / clip(F.col("temperature_mean") + 10, low=1), 3)


def vapour_pressure_deficit() -> Column:
    dryness = 1 - F.col("relative_humidity") / 100
    return np_round(saturation_vapour_pressure("temperature_mean") * dryness, 3)


def altitude_residual() -> Column:
    return np_round(F.col("temperature_mean") + 6.5 * F.col("elevation") / 1000, 1)


def heavy_rain_day() -> Column:
    return flag(F.col("precipitation_daily") > 20)


def _scaled(name: str, ranges: Column) -> Column:
    low, high = ranges[f"min_{name}"], ranges[f"max_{name}"]
    return F.when(high > low, F.try_divide(F.col(name) - low, high - low)).otherwise(F.lit(0.5))


def soil_fertility_index(ranges: Column) -> Column:
    """Row mean of the pH score and three min-max scaled nutrients."""
    ph = 1 - clip(F.abs(F.col("ph_water") - 6.25) / 3.0, 0, 1)
    nutrients = [_scaled(c, ranges) for c in ("organic_carbon", "total_nitrogen", "available_phosphorus")]
    return np_round(row_mean(ph, *nutrients), 3)


def soil_ratios() -> dict[str, Column]:
    carbon = F.col("organic_carbon")
    return {
        "cn_ratio": np_round(carbon / clip("total_nitrogen", low=0.01), 1),
        "cec_estimate": np_round(F.col("clay_percentage") * 0.5 + carbon * 2, 1),
    }


def input_intensity(ranges: Column) -> Column:
    """Weighted share of the largest dose seen, plus irrigation."""

    def share(weight: float, name: str) -> Column:
        top = ranges[f"max_{name}"]
        return F.try_divide(weight * F.col(name), F.when(top == 0, F.lit(1.0)).otherwise(top))

    return np_round(
        share(0.4, "fertilizer_nitrogen") + share(0.2, "fertilizer_phosphorus")
        + share(0.2, "organic_fertilizer") + 0.2 * F.col("irrigation_applied").cast("double"),
        3,
    )


def mineral_fertiliser() -> dict[str, Column]:
    total = np_round(F.col("fertilizer_nitrogen") + F.col("fertilizer_phosphorus"), 1)
    return {
        "total_mineral_fert": total,
        "organic_mineral_ratio": np_round(F.col("organic_fertilizer") / clip(total, low=1), 3),
    }


def altitude_class(outside: str | None = None) -> Column:
    """Class by right-closed bins; an elevation outside them gives ``outside``."""
    height, out = F.col("elevation"), None
    for low, high, name in ALTITUDE_CLASSES:
        test = (height > low) & (height <= high)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(F.lit(outside))


def interactions() -> dict[str, Column]:
    heat = F.col("relative_humidity") * F.col("temperature_mean")
    return {
        "humidity_temp_interaction": np_round(heat / 100, 2),
        "rain_oc_interaction": np_round(F.col("precipitation_daily") * F.col("organic_carbon"), 2),
        "input_soil_interaction": np_round(F.col("input_intensity") * F.col("soil_fertility_index"), 3),
    }


def water_and_disease() -> dict[str, Column]:
    heat = F.col("relative_humidity") * F.col("temperature_mean")
    return {
        "water_supply_index": np_round(
            F.col("precipitation_daily") + F.col("irrigation_applied").cast("double") * 30, 1
        ),
        "disease_risk_score": np_round(heat / (clip("solar_radiation", low=1) * 100), 3),
    }


def efficiencies(zone_mean: Column) -> dict[str, Column]:
    """Leakage set: never model inputs."""
    y = F.col("yield_kg_ha")
    return {
        "nue": np_round(y / clip("fertilizer_nitrogen", low=1), 1),
        "wue": np_round(y / clip("water_supply_index", low=1), 1),
        "yield_gap_ratio": np_round(y / clip(zone_mean, low=1), 3),
    }


def soil_sample_fields(sand: str, silt: str, clay: str, carbon: str) -> dict[str, Column]:
    """Texture scaled to 100 % with clay as the remainder, class, organic matter, CEC."""
    total = F.col(sand) + F.col(silt) + F.col(clay)
    sand_pct = np_round(F.try_divide(F.col(sand), total) * 100, 1)
    silt_pct = np_round(F.try_divide(F.col(silt), total) * 100, 1)
    clay_pct = np_round(100 - sand_pct - silt_pct, 1)
    return {
        "sand_percentage": sand_pct,
        "silt_percentage": silt_pct,
        "clay_percentage": clay_pct,
        "texture_class": F.when(clay_pct >= 40, "clay").when(clay_pct >= 27, "clay_loam")
        .when(clay_pct >= 7, "loam").otherwise("sandy_loam"),
        "organic_matter": np_round(F.col(carbon) * 1.724, 2),
        "cation_exchange_capacity": np_round(clay_pct * 0.5 + F.col(carbon) * 2, 1),
    }
