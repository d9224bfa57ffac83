"""Row and column cleaning of survey and climate tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions.constants import (
    BUFFER_DEG,
    CANONICAL_NAMES,
    CLIMATE_BOUNDS,
    LAT_RANGE,
    LEAKAGE_COLUMNS,
    LON_RANGE,
    MONTHLY_GRID_VARIABLES,
    RAIN_FILL_VALUE,
    SURVEY_BOUNDS,
    TARGETS,
    ID_AND_TEXT_COLUMNS,
)
from harrow.functions.nulls import clip, numeric_columns, np_round
from harrow.operators.quantiles import exact_medians
from harrow.runtime import stabilise


# --- columns ------------------------------------------------------------------
def rename_canonical(df: DataFrame, names: dict[str, str] = CANONICAL_NAMES) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def detect_column(df: DataFrame, candidates: list[str]) -> str:
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"None of {candidates} among {df.columns}")


def normalise_coordinates(df: DataFrame) -> DataFrame:
    """Bring whichever latitude / longitude / time names a grid uses to one form."""
    found = {
        "latitude": detect_column(df, ["latitude", "lat"]),
        "longitude": detect_column(df, ["longitude", "lon"]),
        "time": detect_column(df, ["time", "day"]),
    }
    return df.withColumnsRenamed({old: new for new, old in found.items()})


def drop_present(df: DataFrame, names: tuple[str, ...] = ("record_id", "location_id", "altitude_class")) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns in declared order; absent ones as NULL."""
    return df.select(
        *[
            F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def narrow_floats(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(f.name).cast("float").alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
          for f in df.schema.fields]
    )


def booleans_to_int(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(f.name).cast("int").alias(f.name) if isinstance(f.dataType, T.BooleanType) else F.col(f.name)
          for f in df.schema.fields]
    )


def target_column(df: DataFrame, candidates: tuple[str, ...] = TARGETS) -> str:
    """The first candidate that the table has."""
    have = set(df.columns)
    found = [name for name in candidates if name in have]
    if not found:
        raise ValueError(f"No target column among {', '.join(candidates)}")
    return found[0]


def model_columns(df: DataFrame, target: str | None = None, also_drop: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """Features plus the target; leakage, identifiers, text and the other target go."""
    target = target_column(df, (target, *TARGETS) if target else TARGETS)
    gone = set(LEAKAGE_COLUMNS) | set(ID_AND_TEXT_COLUMNS) | set(also_drop) | (set(TARGETS) - {target})
    return df.select(*[c for c in df.columns if c not in gone]), target


# --- raw grids -----------------------------------------------------------------
def apply_scale_factors(df: DataFrame, specs=MONTHLY_GRID_VARIABLES) -> DataFrame:
    """Scale and rename the raw variables that are present; the rest passes."""
    known = {source: (name, factor) for source, name, factor in specs}
    return df.select(
        *[
            (F.col(c) * F.lit(known[c][1]) if known[c][1] != 1.0 else F.col(c)).alias(known[c][0])
            if c in known else F.col(c)
            for c in df.columns
        ]
    )


def clean_rain(df: DataFrame, source: str = "precip", name: str = "precipitation_daily") -> DataFrame:
    """Fill value to missing, negatives to zero, project name."""
    value = clip(F.nullif(F.col(source), F.lit(RAIN_FILL_VALUE)), low=0)
    return df.withColumn(source, value).withColumnRenamed(source, name)


def inside_box(df: DataFrame, lat: str = "latitude", lon: str = "longitude", buffer: float = BUFFER_DEG) -> DataFrame:
    """Cells of the country box widened by ``buffer``; pushed down to the scan."""
    return df.where(
        F.col(lat).between(LAT_RANGE[0] - buffer, LAT_RANGE[1] + buffer)
        & F.col(lon).between(LON_RANGE[0] - buffer, LON_RANGE[1] + buffer)
    )


def inside_period(df: DataFrame, start: date, end: date, time: str = "time") -> DataFrame:
    """Rows from the first to the last day, both inclusive, for dates and timestamps."""
    after = F.date_add(F.lit(end), 1)
    return df.where((F.col(time) >= F.lit(start)) & (F.col(time) < after))


def drop_all_missing(df: DataFrame, keys: tuple[str, ...] = ("latitude", "longitude", "time")) -> DataFrame:
    return df.dropna(how="all", subset=[c for c in df.columns if c not in keys])


# --- bounds and consistency --------------------------------------------------
def clamp(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[clip(c, *bounds[c]).alias(c) if c in bounds else F.col(c) for c in df.columns])


def clamp_survey(df: DataFrame) -> DataFrame:
    return clamp(df, SURVEY_BOUNDS)


def clamp_climate(df: DataFrame) -> DataFrame:
    return clamp(df, CLIMATE_BOUNDS)


def repair_consistency(df: DataFrame) -> DataFrame:
    """Temperature order, biomass below yield, texture above 100 %."""
    tmin, tmax = F.col("temperature_min"), F.col("temperature_max")
    harvest, biomass = F.col("yield_kg_ha"), F.col("biomass_kg_ha")
    sand, clay = F.col("sand_percentage"), F.col("clay_percentage")
    fixed_tmax = F.when(tmax <= tmin, tmin + 5.0).otherwise(tmax)
    return df.withColumns(
        {
            "temperature_max": fixed_tmax,
            "temperature_mean": np_round((tmin + fixed_tmax) / 2, 1),
            "biomass_kg_ha": F.when(
                harvest > biomass, np_round(F.try_divide(harvest, F.col("harvest_index")), 0)
            ).otherwise(biomass),
            "sand_percentage": F.when(sand + clay > 100, clip(100 - clay - 10, 0, 100)).otherwise(sand),
        }
    )


# --- duplicates -----------------------------------------------------------------
def first_per_key(df: DataFrame, keys: str | list[str], order: list[str | Column]) -> DataFrame:
    """The first row of every key in the given order.

    Spark turns ``row_number() = 1`` into a group limit before the shuffle, so a
    key with very many copies sends one row per input partition.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


# --- imputation --------------------------------------------------------------------
def fit_medians(df: DataFrame, columns: list[str] | None = None, **options) -> dict[str, float]:
    """Exact median per numeric column; a column without values is left out."""
    columns = columns or numeric_columns(df)
    return {c: m for c, m in exact_medians(df, columns, **options).items() if m is not None}


def fill_missing(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Put the fitted values where a row has none; a whole-number column is widened to hold a half."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def filled(c: str) -> Column:
        keep = isinstance(types[c], (T.DoubleType, T.FloatType)) or float(values[c]).is_integer()
        target = types[c] if keep else T.DoubleType()
        return F.coalesce(F.col(c).cast(target), F.lit(values[c]).cast(target)).alias(c)

    return df.select(*[filled(c) if c in values else F.col(c) for c in df.columns])


def handle_missing(df: DataFrame, values: dict[str, float] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """Fit on a training table (no ``values``), reuse the returned values on a test table."""
    values = fit_medians(df) if values is None else values
    return fill_missing(df, {c: v for c, v in values.items() if c in df.columns}), values


def columns_with_gaps(df: DataFrame, columns: list[str]) -> list[str]:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def _impute_gaps(df: DataFrame) -> DataFrame:
    """Medians of the table as it stands; it is read several times, so it is written once."""
    df = stabilise(df)
    gaps = columns_with_gaps(df, numeric_columns(df))
    return fill_missing(df, fit_medians(df, gaps, stored=True)) if gaps else df


def _in_country(df: DataFrame) -> DataFrame:
    return df.where(F.col("latitude").between(*LAT_RANGE) & F.col("longitude").between(*LON_RANGE))


def clean_survey(df: DataFrame, order: list[str], key: str = "record_id") -> DataFrame:
    """Dedupe, filter, impute, round - in this order, since medians follow the filters."""
    df = _in_country(first_per_key(df, key, order))
    for low, high in (("yield_grain", "biomass_total"), ("yield_kg_ha", "biomass_kg_ha")):
        if {low, high} <= set(df.columns):
            df = df.where(F.col(low) <= F.col(high))
    if {"temperature_min", "temperature_max"} <= set(df.columns):
        df = df.where("temperature_max > temperature_min")
    df = _impute_gaps(df)
    digits = {"latitude": 6, "longitude": 6, "temperature_min": 1, "temperature_max": 1, "temperature_mean": 1}
    return df.select(*[np_round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


TABLE_RULES = {
    "crops": [
        "harvest_date > planting_date", "yield_tha <= biomass_tha", "area_hectares > 0",
        "harvest_index between 0.1e0 and 0.8e0", "yield_tha between 0.1e0 and 50e0",
    ],
    "weather": [
        "temperature_max > temperature_min", "relative_humidity between 0e0 and 100e0",
        "precipitation_daily >= 0e0", "solar_radiation >= 0e0",
    ],
    "soil": [
        "abs(sand_percentage + silt_percentage + clay_percentage - 100e0) < 2e0",
        "ph_water between 3.5e0 and 9.5e0", "organic_carbon >= 0.1e0",
    ],
}
TABLE_DIGITS = {
    "latitude": 6, "longitude": 6, "yield_tha": 2, "biomass_tha": 2, "temperature_min": 2, "temperature_max": 2,
}


# What identifies a row, the first key that a table has
TABLE_KEYS = (("field_id",), ("sample_id",), ("station_id", "date"))


def clean_table(df: DataFrame, kind: str, order: list[str]) -> DataFrame:
    """The three table types share the steps and differ in key, rules and rounding."""
    if kind not in TABLE_RULES:
        raise ValueError(f"Unknown table type '{kind}'. Available: {sorted(TABLE_RULES)}")
    unique = next((list(key) for key in TABLE_KEYS if set(key) <= set(df.columns)), None)
    if unique:
        df = first_per_key(df, unique, order)
    for rule in TABLE_RULES[kind]:
        df = df.where(rule)
    if {"latitude", "longitude"} <= set(df.columns):
        df = _in_country(df)
    df = _impute_gaps(df)
    return df.select(
        *[
            np_round(f.name, TABLE_DIGITS.get(f.name, 1)).cast(f.dataType).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
