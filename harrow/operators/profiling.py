"""Table profiles. Every report is one aggregate over all columns, then turned into rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.constants import (
    BIMODAL_SEASONS,
    CATEGORY_COLUMNS,
    CLIMATE_BOUNDS,
    MONOMODAL_SEASONS,
    REGIME_LATITUDE,
    SURVEY_BOUNDS,
)
from harrow.functions.nulls import float_columns, np_round
from harrow.operators.quantiles import exact_percentiles
from harrow.runtime import release, stabilise


def _report(df: DataFrame, names: list[str], fields: dict[str, Callable[[str], Column]], label: str = "column_name") -> DataFrame:
    """One row per name; ``fields`` maps an output column to its aggregate."""
    packed = [
        F.struct(F.lit(n).alias(label), *[make(n).alias(field) for field, make in fields.items()]).alias(f"c{i}")
        for i, n in enumerate(names)
    ]
    wide = df.agg(*packed)
    return wide.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(names))])))


def _known(df: DataFrame, bounds: dict) -> list[str]:
    return [c for c in df.columns if c in bounds]


def bounds_report(df: DataFrame, bounds: dict = CLIMATE_BOUNDS) -> DataFrame:
    """Valid count and values below / above the bounds; missing values are not counted."""
    return _report(
        df, _known(df, bounds),
        {
            "total_valid": lambda c: F.count(c),
            "below_min": lambda c: F.count_if(F.col(c) < float(bounds[c][0])),
            "above_max": lambda c: F.count_if(F.col(c) > float(bounds[c][1])),
        },
        label="variable",
    )


def coverage_report(df: DataFrame, variables: list[str], min_pct: float = 80.0) -> DataFrame:
    """Share of cells with a value per variable, and whether it reaches ``min_pct``."""
    pct = lambda c: F.try_divide(100.0 * F.count(c), F.count(F.lit(1)))
    return _report(
        df, variables,
        {"coverage_pct": pct, "passes": lambda c: F.coalesce(pct(c) >= min_pct, F.lit(True))},
        label="variable",
    )


def coverage_passes(df: DataFrame, variables: list[str], min_pct: float = 80.0) -> DataFrame:
    return coverage_report(df, variables, min_pct).agg(F.bool_and("passes").alias("passes"))


def missing_profile(df: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.col(c).isNull())
    report = _report(
        df, df.columns,
        {"missing": n, "pct": lambda c: np_round(F.try_divide(n(c), F.count(F.lit(1))) * 100, 2)},
    )
    return report.where("missing > 0").orderBy(F.desc("pct"), "column_name")


def out_of_bounds_report(df: DataFrame, bounds: dict = SURVEY_BOUNDS) -> DataFrame:
    """Values outside the bounds; here a missing value counts as outside."""
    inside = lambda c: F.coalesce(
        F.col(c).between(float(bounds[c][0]), float(bounds[c][1])), F.lit(False)
    )
    n = lambda c: F.count_if(~inside(c))
    report = _report(
        df, _known(df, bounds),
        {"n_oob": n, "pct": lambda c: np_round(F.try_divide(n(c), F.count(F.lit(1))) * 100, 2)},
    )
    return report.where("n_oob > 0")


def category_counts(df: DataFrame, columns: tuple[str, ...] = CATEGORY_COLUMNS) -> DataFrame:
    """Distinct values per column: distinct (name, value) pairs first, so no value set is gathered."""
    pairs = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns]))
    ).distinct()
    return pairs.groupBy("column_name").agg(F.count("v").alias("n_distinct"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column)


def top_values(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    return value_counts(df, column).limit(k)


def group_means(df: DataFrame, group: str, columns: dict[str, int]) -> DataFrame:
    """Rounded means per group, highest first by the first column."""
    means = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        *[np_round(F.avg(c), d).alias(f"mean_{c}") for c, d in columns.items()]
    )
    return means.orderBy(F.desc(f"mean_{next(iter(columns))}"), group)


# --- Fixed values: the column pairs of the correlation check ----------------------
CORRELATION_PAIRS = (
    ("relative_humidity", "disease_incidence"),
    ("elevation", "temperature_mean"),
    ("precipitation_daily", "relative_humidity"),
    ("fertilizer_nitrogen", "yield_kg_ha"),
    ("organic_carbon", "total_nitrogen"),
)


def pair_correlations(df: DataFrame, pairs: tuple[tuple[str, str], ...] = CORRELATION_PAIRS) -> DataFrame:
    names = [f"{a} <-> {b}" for a, b in pairs]
    by_name = dict(zip(names, pairs))
    return _report(df, names, {"r": lambda n: F.corr(*by_name[n])}, label="pair")


def target_correlations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Pearson r of every feature with the target in one pass."""
    return _report(df, features, {"r": lambda c: F.corr(F.col(c).cast("double"), F.col(target))}, label="feature")


def extreme_correlations(df: DataFrame, features: list[str], target: str, top: int = 10, bottom: int = 5) -> DataFrame:
    r = target_correlations(df, features, target).where("r is not null")
    high = r.orderBy(F.desc("r"), "feature").limit(top).withColumn("side", F.lit("top"))
    low = r.orderBy("r", F.desc("feature")).limit(bottom).withColumn("side", F.lit("bottom"))
    return high.unionByName(low)


def describe(df: DataFrame, columns: list[str] | None = None, **options) -> DataFrame:
    """count, mean, sample deviation, min, quartiles, max per column; quartiles are exact.

    The columns are written once; all figures are aggregates of that table, one row per column.
    """
    columns = columns or float_columns(df)
    table = stabilise(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    try:
        quartiles = exact_percentiles(table, columns, [0.25, 0.5, 0.75], stored=True, **options)
        figures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
        row = table.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in figures.items()]).first()
    finally:
        release(table)
    rows = [(c, *[row[f"{n}_{i}"] for n in ("count", "mean", "std", "min")], *quartiles[c], row[f"max_{i}"]) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
    )


def column_ranges(df: DataFrame, columns: list[str]) -> Column:
    """``struct(min_<c>, max_<c>, ...)`` of a table as a scalar subquery, for scaling its rows."""
    fields = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return df.agg(F.struct(*fields).alias("ranges")).scalar()


def ranges_table(df: DataFrame, columns: list[str]) -> DataFrame:
    return _report(
        df, columns,
        {"min_value": lambda c: F.min(c), "max_value": lambda c: F.max(c)},
    )


def rule_violations(df: DataFrame) -> DataFrame:
    """Rows that break a cross-variable rule, one report row per rule."""
    north = F.coalesce(F.col("latitude") >= REGIME_LATITUDE, F.lit(False))
    season = F.col("season")
    rules = {
        "temperature_order": F.col("temperature_max") <= F.col("temperature_min"),
        "yield_above_biomass": F.col("yield_kg_ha") > F.col("biomass_kg_ha"),
        "texture_above_100": F.col("sand_percentage") + F.col("clay_percentage") > 100,
        "season_mismatch_south": ~north & season.isin(*MONOMODAL_SEASONS),
        "season_mismatch_north": north & season.isin(*BIMODAL_SEASONS),
    }
    return _report(df, list(rules), {"n_rows": lambda n: F.count_if(rules[n])}, label="rule")


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """Rows a dedupe by ``key`` would remove, as count and per cent."""
    keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    totals = keys.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
    removed = F.col("n_rows") - F.col("n_keys")
    return totals.select(
        "n_rows", removed.alias("n_removed"), np_round(F.try_divide(removed, F.col("n_rows")) * 100, 2).alias("pct_removed")
    )
