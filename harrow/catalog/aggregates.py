"""Aggregations, profiles, windows, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.catalog.files import dry_spell_sql, rain_stats_sql
from harrow.catalog.registry import query, rounded, sql_r6, sql_round
from harrow.functions.constants import (
    BIMODAL_SEASONS,
    CATEGORY_COLUMNS,
    CLIMATE_BOUNDS,
    MONOMODAL_SEASONS,
    SURVEY_BOUNDS,
)
from harrow.operators import grids, metrics, profiling
from harrow.sources.tables import Tables, with_views

STATION = dict(cell=("station_id",), time="observation_date")
DAILY = ("precipitation_daily", "temperature_mean", "relative_humidity")


@query(
    "a1_daily_to_monthly",
    with_views("daily")
    + f"""select station_id, cast(date_trunc('month', observation_date) as date) as month,
      {sql_round('coalesce(sum(precipitation_daily), 0)')} as precipitation_daily, {sql_round('avg(temperature_mean)')} as temperature_mean,
      {sql_round('avg(relative_humidity)')} as relative_humidity from daily group by 1, 2""",
)
def a1(t: Tables) -> DataFrame:
    return rounded(grids.daily_to_monthly(t.daily, **STATION), *DAILY)


RAIN = ("precipitation_daily", "rain_intensity_max", "precipitation_std")


@query(
    "a2_monthly_rain_stats",
    with_views("daily", stats=rain_stats_sql("daily", "station_id", "observation_date"))
    + f"select station_id, month, heavy_rain_days, wet_days, max_dry_spell, {sql_r6(*RAIN)} from stats",
)
def a2(t: Tables) -> DataFrame:
    return rounded(grids.monthly_rain_stats(t.daily, **STATION), *RAIN)


@query(
    "a3_max_dry_spell",
    with_views("daily", spells=dry_spell_sql("daily", "station_id", "observation_date"))
    + "select station_id, month, cast(max_dry_spell as int) as max_dry_spell from spells",
)
def a3(t: Tables) -> DataFrame:
    return grids.max_dry_spell(t.daily, **STATION)


@query(
    "w2_dry_run_counter",
    with_views("daily")
    + """select station_id, observation_date, cast(sum(case when dry then 1 else 0 end) over (partition by station_id, month, island order by observation_date
        rows between unbounded preceding and current row) as bigint) as dry_run from (
      select station_id, observation_date, cast(date_trunc('month', observation_date) as date) as month, precipitation_daily<1 as dry,
        sum(case when precipitation_daily<1 then 0 else 1 end) over (partition by station_id, date_trunc('month', observation_date) order by observation_date
          rows between unbounded preceding and current row) as island from daily) as m""",
)
def w2(t: Tables) -> DataFrame:
    return grids.dry_run_counter(t.daily, **STATION).select("station_id", "observation_date", "dry_run")


def _stack(names, fields: str, source: str = "obs", label: str = "column_name") -> str:
    """One SELECT per column, glued together; ``{c}`` in ``fields`` is the column."""
    return " union all ".join(f"select '{n}' as {label}, {fields.replace('{c}', n)} from {source}" for n in names)


_BOUNDED = ["temperature_min", "temperature_max", "temperature_mean", "precipitation_daily", "relative_humidity",
            "solar_radiation"]


def _bounds_sql(names, bounds) -> str:
    return " union all ".join(
        f"""select '{n}' as variable, count({n}) as total_valid, count(*) filter (where {n}<{bounds[n][0]}) as below_min,
        count(*) filter (where {n}>{bounds[n][1]}) as above_max from shifted""" for n in names
    )


_SHIFT = """select temperature_min-16 as temperature_min, temperature_max+10 as temperature_max, temperature_mean,
  precipitation_daily*4 as precipitation_daily, case when part_id%9=0 then null else relative_humidity+20 end as relative_humidity,
  solar_radiation+15 as solar_radiation from obs"""


@query("a5_bounds_report", with_views("obs", shifted=_SHIFT) + _bounds_sql(_BOUNDED, CLIMATE_BOUNDS))
def a5(t: Tables) -> DataFrame:
    return profiling.bounds_report(t.spark.sql(_SHIFT.replace("from obs", "from {obs}"), obs=t.obs))


_COVERED = ("organic_carbon", "temperature_mean", "relative_humidity")
_SPARSE = "select case when part_id%3=0 then null else organic_carbon end as organic_carbon, temperature_mean, case when station_id%8=0 then null else relative_humidity end as relative_humidity from obs"
_COVERAGE = " union all ".join(
    f"select '{n}' as variable, {sql_round(f'100e0*count({n})/count(*)')} as coverage_pct, 100e0*count({n})/count(*)>=80 as passes from sparse"
    for n in _COVERED
)


def _sparse(t: Tables) -> DataFrame:
    return t.spark.sql(_SPARSE.replace("from obs", "from {obs}"), obs=t.obs)


@query("a6_coverage_report", with_views("obs", sparse=_SPARSE) + _COVERAGE)
def a6(t: Tables) -> DataFrame:
    return rounded(profiling.coverage_report(_sparse(t), list(_COVERED)), "coverage_pct")


@query("a6_coverage_gate", with_views("obs", sparse=_SPARSE, report=_COVERAGE) + "select bool_and(passes) as passes from report")
def a6_gate(t: Tables) -> DataFrame:
    return profiling.coverage_passes(_sparse(t), list(_COVERED))


_PROFILED = ("record_id", "organic_carbon", "temperature_mean", "relative_humidity", "crop_name")
_GAPPY = "select record_id, case when part_id%3=0 then null else organic_carbon end as organic_carbon, temperature_mean, case when station_id%8=0 then null else relative_humidity end as relative_humidity, case when part_id%11=9 then null else crop_name end as crop_name from obs"


@query(
    "a7_missing_profile",
    with_views("obs", gappy=_GAPPY)
    + "select * from ("
    + _stack(_PROFILED, f"count(*) filter (where {{c}} is null) as missing, {sql_round('count(*) filter (where {c} is null)*1e0/count(*)*100', 2)} as pct", "gappy")
    + ") as t where missing>0",
)
def a7(t: Tables) -> DataFrame:
    return profiling.missing_profile(t.spark.sql(_GAPPY.replace("from obs", "from {obs}"), obs=t.obs))


def _oob_sql() -> str:
    parts = []
    for n, (low, high) in SURVEY_BOUNDS.items():
        count = f"count(*) filter (where not coalesce({n} between {float(low)!r}e0 and {float(high)!r}e0, false))"
        parts.append(f"select '{n}' as column_name, {count} as n_oob, {sql_round(f'{count}*1e0/count(*)*100', 2)} as pct from obs")
    return " union all ".join(parts)


@query("a8_out_of_bounds", with_views("obs") + f"select * from ({_oob_sql()}) as t where n_oob>0")
def a8(t: Tables) -> DataFrame:
    return profiling.out_of_bounds_report(t.obs)


@query("a9_category_counts", with_views("obs") + _stack(CATEGORY_COLUMNS, "count(distinct {c}) as n_distinct"))
def a9(t: Tables) -> DataFrame:
    return profiling.category_counts(t.obs)


@query("a10_value_counts", with_views("obs") + "select agroecological_zone, count(*) as n from obs where agroecological_zone is not null group by 1")
def a10(t: Tables) -> DataFrame:
    return profiling.value_counts(t.obs, "agroecological_zone")


@query(
    "a11_group_means",
    with_views("obs")
    + f"""select agroecological_zone, {sql_round('avg(yield_kg_ha)', 0)} as mean_yield_kg_ha, {sql_round('avg(temperature_mean)', 1)} as mean_temperature_mean,
      {sql_round('avg(relative_humidity)', 1)} as mean_relative_humidity from obs group by 1""",
)
def a11(t: Tables) -> DataFrame:
    return profiling.group_means(t.obs, "agroecological_zone", {"yield_kg_ha": 0, "temperature_mean": 1, "relative_humidity": 1})


@query(
    "a12_pair_correlations",
    with_views("obs") + " union all ".join(
        f"select '{a} <-> {b}' as pair, {sql_round(f'corr({a}, {b})')} as r from obs" for a, b in profiling.CORRELATION_PAIRS
    ),
)
def a12(t: Tables) -> DataFrame:
    return rounded(profiling.pair_correlations(t.obs), "r")


FEATURES = ["latitude", "longitude", "elevation", "temperature_min", "temperature_max", "temperature_mean",
            "precipitation_daily", "relative_humidity", "solar_radiation", "ph_water", "organic_carbon",
            "total_nitrogen", "available_phosphorus", "sand_percentage", "clay_percentage", "fertilizer_nitrogen",
            "fertilizer_phosphorus", "organic_fertilizer", "disease_incidence"]
_CORR = " union all ".join(f"select '{c}' as feature, corr({c}, yield_kg_ha) as r from obs" for c in FEATURES)


@query("a13_target_correlations", with_views("obs", cor=_CORR) + f"select feature, {sql_r6('r')} from cor")
def a13(t: Tables) -> DataFrame:
    return rounded(profiling.target_correlations(t.obs, FEATURES, "yield_kg_ha"), "r")


@query(
    "t3_extreme_correlations",
    with_views("obs", cor=_CORR)
    + f"""select feature, {sql_r6('r')}, 'top' as side from (select * from cor order by r desc, feature limit 10) as a
      union all select feature, {sql_r6('r')}, 'bottom' as side from (select * from cor order by r, feature desc limit 5) as b""",
)
def t3(t: Tables) -> DataFrame:
    return rounded(profiling.extreme_correlations(t.obs, FEATURES, "yield_kg_ha"), "r")


_DESCRIBED = ["temperature_mean", "precipitation_daily", "organic_carbon", "elevation", "yield_kg_ha"]


@query(
    "a14_describe",
    with_views("obs") + _stack(
        _DESCRIBED,
        f"""count({{c}}) as count, {sql_round('avg({c})')} as mean, {sql_round('stddev_samp({c})')} as std, {sql_round('min({c})')} as min,
        {sql_round('quantile_cont({c}, 0.25)')} as p25, {sql_round('quantile_cont({c}, 0.5)')} as p50, {sql_round('quantile_cont({c}, 0.75)')} as p75,
        {sql_round('max({c})')} as max""",
    ),
)
def a14(t: Tables) -> DataFrame:
    return rounded(profiling.describe(t.obs, _DESCRIBED), "mean", "std", "min", "p25", "p50", "p75", "max")


@query(
    "a15_column_ranges",
    with_views("obs") + _stack(_DESCRIBED, "min({c}) as min_value, max({c}) as max_value"),
)
def a15(t: Tables) -> DataFrame:
    return profiling.ranges_table(t.obs, _DESCRIBED)


_SOUTH, _NORTH = (", ".join(f"'{s}'" for s in names) for names in (MONOMODAL_SEASONS, BIMODAL_SEASONS))


@query(
    "a16_rule_violations",
    with_views("obs") + " union all ".join(
        f"select '{rule}' as rule, count(*) filter (where {test}) as n_rows from obs"
        for rule, test in {
            "temperature_order": "temperature_max<=temperature_min",
            "yield_above_biomass": "yield_kg_ha>biomass_kg_ha",
            "texture_above_100": "sand_percentage+clay_percentage>100",
            "season_mismatch_south": f"latitude<6 and season in ({_SOUTH})",
            "season_mismatch_north": f"latitude>=6 and season in ({_NORTH})",
        }.items()
    ),
)
def a16(t: Tables) -> DataFrame:
    return profiling.rule_violations(t.obs)


HAVERSINE_SQL = """(2*asin(sqrt(least(1e0, pow(sin((radians({lat2})-radians({lat1}))/2), 2)
  + cos(radians({lat1}))*cos(radians({lat2}))*pow(sin((radians({lon2})-radians({lon1}))/2), 2))))*6371e0)"""


@query(
    "a17_spatial_slopes",
    with_views(
        "obs",
        places="select distinct location_id, latitude, longitude, elevation, agroecological_zone from obs",
        ends="""select agroecological_zone, count(*) as n_points,
          arg_min(latitude, (elevation, location_id)) as lat1, arg_min(longitude, (elevation, location_id)) as lon1, min(elevation) as low,
          arg_min(latitude, (-elevation, location_id)) as lat2, arg_min(longitude, (-elevation, location_id)) as lon2, max(elevation) as high
          from places group by 1""",
        runs=f"select *, {HAVERSINE_SQL.format(lat1='lat1', lon1='lon1', lat2='lat2', lon2='lon2')}*1000 as run from ends",
    )
    + f"""select agroecological_zone, n_points, case when n_points>=3 then case when run=0 then 0e0
      else {sql_round('degrees(atan((high-low)/run))')} end end as slope_degrees from runs""",
)
def a17(t: Tables) -> DataFrame:
    places = t.obs.select("location_id", "latitude", "longitude", "elevation", "agroecological_zone").distinct()
    return rounded(grids.spatial_slopes(places, "agroecological_zone", ["location_id"]), "slope_degrees")


def metrics_sql(y: str = "y_true", p: str = "y_pred") -> str:
    return f"""{sql_round(f'sqrt(avg(({y}-{p})*({y}-{p})))', 9)} as rmse, {sql_round(f'avg(abs({y}-{p}))', 9)} as mae,
    {sql_round(f'1-sum(({y}-{p})*({y}-{p}))/(var_pop({y})*count(*))', 9)} as r2,
    {sql_round(f'avg(abs({y}-{p})/greatest(abs({y}), 1))', 9)} as mape, count(*) as n_samples"""


METRICS = ("rmse", "mae", "r2", "mape")


@query("a18_metrics", with_views("preds") + f"select {metrics_sql()} from preds")
def a18(t: Tables) -> DataFrame:
    return rounded(metrics.evaluate(t.preds), *METRICS, digits=9)


@query(
    "a19_metrics_by_group",
    with_views("preds") + " union all ".join(
        f"select '{g}' as grouping, {g} as value, {metrics_sql()} from preds group by {g}" for g in ("agroecological_zone", "crop_group")
    ),
)
def a19(t: Tables) -> DataFrame:
    return rounded(metrics.evaluate_by_group(t.preds, ["agroecological_zone", "crop_group"]), *METRICS, digits=9)


@query(
    "t1_compare_models",
    with_views("preds")
    + " union all ".join(
        f"""select '{name}' as model, {sql_round('sqrt(avg(pow(y_true-p, 2)))', 9)} as "RMSE", {sql_round('avg(abs(y_true-p))', 9)} as "MAE",
        {sql_round('1-sum(pow(y_true-p, 2))/(var_pop(y_true)*count(*))', 9)} as "R2", {sql_round('avg(abs(y_true-p)/greatest(abs(y_true), 1))', 9)} as "MAPE",
        count(*) as n_samples from (select y_true, {expr} as p from preds) as t""" for name, expr in {"scaled": "y_pred", "flat": "4000e0"}.items()
    ),
)
def t1(t: Tables) -> DataFrame:
    flat = t.preds.withColumn("y_pred", F.lit(4000.0))
    return rounded(
        metrics.compare_models({"scaled": metrics.evaluate(t.preds), "flat": metrics.evaluate(flat)}), "RMSE", "MAE", "R2", "MAPE", digits=9,
    )


@query(
    "a20_year_span",
    with_views("grid") + "select cast(min(year(time)) as int) as first_year, cast(max(year(time)) as int) as last_year from grid",
)
def a20(t: Tables) -> DataFrame:
    return grids.year_span(t.grid)


@query(
    "a22_duplicate_report",
    with_views("obs")
    + f"""select count(*) as n_rows, count(*)-count(distinct record_id) as n_removed,
      {sql_round('(count(*)-count(distinct record_id))*1e0/count(*)*100', 2)} as pct_removed from obs""",
)
def a22(t: Tables) -> DataFrame:
    return profiling.duplicate_report(t.obs, "record_id")


@query("t2_top_crops", with_views("obs") + "select crop_name, count(*) as n from obs group by 1 order by n desc, crop_name limit 15")
def t2(t: Tables) -> DataFrame:
    return profiling.top_values(t.obs, "crop_name")
