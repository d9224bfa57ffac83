"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.catalog.registry import ROW, query, r6, rounded, sql_r6, sql_round
from harrow.functions.constants import CROP_PROFILE
from harrow.operators import grids
from harrow.operators.crops import crop_varieties, with_crop_profile
from harrow.operators.lookup import with_group_stats
from harrow.operators.series import masked_mean, sequence_samples, weather_sequences
from harrow.plans.survey import with_crop_group
from harrow.sources.tables import Tables, with_views

ROW_SQL = ", ".join(ROW)
VALUES = ("temperature_min", "temperature_max", "precipitation_monthly")


@query(
    "j1_merge_variables",
    with_views(
        "grid",
        a="select time, latitude, longitude, temperature_min from grid where latitude<9",
        b="select time, latitude, longitude, temperature_max from grid where latitude>4",
        c="select time, latitude, longitude, precipitation_monthly from grid where longitude>10",
    )
    + f"""select time, latitude, longitude, {sql_r6(*VALUES)} from a full join b using (time, latitude, longitude)
      full join c using (time, latitude, longitude)""",
)
def j1(t: Tables) -> DataFrame:
    key = ("time", "latitude", "longitude")
    parts = [
        t.grid.where("latitude < 9").select(*key, "temperature_min"),
        t.grid.where("latitude > 4").select(*key, "temperature_max"),
        t.grid.where("longitude > 10").select(*key, "precipitation_monthly"),
    ]
    return rounded(grids.merge_variables(parts), *VALUES)


_INSIDE = "latitude between lat_min and lat_max and longitude between lon_min and lon_max"


@query(
    "j2_zone_join",
    with_views("grid", "zones")
    + f"select zone, time, latitude, longitude, {sql_r6('precipitation_monthly')} from grid join zones on {_INSIDE}",
)
def j2(t: Tables) -> DataFrame:
    grid = t.grid.select("time", "latitude", "longitude", "precipitation_monthly")
    return rounded(grids.zone_join(grid, t.zones), "precipitation_monthly").select(
        "zone", "time", "latitude", "longitude", "precipitation_monthly"
    )


@query(
    "a4_zonal_means",
    with_views("grid", "zones")
    + f"select zone, time, {', '.join(f'{sql_round(f'avg({v})')} as {v}' for v in VALUES)} from grid join zones on {_INSIDE} group by 1, 2",
)
def a4(t: Tables) -> DataFrame:
    return rounded(grids.zonal_means(t.grid.select("time", "latitude", "longitude", *VALUES), t.zones), *VALUES)


@query(
    "j3_point_timeseries",
    with_views(
        "grid", "pts",
        lats="""select point_id, arg_min(c, (abs(c-latitude), -c)) as lat from pts, (select distinct latitude as c from grid) as x group by point_id""",
        lons="""select point_id, arg_min(c, (abs(c-longitude), -c)) as lon from pts, (select distinct longitude as c from grid) as x group by point_id""",
    )
    + f"""select point_id, time, latitude, longitude, {sql_r6(*VALUES)} from grid join
      (select lats.point_id, lat, lon from lats join lons on lats.point_id=lons.point_id) as p on latitude=lat and longitude=lon""",
)
def j3(t: Tables) -> DataFrame:
    grid = t.grid.select("time", "latitude", "longitude", *VALUES)
    return rounded(grids.point_timeseries(grid, t.pts), *VALUES).select("point_id", "time", "latitude", "longitude", *VALUES)


@query(
    "j4_crop_group_lookup",
    with_views("obs", "crops")
    + f"""select {ROW_SQL}, name as crop_name, crops.crop_group from (select {ROW_SQL},
      case when part_id%7=0 then 'teff' else crop_name end as name from obs) as o left join crops on crops.crop_name=name""",
)
def j4(t: Tables) -> DataFrame:
    named = t.obs.selectExpr(*ROW, "case when part_id%7=0 then 'teff' else crop_name end as crop_name")
    return with_crop_group(named)


def _zone_mean_sql(columns: str) -> str:
    mean = sql_round("avg(yield_kg_ha) over (partition by agroecological_zone)")
    return with_views("obs") + f"select {columns}, agroecological_zone, {mean} as zone_mean from obs"


@query("j5_group_statistic", _zone_mean_sql(ROW_SQL))
def j5(t: Tables) -> DataFrame:
    rows = t.obs.select(*ROW, "agroecological_zone", "yield_kg_ha")
    return rounded(with_group_stats(rows, "agroecological_zone", zone_mean=F.avg("yield_kg_ha")), "zone_mean").drop("yield_kg_ha")


@query(
    "w1_partition_mean",
    with_views("obs")
    + f"select {ROW_SQL}, crop_name, {sql_round('yield_kg_ha/greatest(avg(yield_kg_ha) over (partition by crop_name), 1)')} as gap from obs",
)
def w1(t: Tables) -> DataFrame:
    rows = t.obs.select(*ROW, "crop_name", "yield_kg_ha")
    attached = with_group_stats(rows, "crop_name", m=F.avg("yield_kg_ha"))
    return attached.select(*ROW, "crop_name", r6(F.col("yield_kg_ha") / F.greatest("m", F.lit(1.0)), "gap"))


def _profile_values() -> str:
    def text(v) -> str:
        return "null" if v is None else repr(v)

    rows = ", ".join(f"('{k}', {', '.join(text(x) for x in v)})" for k, v in CROP_PROFILE.items())
    return f"select * from (values {rows}) as v(crop, cycle_min, cycle_max, cycle_optimal, yield_min, yield_max, yield_average)"


@query(
    "j7_crop_profile",
    with_views("obs", profile=_profile_values())
    + f"""select {ROW_SQL}, name as crop_name, cycle_min, cycle_max, cycle_optimal, cast(yield_min as double) as yield_min,
      cast(yield_max as double) as yield_max, cast(yield_average as double) as yield_average
      from (select {ROW_SQL}, case when part_id%7=0 then 'teff' else crop_name end as name from obs) as o left join profile on crop=name""",
)
def j7(t: Tables) -> DataFrame:
    named = t.obs.selectExpr(*ROW, "case when part_id%7=0 then 'teff' else crop_name end as crop_name")
    return with_crop_profile(named)


@query(
    "j7_crop_varieties",
    with_views("obs", listed="select distinct crop_name, concat(crop_name, '_', cast(part_id%3 as varchar)) as variety from obs where crop_name<>'rice'")
    + f"select {ROW_SQL}, obs.crop_name, variety from obs join listed on listed.crop_name=obs.crop_name",
)
def j7_varieties(t: Tables) -> DataFrame:
    named = t.obs.selectExpr("crop_name", "concat(crop_name, '_', cast(part_id%3 as string)) as variety").where("crop_name<>'rice'")
    listed = named.groupBy("crop_name").agg(F.collect_set("variety").alias("varieties"))
    return crop_varieties(t.obs.select(*ROW, "crop_name"), listed).select(*ROW, "crop_name", "variety")


# --- sequences ---------------------------------------------------------------------------
WEATHER = ["precipitation_daily", "temperature_mean", "relative_humidity"]
_STEPS = "select *, row_number() over (partition by station_id order by observation_date) as i from daily"


@query(
    "j8_weather_sequences",
    with_views(
        "daily", steps=_STEPS,
        lens="select station_id, count(*) as n from steps group by 1",
    )
    + f"""select lens.station_id, s_nationkey, cast(n as int) as length, cast(k as int) as step, {', '.join(
        f'{sql_round(f"coalesce({w}, 0)")} as {w}' for w in WEATHER)}, {sql_round('target')} as target
      from lens join (select unnest(generate_series(1, (select max(n) from lens))) as k) as ks on true
      left join steps on steps.station_id=lens.station_id and i=k
      join supplier on s_suppkey=lens.station_id
      join (select station_id, avg(yield_kg_ha) as target from obs group by 1) as y on y.station_id=lens.station_id""",
)
def j8(t: Tables) -> DataFrame:
    sequences = weather_sequences(t.daily, "station_id", "observation_date", WEATHER)
    static = t.read("supplier").select(F.col("s_suppkey").alias("station_id"), "s_nationkey")
    targets = t.obs.groupBy("station_id").agg(F.avg("yield_kg_ha").alias("target"))
    samples = sequence_samples(static, sequences, targets, "station_id")
    steps = samples.select("station_id", "s_nationkey", "length", "target", F.posexplode("sequence").alias("step", "v"))
    return steps.select(
        "station_id", "s_nationkey", "length", (F.col("step") + 1).alias("step"),
        *[r6(F.col("v")[i], w) for i, w in enumerate(WEATHER)], r6("target"),
    )


@query(
    "a21_masked_mean",
    with_views("daily", steps=_STEPS)
    + f"""select station_id, cast(count(*) as int) as length, {', '.join(
        f'{sql_round(f"sum(coalesce({w}, 0))/greatest(count(*), 1)")} as mean_{w}' for w in WEATHER)} from steps group by 1""",
)
def a21(t: Tables) -> DataFrame:
    sequences = weather_sequences(t.daily, "station_id", "observation_date", WEATHER)
    pooled = sequences.select("station_id", "length", *masked_mean("sequence", "length", WEATHER))
    return rounded(pooled, *[f"mean_{w}" for w in WEATHER])
