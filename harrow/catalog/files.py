"""Sources and sinks: every query writes to the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.catalog.registry import ROW, query, r6, rounded, sql_r6, sql_round
from harrow.operators.cleaning import rename_canonical
from harrow.operators.grids import concat_parts
from harrow.plans.climate import export_climate, rain_table
from harrow.runtime import scratch_path
from harrow.sources import files
from harrow.sources.tables import Tables, with_views

ROW_SQL = ", ".join(ROW)


@query(
    "s1_feature_csv",
    with_views("obs")
    + f"""select {ROW_SQL}, data_source, agroecological_zone, season, crop_name, crop_group, {sql_r6("yield_kg_ha", "biomass_kg_ha", "harvest_index")},
    {sql_round("yield_kg_ha/1000e0")} as nue, {sql_round("yield_kg_ha/2000e0")} as wue, {sql_round("yield_kg_ha/3000e0")} as yield_gap_ratio from obs""",
)
def s1(t: Tables) -> DataFrame:
    shares = {"nue": 1000.0, "wue": 2000.0, "yield_gap_ratio": 3000.0}
    rows = t.obs.select(
        *ROW, "data_source", "agroecological_zone", "season", "crop_name", "crop_group", "yield_kg_ha", "biomass_kg_ha", "harvest_index",
        *[(F.col("yield_kg_ha") / n).alias(c) for c, n in shares.items()],
    )
    path = files.write_delimited(rows, scratch_path(t.spark, "features") + ".csv", compression="gzip")
    return rounded(files.load_feature_csv(t.spark, path, rows.schema), "yield_kg_ha", "biomass_kg_ha", "harvest_index", *shares)


@query(
    "s2_read_by_suffix",
    "select l_orderkey, l_linenumber, l_quantity, l_discount, cast(l_shipdate as date) as l_shipdate from lineitem",
)
def s2(t: Tables) -> DataFrame:
    df = files.load_dataset(t.spark, f"{t.folder}/lineitem.parquet")
    return df.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.to_date("l_shipdate").alias("l_shipdate"))


@query(
    "s3_csv_to_parquet",
    with_views("obs")
    + f"""select {ROW_SQL}, crop_name, irrigation_applied,
    cast(cast(latitude as real) as double) as latitude, cast(cast(organic_carbon as real) as double) as organic_carbon,
    cast(cast(yield_kg_ha as real) as double) as yield_kg_ha from obs""",
)
def s3(t: Tables) -> DataFrame:
    columns = [*ROW, "crop_name", "irrigation_applied", "latitude", "organic_carbon", "yield_kg_ha"]
    source, target = scratch_path(t.spark, "survey") + ".csv", scratch_path(t.spark, "survey") + ".parquet"
    rows = t.obs.select(*columns)
    rows.write.option("header", True).csv(source)
    files.csv_to_parquet(t.spark, source, target, "zstd", rows.schema)
    df = t.spark.read.parquet(target)
    return df.select(*columns[:5], *[F.col(c).cast("double").alias(c) for c in columns[5:]])


@query("s4_save_parquet", with_views("obs") + f"select {ROW_SQL}, agroecological_zone, yield_kg_ha from obs")
def s4(t: Tables) -> DataFrame:
    path = files.save_parquet(t.obs.select(*ROW, "agroecological_zone", "yield_kg_ha"), scratch_path(t.spark, "obs"))
    return t.spark.read.parquet(path)


@query(
    "s5_delimited_round_trip",
    with_views("obs")
    + """select cast(record_id as varchar) as record_id, cast(part_id as varchar) as part_id,
    cast(observation_date as varchar) as observation_date, crop_name, season from obs""",
)
def s5(t: Tables) -> DataFrame:
    columns = [*ROW, "crop_name", "season"]
    path = files.write_delimited(t.obs, scratch_path(t.spark, "delimited"), columns, ";", compression="gzip")
    return files.read_delimited(t.spark, path, columns, ";")


@query(
    "s6_json_round_trip",
    with_views("obs") + f"select {ROW_SQL}, latitude as lat, longitude as lon, crop_name as crop from obs",
)
def s6(t: Tables) -> DataFrame:
    place = F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    docs = t.obs.select(*ROW, place.alias("place"), F.col("crop_name").alias("crop"))
    path = files.write_json(docs, scratch_path(t.spark, "json"))
    back = files.read_json(t.spark, path, docs.schema, multi_line=False)
    return back.select(*ROW, "place.lat", "place.lon", "crop")


GRID_VALUES = ("temperature_min", "temperature_max", "precipitation_monthly", "vapor_pressure", "solar_radiation_raw")


def _yearly_parts(df: DataFrame) -> list[DataFrame]:
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "years")
    files.write_by_year(df, path)
    return [spark.read.schema(df.schema).parquet(f"{path}/year={y}") for y in sorted(files.years_present(spark, path))]


@query(
    "s7_concat_years",
    with_views("grid") + f"select time, latitude, longitude, {sql_r6(*GRID_VALUES)} from grid",
)
def s7(t: Tables) -> DataFrame:
    return rounded(concat_parts(_yearly_parts(t.grid)), *GRID_VALUES).select("time", "latitude", "longitude", *GRID_VALUES)


@query("u1_union_of_years", with_views("grid") + "select cast(year(time) as int) as year, count(*) as n from grid group by 1")
def u1(t: Tables) -> DataFrame:
    return concat_parts(_yearly_parts(t.grid)).groupBy(F.year("time").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "s8_partition_by_year",
    with_views("grid") + "select cast(year(time) as int) as year, count(*) as n, count(distinct latitude) as n_lat from grid group by 1",
)
def s8(t: Tables) -> DataFrame:
    path = files.write_by_year(t.grid, scratch_path(t.spark, "by-year"))
    return t.spark.read.parquet(path).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("latitude").alias("n_lat")
    )


@query(
    "s9_append_new_years",
    with_views("grid") + f"select cast(year(time) as int) as year, count(*) as n, {sql_round('sum(precipitation_monthly)')} as rain from grid group by 1",
)
def s9(t: Tables) -> DataFrame:
    path = files.write_by_year(t.grid.where(F.year("time") <= 1994), scratch_path(t.spark, "incremental"))
    files.append_new_years(t.grid, path)
    return t.spark.read.parquet(path).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("precipitation_monthly"), "rain")
    )


@query(
    "s10_typed_csv",
    with_views("obs")
    + """select record_id, observation_date, data_source, agroecological_zone, season, crop_name, crop_group,
    irrigation_applied, cast(data_quality_flag as tinyint) as data_quality_flag from obs""",
)
def s10(t: Tables) -> DataFrame:
    columns = ["record_id", "observation_date", "data_source", "agroecological_zone", "season", "crop_name",
               "crop_group", "irrigation_applied", "data_quality_flag"]
    path = files.write_delimited(t.obs, scratch_path(t.spark, "typed"), columns, compression="gzip")
    text = files.read_delimited(t.spark, path, columns)
    return files.typed_survey(text).withColumn("record_id", F.col("record_id").cast(T.LongType()))


@query(
    "s11_rename_canonical",
    with_views("obs") + f"select {ROW_SQL}, yield_kg_ha, biomass_kg_ha, season from obs",
)
def s11(t: Tables) -> DataFrame:
    raw = t.obs.selectExpr(*ROW, "yield_kg_ha as yield_grain", "biomass_kg_ha as biomass_total", "season as season_type")
    return rename_canonical(raw)


# --- exports --------------------------------------------------------------------------
RAIN_GRID = """select observation_date as time, cast(floor(latitude) as double) as latitude,
  cast(floor(longitude) as double) as longitude, sum(precipitation_daily) as precipitation_daily
from obs group by 1, 2, 3"""
ZONE_SQL = """case when latitude>10 then 'sahel_savanna' when latitude>8 then 'sudan_savanna' when latitude>6 then 'guinea_savanna'
  when latitude>5 then 'forest_savanna_transition' when longitude<10 then 'humid_forest_coast' else 'humid_forest_inland' end"""


def season_sql(date: str, latitude: str) -> str:
    return f"""case when {latitude}>=6 then case when month({date}) in (11,12,1,2,3) then 'dry_season' when month({date})=4 then 'early_rainy'
    when month({date}) in (5,6,7,8,9) then 'rainy_season' else 'late_rainy' end
  else case when month({date}) in (12,1,2) then 'grand_dry_season' when month({date}) in (3,4,5) then 'first_rainy_season'
    when month({date}) in (6,7) then 'petit_dry_season' when month({date}) in (8,9,10) then 'second_rainy_season' else 'transition_to_dry' end end"""


def _rain_grid(t: Tables) -> DataFrame:
    return t.obs.groupBy(
        F.col("observation_date").alias("time"),
        F.floor("latitude").cast("double").alias("latitude"),
        F.floor("longitude").cast("double").alias("longitude"),
    ).agg(F.sum("precipitation_daily").alias("precipitation_daily"))


def _exported(t: Tables, name: str, **choice) -> DataFrame:
    table = rain_table(_yearly_parts(_rain_grid(t)), **choice)
    return t.spark.read.parquet(export_climate(table, scratch_path(t.spark, "export"), name))


TAGS = f"{ZONE_SQL} as agroecological_zone, {season_sql('time', 'latitude')} as season"


@query(
    "s12_export_daily",
    with_views("obs", rain=RAIN_GRID) + f"select time, latitude, longitude, {sql_r6('precipitation_daily')}, {TAGS} from rain",
)
def s12_daily(t: Tables) -> DataFrame:
    return rounded(_exported(t, "rain_daily", daily_stats=False), "precipitation_daily")


MONTHLY_RAIN = """select cast(date_trunc('month', time) as date) as time, latitude, longitude,
  sum(precipitation_daily) as precipitation_daily from rain group by 1, 2, 3"""


@query(
    "s12_export_monthly",
    with_views("obs", rain=RAIN_GRID, monthly=MONTHLY_RAIN)
    + f"select time, latitude, longitude, {sql_r6('precipitation_daily')}, {TAGS} from monthly",
)
def s12_monthly(t: Tables) -> DataFrame:
    return rounded(_exported(t, "rain_monthly", daily_stats=False, aggregate_monthly=True), "precipitation_daily")


def dry_spell_sql(source: str, cell: str, time: str, rain: str = "precipitation_daily") -> str:
    """Gaps-and-islands form of the longest dry run per cell and month."""
    return f"""select {cell}, month, max(run) as max_dry_spell from (
    select {cell}, month, island, count(*) filter (where dry) as run from (
      select {cell}, cast(date_trunc('month', {time}) as date) as month, {rain}<1 as dry,
        sum(case when {rain}<1 then 0 else 1 end) over (partition by {cell}, date_trunc('month', {time}) order by {time}
          rows between unbounded preceding and current row) as island
      from {source} where {rain} is not null) as marked
    group by {cell}, month, island) as islands
  group by {cell}, month"""


def rain_stats_sql(source: str, cell: str, time: str, rain: str = "precipitation_daily") -> str:
    on = " and ".join(f"s.{c.strip()}=d.{c.strip()}" for c in cell.split(","))
    return f"""select {', '.join('s.' + c.strip() for c in cell.split(','))}, s.month, s.{rain}, s.heavy_rain_days, s.wet_days,
    s.rain_intensity_max, s.precipitation_std, cast(coalesce(d.max_dry_spell, 0) as int) as max_dry_spell
  from (select {cell}, cast(date_trunc('month', {time}) as date) as month, coalesce(sum({rain}), 0) as {rain},
      count(*) filter (where {rain}>20) as heavy_rain_days, count(*) filter (where {rain}>=1) as wet_days,
      max({rain}) as rain_intensity_max, stddev_pop({rain}) as precipitation_std
    from {source} group by {cell}, {len(cell.split(',')) + 1}) as s
  left join ({dry_spell_sql(source, cell, time, rain)}) as d on {on} and s.month=d.month"""


STATS = ("precipitation_daily", "rain_intensity_max", "precipitation_std")


@query(
    "s12_export_monthly_stats",
    with_views("obs", rain=RAIN_GRID, stats=rain_stats_sql("rain", "latitude, longitude", "time"))
    + f"""select month as time, latitude, longitude, heavy_rain_days, wet_days, max_dry_spell, {sql_r6(*STATS)},
    {ZONE_SQL} as agroecological_zone, {season_sql("month", "latitude")} as season from stats""",
)
def s12_stats(t: Tables) -> DataFrame:
    return rounded(_exported(t, "rain_monthly_stats"), *STATS)
