"""Projections, filters, casts and cleaning."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.catalog.registry import ROW, query, r6, rounded, sql_r6, sql_round
from harrow.functions.constants import CLIMATE_BOUNDS, MONTHLY_GRID_VARIABLES, SURVEY_BOUNDS
from harrow.functions.geo import check_coordinates
from harrow.operators import cleaning as c
from harrow.sources.tables import Tables, with_views

ROW_SQL = ", ".join(ROW)
FIRST = ["observation_date", "part_id", "yield_kg_ha"]
FIRST_SQL = "row_number() over (partition by record_id order by observation_date, part_id, yield_kg_ha)"

_RAW = {name: 100 + 37 * i for i, (name, _, _) in enumerate(MONTHLY_GRID_VARIABLES)}


@query(
    "p1_scale_factors",
    "select l_orderkey, l_linenumber, "
    + ", ".join(
        f"{sql_round(f'cast((l_partkey*{_RAW[s]}+l_orderkey)%1000 as double)*{f}e0')} as {n}"
        for s, n, f in MONTHLY_GRID_VARIABLES
    )
    + " from lineitem",
)
def p1(t: Tables) -> DataFrame:
    raw = t.read("lineitem").selectExpr(
        "l_orderkey", "l_linenumber",
        *[f"cast((l_partkey*{k}+l_orderkey)%1000 as double) as `{s}`" for s, k in _RAW.items()],
    )
    return rounded(c.apply_scale_factors(raw), *[n for _, n, _ in MONTHLY_GRID_VARIABLES])


_PRECIP = "case when l_partkey%13=0 then -9999e0 when l_partkey%7=0 then -5e0 else l_quantity end"


@query(
    "p2_clean_rain",
    f"""select l_orderkey, l_linenumber, case when precip<>-9999e0 then greatest(precip, 0e0) end as precipitation_daily
    from (select l_orderkey, l_linenumber, {_PRECIP} as precip from lineitem) as t""",
)
def p2(t: Tables) -> DataFrame:
    return c.clean_rain(t.read("lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_PRECIP} as precip"))


@query(
    "p3_inside_box",
    with_views("obs")
    + f"""select * from (select {ROW_SQL}, latitude-1e0 as latitude, longitude+1e0 as longitude from obs) as t
    where latitude between {1.6 - 0.1!r}e0 and {13.1 + 0.1!r}e0 and longitude between {8.3 - 0.1!r}e0 and {16.2 + 0.1!r}e0""",
)
def p3(t: Tables) -> DataFrame:
    return c.inside_box(t.obs.selectExpr(*ROW, "latitude-1e0 as latitude", "longitude+1e0 as longitude"))


@query(
    "p4_inside_period",
    """select l_orderkey, l_linenumber, cast(l_shipdate as date) as ship_day, l_quantity from lineitem
    where l_shipdate >= date '1994-01-01' and l_shipdate < date '1995-07-01'""",
)
def p4(t: Tables) -> DataFrame:
    df = c.inside_period(t.read("lineitem"), date(1994, 1, 1), date(1995, 6, 30), "l_shipdate")
    return df.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ship_day"), "l_quantity")


@query(
    "p5_pick_variables",
    with_views("grid") + f"select time, latitude, longitude, {sql_r6('precipitation_monthly')} from grid",
)
def p5(t: Tables) -> DataFrame:
    return rounded(t.grid.select("time", "latitude", "longitude", "precipitation_monthly"), "precipitation_monthly")


@query(
    "p6_normalise_coordinates",
    with_views("obs") + "select observation_date as time, latitude, longitude, temperature_mean from obs",
)
def p6(t: Tables) -> DataFrame:
    grid = t.obs.selectExpr("observation_date as day", "latitude as lat", "longitude as lon", "temperature_mean")
    return c.normalise_coordinates(grid)


_SPARSE = """observation_date as time, station_id,
  case when station_id%5=0 or record_id%3=0 then null else temperature_mean end as temperature_mean,
  case when station_id%5=0 then null else precipitation_daily end as precipitation_daily"""


@query(
    "p7_drop_all_missing",
    with_views("obs")
    + f"select * from (select {_SPARSE} from obs) as t where temperature_mean is not null or precipitation_daily is not null",
)
def p7(t: Tables) -> DataFrame:
    sparse = t.spark.sql(f"select {_SPARSE} from {{obs}}", obs=t.obs)
    return c.drop_all_missing(sparse, ("time", "station_id"))


def _clip_sql(column: str, low: float, high: float) -> str:
    return f"case when {column} is not null then greatest({float(low)!r}e0, least({float(high)!r}e0, {column})) end as {column}"


@query(
    "p8_clamp_survey",
    with_views("obs") + f"select {ROW_SQL}, " + ", ".join(_clip_sql(k, *v) for k, v in SURVEY_BOUNDS.items()) + " from obs",
)
def p8(t: Tables) -> DataFrame:
    return c.clamp_survey(t.obs.select(*ROW, *SURVEY_BOUNDS))


_CLIMATE = {
    "temperature_min": "temperature_min-20", "temperature_max": "temperature_max+20",
    "relative_humidity": "relative_humidity+30", "solar_radiation": "solar_radiation+20",
    "precipitation_daily": "precipitation_daily*4-10", "soil_moisture": "organic_carbon*200",
    "wind_speed": "clay_percentage/2e0", "crop_water_stress": "harvest_index*2",
}


@query(
    "p9_clamp_climate",
    with_views("obs")
    + f"select {ROW_SQL}, " + ", ".join(_clip_sql(k, *CLIMATE_BOUNDS[k]) for k in _CLIMATE)
    + f" from (select {ROW_SQL}, " + ", ".join(f"{e} as {k}" for k, e in _CLIMATE.items()) + " from obs) as t",
)
def p9(t: Tables) -> DataFrame:
    return c.clamp_climate(t.obs.selectExpr(*ROW, *[f"{e} as {k}" for k, e in _CLIMATE.items()]))


@query(
    "p10_check_coordinates",
    with_views("obs")
    + f"""select {ROW_SQL}, message='' as is_valid, message from (
      select {ROW_SQL}, case when latitude not between 1.6e0 and 13.1e0 then 'Latitude ' || cast(latitude as varchar) || ' is outside Cameroon bounds'
        when longitude not between 8.3e0 and 16.2e0 then 'Longitude ' || cast(longitude as varchar) || ' is outside Cameroon bounds' else '' end as message
      from (select {ROW_SQL}, latitude-1.5e0 as latitude, longitude+2e0 as longitude from obs) as moved) as t""",
)
def p10(t: Tables) -> DataFrame:
    moved = t.obs.selectExpr(*ROW, "latitude-1.5e0 as latitude", "longitude+2e0 as longitude")
    judged = moved.select(*ROW, check_coordinates("latitude", "longitude").alias("check"))
    return judged.select(*ROW, "check.is_valid", "check.message")


_P11 = ("organic_carbon", "yield_kg_ha", "biomass_kg_ha", "agroecological_zone")


@query(
    "p11_clean_survey",
    with_views(
        "obs",
        firsts=f"select * from (select *, {FIRST_SQL} as place from obs) as t where place=1",
        kept="""select * from firsts where latitude>=1.6e0 and latitude<=13.1e0 and longitude>=8.3e0 and longitude<=16.2e0
          and yield_kg_ha<=biomass_kg_ha and temperature_max>temperature_min""",
        med="select quantile_cont(organic_carbon, 0.5) as m from kept",
    )
    + f"""select {ROW_SQL}, {sql_round('latitude', 6)} as latitude, {sql_round('longitude', 6)} as longitude,
      {sql_round('temperature_min', 1)} as temperature_min, {sql_round('temperature_max', 1)} as temperature_max,
      {sql_round('temperature_mean', 1)} as temperature_mean, {sql_round('coalesce(organic_carbon, m)')} as organic_carbon,
      yield_kg_ha, biomass_kg_ha, agroecological_zone from kept, med""",
)
def p11(t: Tables) -> DataFrame:
    clean = c.clean_survey(t.obs, FIRST)
    return rounded(
        clean.select(*ROW, "latitude", "longitude", "temperature_min", "temperature_max", "temperature_mean", *_P11),
        "organic_carbon",
    )


@query(
    "p12_narrow_floats",
    with_views("obs") + f"select {ROW_SQL}, " + ", ".join(
        f"cast(cast({k} as real) as double) as {k}" for k in ("latitude", "total_nitrogen", "yield_kg_ha")) + " from obs",
)
def p12(t: Tables) -> DataFrame:
    names = ("latitude", "total_nitrogen", "yield_kg_ha")
    narrow = c.narrow_floats(t.obs.select(*ROW, *names))
    return narrow.select(*ROW, *[F.col(n).cast("double").alias(n) for n in names])


@query("p13_booleans_to_int", with_views("obs") + f"select {ROW_SQL}, cast(irrigation_applied as int) as irrigation_applied from obs")
def p13(t: Tables) -> DataFrame:
    return c.booleans_to_int(t.obs.select(*ROW, "irrigation_applied"))


_P14 = ("latitude", "longitude", "elevation", "temperature_mean", "precipitation_daily", "ph_water",
        "fertilizer_nitrogen", "irrigation_applied")


@query(
    "p14_model_columns",
    with_views("obs") + f"select record_id, part_id, {', '.join(_P14)}, yield_kg_ha/1000e0 as yield_tha from obs",
)
def p14(t: Tables) -> DataFrame:
    table = t.obs.select(
        *ROW, *_P14, "agroecological_zone", "crop_name", "yield_kg_ha", "harvest_index", "biomass_kg_ha", "data_source",
        (F.col("yield_kg_ha") / 1000).alias("yield_tha"), F.lit(1.0).alias("nue"), F.lit(1.0).alias("wue"),
        F.lit(1.0).alias("yield_gap_ratio"),
    )
    return c.model_columns(table)[0]


@query(
    "p16_conform",
    with_views("obs")
    + """select record_id, observation_date, cast(null as double) as field_area, latitude, longitude, crop_name,
    cast(null as varchar) as variety_name, cast(null as varchar) as growth_stage, yield_kg_ha from obs""",
)
def p16(t: Tables) -> DataFrame:
    schema = T.StructType().add("record_id", "long").add("observation_date", "date").add("field_area", "double")
    schema = schema.add("latitude", "double").add("longitude", "double").add("crop_name", "string")
    schema = schema.add("variety_name", "string").add("growth_stage", "string").add("yield_kg_ha", "double")
    return c.conform(t.obs, schema)


# --- the three table types ---------------------------------------------------------------
_AS_CROPS = """record_id as field_id, part_id, observation_date as planting_date, yield_kg_ha,
  yield_kg_ha/1000e0 as yield_tha, biomass_kg_ha/1000e0 as biomass_tha, (station_id%20)/10e0 as area_hectares, harvest_index,
  latitude, longitude, organic_carbon"""


def _place_sql(keys: str, order: str) -> str:
    return f"row_number() over (partition by {keys} order by {order})"


@query(
    "p17_clean_crops",
    with_views(
        "obs",
        raw=f"select {_AS_CROPS}, observation_date + cast(part_id%120 as int) as harvest_date from obs",
        firsts=f"select * from (select *, {_place_sql('field_id', 'planting_date, part_id, yield_kg_ha')} as place from raw) as t where place=1",
        kept="""select * from firsts where harvest_date>planting_date and yield_tha<=biomass_tha and area_hectares>0
          and harvest_index between 0.1e0 and 0.8e0 and yield_tha between 0.1e0 and 50e0
          and latitude between 1.6e0 and 13.1e0 and longitude between 8.3e0 and 16.2e0""",
        med="select quantile_cont(organic_carbon, 0.5) as m from kept",
    )
    + f"""select field_id, part_id, planting_date, harvest_date, {sql_round('yield_tha', 2)} as yield_tha, {sql_round('biomass_tha', 2)} as biomass_tha,
      {sql_round('area_hectares', 1)} as area_hectares, {sql_round('harvest_index', 1)} as harvest_index, {sql_round('latitude', 6)} as latitude,
      {sql_round('longitude', 6)} as longitude, {sql_round('coalesce(organic_carbon, m)', 1)} as organic_carbon from kept, med""",
)
def p17_crops(t: Tables) -> DataFrame:
    raw = t.obs.selectExpr(
        *_AS_CROPS.replace("\n", " ").split(", "), "date_add(observation_date, cast(part_id%120 as int)) as harvest_date"
    )
    return c.clean_table(raw, "crops", ["planting_date", "part_id", "yield_kg_ha"]).drop("yield_kg_ha")


_AS_WEATHER = ("station_id", "observation_date as date", "record_id", "part_id", "temperature_min", "temperature_max",
               "relative_humidity", "precipitation_daily", "solar_radiation", "latitude", "longitude", "organic_carbon")


@query(
    "p17_clean_weather",
    with_views(
        "obs",
        raw=f"select {', '.join(_AS_WEATHER)} from obs",
        firsts=f"select * from (select *, {_place_sql('station_id, date', 'record_id, part_id, precipitation_daily')} as place from raw) as t where place=1",
        kept="""select * from firsts where temperature_max>temperature_min and relative_humidity between 0 and 100
          and precipitation_daily>=0 and solar_radiation>=0 and latitude between 1.6e0 and 13.1e0 and longitude between 8.3e0 and 16.2e0""",
        med="select quantile_cont(organic_carbon, 0.5) as m from kept",
    )
    + f"""select station_id, date, record_id, part_id, {sql_round('temperature_min', 2)} as temperature_min, {sql_round('temperature_max', 2)} as temperature_max,
      {sql_round('relative_humidity', 1)} as relative_humidity, {sql_round('precipitation_daily', 1)} as precipitation_daily,
      {sql_round('solar_radiation', 1)} as solar_radiation, {sql_round('latitude', 6)} as latitude, {sql_round('longitude', 6)} as longitude,
      {sql_round('coalesce(organic_carbon, m)', 1)} as organic_carbon from kept, med""",
)
def p17_weather(t: Tables) -> DataFrame:
    return c.clean_table(t.obs.selectExpr(*_AS_WEATHER), "weather", ["record_id", "part_id", "precipitation_daily"])


_AS_SOIL = ("record_id as sample_id", "part_id", "observation_date", "sand_percentage", "clay_percentage",
            "100e0-sand_percentage-clay_percentage+(part_id%5) as silt_percentage", "ph_water", "organic_carbon",
            "case when part_id%19=0 then null else total_nitrogen end as total_nitrogen", "latitude", "longitude")


@query(
    "p17_clean_soil",
    with_views(
        "obs",
        raw=f"select {', '.join(_AS_SOIL)} from obs",
        firsts=f"select * from (select *, {_place_sql('sample_id', 'observation_date, part_id')} as place from raw) as t where place=1",
        kept="""select * from firsts where abs(sand_percentage+silt_percentage+clay_percentage-100)<2 and ph_water between 3.5e0 and 9.5e0
          and organic_carbon>=0.1e0 and latitude between 1.6e0 and 13.1e0 and longitude between 8.3e0 and 16.2e0""",
        med="select quantile_cont(total_nitrogen, 0.5) as m from kept",
    )
    + f"""select sample_id, part_id, observation_date, {', '.join(f'{sql_round(k, 1)} as {k}' for k in ('sand_percentage', 'silt_percentage', 'clay_percentage', 'ph_water', 'organic_carbon'))},
      {sql_round('coalesce(total_nitrogen, m)', 1)} as total_nitrogen, {sql_round('latitude', 6)} as latitude, {sql_round('longitude', 6)} as longitude from kept, med""",
)
def p17_soil(t: Tables) -> DataFrame:
    return c.clean_table(t.obs.selectExpr(*_AS_SOIL), "soil", ["observation_date", "part_id"])


_FIXED_TMAX = "case when temperature_max<=temperature_min then temperature_min+5 else temperature_max end"


@query(
    "p18_repair_consistency",
    with_views("obs")
    + f"""select {ROW_SQL}, {_FIXED_TMAX} as temperature_max, {sql_round(f'(temperature_min+{_FIXED_TMAX})/2', 1)} as temperature_mean,
      case when yield_kg_ha>biomass_kg_ha then round_even(yield_kg_ha/harvest_index, 0) else biomass_kg_ha end as biomass_kg_ha,
      case when sand_percentage+clay_percentage>100 then greatest(0e0, least(100e0, 100-clay_percentage-10)) else sand_percentage end as sand_percentage
      from obs""",
)
def p18(t: Tables) -> DataFrame:
    return c.repair_consistency(t.obs).select(
        *ROW, "temperature_max", "temperature_mean", "biomass_kg_ha", "sand_percentage"
    )


@query("p19_drop_present", with_views("obs") + "select part_id, observation_date, crop_name, yield_kg_ha from obs")
def p19(t: Tables) -> DataFrame:
    return c.drop_present(t.obs.select("record_id", "location_id", "part_id", "observation_date", "crop_name", "yield_kg_ha"))


_FIRST_ROWS = with_views("obs") + f"""select record_id, part_id, observation_date, yield_kg_ha, crop_name from
    (select *, {FIRST_SQL} as place from obs) as t where place=1"""


def _first_rows(t: Tables) -> DataFrame:
    return c.first_per_key(t.obs, "record_id", FIRST).select("record_id", "part_id", "observation_date", "yield_kg_ha", "crop_name")


query("u3_first_per_key", _FIRST_ROWS)(_first_rows)


@query(
    "w3_first_row_number",
    with_views("obs") + """select station_id, observation_date, record_id, part_id from
    (select *, row_number() over (partition by station_id, observation_date order by record_id, part_id) as place from obs) as t where place=1""",
)
def w3(t: Tables) -> DataFrame:
    return c.first_per_key(t.obs, ["station_id", "observation_date"], ["record_id", "part_id"]).select(
        "station_id", "observation_date", "record_id", "part_id"
    )
