"""Scalar expressions: dates, geography, climate, engineered features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.catalog.aggregates import HAVERSINE_SQL
from harrow.catalog.files import season_sql
from harrow.catalog.registry import ROW, query, r6, rounded, sql_round
from harrow.functions import climate, dates, features, geo
from harrow.functions.constants import RAINY_SEASONS, SEASON_ORDINAL
from harrow.operators.profiling import column_ranges
from harrow.plans.survey import SCALED, encode, engineer, soil_and_inputs, with_efficiencies
from harrow.sources.tables import Tables, with_views

ROW_SQL = ", ".join(ROW)
OBS = with_views("obs")


def _rows(t: Tables, *extra: str) -> DataFrame:
    return t.obs.select(*ROW, *extra)


# --- dates -----------------------------------------------------------------------------
@query("d1_day_of_year", OBS + f"select {ROW_SQL}, cast(dayofyear(observation_date) as int) as doy from obs")
def d1(t: Tables) -> DataFrame:
    return _rows(t).withColumn("doy", dates.day_of_year("observation_date"))


@query(
    "d2_agricultural_season",
    OBS + f"""select {ROW_SQL}, {season_sql('observation_date', 'latitude')} as season,
      {season_sql('observation_date', 'lat_or_null')} as season_without_gaps
      from (select *, case when part_id%10=0 then null else latitude end as lat_or_null from obs) as t""",
)
def d2(t: Tables) -> DataFrame:
    gap = F.when(F.col("part_id") % 10 != 0, F.col("latitude"))
    return _rows(t, "latitude").select(
        *ROW, dates.agricultural_season("observation_date", "latitude").alias("season"),
        dates.agricultural_season("observation_date", gap).alias("season_without_gaps"),
    )


@query(
    "d3_growing_degree_days",
    OBS + f"select {ROW_SQL}, greatest(0e0, (temperature_min+temperature_max)/2e0-10) as gdd10, greatest(0e0, (temperature_min+temperature_max)/2e0-22.5e0) as gdd22 from obs",
)
def d3(t: Tables) -> DataFrame:
    ends = ("temperature_min", "temperature_max")
    return _rows(t, *ends).select(
        *ROW, dates.growing_degree_days(*ends).alias("gdd10"), dates.growing_degree_days(*ends, base=22.5).alias("gdd22")
    )


@query(
    "d4_date_range",
    """select l_orderkey, l_linenumber, l_partkey, cast(day as date) as day from (select l_orderkey, l_linenumber, l_partkey,
      unnest(generate_series(cast(l_shipdate as date), cast(l_shipdate as date)+l_linenumber-3, interval 1 day)) as day from lineitem) as t""",
)
def d4(t: Tables) -> DataFrame:
    start = F.to_date("l_shipdate")
    days = dates.date_range(start, F.date_add(start, F.col("l_linenumber") - 3))
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.explode(days).alias("day"))


@query(
    "d5_check_date_range",
    """select l_orderkey, l_linenumber, l_partkey, message='' as is_valid, message from (select l_orderkey, l_linenumber, l_partkey,
      case when a>b then 'Start date must be before end date' when b-a>3650 then 'Date range cannot exceed 10 years'
        when a>date '1997-06-01' then 'Start date cannot be in the future' when b>date '1997-06-01' then 'End date cannot be in the future' else '' end as message
      from (select *, case when l_partkey%9=0 then null else cast(l_shipdate as date) end as a,
        case when l_partkey%8=0 then null else cast(l_shipdate as date)+cast((l_partkey*31)%5000-200 as int) end as b from lineitem) as x) as t""",
)
def d5(t: Tables) -> DataFrame:
    ship = F.to_date("l_shipdate")
    start = F.when(F.col("l_partkey") % 9 != 0, ship)
    end = F.when(F.col("l_partkey") % 8 != 0, F.date_add(ship, ((F.col("l_partkey") * 31) % 5000 - 200).cast("int")))
    check = dates.check_date_range(start, end, F.lit("1997-06-01").cast("date"))
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", check.alias("check")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "check.is_valid", "check.message"
    )


_FORMATS = (("%Y-%m-%d", "yyyy-MM-dd"), ("%d/%m/%Y", "dd/MM/yyyy"), ("%m/%d/%Y", "MM/dd/yyyy"),
            ("%Y/%m/%d", "yyyy/MM/dd"), ("%d-%m-%Y", "dd-MM-yyyy"), ("%m-%d-%Y", "MM-dd-yyyy"))


@query(
    "d6_parse_date",
    "select l_orderkey, l_linenumber, l_partkey, text, cast(try_strptime(text, ["
    + ", ".join(f"'{a}'" for a, _ in _FORMATS)
    + "]) as date) as parsed from (select *, case l_partkey%8 "
    + " ".join(f"when {i} then strftime(l_shipdate, '{a}')" for i, (a, _) in enumerate(_FORMATS))
    + " when 6 then 'not-a-date' else '' end as text from lineitem) as t",
)
def d6(t: Tables) -> DataFrame:
    kind, text = F.col("l_partkey") % 8, F.when(F.col("l_partkey") % 8 == 6, "not-a-date")
    for i, (_, pattern) in enumerate(_FORMATS):
        text = text.when(kind == i, F.date_format("l_shipdate", pattern))
    lines = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.otherwise("").alias("text"))
    return lines.withColumn("parsed", dates.parse_date("text"))


@query(
    "d7_date_parts",
    OBS + f"select {ROW_SQL}, cast(month(observation_date) as int) as month, cast(dayofyear(observation_date) as int) as day_of_year, cast(year(observation_date) as int) as year from obs",
)
def d7(t: Tables) -> DataFrame:
    parts = features.calendar()
    return _rows(t).select(*ROW, *[parts[c].alias(c) for c in ("month", "day_of_year", "year")])


_TAU = repr(2 * math.pi) + "e0"
_CYCLIC = {
    "month_sin": f"sin({_TAU}*month(observation_date)/12e0)", "month_cos": f"cos({_TAU}*month(observation_date)/12e0)",
    "doy_sin": f"sin({_TAU}*dayofyear(observation_date)/365e0)", "doy_cos": f"cos({_TAU}*dayofyear(observation_date)/365e0)",
}


@query("d8_cyclic_encodings", OBS + f"select {ROW_SQL}, " + ", ".join(f"{sql_round(e, 4)} as {n}" for n, e in _CYCLIC.items()) + " from obs")
def d8(t: Tables) -> DataFrame:
    parts = features.calendar()
    return _rows(t).select(*ROW, *[parts[c].alias(c) for c in _CYCLIC])


_ORDINAL_SQL = "case season " + " ".join(f"when '{s}' then {n}" for s, n in SEASON_ORDINAL.items()) + " else 0 end"
_RAINY_SQL = f"coalesce(season in ({', '.join(repr(s) for s in RAINY_SEASONS)}), false)"


@query(
    "d9_season_encodings",
    OBS + f"""select {ROW_SQL}, season, cast({_ORDINAL_SQL} as tinyint) as season_ordinal, cast({_RAINY_SQL} as tinyint) as is_rainy_season
      from (select {ROW_SQL}, case when part_id%12=0 then 'main_season' when part_id%12=1 then null else season end as season from obs) as t""",
)
def d9(t: Tables) -> DataFrame:
    varied = t.obs.selectExpr(*ROW, "case when part_id%12=0 then 'main_season' when part_id%12=1 then null else season end as season")
    return varied.withColumn("season_ordinal", dates.season_ordinal("season")).withColumn("is_rainy_season", dates.is_rainy_season("season"))


@query(
    "d10_rainfall_regime",
    OBS + f"""select {ROW_SQL}, case when lat>=6 then 'monomodal' when lat is not null then 'bimodal' end as regime_name,
      cast(coalesce(lat>=6, false) as tinyint) as rainfall_regime from (select {ROW_SQL}, case when part_id%10=0 then null else latitude end as lat from obs) as t""",
)
def d10(t: Tables) -> DataFrame:
    rows = t.obs.selectExpr(*ROW, "case when part_id%10=0 then null else latitude end as lat")
    return rows.select(*ROW, dates.rainfall_regime_name("lat").alias("regime_name"), dates.rainfall_regime_flag("lat").alias("rainfall_regime"))


# --- geography ---------------------------------------------------------------------------
@query(
    "g1_haversine",
    OBS + f"select {ROW_SQL}, {sql_round(HAVERSINE_SQL.format(lat1='latitude', lon1='longitude', lat2='3.8667e0', lon2='11.5167e0'))} as km from obs",
)
def g1(t: Tables) -> DataFrame:
    km = geo.haversine_km("latitude", "longitude", F.lit(3.8667), F.lit(11.5167))
    return _rows(t, "latitude", "longitude").select(*ROW, r6(km, "km"))


@query(
    "g2_slope_degrees",
    OBS + f"select {ROW_SQL}, {sql_round('case when sand_percentage-20=0 then 0e0 else degrees(atan(elevation/(sand_percentage-20))) end')} as slope from obs",
)
def g2(t: Tables) -> DataFrame:
    return _rows(t, "elevation", "sand_percentage").select(
        *ROW, r6(geo.slope_degrees("elevation", F.col("sand_percentage") - 20), "slope")
    )


_BOX = {
    "north": "latitude+25e0*(1e0/111e0)", "south": "latitude-25e0*(1e0/111e0)",
    "east": "longitude+25e0*(1e0/(111e0*cos(radians(latitude))))", "west": "longitude-25e0*(1e0/(111e0*cos(radians(latitude))))",
}


@query("g3_bounding_box", OBS + f"select {ROW_SQL}, " + ", ".join(f"{sql_round(e)} as {n}" for n, e in _BOX.items()) + " from obs")
def g3(t: Tables) -> DataFrame:
    box = geo.bounding_box("latitude", "longitude", F.lit(25.0))
    return rounded(_rows(t, "latitude", "longitude").withColumn("b", box).select(*ROW, "b.*"), *_BOX)


@query("g4_agroecological_zone", OBS + f"select {ROW_SQL}, latitude, longitude, elevation, agroecological_zone as zone from obs")
def g4(t: Tables) -> DataFrame:
    return _rows(t, "latitude", "longitude", "elevation").withColumn(
        "zone", geo.agroecological_zone("latitude", "longitude", "elevation")
    )


@query("g5_geojson_point", OBS + f"select {ROW_SQL}, 'Point' as type, longitude as x, latitude as y from obs")
def g5(t: Tables) -> DataFrame:
    point = geo.geojson_point("longitude", "latitude")
    return _rows(t, "latitude", "longitude").withColumn("p", point).select(
        *ROW, "p.type", F.col("p.coordinates")[0].alias("x"), F.col("p.coordinates")[1].alias("y")
    )


@query(
    "g6_utm_simplified",
    OBS + f"""select {ROW_SQL}, case when longitude<12 then '32N' else '33N' end as zone,
      {sql_round('(longitude-case when longitude<12 then 9 else 15 end)*111320e0')} as easting, {sql_round('latitude*111320e0')} as northing, 'WGS84' as datum from obs""",
)
def g6(t: Tables) -> DataFrame:
    utm = _rows(t, "latitude", "longitude").withColumn("u", geo.utm_simplified("latitude", "longitude"))
    return rounded(utm.select(*ROW, "u.*"), "easting", "northing")


# --- climate derivations --------------------------------------------------------------------
KEY = ("time", "latitude", "longitude")
_T = "((temperature_min+temperature_max)/2e0)"
_SVP = f"(0.6108e0*exp(17.27e0*{_T}/({_T}+237.3e0)))"
CLIMATE_SQL = {
    "temperature_mean": _T,
    "diurnal_range": "temperature_max-temperature_min",
    "relative_humidity": f"greatest(0e0, least(100e0, 100e0*vapor_pressure/{_SVP}))",
    "solar_radiation": "solar_radiation_raw*0.0864e0",
    "aridity_index": "case when potential_evapotranspiration>0 then precipitation_monthly/potential_evapotranspiration end",
    "water_balance": "precipitation_monthly-actual_evapotranspiration",
    "crop_water_stress": "case when potential_evapotranspiration>0 then greatest(0e0, least(1e0, 1-actual_evapotranspiration/potential_evapotranspiration)) end",
    "gdd_base10": f"greatest({_T}-10, 0)",
    "gdd_base15": f"greatest({_T}-15, 0)",
}
_STEPS = {
    "c1_temperature_mean": (("temperature_mean",), (climate.temperature_mean,)),
    "c2_diurnal_range": (("diurnal_range",), (climate.diurnal_range,)),
    "c3_relative_humidity": (("relative_humidity",), (climate.temperature_mean, climate.relative_humidity)),
    "c4_solar_radiation": (("solar_radiation",), (climate.solar_radiation,)),
    "c5_aridity_index": (("aridity_index",), (climate.aridity_index,)),
    "c6_water_balance": (("water_balance",), (climate.water_balance,)),
    "c7_crop_water_stress": (("crop_water_stress",), (climate.crop_water_stress,)),
    "c8_growing_degrees": (("gdd_base10", "gdd_base15"), (climate.temperature_mean, climate.growing_degrees)),
    "c9_derive_all": (tuple(CLIMATE_SQL), (climate.derive_all,)),
}


def _register_climate(name: str, outputs: tuple[str, ...], steps: tuple) -> None:
    sql = ", ".join(f"{sql_round(CLIMATE_SQL[o])} as {o}" for o in outputs)

    @query(name, with_views("grid") + f"select {', '.join(KEY)}, {sql} from grid")
    def run(t: Tables) -> DataFrame:
        df = t.grid
        for step in steps:
            df = step(df)
        return rounded(df.select(*KEY, *outputs), *outputs)


for _name, (_outputs, _fns) in _STEPS.items():
    _register_climate(_name, _outputs, _fns)


# --- engineered features -------------------------------------------------------------------------
_SVP_OBS = "(0.6108e0*exp(17.27e0*temperature_mean/(temperature_mean+237.3e0)))"
_TMF = sql_round("fertilizer_nitrogen+fertilizer_phosphorus", 1)
_WSI = sql_round("precipitation_daily+cast(cast(irrigation_applied as int) as double)*30", 1)
_LIMITS = ", ".join(f"min({c}) as min_{c}, max({c}) as max_{c}" for c in SCALED)
FEATURE_VIEWS = with_views(
    "obs",
    lim=f"select {_LIMITS} from obs",
    zone_means="select agroecological_zone as z, avg(yield_kg_ha) as zone_mean from obs group by 1",
    o="select * from obs join lim on true join zone_means on z=agroecological_zone",
)


def _norm(c: str) -> str:
    return f"(({c}-min_{c})/(max_{c}-min_{c}))"


_PH = "(1-greatest(0e0, least(1e0, abs(ph_water-6.25e0)/3e0)))"
_SFI = sql_round(
    f"""({_PH}+coalesce({_norm('organic_carbon')}, 0)+{_norm('total_nitrogen')}+{_norm('available_phosphorus')})
    /(3+case when organic_carbon is null then 0 else 1 end)""", 3)
_INTENSITY = sql_round(
    """0.4e0*fertilizer_nitrogen/max_fertilizer_nitrogen+0.2e0*fertilizer_phosphorus/max_fertilizer_phosphorus
    +0.2e0*organic_fertilizer/max_organic_fertilizer+0.2e0*cast(cast(irrigation_applied as int) as double)""", 3)
_ALT = """case when elevation>0 and elevation<=200 then 'lowland' when elevation>200 and elevation<=800 then 'plateau'
  when elevation>800 and elevation<=1200 then 'mid_altitude' when elevation>1200 and elevation<=2500 then 'highland'
  when elevation>2500 and elevation<=5000 then 'mountain'"""
FEATURE_SQL = {
    "gdd_base10": sql_round("greatest(temperature_mean-10, 0)", 1),
    "gdd_base15": sql_round("greatest(temperature_mean-15, 0)", 1),
    "diurnal_range": sql_round("temperature_max-temperature_min", 1),
    "aridity_index": sql_round("precipitation_daily/greatest(temperature_mean+10, 1)", 3),
    "vpd_kpa": sql_round(f"{_SVP_OBS}*(1-relative_humidity/100)", 3),
    "temp_altitude_residual": sql_round("temperature_mean+6.5e0*elevation/1000", 1),
    "heavy_rain_day": "cast(precipitation_daily>20 as tinyint)",
    "soil_fertility_index": _SFI,
    "cn_ratio": sql_round("organic_carbon/greatest(total_nitrogen, 0.01e0)", 1),
    "cec_estimate": sql_round("clay_percentage*0.5e0+organic_carbon*2", 1),
    "input_intensity": _INTENSITY,
    "total_mineral_fert": _TMF,
    "organic_mineral_ratio": sql_round(f"organic_fertilizer/greatest({_TMF}, 1)", 3),
    "humidity_temp_interaction": sql_round("relative_humidity*temperature_mean/100", 2),
    "rain_oc_interaction": sql_round("precipitation_daily*organic_carbon", 2),
    "input_soil_interaction": sql_round(f"{_INTENSITY}*{_SFI}", 3),
    "water_supply_index": _WSI,
    "disease_risk_score": sql_round("relative_humidity*temperature_mean/(greatest(solar_radiation, 1)*100)", 3),
    "nue": sql_round("yield_kg_ha/greatest(fertilizer_nitrogen, 1)", 1),
    "wue": sql_round(f"yield_kg_ha/greatest({_WSI}, 1)", 1),
    "yield_gap_ratio": sql_round("yield_kg_ha/greatest(zone_mean, 1)", 3),
}


def _feature_sql(*names: str) -> str:
    return FEATURE_VIEWS + f"select {ROW_SQL}, " + ", ".join(f"{FEATURE_SQL[n]} as {n}" for n in names) + " from o"


def _register_feature(name: str, outputs: tuple[str, ...], make) -> None:
    @query(name, _feature_sql(*outputs))
    def run(t: Tables) -> DataFrame:
        return make(t.obs).select(*ROW, *outputs)


_register_feature("f1_thermal", ("gdd_base10", "gdd_base15", "diurnal_range"), lambda d: d.withColumns(features.thermal()))
_register_feature("f2_aridity_proxy", ("aridity_index",), lambda d: d.withColumn("aridity_index", features.aridity_proxy()))
_register_feature("f3_vapour_pressure_deficit", ("vpd_kpa",), lambda d: d.withColumn("vpd_kpa", features.vapour_pressure_deficit()))
_register_feature("f4_altitude_residual", ("temp_altitude_residual",), lambda d: d.withColumn("temp_altitude_residual", features.altitude_residual()))
_register_feature("f5_heavy_rain_day", ("heavy_rain_day",), lambda d: d.withColumn("heavy_rain_day", features.heavy_rain_day()))
_register_feature("f6_soil_fertility_index", ("soil_fertility_index",), soil_and_inputs)
_register_feature("f7_soil_ratios", ("cn_ratio", "cec_estimate"), lambda d: d.withColumns(features.soil_ratios()))
_register_feature("f8_input_intensity", ("input_intensity",), lambda d: d.withColumn("input_intensity", features.input_intensity(column_ranges(d, list(SCALED[3:])))))
_register_feature("f9_mineral_fertiliser", ("total_mineral_fert", "organic_mineral_ratio"), lambda d: d.withColumns(features.mineral_fertiliser()))
_register_feature(
    "f11_interactions", ("humidity_temp_interaction", "rain_oc_interaction", "input_soil_interaction"),
    lambda d: soil_and_inputs(d).withColumns(features.interactions()),
)
_register_feature("f12_water_and_disease", ("water_supply_index", "disease_risk_score"), lambda d: d.withColumns(features.water_and_disease()))
_register_feature(
    "f13_efficiencies", ("nue", "wue", "yield_gap_ratio"), lambda d: with_efficiencies(d.withColumns(features.water_and_disease())),
)


@query(
    "f10_altitude_class",
    OBS + f"select {ROW_SQL}, elevation, {_ALT} else 'nan' end as altitude_class, {_ALT} end as altitude_class_or_null from obs",
)
def f10(t: Tables) -> DataFrame:
    return _rows(t, "elevation").select(
        *ROW, "elevation", features.altitude_class("nan").alias("altitude_class"), features.altitude_class().alias("altitude_class_or_null")
    )


_ZONES = ("forest_savanna_transition", "guinea_savanna", "humid_forest_coast", "humid_forest_inland", "mont_cameroun_volcanic",
          "sahel_savanna", "sudan_savanna", "western_highlands")
_GROUPS = ("cereals", "legumes", "root_tubers", "tree_crops", "vegetables")
_CLASSES = ("highland", "lowland", "mid_altitude", "mountain", "nan", "plateau")
_HOT_SQL = ", ".join(
    [f"cast(agroecological_zone='{z}' as tinyint) as zone_{z}" for z in _ZONES]
    + [f"cast(coalesce(crop_group='{g}', false) as tinyint) as grp_{g}" for g in _GROUPS]
    + [f"cast(coalesce({_ALT} else 'nan' end='{a}', false) as tinyint) as alt_{a}" for a in _CLASSES]
)


@query(
    "e5_one_hot",
    with_views("obs", o="select * exclude (crop_group), case when part_id%13=0 then null else crop_group end as crop_group from obs")
    + f"select {ROW_SQL}, {_HOT_SQL} from o",
)
def e5(t: Tables) -> DataFrame:
    rows = t.obs.withColumn("crop_group", F.when(F.col("part_id") % 13 != 0, F.col("crop_group")))
    hot = encode(rows, outside="nan")
    return hot.select(*ROW, *[c for c in hot.columns if c.startswith(("zone_", "grp_", "alt_"))])


_ALL = (*FEATURE_SQL, "month", "day_of_year", "year", *_CYCLIC, "season_ordinal", "is_rainy_season", "rainfall_regime")


@query(
    "f14_all_features",
    FEATURE_VIEWS + f"select {ROW_SQL}, " + ", ".join(f"{e} as {n}" for n, e in FEATURE_SQL.items())
    + ", cast(month(observation_date) as int) as month, cast(dayofyear(observation_date) as int) as day_of_year, cast(year(observation_date) as int) as year, "
    + ", ".join(f"{sql_round(e, 4)} as {n}" for n, e in _CYCLIC.items())
    + f", cast({_ORDINAL_SQL} as tinyint) as season_ordinal, cast({_RAINY_SQL} as tinyint) as is_rainy_season, cast(latitude>=6 as tinyint) as rainfall_regime"
    + ", cast(agroecological_zone='guinea_savanna' as tinyint) as zone_guinea_savanna, cast(crop_group='cereals' as tinyint) as grp_cereals from o",
)
def f14(t: Tables) -> DataFrame:
    table = engineer(t.written_obs, zones=list(_ZONES), groups=list(_GROUPS), keep_ids=True)
    return table.select(*ROW, *_ALL, "zone_guinea_savanna", "grp_cereals")


_SOIL = """select *, clay_percentage as clay_raw, sand_percentage as sand_raw, greatest(100e0-sand_percentage-clay_percentage, 0e0) as silt_raw from obs"""
_SAND, _SILT = sql_round("sand_raw/(sand_raw+silt_raw+clay_raw)*100", 1), sql_round("silt_raw/(sand_raw+silt_raw+clay_raw)*100", 1)
_CLAY = sql_round(f"100-{_SAND}-{_SILT}", 1)


@query(
    "f15_soil_sample_fields",
    with_views("obs", soil=_SOIL)
    + f"""select {ROW_SQL}, {_SAND} as sand_percentage, {_SILT} as silt_percentage, {_CLAY} as clay_percentage,
      case when {_CLAY}>=40 then 'clay' when {_CLAY}>=27 then 'clay_loam' when {_CLAY}>=7 then 'loam' else 'sandy_loam' end as texture_class,
      {sql_round('organic_carbon*1.724e0', 2)} as organic_matter, {sql_round(f'{_CLAY}*0.5e0+organic_carbon*2', 1)} as cation_exchange_capacity from soil""",
)
def f15(t: Tables) -> DataFrame:
    raw = t.obs.selectExpr(
        *ROW, "organic_carbon", "clay_percentage as clay_raw", "sand_percentage as sand_raw",
        "greatest(100e0-sand_percentage-clay_percentage, 0e0) as silt_raw",
    )
    fields = features.soil_sample_fields("sand_raw", "silt_raw", "clay_raw", "organic_carbon")
    return raw.select(*ROW, *[c.alias(n) for n, c in fields.items()])
