"""Indices and series figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.catalog.quality import errors_sql
from harrow.catalog.registry import ROW, query, r6, rounded, sql_round
from harrow.functions import indices
from harrow.functions.constants import HARVEST_INDEX_RANGE
from harrow.operators import schemas, series
from harrow.operators.quality import validate
from harrow.sources.tables import Tables, with_views

ROW_SQL = ", ".join(ROW)
KEY = ("station_id", "observation_date")
KEY_SQL = ", ".join(KEY)
DAILY = with_views("daily")

_BANDS = {
    "blue": "(l_partkey%40+10)/1000e0", "green": "(l_partkey%60+20)/1000e0", "red": "(l_suppkey%90+10)/1000e0",
    "red_edge1": "(l_orderkey%120+50)/1000e0", "red_edge3": "(l_orderkey%200+100)/1000e0", "nir": "(l_quantity+20)/100e0",
    "swir1": "(l_partkey%150+50)/1000e0", "swir2": "(l_suppkey%130+30)/1000e0",
}
_INDEX_SQL = {
    "ndvi": "(nir-red)/(nir+red)", "evi": "2.5e0*((nir-red)/(nir+6*red-7.5e0*blue+1))", "savi": "(nir-red)/(nir+red+0.5e0)*1.5e0",
    "ndre": "(nir-red_edge1)/(nir+red_edge1)", "ci_red_edge": "red_edge3/red_edge1-1",
    "mcari": "((red_edge1-red)-0.2e0*(red_edge1-green))*(red_edge1/red)", "ndwi": "(green-nir)/(green+nir)", "msi": "swir1/nir",
    "nmdi": "(nir-(swir1-swir2))/(nir+(swir1-swir2))",
}
_LINE = "l_orderkey, l_linenumber, l_partkey"


@query(
    "x1_vegetation_indices",
    f"select {_LINE}, {', '.join(f'{sql_round(e)} as {n}' for n, e in _INDEX_SQL.items())} from (select {_LINE}, "
    + ", ".join(f"{e} as {n}" for n, e in _BANDS.items()) + " from lineitem) as t",
)
def x1(t: Tables) -> DataFrame:
    bands = t.read("lineitem").selectExpr(*_LINE.split(", "), *[f"{e} as {n}" for n, e in _BANDS.items()])
    made = indices.vegetation_indices()
    return bands.select(*_LINE.split(", "), *[r6(c, n) for n, c in made.items()])


@query("x2_cloud_mask", f"select {_LINE} from lineitem where l_linenumber%4=0 and l_partkey%100<=20")
def x2(t: Tables) -> DataFrame:
    pixels = t.read("lineitem").selectExpr(*_LINE.split(", "), "l_linenumber%4 as mask", "l_partkey%100 as probability")
    return pixels.where(indices.usable_pixel("mask", "probability")).select(*_LINE.split(", "))


_SPANS, _LAGS = (3, 7, 15, 30), (1, 3, 7, 14)
_BY_DAY = "partition by station_id order by observation_date"
_ROLLING = (
    [f"{sql_round(f'avg(temperature_mean) over ({_BY_DAY} range between interval {n - 1} day preceding and current row)')} as temperature_mean_ma{n}" for n in _SPANS]
    + [f"{sql_round(f'max(precipitation_daily) over ({_BY_DAY} range between interval {k} day preceding and interval {k} day preceding)')} as precipitation_daily_lag{k}" for k in _LAGS]
    + [f"{sql_round(f'sum({c}) over (partition by station_id, year(observation_date) order by observation_date)')} as {c}_cum" for c in ("precipitation_daily", "gdd")]
)


@query(
    "x3_rolling_features",
    with_views("daily", d="select *, greatest(temperature_mean-10, 0) as gdd from daily") + f"select {KEY_SQL}, {', '.join(_ROLLING)} from d",
)
def x3(t: Tables) -> DataFrame:
    days = t.daily.withColumn("gdd", series.degree_days("temperature_mean"))
    rolled = series.rolling_features(
        days, *KEY, {"temperature_mean": list(_SPANS)}, {"precipitation_daily": list(_LAGS)}, ["precipitation_daily", "gdd"]
    )
    made = [c for c in rolled.columns if c not in days.columns]
    return rolled.select(*KEY, *[r6(c) for c in made])


@query(
    "x4_days_since_rain",
    DAILY + f"""select {KEY_SQL}, cast(observation_date-max(case when precipitation_daily>=1 then observation_date end) over
      ({_BY_DAY} rows between unbounded preceding and current row) as int) as days_since_rain from daily""",
)
def x4_rain(t: Tables) -> DataFrame:
    return series.days_since_rain(t.daily, *KEY, "precipitation_daily").select(*KEY, "days_since_rain")


_RUNS = """select *, observation_date-cast(row_number() over (partition by station_id, hot order by observation_date) as int) as run
  from (select *, temperature_mean>22 as hot from daily) as h"""


@query(
    "x4_consecutive_hot_days",
    with_views("daily", runs=_RUNS)
    + f"""select {KEY_SQL}, cast(case when hot then row_number() over (partition by station_id, hot, run order by observation_date) else 0 end as int) as hot_days from runs""",
)
def x4_hot(t: Tables) -> DataFrame:
    return series.consecutive_days(t.daily, *KEY, F.col("temperature_mean") > 22, "hot_days").select(*KEY, "hot_days")


@query(
    "x5_monthly_anomalies",
    with_views(
        "daily",
        months="select station_id, cast(date_trunc('month', observation_date) as date) as month_start, avg(temperature_mean) as temperature, sum(precipitation_daily) as rain from daily group by 1, 2",
        normals="select station_id as s, month(month_start) as m, avg(temperature) as tn, avg(rain) as rn from months where year(month_start) between 1991 and 2020 group by 1, 2",
    )
    + f"""select station_id, month_start, {sql_round('temperature-tn')} as temperature_anomaly,
      {sql_round('case when rn<>0 then (rain-rn)/rn end*100')} as rain_anomaly_pct from months left join normals on s=station_id and m=month(month_start)""",
)
def x5(t: Tables) -> DataFrame:
    table = series.monthly_anomalies(t.daily, *KEY, "temperature_mean", "precipitation_daily")
    return rounded(table.select("station_id", "month_start", "temperature_anomaly", "rain_anomaly_pct"), "temperature_anomaly", "rain_anomaly_pct")


@query(
    "x6_spikes",
    with_views(
        "daily",
        med="select station_id as s, quantile_cont(temperature_mean, 0.5) as m from daily group by 1",
        dev="select station_id, observation_date, temperature_mean, abs(temperature_mean-m) as d from daily join med on s=station_id",
        mad="select station_id as s, quantile_cont(d, 0.5) as q from dev group by 1",
    )
    + f"select {KEY_SQL}, {sql_round('temperature_mean')} as temperature_mean, d>{1.4826 * 1.5!r}e0*q as is_spike from dev join mad on s=station_id",
)
def x6_spikes(t: Tables) -> DataFrame:
    days = t.daily.select(*KEY, "temperature_mean")
    return rounded(series.flag_spikes(days, "station_id", "temperature_mean", sigmas=1.5), "temperature_mean")


@query(
    "x6_gap_filling",
    with_views(
        "daily",
        gappy="select station_id, observation_date, precipitation_daily, case when dayofyear(observation_date)%7>1 then temperature_mean end as v from daily",
        ahead=f"select station_id, observation_date, v, lead(observation_date) over ({_BY_DAY}) as nd, lead(v) over ({_BY_DAY}) as nv from gappy where v is not null",
        fills="select station_id as s, observation_date+cast(k as int) as d, v+(nv-v)*k/(nd-observation_date) as f from (select *, unnest(generate_series(1, nd-observation_date-1)) as k from ahead where nd-observation_date between 2 and 6)",
    )
    + f"""select coalesce(station_id, s) as station_id, coalesce(observation_date, d) as observation_date, {sql_round('precipitation_daily')} as precipitation_daily,
      {sql_round('coalesce(v, f)')} as temperature_mean, v is null and f is not null as is_filled
      from gappy full join fills on station_id=s and observation_date=d""",
)
def x6_gaps(t: Tables) -> DataFrame:
    seen = F.when(F.dayofyear("observation_date") % 7 > 1, F.col("temperature_mean"))
    days = t.daily.select(*KEY, "precipitation_daily", seen.alias("temperature_mean"))
    return rounded(series.fill_short_gaps(days, *KEY, "temperature_mean"), "precipitation_daily", "temperature_mean")


@query(
    "x7_heat_waves",
    with_views("daily", runs=_RUNS)
    + f"""select station_id, min(observation_date) as first_day, max(observation_date) as last_day, count(*) as duration_days,
      {sql_round('avg(temperature_mean-22)')} as mean_excess from runs where hot group by station_id, run having count(*)>=3""",
)
def x7(t: Tables) -> DataFrame:
    return rounded(series.heat_waves(t.daily, *KEY, "temperature_mean", 22.0), "mean_excess")


@query(
    "x7_frost_and_wind",
    with_views("obs") + f"select {ROW_SQL}, temperature_min-15<0 as frost, relative_humidity/5e0>15 as high_wind from obs",
)
def x7_flags(t: Tables) -> DataFrame:
    return t.obs.select(
        *ROW, series.frost_flag(F.col("temperature_min") - 15).alias("frost"), series.high_wind_flag(F.col("relative_humidity") / 5).alias("high_wind")
    )


_BALANCE = ("crop_et", "daily_balance", "cumulative_balance")


@query(
    "x8_comfort_and_water",
    with_views("daily", b="select *, temperature_mean/4e0*1.15e0 as crop_et, precipitation_daily-temperature_mean/4e0*1.15e0 as daily_balance from daily")
    + f"""select {KEY_SQL}, {sql_round('0.8e0*temperature_mean+relative_humidity/100e0*(temperature_mean-14.4e0)+46.4e0')} as thi,
      {sql_round('crop_et', 9)} as crop_et, {sql_round('daily_balance', 9)} as daily_balance,
      {sql_round('sum(daily_balance) over (partition by station_id, year(observation_date) order by observation_date)', 9)} as cumulative_balance from b""",
)
def x8(t: Tables) -> DataFrame:
    days = t.daily.withColumn("et0", F.col("temperature_mean") / 4)
    table = series.water_balance(days, *KEY, "precipitation_daily", "et0", F.lit(1.15))
    thi = indices.temperature_humidity_index("temperature_mean", "relative_humidity")
    return table.select(*KEY, r6(thi, "thi"), *[r6(c, digits=9) for c in _BALANCE])


_CATIONS = {"ca": "0.5e0+(part_id%50)/2e0", "mg": "(part_id%16)/2e0", "k": "(part_id%30)/10e0", "na": "organic_carbon*6", "cec": "clay_percentage", "ec": "disease_incidence/5e0"}
_CATION_SQL = {
    "ca_mg_ratio": "case when mg<>0 then ca/mg end", "mg_k_ratio": "case when k<>0 then mg/k end", "base_saturation": "(ca+mg+k+na)/cec*100",
    "sodium_adsorption_ratio": "na/sqrt((ca+mg)/2)",
}


def _class_sql(value: str, classes: tuple) -> str:
    return "case " + " ".join(f"when {value}>={low} then '{name}'" for low, name in classes) + " end"


@query(
    "x9_cation_indices",
    with_views("obs", src=f"select {ROW_SQL}, {', '.join(f'{e} as {n}' for n, e in _CATIONS.items())} from obs")
    + f"""select {ROW_SQL}, {', '.join(f'{sql_round(e)} as {n}' for n, e in _CATION_SQL.items())}, {_class_sql('ec', indices.SALINITY_CLASSES)} as salinity,
      {_class_sql('(na/sqrt((ca+mg)/2))', indices.SODICITY_CLASSES)} as sodicity from src""",
)
def x9(t: Tables) -> DataFrame:
    samples = t.obs.selectExpr(*ROW, *[f"{e} as {n}" for n, e in _CATIONS.items()])
    made = indices.cation_indices()
    table = samples.withColumns(made)
    return table.select(
        *ROW, *[r6(n) for n in made], indices.salinity_class("ec").alias("salinity"),
        indices.sodicity_class("sodium_adsorption_ratio").alias("sodicity"),
    )


_PARTS = {
    "ph": "(ph_water-4.5e0)/4e0", "organic_matter": "organic_carbon/7e0", "available_p": "available_phosphorus/160e0", "exchangeable_k": "harvest_index",
    "cec": "clay_percentage/60e0", "base_saturation": "disease_incidence/110e0", "available_water_capacity": "harvest_index/2e0",
    "chemical": "total_nitrogen", "physical": "sand_percentage/100e0", "biological": "organic_fertilizer/50e0",
}


@query(
    "x10_weighted_soil_indices",
    with_views("obs", src=f"select {ROW_SQL}, {', '.join(f'{e} as {n}' for n, e in _PARTS.items())} from obs")
    + f"""select {ROW_SQL}, {sql_round('+'.join(f'{n}*{w}e0' for n, w in indices.FERTILITY_WEIGHTS.items()))} as fertility_index,
      {sql_round('+'.join(f'{n}*{w}e0' for n, w in indices.HEALTH_WEIGHTS.items()))} as health_index from src""",
)
def x10(t: Tables) -> DataFrame:
    samples = t.obs.selectExpr(*ROW, *[f"{e} as {n}" for n, e in _PARTS.items()])
    return samples.select(
        *ROW, r6(indices.weighted_index(indices.FERTILITY_WEIGHTS), "fertility_index"), r6(indices.weighted_index(indices.HEALTH_WEIGHTS), "health_index")
    )


_CEREALS = {
    "crop_type": "crop_name", "season": "case when part_id%3=0 then 'main' when part_id%3=1 then 'wet' end", "year": "cast(year(observation_date)+6 as int)",
    "area_hectares": "(station_id%20)/10e0", "nitrogen_kg_ha": "fertilizer_nitrogen", "phosphorus_kg_ha": "fertilizer_phosphorus",
    "yield_tha": "yield_kg_ha/1000e0", "biomass_tha": "biomass_kg_ha/2000e0", "harvest_index": "harvest_index",
}
_CEREAL_TESTS = [
    ("crop_type not in ('maize', 'rice', 'sorghum', 'millet')", "crop_type: not an allowed value"),
    ("season not in ('main', 'dry', 'off-season')", "season: not an allowed value"),
    ("year<2000 or year>2024", "year: outside [2000, 2024]"),
    ("area_hectares<0.1e0 or area_hectares>100", "area_hectares: outside [0.1, 100]"),
    ("nitrogen_kg_ha<0 or nitrogen_kg_ha>300", "nitrogen_kg_ha: outside [0, 300]"),
    ("phosphorus_kg_ha<0 or phosphorus_kg_ha>150", "phosphorus_kg_ha: outside [0, 150]"),
    ("yield_tha<0 or yield_tha>15", "yield_tha: outside [0, 15]"),
    ("biomass_tha<0 or biomass_tha>50", "biomass_tha: outside [0, 50]"),
    ("harvest_index<0.2e0 or harvest_index>0.6e0", "harvest_index: outside [0.2, 0.6]"),
    ("harvest_date<=planting_date", "harvest_date > planting_date"),
    ("yield_tha*harvest_index>biomass_tha", "yield_tha * harvest_index <= biomass_tha"),
    ("area_hectares<=0", "area_hectares > 0"),
]


@query(
    "x11_cereal_file",
    with_views(
        "obs",
        src=f"select {ROW_SQL}, {', '.join(f'{e} as {n}' for n, e in _CEREALS.items())}, observation_date as planting_date, observation_date+cast(part_id%90 as int) as harvest_date from obs",
    )
    + f"select {ROW_SQL}, errors='' as is_valid, errors from (select *, {errors_sql(_CEREAL_TESTS)} as errors from src) as t",
)
def x11(t: Tables) -> DataFrame:
    table = t.obs.selectExpr(
        *ROW, *[f"{e} as {n}" for n, e in _CEREALS.items()], "observation_date as planting_date",
        "date_add(observation_date, cast(part_id%90 as int)) as harvest_date",
    )
    return validate(table, schemas.CROP_FILES["cereals"]).select(*ROW, "is_valid", F.array_join("errors", "; ").alias("errors"))


def _crop_file(group: str, columns: dict[str, str], tests: list[tuple[str, str]]) -> None:
    """Judge ``obs`` read as the crop file of a group; the limits of the SQL stand here a second time."""
    source = [f"{e} as {n}" for n, e in columns.items()]

    @query(
        f"x11_{group}_file",
        with_views("obs", src=f"select {ROW_SQL}, {', '.join(source)} from obs")
        + f"select {ROW_SQL}, errors='' as is_valid, errors from (select *, {errors_sql(tests)} as errors from src) as t",
    )
    def judged(t: Tables) -> DataFrame:
        table = validate(t.obs.selectExpr(*ROW, *source), schemas.CROP_FILES[group])
        return table.select(*ROW, "is_valid", F.array_join("errors", "; ").alias("errors"))


_crop_file(
    "vegetables",
    {
        "crop_type": "case when part_id%4=0 then 'okra' when part_id%4=1 then 'tomato' when part_id%4=2 then 'leek' end",
        "plant_support": "case when part_id%3=0 then 'cages' else 'wires' end", "harvest_frequency": "cast(part_id%25 as int)",
        "brix_content": "disease_incidence/5e0", "shelf_life_days": "cast(station_id%40 as int)",
    },
    [
        ("crop_type not in ('tomato', 'pepper', 'onion', 'cabbage', 'carrot', 'lettuce', 'cucumber', 'okra')", "crop_type: not an allowed value"),
        ("plant_support not in ('none', 'stakes', 'trellis', 'cages')", "plant_support: not an allowed value"),
        ("harvest_frequency<1 or harvest_frequency>20", "harvest_frequency: outside [1, 20]"),
        ("brix_content<3 or brix_content>12", "brix_content: outside [3, 12]"),
        ("shelf_life_days<1 or shelf_life_days>30", "shelf_life_days: outside [1, 30]"),
    ],
)
_crop_file(
    "root_tubers",
    {
        "crop_type": "crop_name", "propagation_material": "case when part_id%3=0 then 'true_seeds' when part_id%3=1 then 'cloves' end",
        "plant_spacing_cm": "disease_incidence*2e0", "storage_root_yield_tha": "yield_kg_ha/100e0", "fiber_content": "harvest_index*10e0",
        "storage_duration_days": "cast(elevation as int)", "post_harvest_losses": "clay_percentage",
    },
    [
        ("crop_type not in ('cassava', 'sweet_potato', 'yam', 'potato')", "crop_type: not an allowed value"),
        ("propagation_material not in ('stem_cuttings', 'vine_cuttings', 'tuber_pieces', 'whole_tubers', 'true_seeds')", "propagation_material: not an allowed value"),
        ("plant_spacing_cm<20 or plant_spacing_cm>150", "plant_spacing_cm: outside [20, 150]"),
        ("storage_root_yield_tha<1 or storage_root_yield_tha>50", "storage_root_yield_tha: outside [1, 50]"),
        ("fiber_content<0.5e0 or fiber_content>5", "fiber_content: outside [0.5, 5]"),
        ("storage_duration_days<1 or storage_duration_days>365", "storage_duration_days: outside [1, 365]"),
        ("post_harvest_losses<0 or post_harvest_losses>50", "post_harvest_losses: outside [0, 50]"),
    ],
)
_crop_file(
    "tree_crops",
    {
        "crop_type": "crop_name", "pest_pressure": "case when part_id%3=0 then 'high' when part_id%3=1 then 'severe' end",
        "planting_year": "cast(year(observation_date)-14 as int)", "tree_age_years": "cast(station_id%60 as int)",
        "disease_incidence": "disease_incidence", "annual_yield_kg_ha": "yield_kg_ha",
    },
    [
        ("crop_type not in ('cocoa', 'coffee', 'oil_palm', 'mango', 'plantain_banana')", "crop_type: not an allowed value"),
        ("pest_pressure not in ('low', 'moderate', 'high')", "pest_pressure: not an allowed value"),
        ("planting_year<1980 or planting_year>2024", "planting_year: outside [1980, 2024]"),
        ("tree_age_years<1 or tree_age_years>50", "tree_age_years: outside [1, 50]"),
        ("disease_incidence<0 or disease_incidence>100", "disease_incidence: outside [0, 100]"),
        ("annual_yield_kg_ha<100 or annual_yield_kg_ha>5000", "annual_yield_kg_ha: outside [100, 5000]"),
    ],
)


@query(
    "x12_harvest_index_in_range",
    with_views(
        "obs",
        ranges="select * from (values " + ", ".join(f"('{k}', {a!r}e0, {b!r}e0)" for k, (a, b) in HARVEST_INDEX_RANGE.items()) + ") as v(crop, low, high)",
    )
    + f"select {ROW_SQL}, crop_name, harvest_index between low and high as in_range from obs left join ranges on crop=crop_name",
)
def x12(t: Tables) -> DataFrame:
    return t.obs.select(*ROW, "crop_name", indices.harvest_index_in_range("crop_name", "harvest_index").alias("in_range"))
