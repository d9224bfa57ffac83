"""Row validation: every model over survey rows read as its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.catalog.files import season_sql
from harrow.catalog.registry import ROW, query, rounded, sql_round
from harrow.operators import schemas
from harrow.operators.quality import Model, model_rules, validate, violations
from harrow.sources.tables import Tables, with_views

ROW_SQL = ", ".join(ROW)


def error_tests(model: Model, columns: set[str], prefix: str = "", value=lambda c: c) -> list[tuple[str, str]]:
    """(SQL condition, message) of a model's field limits, in declared order."""
    tests = []
    for f in model.fields:
        if f.name not in columns:
            if f.required:
                tests.append(("true", f"{prefix}{f.name}: required"))
            continue
        v = value(f.name)
        if f.required:
            tests.append((f"{v} is null", f"{prefix}{f.name}: required"))
        if f.low is not None or f.high is not None:
            low = f"{v}<{float(f.low)!r}e0" if f.low is not None else "false"
            high = f"{v}>{float(f.high)!r}e0" if f.high is not None else "false"
            limits = f"[{'-inf' if f.low is None else f'{f.low:g}'}, {'inf' if f.high is None else f'{f.high:g}'}]"
            tests.append((f"({low} or {high})", f"{prefix}{f.name}: outside {limits}"))
        if f.choices:
            tests.append((f"{v} not in ({', '.join(repr(c) for c in f.choices)})", f"{prefix}{f.name}: not an allowed value"))
    return tests


def errors_sql(tests: list[tuple[str, str]]) -> str:
    return "concat_ws('; ', " + ", ".join(f"case when {c} then '{m}' end" for c, m in tests) + ")"


def _judged(df: DataFrame, model: Model) -> DataFrame:
    return validate(df, model).withColumn("errors", F.array_join("errors", "; "))


def _register(name: str, model: Model, columns: dict[str, str], checks: list[tuple[str, str]] = (), derived: dict[str, str] | None = None):
    """One flat model over expressions of ``obs``; ``derived`` are fill-ins to compare as well."""
    derived = derived or {}
    source = f"select {ROW_SQL}, " + ", ".join(f"{e} as {c}" for c, e in columns.items()) + " from obs"
    errors = errors_sql([*error_tests(model, set(columns)), *checks])
    extra = "".join(f", {e} as {c}" for c, e in derived.items())

    @query(name, with_views("obs", src=source) + f"select {ROW_SQL}, errors='' as is_valid, errors{extra} from (select *, {errors} as errors from src) as t")
    def run(t: Tables) -> DataFrame:
        df = t.obs.selectExpr(*ROW, *[f"{e} as {c}" for c, e in columns.items()])
        judged = _judged(df, model).select(*ROW, "is_valid", "errors", *derived)
        return rounded(judged, *[c for c, e in derived.items() if "round_even" in e])


_register(
    "v1_coordinates", schemas.COORDINATES,
    {"latitude": "case when part_id%23=0 then null else latitude-0.5e0 end", "longitude": "longitude+0.5e0", "elevation": "elevation",
     "slope": "organic_carbon*10", "aspect": "yield_kg_ha/20e0"},
)
_register(
    "v2_texture", schemas.TEXTURE,
    {"sand_percentage": "sand_percentage", "silt_percentage": "100e0-sand_percentage-clay_percentage+(part_id%3)", "clay_percentage": "clay_percentage",
     "texture_class": "case when part_id%5=0 then 'gravel' when part_id%5=1 then 'loam' else 'sandy_clay' end"},
    [("abs(sand_percentage+silt_percentage+clay_percentage-100)>1", "Sand + silt + clay must equal 100%")],
)
_register(
    "v3_water_properties", schemas.WATER,
    {"field_capacity": "harvest_index", "wilting_point": "total_nitrogen/2e0", "infiltration_rate": "elevation/10e0",
     "available_water_capacity": "case when part_id%2=0 then 0.15e0 end",
     "drainage_class": "case when part_id%4=0 then 'swampy' when part_id%4=1 then 'good' end"},
    derived={"available_water_capacity": sql_round("coalesce(available_water_capacity, greatest(0e0, field_capacity-wilting_point))")},
)
_register(
    "v4_chemical_properties", schemas.CHEMICAL,
    {"ph_water": "ph_water+2", "organic_carbon": "organic_carbon", "total_nitrogen": "case when part_id%6=0 then null else total_nitrogen+0.1e0 end",
     "c_n_ratio": "case when part_id%5=0 then organic_carbon*12 end", "available_phosphorus": "available_phosphorus",
     "base_saturation": "disease_incidence"},
    derived={"organic_matter": sql_round("organic_carbon*1.724e0"),
             "c_n_ratio": sql_round("coalesce(c_n_ratio, case when total_nitrogen>0 then organic_carbon/total_nitrogen end)")},
)
_register(
    "v5_micronutrients", schemas.MICRONUTRIENTS,
    {"iron": "disease_incidence", "manganese": "clay_percentage", "zinc": "organic_carbon*4", "copper": "ph_water*1.5e0", "boron": "organic_carbon"},
)
_register(
    "v6_physical_properties", schemas.PHYSICAL,
    {"bulk_density": "ph_water/4e0", "aggregate_stability": "disease_incidence", "porosity": "case when part_id%3=0 then sand_percentage end"},
    derived={"porosity": sql_round("coalesce(porosity, (1-bulk_density/2.65e0)*100)")},
)
_register(
    "v7_sampling_metadata", schemas.SAMPLING,
    {"sampling_date": "case when part_id%21=0 then null else observation_date end", "quality_flag": "data_quality_flag*2",
     "sampling_strategy": "case when part_id%3=0 then 'composite' when part_id%3=1 then 'guess' end",
     "sampling_depth": "case when part_id%2=0 then '20-40cm' end"},
    derived={"sampling_depth": "coalesce(sampling_depth, '0-20cm')"},
)
_register(
    "v9_station", schemas.STATION,
    {"station_id": "station_id", "station_name": "crop_name", "latitude": "latitude-0.3e0", "longitude": "longitude", "elevation": "elevation",
     "station_type": "case when part_id%4=0 then 'buoy' when part_id%4=1 then 'manual' else 'hybrid' end",
     "completeness_percentage": "disease_incidence", "rainfall_regime": "case when part_id%7=0 then 'trimodal' end"},
    derived={"rainfall_regime": "coalesce(rainfall_regime, case when latitude>=6 then 'monomodal' else 'bimodal' end)", "measurement_height_temp": "2e0",
             "measurement_height_wind": "10e0", "is_active": "true"},
)
_register(
    "v10_temperature", schemas.TEMPERATURE,
    {"temperature_min": "temperature_min-16", "temperature_max": "case when part_id%9=0 then null else temperature_max-8 end",
     "temperature_avg": "case when part_id%4=0 then temperature_mean+15 end", "dew_point": "temperature_mean+10"},
    derived={"temperature_avg": sql_round("coalesce(temperature_avg, (temperature_min+temperature_max)/2)"),
             "temperature_range": sql_round("temperature_max-temperature_min")},
)
_register(
    "v11_precipitation", schemas.PRECIPITATION,
    {"precipitation_daily": "precipitation_daily*4", "precipitation_intensity_max": "precipitation_daily*2", "precipitation_duration": "solar_radiation",
     "precipitation_type": "case when part_id%3=0 then 'snow' else 'rain' end"},
)
_register(
    "v11_humidity", schemas.HUMIDITY,
    {"relative_humidity_avg": "relative_humidity+10", "relative_humidity_min": "relative_humidity-40", "specific_humidity": "solar_radiation+5"},
)
_register("v11_radiation", schemas.RADIATION, {"solar_radiation_daily": "solar_radiation+8", "sunshine_hours": "ph_water*2", "photoperiod": "ph_water+6"})
_register("v11_wind", schemas.WIND, {"wind_speed_avg": "clay_percentage", "wind_direction": "elevation/10e0", "wind_gust": "disease_incidence"})
_register("v11_pressure", schemas.PRESSURE, {"atmospheric_pressure": "1013e0-elevation/9e0", "sea_level_pressure": "980e0+relative_humidity"})
_register(
    "v12_quality_control", schemas.QUALITY_CONTROL,
    {"temperature_quality": "case data_quality_flag when 0 then 'good' when 1 then 'poor' else 'bad' end", "overall_quality_score": "harvest_index*2",
     "data_completeness": "disease_incidence", "interpolation_method": "case when part_id%5=0 then 'nearest' else 'idw' end"},
)
_register(
    "v13_weather_day", schemas.WEATHER,
    {"station_id": "station_id", "date": "observation_date", "latitude": "case when part_id%10=0 then null else latitude end", "longitude": "longitude",
     "elevation": "elevation", "day_of_year": "case when part_id%4=0 then cast(part_id%400 as int) end",
     "season": "case when part_id%3=0 then 'given' end"},
    derived={"day_of_year": "coalesce(day_of_year, cast(dayofyear(date) as int))", "season": f"coalesce(season, {season_sql('date', 'latitude')})",
             "rainfall_regime": "case when latitude>=6 then 'monomodal' when latitude is not null then 'bimodal' end", "version": "1"},
)
_register(
    "v14_variety", schemas.VARIETY,
    {"variety_name": "case when part_id%25=0 then null else crop_name end", "maturity_days": "cast(elevation as int)", "protein_content": "disease_incidence/2e0",
     "yield_potential_min": "yield_kg_ha", "yield_potential_max": "biomass_kg_ha"},
    [("yield_potential_max<=yield_potential_min", "Max yield must be > min yield")],
)
_register(
    "v15_planting_details", schemas.PLANTING,
    {"planting_density": "cast(floor(yield_kg_ha*25) as int)", "row_spacing_cm": "elevation/10e0", "plant_spacing_cm": "disease_incidence", "planting_depth_cm": "ph_water*2"},
)
_register(
    "v15_fertilisation", schemas.FERTILISATION,
    {"nitrogen_kg_ha": "fertilizer_nitrogen*1.5e0", "phosphorus_kg_ha": "fertilizer_phosphorus", "organic_fertilizer_tha": "organic_fertilizer", "split_applications": "data_quality_flag*3"},
)
_register(
    "v15_irrigation", schemas.IRRIGATION,
    {"irrigated": "case when part_id%3=0 then null else irrigation_applied end", "water_applied_mm": "yield_kg_ha/3e0"},
    derived={"irrigated": "coalesce(irrigated, false)"},
)
_register(
    "v16_yield", schemas.YIELD,
    {"yield_tha": "case when part_id%31=0 then null else yield_kg_ha/90e0 end", "biomass_tha": "biomass_kg_ha/90e0", "harvest_index": "harvest_index+0.4e0"},
    [("yield_tha>biomass_tha", "Yield cannot exceed total biomass")],
)
_register(
    "v18_crop", schemas.CROP,
    {"field_id": "record_id", "crop_type": "case when part_id%17=0 then 'teff' else crop_name end", "crop_group": "crop_group", "season": "season",
     "year": "cast(year(observation_date)+part_id%10 as int)", "latitude": "latitude", "longitude": "longitude", "elevation": "elevation",
     "area_hectares": "(station_id%20)/10e0", "cycle_length_days": "cast(floor(elevation/5) as int)", "disease_incidence": "disease_incidence",
     "version": "case when part_id%2=0 then 3 end"},
    derived={"version": "coalesce(version, 1)"},
)
_SURVEY_COLUMNS = {
    "location_id": "case when part_id%27=0 then null else cast(location_id as string) end",
    "data_source": "data_source", "latitude": "latitude", "longitude": "longitude", "elevation": "elevation",
    "field_area": "(station_id%20)/10e0", "crop_name": "crop_name",
    "season_type": "case when part_id%2=0 then season else 'main_season' end", "growth_stage": "case when part_id%2=0 then 'flowering' end",
    "temperature_min": "temperature_min", "temperature_max": "temperature_max", "precipitation_daily": "precipitation_daily*5",
    "relative_humidity": "relative_humidity", "solar_radiation": "solar_radiation+10", "ph_water": "ph_water+2", "organic_carbon": "organic_carbon",
    "total_nitrogen": "total_nitrogen", "available_phosphorus": "available_phosphorus", "sand_percentage": "sand_percentage",
    "clay_percentage": "clay_percentage", "fertilizer_nitrogen": "fertilizer_nitrogen", "fertilizer_phosphorus": "fertilizer_phosphorus",
    "organic_fertilizer": "organic_fertilizer", "irrigation_applied": "irrigation_applied", "yield_grain": "yield_kg_ha*20",
    "biomass_total": "biomass_kg_ha*20", "harvest_index": "harvest_index", "data_quality_flag": "data_quality_flag",
    "agroecological_zone": "case when part_id%2=0 then agroecological_zone else 'highlands' end",
}
_register("v19_survey_table", Model("survey", tuple(f for f in schemas.SURVEY_TABLE.fields if f.name not in ROW)), _SURVEY_COLUMNS)


# --- nested documents -----------------------------------------------------------------
_SOIL_FLAT = f"""select {ROW_SQL}, latitude, longitude, elevation, sand_percentage, 100e0-sand_percentage-clay_percentage as silt_percentage,
  clay_percentage, ph_water, organic_carbon, total_nitrogen, harvest_index+0.8e0 as bulk_density, harvest_index as field_capacity,
  0.1e0 as wilting_point, case when part_id%2=0 then disease_incidence end as iron, part_id%4=0 as no_physics from obs"""
_SOIL_TESTS = [
    ("latitude<1.6e0 or latitude>13.1e0", "coordinates.latitude: outside [1.6, 13.1]"),
    ("silt_percentage<0 or silt_percentage>100", "texture.silt_percentage: outside [0, 100]"),
    ("abs(sand_percentage+silt_percentage+clay_percentage-100)>1", "Sand + silt + clay must equal 100%"),
    ("no_physics", "physical_properties: required"),
    ("organic_carbon is null", "chemical_properties.organic_carbon: required"),
    ("total_nitrogen<0.01e0 or total_nitrogen>1", "chemical_properties.total_nitrogen: outside [0.01, 1]"),
    ("field_capacity<0.05e0 or field_capacity>0.6e0", "water_properties.field_capacity: outside [0.05, 0.6]"),
    ("iron<1 or iron>100", "micronutrients.iron: outside [1, 100]"),
]


def soil_documents(obs: DataFrame) -> DataFrame:
    """Survey rows as nested soil samples."""
    flat = obs.selectExpr(
        *ROW, "latitude", "longitude", "elevation", "sand_percentage", "100e0-sand_percentage-clay_percentage as silt_percentage",
        "clay_percentage", "ph_water", "organic_carbon", "total_nitrogen", "harvest_index+0.8e0 as bulk_density", "harvest_index as field_capacity",
        "case when part_id%2=0 then disease_incidence end as iron",
    )
    return flat.select(
        *ROW, F.col("record_id").cast("string").alias("field_id"),
        F.struct("latitude", "longitude", "elevation").alias("coordinates"),
        F.struct(F.col("observation_date").alias("sampling_date"), F.lit("composite").alias("sampling_strategy")).alias("sampling_metadata"),
        F.struct("sand_percentage", "silt_percentage", "clay_percentage", F.lit("loam").alias("texture_class")).alias("texture"),
        F.when(F.col("part_id") % 4 != 0, F.struct("bulk_density")).alias("physical_properties"),
        F.struct("ph_water", "organic_carbon", "total_nitrogen").alias("chemical_properties"),
        F.struct("field_capacity", F.lit(0.1).alias("wilting_point")).alias("water_properties"),
        F.when(F.col("iron").isNotNull(), F.struct("iron")).alias("micronutrients"),
    )


@query(
    "v8_soil_documents",
    with_views("obs", src=_SOIL_FLAT)
    + f"""select {ROW_SQL}, errors='' as is_valid, errors, {sql_round('organic_carbon*1.724e0')} as organic_matter,
      {sql_round('case when total_nitrogen>0 then organic_carbon/total_nitrogen end')} as c_n_ratio,
      {sql_round('case when not no_physics then (1-bulk_density/2.65e0)*100 end')} as porosity,
      {sql_round('greatest(0e0, field_capacity-wilting_point)')} as available_water_capacity, '0-20cm' as sampling_depth, 1 as version
      from (select *, {errors_sql(_SOIL_TESTS)} as errors from src) as t""",
)
def v8(t: Tables) -> DataFrame:
    judged = _judged(soil_documents(t.obs), schemas.SOIL).select(
        *ROW, "is_valid", "errors", "chemical_properties.organic_matter", "chemical_properties.c_n_ratio",
        "physical_properties.porosity", "water_properties.available_water_capacity", "sampling_metadata.sampling_depth", "version",
    )
    return rounded(judged, "organic_matter", "c_n_ratio", "porosity", "available_water_capacity")


_HEALTH_TESTS = [
    ("disease_incidence is null or part_id%6=0", "crop_health.disease_type: not an allowed value"),
    ("disease_incidence>100 or disease_incidence-20<0", "crop_health.incidence_percentage: outside [0, 100]"),
    ("ler<0.5e0 or ler>3", "intercropping.land_equivalent_ratio: outside [0.5, 3]"),
]


@query(
    "v17_crop_health",
    with_views("obs", src="select *, organic_carbon as ler from obs")
    + f"select {ROW_SQL}, errors='' as is_valid, errors from (select *, {errors_sql(_HEALTH_TESTS)} as errors from src) as t",
)
def v17(t: Tables) -> DataFrame:
    def observation(kind, incidence):
        return F.struct(F.lit("rust").alias("disease_name"), kind.alias("disease_type"), incidence.alias("incidence_percentage"))

    odd = F.when(F.col("part_id") % 6 == 0, F.lit("magic")).otherwise(F.lit("viral"))
    docs = t.obs.select(
        *ROW,
        F.array(observation(F.lit("fungal"), F.col("disease_incidence")), observation(odd, F.col("disease_incidence") - 20)).alias("crop_health"),
        F.struct(
            F.col("crop_name").alias("primary_crop"), F.array(F.lit("cowpea")).alias("companion_crops"),
            F.col("organic_carbon").alias("land_equivalent_ratio"),
        ).alias("intercropping"),
    )
    model = Model("health", (), blocks={k: schemas.CROP.blocks[k] for k in ("crop_health", "intercropping")})
    return _judged(docs, model).select(*ROW, "is_valid", "errors")


_COUNTED = error_tests(schemas.COORDINATES, {"latitude", "longitude", "elevation", "slope"})
_PLACES = f"select {ROW_SQL}, case when part_id%23=0 then null else latitude-0.5e0 end as latitude, longitude+0.5e0 as longitude, elevation, organic_carbon*10 as slope from obs"


@query(
    "v0_violation_counts",
    with_views("obs", src=_PLACES) + "select * from (" + " union all ".join(
        f"select '{m.split(':')[0]}.{'required' if m.endswith('required') else 'range'}' as rule, count(*) filter (where {c}) as n_rows from src"
        for c, m in _COUNTED
    ) + ") as t where n_rows>0",
)
def v0(t: Tables) -> DataFrame:
    places = t.spark.sql(_PLACES.replace("from obs", "from {obs}"), obs=t.obs)
    return violations(places, model_rules(schemas.COORDINATES, places.schema))
