"""Declared row models: soil sample, weather day, crop record, survey table, crop files."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions.constants import ELEVATION_RANGE, LAT_RANGE, LON_RANGE
from harrow.functions.dates import agricultural_season, rainfall_regime_name
from harrow.operators.quality import Check, Field, Model


def _ranges(**limits: tuple[float, float]) -> tuple[Field, ...]:
    return tuple(Field(name, *pair) for name, pair in limits.items())


def _typed(kind: str, *names: str) -> tuple[Field, ...]:
    return tuple(Field(name, kind=kind) for name in names)


def _required(*names: str) -> tuple[Field, ...]:
    return tuple(Field(name, required=True) for name in names)


def _place(required: bool) -> tuple[Field, ...]:
    return (
        Field("latitude", *LAT_RANGE, required=required),
        Field("longitude", *LON_RANGE, required=required),
        Field("elevation", *ELEVATION_RANGE, required=required),
    )


# --- Fixed values: vocabularies ----------------------------------------------------
TEXTURE_CLASSES = (
    "sand", "loamy_sand", "sandy_loam", "loam", "silt_loam", "silt", "sandy_clay_loam", "clay_loam",
    "silty_clay_loam", "sandy_clay", "silty_clay", "clay",
)
DRAINAGE_CLASSES = ("very_poor", "poor", "imperfect", "moderate", "good", "excessive")
SAMPLING_STRATEGIES = ("systematic_grid", "random_stratified", "targeted_zones", "composite")
STATION_TYPES = ("automatic", "manual", "hybrid", "satellite_derived")
QUALITY_FLAGS = ("good", "questionable", "poor", "missing", "estimated")
INTERPOLATIONS = ("idw", "kriging", "spline", "reanalysis_blend")
PRECIPITATION_TYPES = ("rain", "drizzle", "shower", "thunderstorm", "hail")
REGIMES = ("bimodal", "monomodal")
CROP_GROUPS = (
    "cereals", "legumes", "root_tubers", "vegetables", "tree_crops", "cash_crops", "industrial_crops",
)
CROP_TYPES = (
    "maize", "rice", "sorghum", "millet", "cowpea", "groundnut", "common_bean", "soybean", "cassava",
    "sweet_potato", "yam", "potato", "tomato", "pepper", "onion", "cabbage", "carrot", "lettuce", "cucumber",
    "okra", "cotton", "plantain_banana", "cocoa", "coffee", "oil_palm", "mango", "pineapple",
)
SEASONS = (
    "grand_dry_season", "first_rainy_season", "petit_dry_season", "second_rainy_season", "transition_to_dry",
    "dry_season", "early_rainy", "rainy_season", "late_rainy", "off_season",
)
GROWTH_STAGES = ("germination", "vegetative", "flowering", "grain_filling", "maturity", "harvest")
CULTIVATION_SYSTEMS = (
    "open_field", "greenhouse", "shade_house", "hydroponic", "irrigated", "rainfed", "agroforestry",
)
INTENSITIES = ("low_input", "medium_input", "high_input", "organic", "integrated")
MARKETS = ("local_market", "regional_market", "national_market", "export", "processing", "subsistence")
DISEASE_TYPES = ("fungal", "bacterial", "viral", "nematode", "parasitic_plant")

# --- soil ------------------------------------------------------------------------------
COORDINATES = Model("coordinates", _place(True) + _ranges(slope=(0, 45), aspect=(0, 360)))

TEXTURE = Model(
    "texture",
    tuple(Field(f"{part}_percentage", 0, 100, required=True) for part in ("sand", "silt", "clay"))
    + (Field("texture_class", required=True, choices=TEXTURE_CLASSES),),
    checks=(
        Check(
            "texture_sum", ("sand_percentage", "silt_percentage", "clay_percentage"),
            lambda g: F.abs(g("sand_percentage") + g("silt_percentage") + g("clay_percentage") - 100) > 1,
            "Sand + silt + clay must equal 100%",
        ),
    ),
)

WATER = Model(
    "water_properties",
    (
        Field("field_capacity", 0.05, 0.60, required=True),
        Field("wilting_point", 0.02, 0.40, required=True),
        Field("drainage_class", choices=DRAINAGE_CLASSES),
    )
    + _ranges(saturated_hydraulic_conductivity=(0.01, 100), infiltration_rate=(1, 300)),
    derive={
        "available_water_capacity": (
            ("field_capacity", "wilting_point"),
            lambda g: F.greatest(F.lit(0.0), g("field_capacity") - g("wilting_point")),
        )
    },
)

CHEMICAL = Model(
    "chemical_properties",
    (Field("ph_water", 3.5, 9.5, required=True), Field("organic_carbon", 0.1, 10.0, required=True))
    + _ranges(
        ph_kcl=(3.0, 8.5), total_nitrogen=(0.01, 1.0), c_n_ratio=(5, 50), available_phosphorus=(1, 150),
        exchangeable_potassium=(0.05, 3.0), exchangeable_calcium=(0.5, 25.0), exchangeable_magnesium=(0.1, 8.0),
        cation_exchange_capacity=(2, 60), base_saturation=(10, 100), aluminum_saturation=(0, 80),
    ),
    derive={
        "organic_matter": (("organic_carbon",), lambda g: g("organic_carbon") * 1.724),
        "c_n_ratio": (
            ("organic_carbon", "total_nitrogen"),
            lambda g: F.when(g("total_nitrogen") > 0, F.try_divide(g("organic_carbon"), g("total_nitrogen"))),
        ),
    },
)

MICRONUTRIENTS = Model(
    "micronutrients",
    _ranges(iron=(1, 100), manganese=(0.5, 50), zinc=(0.1, 20), copper=(0.1, 10), boron=(0.1, 5)),
)

PHYSICAL = Model(
    "physical_properties",
    (Field("bulk_density", 0.8, 2.0, required=True),) + _ranges(porosity=(20, 70), aggregate_stability=(0, 100)),
    derive={"porosity": (("bulk_density",), lambda g: (1 - g("bulk_density") / 2.65) * 100)},
)

QUALITY_INDEX = Model(
    "quality_indices", _ranges(fertility_index=(0, 1), health_index=(0, 1), productivity_potential=(0, 1))
)

SAMPLING = Model(
    "sampling_metadata",
    (
        Field("sampling_date", required=True),
        Field("sampling_strategy", required=True, choices=SAMPLING_STRATEGIES),
        Field("quality_flag", 0, 3),
    ),
    derive={"sampling_depth": ((), lambda g: F.lit("0-20cm"))},
)

_VERSION = {"version": ((), lambda g: F.lit(1))}

SOIL = Model(
    "soil",
    _required("field_id"),
    derive=_VERSION,
    blocks={
        "coordinates": (COORDINATES, True), "sampling_metadata": (SAMPLING, True), "texture": (TEXTURE, True),
        "physical_properties": (PHYSICAL, True), "chemical_properties": (CHEMICAL, True),
        "water_properties": (WATER, True), "micronutrients": (MICRONUTRIENTS, False),
        "quality_indices": (QUALITY_INDEX, False),
    },
)

# --- weather -------------------------------------------------------------------------------
_REGIME = (("latitude",), lambda g: rainfall_regime_name(g("latitude")))

STATION = Model(
    "station",
    _required("station_id", "station_name") + _place(True)
    + (
        Field("station_type", required=True, choices=STATION_TYPES),
        Field("rainfall_regime", choices=REGIMES),
    )
    + _ranges(completeness_percentage=(0, 100), data_quality_rating=(0, 1)),
    derive={
        "rainfall_regime": _REGIME,
        "measurement_height_temp": ((), lambda g: F.lit(2.0)),
        "measurement_height_wind": ((), lambda g: F.lit(10.0)),
        "measurement_height_precip": ((), lambda g: F.lit(1.5)),
        "microclimate_effects": ((), lambda g: F.lit(False)),
        "is_active": ((), lambda g: F.lit(True)),
    },
)

_BOTH_ENDS = ("temperature_min", "temperature_max")
TEMPERATURE = Model(
    "temperature",
    _ranges(
        temperature_min=(-5, 45), temperature_max=(5, 50), temperature_avg=(0, 40), soil_temp_5cm=(10, 45),
        soil_temp_10cm=(10, 45), soil_temp_20cm=(10, 45), dew_point=(-10, 35),
    ),
    derive={
        "temperature_avg": (_BOTH_ENDS, lambda g: (g("temperature_min") + g("temperature_max")) / 2),
        "temperature_range": (_BOTH_ENDS, lambda g: g("temperature_max") - g("temperature_min")),
    },
)

PRECIPITATION = Model(
    "precipitation",
    _ranges(
        precipitation_daily=(0, 500), precipitation_intensity_max=(0, 200), precipitation_duration=(0, 24),
        wind_with_precipitation=(0, 50),
    )
    + (Field("precipitation_type", choices=PRECIPITATION_TYPES),),
)

HUMIDITY = Model(
    "humidity",
    _ranges(
        relative_humidity_avg=(0, 100), relative_humidity_min=(0, 100), relative_humidity_max=(0, 100),
        rh_morning=(0, 100), rh_afternoon=(0, 100), specific_humidity=(0, 30),
    ),
)

RADIATION = Model(
    "radiation",
    _ranges(
        solar_radiation_daily=(0, 35), sunshine_hours=(0, 14), sunshine_fraction=(0, 1), uv_index=(0, 15),
        photoperiod=(10.5, 13.5),
    ),
)

WIND = Model(
    "wind",
    _ranges(wind_speed_avg=(0, 50), wind_speed_max=(0, 100), wind_direction=(0, 360), wind_gust=(0, 100)),
)

PRESSURE = Model("pressure", _ranges(atmospheric_pressure=(600, 1040), sea_level_pressure=(990, 1035)))

# Optional fields that have a type and no limits
DERIVED_INDICES = Model(
    "derived_indices",
    _typed(
        "double", "growing_degree_days_base10", "growing_degree_days_base15", "cooling_degree_days", "heat_index",
        "reference_et_penman_monteith", "potential_et_priestley_taylor", "aridity_index",
        "standardized_precipitation_index", "water_balance", "cumulative_water_deficit",
    ),
)
EXTREME_EVENTS = Model(
    "extreme_events",
    _typed("boolean", "frost_occurrence", "heat_wave_occurrence", "heavy_rainfall_event", "drought_event", "high_wind_event")
    + _typed("double", "frost_duration_hours", "storm_damage_potential")
    + _typed("int", "heat_wave_duration_days", "dry_spell_length"),
)

QUALITY_CONTROL = Model(
    "quality_control",
    tuple(
        Field(f"{v}_quality", choices=QUALITY_FLAGS)
        for v in ("temperature", "precipitation", "humidity", "wind", "radiation")
    )
    + _ranges(overall_quality_score=(0, 1), data_completeness=(0, 100))
    + (Field("interpolation_method", choices=INTERPOLATIONS),),
)

WEATHER = Model(
    "weather",
    _required("station_id", "date") + _place(False) + _ranges(day_of_year=(1, 366))
    + (Field("rainfall_regime", choices=REGIMES),),
    derive={
        "day_of_year": (("date",), lambda g: F.dayofyear(g("date"))),
        "season": (("date", "latitude"), lambda g: agricultural_season(g("date"), g("latitude"))),
        "rainfall_regime": _REGIME,
        **_VERSION,
    },
    blocks={
        "temperature": (TEMPERATURE, False), "precipitation": (PRECIPITATION, False),
        "humidity": (HUMIDITY, False), "radiation": (RADIATION, False), "wind": (WIND, False),
        "pressure": (PRESSURE, False), "derived_indices": (DERIVED_INDICES, False),
        "extreme_events": (EXTREME_EVENTS, False), "quality_control": (QUALITY_CONTROL, False),
    },
)

# --- crop --------------------------------------------------------------------------------------
VARIETY = Model(
    "variety",
    _required("variety_name")
    + _ranges(maturity_days=(30, 600), protein_content=(0, 50), oil_content=(0, 60), starch_content=(0, 90))
    + (Field("yield_potential_min", low=0), Field("yield_potential_max", low=0)),
    checks=(
        Check(
            "yield_potential_order", ("yield_potential_min", "yield_potential_max"),
            lambda g: g("yield_potential_max") <= g("yield_potential_min"),
            "Max yield must be > min yield",
        ),
    ),
)

PLANTING = Model(
    "planting_details",
    (Field("seed_rate", low=0),)
    + _ranges(
        planting_density=(50, 200000), row_spacing_cm=(10, 300), plant_spacing_cm=(5, 200),
        planting_depth_cm=(0.5, 15),
    ),
)

FERTILISATION = Model(
    "fertilization",
    _ranges(
        nitrogen_kg_ha=(0, 500), phosphorus_kg_ha=(0, 200), potassium_kg_ha=(0, 300),
        organic_fertilizer_tha=(0, 50), compost_tha=(0, 30), split_applications=(1, 5),
    ),
)

IRRIGATION = Model(
    "irrigation", _ranges(water_applied_mm=(0, 2000)), derive={"irrigated": ((), lambda g: F.lit(False))}
)

YIELD = Model(
    "yield_data",
    (Field("yield_tha", 0, 100, required=True),) + _ranges(biomass_tha=(0, 200), harvest_index=(0.05, 0.95)),
    checks=(
        Check(
            "yield_biomass", ("yield_tha", "biomass_tha"), lambda g: g("yield_tha") > g("biomass_tha"),
            "Yield cannot exceed total biomass",
        ),
    ),
)

CROP_HEALTH = Model(
    "crop_health",
    _required("disease_name")
    + (
        Field("disease_type", required=True, choices=DISEASE_TYPES),
        Field("incidence_percentage", 0, 100, required=True),
    ),
)

INTERCROPPING = Model(
    "intercropping", _required("primary_crop", "companion_crops") + _ranges(land_equivalent_ratio=(0.5, 3.0))
)

CROP = Model(
    "crop",
    _required("field_id")
    + (
        Field("crop_type", required=True, choices=CROP_TYPES),
        Field("crop_group", choices=CROP_GROUPS),
        Field("season", required=True, choices=SEASONS),
        Field("year", 2000, 2100, required=True),
        Field("latitude", *LAT_RANGE, required=True),
        Field("longitude", *LON_RANGE, required=True),
        Field("cultivation_system", choices=CULTIVATION_SYSTEMS),
        Field("management_intensity", choices=INTENSITIES),
        Field("growth_stage", choices=GROWTH_STAGES),
        Field("market_destination", choices=MARKETS),
    )
    + _ranges(
        elevation=ELEVATION_RANGE, area_hectares=(0.01, 10000), cycle_length_days=(30, 600),
        disease_incidence=(0, 100),
    ),
    derive=_VERSION,
    blocks={
        "variety": (VARIETY, False), "planting_details": (PLANTING, False), "fertilization": (FERTILISATION, False),
        "irrigation": (IRRIGATION, False), "yield_data": (YIELD, False), "crop_health": (CROP_HEALTH, False),
        "intercropping": (INTERCROPPING, False),
    },
)

# --- declared survey table ----------------------------------------------------------------------
_SURVEY_SOURCES = ("field_measurement", "weather_station", "laboratory_analysis")
_SURVEY_SEASONS = ("dry_season", "wet_season", "main_season", "off_season")
_SURVEY_STAGES = ("planting", "vegetative", "flowering", "maturity", "harvest")
_SURVEY_ZONES = ("coastal_forest", "forest_savanna", "guinea_savanna", "sahel_savanna", "highlands")


def _float(name: str, low: float | None = None, high: float | None = None, required: bool = False) -> Field:
    return Field(name, low, high, required=required, kind="float")


SURVEY_TABLE = Model(
    "survey",
    (
        Field("record_id", required=True, kind="string"),
        Field("location_id", required=True, kind="string"),
        Field("observation_date", required=True, kind="date"),
        Field("data_source", required=True, choices=_SURVEY_SOURCES, kind="string"),
        Field("latitude", *LAT_RANGE, required=True, kind="double"),
        Field("longitude", *LON_RANGE, required=True, kind="double"),
        _float("elevation", *ELEVATION_RANGE, required=True),
        _float("field_area", 0.001, 1000),
        Field("crop_group_id", kind="tinyint"),
        Field("crop_type_id", kind="smallint"),
        Field("variety_id", kind="smallint"),
        Field("crop_name", kind="string"),
        Field("variety_name", kind="string"),
        Field("season_type", choices=_SURVEY_SEASONS, kind="string"),
        Field("growth_stage", choices=_SURVEY_STAGES, kind="string"),
        _float("temperature_min", -5, 45),
        _float("temperature_max", 5, 50),
        _float("temperature_mean"),
        _float("precipitation_daily", 0, 500),
        _float("relative_humidity", 0, 100),
        _float("solar_radiation", 0, 35),
        _float("ph_water", 3.5, 9.5),
        _float("organic_carbon", 0.1, 10.0),
        _float("total_nitrogen", 0.01, 1.0),
        _float("available_phosphorus", 1, 150),
        _float("sand_percentage", 0, 100),
        _float("clay_percentage", 0, 100),
        _float("fertilizer_nitrogen", 0, 400),
        _float("fertilizer_phosphorus", 0, 200),
        _float("organic_fertilizer", 0, 50),
        Field("irrigation_applied", kind="boolean"),
        _float("yield_grain", 0, 100000),
        _float("biomass_total", 0, 200000),
        _float("harvest_index", 0.1, 0.8),
        Field("data_quality_flag", required=True, kind="tinyint"),
        Field("agroecological_zone", required=True, choices=_SURVEY_ZONES, kind="string"),
    ),
)

# --- per-group crop files ------------------------------------------------------------------------
def _choice(name: str, *values: str) -> Field:
    return Field(name, choices=values, kind="string")


CROP_FILES = {
    "cereals": Model(
        "cereals_file",
        (
            _choice("crop_type", "maize", "rice", "sorghum", "millet"),
            _choice("season", "main", "dry", "off-season"),
        )
        + _ranges(
            year=(2000, 2024), area_hectares=(0.1, 100), nitrogen_kg_ha=(0, 300), phosphorus_kg_ha=(0, 150),
            potassium_kg_ha=(0, 200), organic_fertilizer_tha=(0, 20), yield_tha=(0, 15), biomass_tha=(0, 50),
            harvest_index=(0.2, 0.6), grain_moisture=(10, 25), protein_content=(6, 20),
        ),
        checks=(
            Check("harvest_after_planting", ("harvest_date", "planting_date"),
                  lambda g: g("harvest_date") <= g("planting_date"), "harvest_date > planting_date"),
            Check("yield_within_biomass", ("yield_tha", "harvest_index", "biomass_tha"),
                  lambda g: g("yield_tha") * g("harvest_index") > g("biomass_tha"),
                  "yield_tha * harvest_index <= biomass_tha"),
            Check("area_positive", ("area_hectares",), lambda g: g("area_hectares") <= 0, "area_hectares > 0"),
        ),
    ),
    "vegetables": Model(
        "vegetables_file",
        (
            _choice("crop_type", "tomato", "pepper", "onion", "cabbage", "carrot", "lettuce", "cucumber", "okra"),
            _choice("cultivation_system", "open_field", "greenhouse", "shade_house", "hydroponic"),
            _choice("planting_method", "direct_seeding", "transplanting"),
            _choice("plant_support", "none", "stakes", "trellis", "cages"),
            _choice("market_destination", "local_market", "regional_market", "export", "processing"),
            _choice("fruit_quality_grade", "grade_1", "grade_2", "grade_3", "processing"),
        )
        + _ranges(harvest_frequency=(1, 20), brix_content=(3, 12), shelf_life_days=(1, 30)),
    ),
    "root_tubers": Model(
        "root_tubers_file",
        (
            _choice("crop_type", "cassava", "sweet_potato", "yam", "potato"),
            _choice("propagation_material", "stem_cuttings", "vine_cuttings", "tuber_pieces", "whole_tubers",
                    "true_seeds"),
        )
        + _ranges(
            plant_spacing_cm=(20, 150), row_spacing_cm=(50, 200), hilling_frequency=(0, 5),
            storage_root_yield_tha=(1, 50), dry_matter_content=(15, 45), starch_content=(60, 85),
            fiber_content=(0.5, 5), beta_carotene_mg100g=(0, 15), storage_duration_days=(1, 365),
            post_harvest_losses=(0, 50),
        ),
    ),
    "tree_crops": Model(
        "tree_crops_file",
        (
            _choice("crop_type", "cocoa", "coffee", "oil_palm", "mango", "plantain_banana"),
            _choice("shade_management", "full_sun", "partial_shade", "heavy_shade"),
            _choice("pruning_intensity", "none", "light", "moderate", "heavy"),
            _choice("pest_pressure", "low", "moderate", "high"),
            _choice("quality_grade", "grade_1", "grade_2", "standard", "below_standard"),
            _choice("processing_type", "fresh_consumption", "dried", "fermented", "oil_extraction"),
        )
        + _ranges(
            planting_year=(1980, 2024), tree_age_years=(1, 50), planting_density_trees_ha=(100, 2000),
            disease_incidence=(0, 100), annual_yield_kg_ha=(100, 5000),
        ),
    ),
}
