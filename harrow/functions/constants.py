"""Bounds, vocabularies, thresholds and scale factors of the domain."""

# --- Fixed values: country box, widened box and physical limits -------------
LAT_RANGE = (1.6, 13.1)
LON_RANGE = (8.3, 16.2)
ELEVATION_RANGE = (0, 4095)
BUFFER_DEG = 0.1
EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0
METRES_PER_DEGREE = 111320.0
RAIN_FILL_VALUE = -9999.0

# --- Fixed values: seasons ---------------------------------------------------
REGIME_LATITUDE = 6.0
MONOMODAL_SEASONS = {
    "dry_season": (11, 12, 1, 2, 3),
    "early_rainy": (4,),
    "rainy_season": (5, 6, 7, 8, 9),
    "late_rainy": (10,),
}
BIMODAL_SEASONS = {
    "grand_dry_season": (12, 1, 2),
    "first_rainy_season": (3, 4, 5),
    "petit_dry_season": (6, 7),
    "second_rainy_season": (8, 9, 10),
    "transition_to_dry": (11,),
}
SEASON_ORDINAL = {
    "grand_dry_season": 0,
    "dry_season": 0,
    "early_rainy": 1,
    "transition_to_dry": 1,
    "first_rainy_season": 2,
    "rainy_season": 2,
    "petit_dry_season": 3,
    "second_rainy_season": 4,
    "late_rainy": 4,
    "off_season": 0,
}
RAINY_SEASONS = ("first_rainy_season", "second_rainy_season", "rainy_season", "early_rainy", "late_rainy")

# --- Fixed values: date text formats, in order of trial ------------------------
DATE_PATTERNS = ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy", "M-d-yyyy")
MAX_RANGE_DAYS = 3650

# --- Fixed values: agro-ecological zones --------------------------------------
ZONES = (
    "sahel_savanna",
    "sudan_savanna",
    "guinea_savanna",
    "forest_savanna_transition",
    "humid_forest_inland",
    "humid_forest_coast",
    "western_highlands",
    "mont_cameroun_volcanic",
)
VOLCANIC_BOX = {"lat": (4.0, 4.35), "lon": (9.0, 9.35), "above": 2500.0}
HIGHLANDS = {"lat": (4.5, 7.5), "max_lon": 11.5, "above": 1200.0}
LATITUDE_ZONES = (
    (10.0, "sahel_savanna"),
    (8.0, "sudan_savanna"),
    (6.0, "guinea_savanna"),
    (5.0, "forest_savanna_transition"),
)
COAST = {"max_lon": 10.0, "max_elevation": 500.0}
ALTITUDE_CLASSES = (
    (0, 200, "lowland"),
    (200, 800, "plateau"),
    (800, 1200, "mid_altitude"),
    (1200, 2500, "highland"),
    (2500, 5000, "mountain"),
)

# --- Fixed values: raw monthly grid variables (source, project name, factor) ---
MONTHLY_GRID_VARIABLES = (
    ("tmin", "temperature_min", 0.1),
    ("tmax", "temperature_max", 0.1),
    ("ppt", "precipitation_monthly", 1.0),
    ("srad", "solar_radiation_raw", 0.1),
    ("vap", "vapor_pressure", 0.001),
    ("vpd", "vapor_pressure_deficit", 0.01),
    ("def", "climate_water_deficit", 0.1),
    ("soil", "soil_moisture", 0.1),
    ("aet", "actual_evapotranspiration", 0.1),
    ("pet", "potential_evapotranspiration", 0.1),
    ("ws", "wind_speed", 0.01),
)

# --- Fixed values: climate bounds ----------------------------------------------
CLIMATE_BOUNDS = {
    "temperature_min": (-5, 50),
    "temperature_max": (-5, 50),
    "precipitation_monthly": (0, 2000),
    "vapor_pressure": (0, 10),
    "vapor_pressure_deficit": (0, 15),
    "climate_water_deficit": (0, 500),
    "soil_moisture": (0, 1000),
    "actual_evapotranspiration": (0, 500),
    "potential_evapotranspiration": (0, 500),
    "wind_speed": (0, 30),
    "solar_radiation_raw": (0, 500),
    "temperature_mean": (-5, 50),
    "relative_humidity": (0, 100),
    "solar_radiation": (0, 40),
    "diurnal_range": (0, 35),
    "aridity_index": (0, 30),
    "water_balance": (-300, 1500),
    "crop_water_stress": (0, 1),
    "gdd_base10": (0, 40),
    "gdd_base15": (0, 35),
    "precipitation_daily": (0, 500),
    "heavy_rain_days": (0, 31),
    "wet_days": (0, 31),
    "max_dry_spell": (0, 31),
    "rain_intensity_max": (0, 500),
    "precipitation_std": (0, 200),
}

# --- Fixed values: survey bounds -------------------------------------------------
SURVEY_BOUNDS = {
    "latitude": LAT_RANGE,
    "longitude": LON_RANGE,
    "elevation": ELEVATION_RANGE,
    "temperature_min": (-5, 45),
    "temperature_max": (5, 50),
    "temperature_mean": (0, 40),
    "precipitation_daily": (0, 500),
    "relative_humidity": (0, 100),
    "solar_radiation": (0, 35),
    "ph_water": (3.5, 9.5),
    "organic_carbon": (0.1, 10.0),
    "total_nitrogen": (0.01, 1.0),
    "available_phosphorus": (1, 150),
    "sand_percentage": (0, 100),
    "clay_percentage": (0, 100),
    "fertilizer_nitrogen": (0, 400),
    "fertilizer_phosphorus": (0, 200),
    "organic_fertilizer": (0, 50),
    "disease_incidence": (0, 100),
    "yield_kg_ha": (0, 200000),
    "biomass_kg_ha": (0, 500000),
    "harvest_index": (0.05, 0.95),
}

# --- Fixed values: crops -----------------------------------------------------------
CROPS_BY_GROUP = {
    "cereals": ("maize", "rice", "sorghum", "millet", "wheat"),
    "legumes": ("cowpea", "groundnut", "common_bean", "soybean"),
    "root_tubers": ("cassava", "sweet_potato", "yam", "potato"),
    "vegetables": ("tomato", "pepper", "onion", "cabbage", "carrot", "lettuce", "cucumber", "okra"),
    "tree_crops": ("cocoa", "coffee", "oil_palm", "mango", "plantain_banana", "pineapple", "papaya"),
}
CROP_GROUP = {crop: group for group, crops in CROPS_BY_GROUP.items() for crop in crops}

# Crop -> (cycle min, max, optimal days or None; yield potential min, max, average t/ha)
CROP_PROFILE = {
    "maize": (90, 140, 120, 1.0, 8.0, 2.5),
    "rice": (105, 150, 120, 1.5, 6.0, 3.2),
    "sorghum": (100, 130, 115, 0.8, 4.0, 1.8),
    "millet": (75, 110, 90, 0.5, 3.0, 1.2),
    "cowpea": (60, 90, 75, 0.3, 2.5, 0.8),
    "groundnut": (90, 120, 105, 0.5, 3.0, 1.2),
    "common_bean": (65, 100, 80, 0.4, 2.0, 0.9),
    "soybean": (100, 130, 115, 0.8, 3.5, 1.5),
    "cassava": (300, 540, 365, 8.0, 40.0, 15.0),
    "sweet_potato": (90, 150, 120, 5.0, 25.0, 12.0),
    "yam": (180, 300, 240, 10.0, 35.0, 18.0),
    "potato": (90, 120, 105, 8.0, 30.0, 15.0),
    "tomato": (70, 120, 90, 15.0, 80.0, 35.0),
    "pepper": (80, 130, 100, 8.0, 40.0, 18.0),
    "onion": (100, 140, 120, 10.0, 40.0, 20.0),
    "cabbage": (80, 120, 100, 20.0, 60.0, 35.0),
    "carrot": (70, 100, 85, 15.0, 50.0, 25.0),
    "lettuce": (45, 80, 60, 8.0, 25.0, 15.0),
    "cucumber": (50, 70, 60, 10.0, 40.0, 20.0),
    "okra": (55, 90, 70, 5.0, 20.0, 10.0),
    "plantain_banana": (300, 450, 365, 20.0, 60.0, 35.0),
    "pineapple": (450, 600, 540, 30.0, 80.0, 50.0),
    "papaya": (300, 400, 365, 40.0, 100.0, 60.0),
    "mango": (None, None, None, 50.0, 200.0, 100.0),
    "cocoa": (None, None, None, 0.3, 1.5, 0.6),
    "coffee": (None, None, None, 0.5, 2.0, 0.8),
    "cotton": (150, 200, 175, 0.8, 2.5, 1.2),
    "oil_palm": (None, None, None, 8.0, 25.0, 15.0),
}

HARVEST_INDEX_RANGE = {
    "maize": (0.45, 0.55),
    "rice": (0.40, 0.55),
    "sorghum": (0.25, 0.40),
    "millet": (0.20, 0.35),
    "cowpea": (0.25, 0.40),
    "groundnut": (0.30, 0.45),
    "common_bean": (0.35, 0.50),
    "soybean": (0.35, 0.50),
    "cassava": (0.50, 0.70),
    "sweet_potato": (0.50, 0.65),
    "yam": (0.45, 0.60),
    "potato": (0.70, 0.85),
    "tomato": (0.55, 0.70),
    "pepper": (0.40, 0.55),
    "onion": (0.65, 0.80),
    "cabbage": (0.50, 0.70),
    "carrot": (0.55, 0.75),
    "lettuce": (0.60, 0.80),
    "cucumber": (0.55, 0.70),
    "okra": (0.30, 0.45),
    "plantain_banana": (0.30, 0.45),
    "cocoa": (0.20, 0.30),
    "coffee": (0.25, 0.35),
    "oil_palm": (0.20, 0.30),
    "mango": (0.30, 0.45),
    "pineapple": (0.40, 0.55),
    "cotton": (0.30, 0.45),
}

# --- Fixed values: column names --------------------------------------------------
CANONICAL_NAMES = {"yield_grain": "yield_kg_ha", "biomass_total": "biomass_kg_ha", "season_type": "season"}
CATEGORY_COLUMNS = ("data_source", "agroecological_zone", "season", "crop_name", "crop_group")
LEAKAGE_COLUMNS = ("nue", "wue", "yield_gap_ratio", "harvest_index", "biomass_kg_ha")
TARGETS = ("yield_tha", "yield_kg_ha")
FEATURE_FILE_DROP = (
    "observation_date", "data_source", "agroecological_zone", "season", "crop_name", "crop_group",
)
ID_AND_TEXT_COLUMNS = (
    "field_id", "observation_date", "planting_date", "harvest_date", "data_source", "agroecological_zone",
    "season", "crop_name", "crop_type", "crop_group", "variety",
)
CONTINUOUS_FEATURES = (
    "latitude", "longitude", "elevation", "temperature_min", "temperature_max", "temperature_mean",
    "precipitation_daily", "relative_humidity", "solar_radiation", "ph_water", "organic_carbon",
    "total_nitrogen", "available_phosphorus", "sand_percentage", "clay_percentage", "fertilizer_nitrogen",
    "fertilizer_phosphorus", "organic_fertilizer", "disease_incidence", "month_sin", "month_cos", "doy_sin",
    "doy_cos", "gdd_base10", "gdd_base15", "diurnal_range", "aridity_index", "vpd_kpa",
    "temp_altitude_residual", "soil_fertility_index", "cn_ratio", "cec_estimate", "input_intensity",
    "total_mineral_fert", "organic_mineral_ratio", "humidity_temp_interaction", "rain_oc_interaction",
    "input_soil_interaction", "water_supply_index", "disease_risk_score",
)
BINARY_FEATURES = (
    "irrigation_applied", "heavy_rain_day", "is_rainy_season", "data_quality_flag", "rainfall_regime",
    "zone_coastal_forest", "zone_forest_savanna", "zone_guinea_savanna", "zone_highlands",
    "zone_mont_cameroun_volcanic", "zone_sahel_savanna", "grp_cereals", "grp_industrial_crops",
    "grp_legumes", "grp_root_tubers", "grp_tree_crops", "grp_vegetables", "alt_highland", "alt_lowland",
    "alt_mid_altitude", "alt_mountain", "alt_plateau",
)
ORDINAL_FEATURES = ("month", "day_of_year", "year", "season_ordinal")
ENGINEERED_FEATURES = (
    "month", "day_of_year", "year", "month_sin", "month_cos", "doy_sin", "doy_cos", "season_ordinal",
    "is_rainy_season", "gdd_base10", "gdd_base15", "diurnal_range", "aridity_index", "vpd_kpa",
    "temp_altitude_residual", "heavy_rain_day", "soil_fertility_index", "cn_ratio", "cec_estimate",
    "input_intensity", "total_mineral_fert", "organic_mineral_ratio", "rainfall_regime",
    "humidity_temp_interaction", "rain_oc_interaction", "input_soil_interaction", "water_supply_index",
    "disease_risk_score", "nue", "wue", "yield_gap_ratio",
)
WEATHER_SEQUENCE_FEATURES = (
    "temperature_min", "temperature_max", "precipitation_daily", "relative_humidity", "solar_radiation",
)
