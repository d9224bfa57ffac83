"""Literal values of the scalar expressions."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.functions import climate, dates, features, geo, indices
from harrow.functions.nulls import clip, nan_to_null, np_round, row_mean


def day(text):
    return F.lit(text).cast("date")


# --- missing values and rounding ---------------------------------------------------
def test_clip_keeps_missing(one):
    assert one(clip(F.lit(None).cast("double"), 0, 1)) is None
    assert one(clip(F.lit(5.0), 0, 1)) == 1.0
    assert one(clip(F.lit(-5.0), low=0)) == 0.0


@pytest.mark.parametrize("value,digits", [(2.5, 0), (3.5, 0), (0.125, 2), (-1.25, 1), (1.005, 2), (2.675, 2)])
def test_rounding_is_numpy_rounding(one, value, digits):
    assert one(np_round(F.lit(value), digits)) == np.round(value, digits)


def test_nan_becomes_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b")], "x double, s string")
    assert nan_to_null(df).where("x is null").count() == 1


def test_row_mean_skips_missing(one):
    assert one(row_mean(F.lit(1.0), F.lit(None).cast("double"), F.lit(3.0))) == 2.0
    assert one(row_mean(F.lit(None).cast("double"))) is None


# --- dates ---------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text,latitude,season",
    [
        ("2024-07-15", 6.0, "rainy_season"), ("2024-07-15", 5.99, "petit_dry_season"),
        ("2024-07-15", None, "petit_dry_season"), ("2024-10-01", 7.0, "late_rainy"),
        ("2024-01-15", 3.87, "grand_dry_season"), ("2024-07-15", 10.5, "rainy_season"),
        ("2024-04-01", 9.0, "early_rainy"), ("2024-11-30", 9.0, "dry_season"), ("2024-11-30", 3.0, "transition_to_dry"),
        ("2024-09-01", 3.0, "second_rainy_season"), ("2024-03-01", 3.0, "first_rainy_season"),
    ],
)
def test_season(one, text, latitude, season):
    assert one(dates.agricultural_season(day(text), F.lit(latitude).cast("double"))) == season


def test_season_without_latitude_column(one):
    assert one(dates.agricultural_season(day("2024-12-01"))) == "grand_dry_season"


@pytest.mark.parametrize("text,doy", [("2024-01-01", 1), ("2023-12-31", 365), ("2024-12-31", 366), ("2024-02-14", 45)])
def test_day_of_year(one, text, doy):
    assert one(dates.day_of_year(day(text))) == doy


@pytest.mark.parametrize("low,high,base,gdd", [(20, 30, 10, 15), (5, 10, 10, 0), (20, 30, 15, 10)])
def test_growing_degree_days(one, low, high, base, gdd):
    assert one(dates.growing_degree_days(F.lit(float(low)), F.lit(float(high)), base)) == gdd


@pytest.mark.parametrize("a,b,n", [("2024-01-01", "2024-01-01", 1), ("2024-01-01", "2024-01-03", 3), ("2024-01-03", "2024-01-01", 0)])
def test_date_range(one, a, b, n):
    assert one(F.size(dates.date_range(day(a), day(b)))) == n


@pytest.mark.parametrize(
    "a,b,word",
    [
        ("2024-02-01", "2024-01-01", "before"), ("2000-01-01", "2020-01-01", "10 years"),
        ("2031-01-01", None, "Start date cannot be in the future"), (None, "2031-01-01", "End date cannot be in the future"),
        (None, None, ""), ("2024-01-01", "2024-06-01", ""),
    ],
)
def test_check_date_range(one, a, b, word):
    got = one(dates.check_date_range(day(a), day(b), day("2025-01-01")))
    assert got["is_valid"] == (word == "") and word in got["message"]


@pytest.mark.parametrize(
    "text,parsed",
    [
        ("2024-01-15", date(2024, 1, 15)), ("15/01/2024", date(2024, 1, 15)), ("01/15/2024", date(2024, 1, 15)),
        ("2024/01/15", date(2024, 1, 15)), ("15-01-2024", date(2024, 1, 15)), ("01-15-2024", date(2024, 1, 15)),
        ("05/04/2024", date(2024, 4, 5)), ("not-a-date", None), ("", None), ("2024-01-15x", None), ("2023-02-30", None),
    ],
)
def test_parse_date(one, text, parsed):
    assert one(dates.parse_date(F.lit(text))) == parsed


def test_season_encodings(one):
    assert one(dates.season_ordinal(F.lit("late_rainy"))) == 4
    assert one(dates.season_ordinal(F.lit("main_season"))) == 0
    assert one(dates.season_ordinal(F.lit(None).cast("string"))) == 0
    assert one(dates.is_rainy_season(F.lit("early_rainy"))) == 1
    assert one(dates.is_rainy_season(F.lit("petit_dry_season"))) == 0


# --- geography ----------------------------------------------------------------------------
@pytest.mark.parametrize(
    "lat,lon,elevation,zone",
    [
        (10.5, 14.3, 420, "sahel_savanna"), (9.3, 13.4, 213, "sudan_savanna"), (7.3, 13.6, 1100, "guinea_savanna"),
        (5.95, 10.15, 1600, "western_highlands"), (6.5, 12.0, 1500, "guinea_savanna"),
        (5.5, 13.5, 600, "forest_savanna_transition"), (4.05, 9.77, 13, "humid_forest_coast"),
        (4.0, 9.2, 50, "humid_forest_coast"), (3.87, 11.52, 650, "humid_forest_inland"),
        (2.9, 11.15, 600, "humid_forest_inland"), (4.2, 9.17, 3000, "mont_cameroun_volcanic"),
        (4.35, 9.35, 2501, "mont_cameroun_volcanic"), (10.0, 14.0, 300, "sudan_savanna"),
    ],
)
def test_zone(one, lat, lon, elevation, zone):
    assert one(geo.agroecological_zone(F.lit(lat), F.lit(lon), F.lit(float(elevation)))) == zone


@pytest.mark.parametrize(
    "lat,lon,word",
    [(3.8667, 11.5167, ""), (1.0, 11.0, "Latitude"), (5.0, 7.0, "Longitude"), (1.6, 8.3, ""), (13.1, 16.2, ""), (1.0, 7.0, "Latitude")],
)
def test_check_coordinates(one, lat, lon, word):
    got = one(geo.check_coordinates(F.lit(lat), F.lit(lon)))
    assert got["is_valid"] == (word == "") and word in got["message"]


def test_haversine(one):
    assert one(geo.haversine_km(*map(F.lit, (3.0, 11.0, 3.0, 11.0)))) == 0.0
    assert 190 < one(geo.haversine_km(*map(F.lit, (3.8667, 11.5167, 4.0511, 9.7679)))) < 230
    assert one(geo.haversine_km(*map(F.lit, (0.0, 0.0, 0.0, 180.0)))) == pytest.approx(math.pi * 6371)


def test_bounding_box_and_slope(one):
    box = one(geo.bounding_box(F.lit(0.0), F.lit(10.0), F.lit(111.0)))
    assert (box["north"], box["south"], box["east"], box["west"]) == pytest.approx((1, -1, 11, 9))
    assert one(geo.slope_degrees(F.lit(100.0), F.lit(100.0))) == pytest.approx(45)
    assert one(geo.slope_degrees(F.lit(100.0), F.lit(0.0))) == 0.0


@pytest.mark.parametrize("lon,zone", [(10.0, "32N"), (13.0, "33N"), (12.0, "33N")])
def test_utm(one, lon, zone):
    got = one(geo.utm_simplified(F.lit(4.0), F.lit(lon)))
    meridian = 9 if zone == "32N" else 15
    assert got["zone"] == zone and got["easting"] == pytest.approx((lon - meridian) * 111320)
    assert got["northing"] == pytest.approx(4 * 111320) and got["datum"] == "WGS84"


def test_geojson(one):
    assert one(F.to_json(geo.geojson_point(F.lit(11.5), F.lit(3.9)))) == '{"type":"Point","coordinates":[11.5,3.9]}'


# --- climate -----------------------------------------------------------------------------
def test_derivations_skip_absent_inputs(spark):
    df = spark.createDataFrame([(1.0,)], "wind_speed double")
    assert climate.derive_all(df).columns == ["wind_speed"]


def test_derivations(spark):
    df = spark.createDataFrame(
        [(20.0, 30.0, 1.5, 200.0, 100.0, 0.0, 50.0), (10.0, 12.0, 9.0, 100.0, 60.0, 120.0, 30.0)],
        "temperature_min double, temperature_max double, vapor_pressure double, solar_radiation_raw double, "
        "precipitation_monthly double, potential_evapotranspiration double, actual_evapotranspiration double",
    )
    dry, wet = climate.derive_all(df).orderBy("temperature_min", ascending=False).collect()
    assert dry["temperature_mean"] == 25 and dry["diurnal_range"] == 10 and dry["gdd_base15"] == 10
    assert dry["solar_radiation"] == pytest.approx(17.28) and "solar_radiation_raw" not in dry
    assert dry["aridity_index"] is None and dry["crop_water_stress"] is None and dry["water_balance"] == 50
    assert wet["relative_humidity"] == 100 and wet["aridity_index"] == 0.5 and wet["crop_water_stress"] == 0.75
    assert wet["gdd_base15"] == 0


# --- features -----------------------------------------------------------------------------
@pytest.mark.parametrize("elevation,name", [(0, None), (200, "lowland"), (201, "plateau"), (800, "plateau"), (1200, "mid_altitude"), (2500, "highland"), (2501, "mountain"), (5001, None)])
def test_altitude_class(spark, elevation, name):
    df = spark.createDataFrame([(float(elevation),)], "elevation double")
    assert df.select(features.altitude_class()).first()[0] == name
    assert df.select(features.altitude_class("nan")).first()[0] == (name or "nan")


def test_constant_soil_column_counts_half(spark):
    from harrow.plans.survey import soil_and_inputs

    rows = [(6.25, 2.0, 0.5, 10.0, 0.0, 0.0, 0.0, True), (6.25, 2.0, 0.5, 10.0, 0.0, 0.0, 0.0, False)]
    df = spark.createDataFrame(
        rows,
        "ph_water double, organic_carbon double, total_nitrogen double, available_phosphorus double, "
        "fertilizer_nitrogen double, fertilizer_phosphorus double, organic_fertilizer double, irrigation_applied boolean",
    )
    got = soil_and_inputs(df).collect()
    assert {r["soil_fertility_index"] for r in got} == {0.625}
    assert sorted(r["input_intensity"] for r in got) == [0.0, 0.2]


# --- indices -------------------------------------------------------------------------------
def test_indices_guard_division(one):
    zero = F.lit(0.0)
    made = indices.vegetation_indices(*[zero] * 8)
    assert one(made["ndvi"]) is None and one(made["msi"]) is None


def test_classes(one):
    assert one(indices.salinity_class(F.lit(2.0))) == "slightly_saline"
    assert one(indices.sodicity_class(F.lit(12.9))) == "non_sodic"
    assert one(indices.harvest_index_in_range(F.lit("maize"), F.lit(0.5))) is True
    assert one(indices.harvest_index_in_range(F.lit("maize"), F.lit(0.6))) is False
    assert one(indices.harvest_index_in_range(F.lit("teff"), F.lit(0.6))) is None
    assert one(indices.temperature_humidity_index(F.lit(30.0), F.lit(50.0))) == pytest.approx(0.8 * 30 + 0.5 * 15.6 + 46.4)
