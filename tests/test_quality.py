"""Literal rows of the declared models."""

from datetime import date

import pytest

from harrow.operators import schemas
from harrow.operators.quality import apply_rules, model_rules, quarantine, schema_mismatches, validate, violations


def judged(spark, model, schema, *values):
    return validate(spark.createDataFrame([values], schema), model).first()


PLACE = "latitude double, longitude double, elevation double"
TEXTURE = "sand_percentage double, silt_percentage double, clay_percentage double, texture_class string"


@pytest.mark.parametrize("lat,lon,elev,ok", [(3.9, 11.5, 700.0, True), (1.5, 11.5, 700.0, False), (3.9, 16.3, 0.0, False), (None, 9.0, 0.0, False), (13.1, 16.2, 4095.0, True)])
def test_coordinates(spark, lat, lon, elev, ok):
    assert judged(spark, schemas.COORDINATES, PLACE, lat, lon, elev)["is_valid"] is ok


@pytest.mark.parametrize("s,si,c,name,word", [(45.0, 33.0, 22.0, "loam", ""), (50.0, 50.0, 50.0, "loam", "100%"), (45.0, 33.5, 22.0, "loam", ""), (45.0, 33.0, 22.0, "mud", "allowed")])
def test_texture(spark, s, si, c, name, word):
    row = judged(spark, schemas.TEXTURE, TEXTURE, s, si, c, name)
    assert row["is_valid"] == (word == "") and all(word in e for e in row["errors"])


def test_every_message_is_kept(spark):
    row = judged(spark, schemas.TEXTURE, TEXTURE, -1.0, 120.0, None, "mud")
    assert row["errors"] == [
        "sand_percentage: outside [0, 100]", "silt_percentage: outside [0, 100]", "clay_percentage: required",
        "texture_class: not an allowed value",
    ]


def test_water_fill_in(spark):
    schema = "field_capacity double, wilting_point double, available_water_capacity double"
    assert judged(spark, schemas.WATER, schema, 0.32, 0.18, None)["available_water_capacity"] == pytest.approx(0.14)
    assert judged(spark, schemas.WATER, schema, 0.32, 0.18, 0.15)["available_water_capacity"] == 0.15
    assert judged(spark, schemas.WATER, schema, 0.10, 0.18, None)["available_water_capacity"] == 0.0


def test_chemistry_fill_in(spark):
    schema = "ph_water double, organic_carbon double, total_nitrogen double"
    row = judged(spark, schemas.CHEMICAL, schema, 6.0, 2.0, 0.2)
    assert row["organic_matter"] == pytest.approx(3.448) and row["c_n_ratio"] == pytest.approx(10)
    assert judged(spark, schemas.CHEMICAL, schema, 6.0, 2.0, None)["c_n_ratio"] is None
    # a derived ratio outside its range is not judged
    assert judged(spark, schemas.CHEMICAL, schema, 6.0, 9.0, 0.01)["is_valid"]


def test_physics(spark):
    schema = "bulk_density double, porosity double"
    assert judged(spark, schemas.PHYSICAL, schema, 1.35, None)["porosity"] == pytest.approx(49.06, abs=0.01)
    assert judged(spark, schemas.PHYSICAL, schema, 1.35, 50.0)["porosity"] == 50.0
    assert not judged(spark, schemas.PHYSICAL, schema, 0.5, None)["is_valid"]
    assert not judged(spark, schemas.PHYSICAL, schema, 2.5, None)["is_valid"]


def test_temperature(spark):
    schema = "temperature_min double, temperature_max double, temperature_avg double"
    row = judged(spark, schemas.TEMPERATURE, schema, 20.0, 30.0, None)
    assert row["temperature_avg"] == 25 and row["temperature_range"] == 10
    assert judged(spark, schemas.TEMPERATURE, schema, 20.0, 30.0, 26.0)["temperature_avg"] == 26
    assert not judged(spark, schemas.TEMPERATURE, schema, -10.0, 30.0, None)["is_valid"]
    assert judged(spark, schemas.TEMPERATURE, schema, None, 30.0, None)["temperature_avg"] is None


@pytest.mark.parametrize("hpa,ok", [(620.0, True), (500.0, False), (1100.0, False)])
def test_pressure(spark, hpa, ok):
    assert judged(spark, schemas.PRESSURE, "atmospheric_pressure double", hpa)["is_valid"] is ok


def test_weather_day(spark):
    schema = "station_id string, date date, latitude double"
    row = judged(spark, schemas.WEATHER, schema, "s1", date(2024, 2, 14), None)
    assert row["day_of_year"] == 45 and row["rainfall_regime"] is None and row["version"] == 1
    row = judged(spark, schemas.WEATHER, schema, "s1", date(2024, 1, 15), 3.87)
    assert (row["season"], row["rainfall_regime"]) == ("grand_dry_season", "bimodal")
    row = judged(spark, schemas.WEATHER, schema, "s1", date(2024, 7, 15), 10.5)
    assert (row["season"], row["rainfall_regime"]) == ("rainy_season", "monomodal")
    assert not judged(spark, schemas.WEATHER, schema, None, date(2024, 7, 15), 10.5)["is_valid"]


def test_yield(spark):
    schema = "yield_tha double, biomass_tha double"
    assert judged(spark, schemas.YIELD, schema, 3.5, 7.0)["is_valid"]
    assert "biomass" in judged(spark, schemas.YIELD, schema, 10.0, 5.0)["errors"][0]


@pytest.mark.parametrize("density,ok", [(100, True), (50, True), (49, False), (200001, False)])
def test_planting(spark, density, ok):
    assert judged(spark, schemas.PLANTING, "planting_density int", density)["is_valid"] is ok


@pytest.mark.parametrize("low,high,ok", [(1.0, 2.0, True), (2.0, 2.0, False), (3.0, 2.0, False), (None, 2.0, True)])
def test_variety(spark, low, high, ok):
    schema = "variety_name string, yield_potential_min double, yield_potential_max double"
    assert judged(spark, schemas.VARIETY, schema, "v", low, high)["is_valid"] is ok


def test_nested_crop(spark):
    schema = (
        "field_id string, crop_type string, season string, year int, latitude double, longitude double, "
        "yield_data struct<yield_tha:double,biomass_tha:double>, "
        "crop_health array<struct<disease_name:string,disease_type:string,incidence_percentage:double>>, "
        "irrigation struct<water_applied_mm:double>"
    )
    good = ("f", "maize", "rainy_season", 2020, 5.0, 10.0)
    row = judged(spark, schemas.CROP, schema, *good, (3.0, 6.0), [("rust", "fungal", 10.0)], (5.0,))
    assert row["is_valid"] and row["irrigation"]["irrigated"] is False and row["version"] == 1
    row = judged(spark, schemas.CROP, schema, *good, None, None, None)
    assert row["is_valid"] and row["irrigation"] is None
    row = judged(spark, schemas.CROP, schema, *good, (7.0, 6.0), [("rust", "fungal", 10.0), (None, "odd", 101.0)], None)
    assert row["errors"] == [
        "Yield cannot exceed total biomass", "crop_health.disease_name: required",
        "crop_health.disease_type: not an allowed value", "crop_health.incidence_percentage: outside [0, 100]",
    ]


def test_missing_required_block(spark):
    schema = f"field_id string, coordinates struct<{PLACE.replace(' double', ':double')}>"
    row = judged(spark, schemas.SOIL, schema, "f", (3.9, 11.5, 700.0))
    assert "texture: required" in row["errors"] and "coordinates: required" not in row["errors"]


def test_report_and_quarantine(spark):
    df = spark.createDataFrame([(3.9, 11.5, 1.0), (0.0, 11.5, 1.0), (0.0, 11.5, None)], PLACE)
    rules = model_rules(schemas.COORDINATES, df.schema)
    counts = {r["rule"]: r["n_rows"] for r in violations(df, rules).collect()}
    assert counts == {"latitude.range": 2, "elevation.required": 1}
    good, bad = quarantine(apply_rules(df, rules))
    assert good.count() == 1 and bad.count() == 2 and good.columns == df.columns


def test_declared_types(spark):
    df = spark.createDataFrame([("a", 1.0)], "record_id string, elevation double")
    assert schema_mismatches(df, schemas.SURVEY_TABLE.fields) == [("elevation", "float", "double")]


def test_crop_file_contract(spark):
    schema = "crop_type string, harvest_date date, planting_date date, yield_tha double, harvest_index double, biomass_tha double"
    model = schemas.CROP_FILES["cereals"]
    assert judged(spark, model, schema, "maize", date(2020, 6, 1), date(2020, 3, 1), 5.0, 0.5, 9.0)["is_valid"]
    row = judged(spark, model, schema, "yam", date(2020, 3, 1), date(2020, 3, 1), 5.0, 0.5, 2.0)
    assert row["errors"] == ["crop_type: not an allowed value", "harvest_date > planting_date", "yield_tha * harvest_index <= biomass_tha"]


def test_typed_weather_blocks(spark):
    kinds = {f.name: f.kind for f in schemas.EXTREME_EVENTS.fields}
    assert kinds["drought_event"] == "boolean" and kinds["dry_spell_length"] == "int" and len(kinds) == 9
    assert len(schemas.DERIVED_INDICES.fields) == 10
    df = spark.createDataFrame([("3", True)], "dry_spell_length string, drought_event boolean")
    assert schema_mismatches(df, schemas.EXTREME_EVENTS.fields) == [("dry_spell_length", "int", "string")]
