"""From raw survey rows to a compared model, and the shape of the feature table."""

from pyspark.sql import functions as F

from harrow.functions.constants import ENGINEERED_FEATURES
from harrow.operators.cleaning import clamp_survey, clean_survey, repair_consistency
from harrow.operators.crops import crop_varieties, with_crop_profile
from harrow.operators.encoding import one_hot
from harrow.plans.survey import engineer, with_crop_group
from harrow.plans.training import train


def test_raw_rows_to_models(tables):
    clean = repair_consistency(clamp_survey(clean_survey(tables.obs, ["observation_date", "part_id", "yield_kg_ha"])))
    table = engineer(clean.drop("part_id", "station_id"), keep_ids=True)
    assert set(ENGINEERED_FEATURES) <= set(table.columns)
    assert table.count() == clean.count() == clean.select("record_id").distinct().count()
    run = train(table, ["record_id"], ("baseline", "ridge"), ids=("location_id", "altitude_class"))
    scores = [r["RMSE"] for r in run.comparison.collect()]
    assert len(scores) == 2 and scores == sorted(scores)
    assert not {"nue", "wue", "yield_gap_ratio"} & set(run.features)


def test_feature_table_drops_ids(tables):
    table = engineer(tables.obs)
    assert not {"record_id", "location_id", "altitude_class"} & set(table.columns)
    assert {"zone_sahel_savanna", "grp_cereals", "alt_plateau"} <= set(table.columns)


def test_one_hot_columns_do_not_depend_on_the_batch(spark):
    df = spark.createDataFrame([("a",), (None,)], "c string")
    hot = one_hot(df, "c", "p", ["a", "b"])
    assert hot.columns == ["c", "p_a", "p_b"]
    assert sorted(r[1:] for r in hot.collect()) == [(0, 0), (1, 0)]
    assert one_hot(df, "c", "p").columns == ["c", "p_a"]


def test_group_only_where_absent(spark):
    df = spark.createDataFrame([("maize",), ("teff",)], "crop_name string")
    assert {r[0]: r[1] for r in with_crop_group(df).collect()} == {"maize": "cereals", "teff": None}
    given = df.withColumn("crop_group", F.lit("mine"))
    assert with_crop_group(given).select("crop_group").distinct().count() == 1


def test_crop_attributes(spark):
    df = spark.createDataFrame([("maize",), ("mango",), ("teff",)], "crop_name string")
    got = {r["crop_name"]: r for r in with_crop_profile(df).collect()}
    assert got["maize"]["cycle_optimal"] == 120 and got["mango"]["cycle_min"] is None and got["mango"]["yield_average"] == 100
    assert got["teff"]["yield_max"] is None
    varieties = spark.createDataFrame([("maize", ["CMS_8704", "COCA_SR"])], "crop string, varieties array<string>")
    assert sorted(map(tuple, crop_varieties(df, varieties).collect())) == [("maize", "CMS_8704"), ("maize", "COCA_SR")]
