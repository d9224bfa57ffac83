from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions.constants import FEATURE_FILE_DROP, LEAKAGE_COLUMNS
from harrow.operators import cleaning
from harrow.plans.climate import export_climate, monthly_climate, rain_table
from harrow.runtime import shared_folder, stabilise
from harrow.sources import files


def grid(spark, first=2018, years=3):
    days = spark.range(years * 365).selectExpr(f"date_add(date'{first}-01-01', cast(id as int)) as time", "id")
    return days.selectExpr("time", "4.0D as latitude", "10.0D as longitude", "cast(id % 30 as double) as precipitation_daily")


def test_suffix_decides(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.5)], "a int, b double")
    df.write.parquet(str(tmp_path / "t.parquet"))
    df.write.option("header", True).csv(str(tmp_path / "t.csv"))
    for name in ("t.parquet", "t.csv"):
        back = files.load_dataset(spark, str(tmp_path / name))
        assert back.where("b is null").count() == 1 and back.where("b = 3.5").count() == 1
    with pytest.raises(ValueError, match="Unsupported format"):
        files.load_dataset(spark, "x.xlsx")


def test_feature_csv_needs_its_columns(spark, tmp_path):
    names = ["yield_kg_ha", *LEAKAGE_COLUMNS, *FEATURE_FILE_DROP, "latitude"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    path = str(tmp_path / "f.csv")
    spark.createDataFrame([tuple("1" for _ in names)], schema).write.option("header", True).csv(path)
    assert files.load_feature_csv(spark, path, schema).count() == 1
    short = T.StructType([f for f in schema.fields if f.name not in ("nue", "season")])
    with pytest.raises(ValueError, match=r"\['nue', 'season'\]"):
        files.load_feature_csv(spark, path, short)


def test_delimited(spark, tmp_path):
    df = spark.createDataFrame([("é", 1), ("b", 2)], "name string, n int")
    path = files.write_delimited(df, str(tmp_path / "d"), ["n", "name"], ";", "ISO-8859-1")
    back = files.read_delimited(spark, path, ["n", "name"], ";", "ISO-8859-1")
    assert sorted(map(tuple, back.collect())) == [("1", "é"), ("2", "b")]
    with pytest.raises(ValueError, match="No data"):
        files.write_delimited(df.limit(0), str(tmp_path / "e"))


def test_delimited_rows_are_derived_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(1000).repartition(1).mapInArrow(count, "id long")
    path = files.write_delimited(df, str(tmp_path / "once"), compression="gzip")
    assert seen.value == 1000 and files.read_delimited(spark, path, ["id"]).distinct().count() == 1000
    assert all(f.name.endswith(".csv.gz") for f in Path(path).glob("part-*"))
    with pytest.raises(ValueError, match="No data"):  # what stands there is not replaced by nothing
        files.write_delimited(df.limit(0), path)
    assert files.read_delimited(spark, path, ["id"]).count() == 1000
    with pytest.raises(ValueError, match="No data"):
        files.write_delimited(df.where("id < 0"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_json(spark, tmp_path):
    df = spark.createDataFrame([(1, {"a": 1.5})], "id int, m map<string,double>")
    path = files.write_json(df, str(tmp_path / "j"))
    assert files.read_json(spark, path, df.schema, multi_line=False).first()["m"] == {"a": 1.5}


def test_compression_is_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="compression"):
        files.csv_to_parquet(spark, "a.csv", compression="lzo")


def test_years_are_written_once(spark, tmp_path):
    path = str(tmp_path / "years")
    assert files.years_present(spark, path) == set()
    files.write_by_year(grid(spark, 2018, 1), path)
    files.append_new_years(grid(spark, 2018, 2), path)
    counts = {r["year"]: r["count"] for r in spark.read.parquet(path).groupBy("year").count().collect()}
    assert counts == {2018: 365, 2019: 365}


def test_a_bad_year_does_not_stop_the_others(spark, tmp_path):
    path, seen = str(tmp_path / "collect"), []

    def load(year):
        seen.append(year)
        if year == 2019:
            raise OSError("no such year")
        return grid(spark, year, 1)

    assert files.collect_years(spark, [2018, 2019, 2021], load, path) == [2018, 2021]
    assert files.collect_years(spark, [2018, 2019, 2021], load, path) == []
    assert seen == [2018, 2019, 2021, 2019]


def test_typed_survey(spark):
    raw = spark.createDataFrame([("2020-02-03", "true", "2", "x")], "observation_date string, irrigation_applied string, data_quality_flag string, season string")
    assert [f.dataType.simpleString() for f in files.typed_survey(raw).schema] == ["date", "boolean", "tinyint", "string"]


def test_export_names_carry_the_years(spark, tmp_path):
    parts = [grid(spark, 2018, 1), grid(spark, 2019, 1)]
    stats = rain_table(parts, aggregate_monthly=True, daily_stats=True)
    assert "max_dry_spell" in stats.columns
    path = export_climate(stats, str(tmp_path), "rain")
    assert path.endswith("rain_2018_2019.parquet")
    row = spark.read.parquet(path).where("time = date'2018-01-01'").first()
    assert (row["wet_days"], row["heavy_rain_days"], row["max_dry_spell"]) == (29, 9, 1)
    assert (row["agroecological_zone"], row["season"]) == ("humid_forest_inland", "grand_dry_season")
    assert rain_table(parts, daily_stats=False).count() == 730


def test_monthly_climate(spark):
    key = "date'2020-01-01' time, cast(id as double) latitude, 10.0D longitude"
    cells = spark.range(0, 20)
    parts = [cells.selectExpr(*key.split(", "), f"{v}D as {n}") for n, v in (("tmin", 200.0), ("tmax", 900.0), ("ppt", 90.0), ("pet", 600.0), ("aet", 300.0))]
    table = monthly_climate(parts)
    assert table.agg(F.min("latitude"), F.max("latitude")).first()[:] == (2.0, 13.0)
    row = table.first()
    assert (row["temperature_max"], row["temperature_mean"], row["aridity_index"], row["crop_water_stress"]) == (50.0, 50.0, 1.5, 0.5)


# --- cleaning -------------------------------------------------------------------------
def test_targets(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, "a")], "yield_tha double, yield_kg_ha double, latitude double, crop_name string")
    table, target = cleaning.model_columns(df)
    assert target == "yield_tha" and table.columns == ["yield_tha", "latitude"]
    assert cleaning.target_column(df, ("yield_kg_ha",)) == "yield_kg_ha"
    with pytest.raises(ValueError, match="No target column"):
        cleaning.target_column(df.select("latitude"))


def test_medians_are_reused(spark):
    train = spark.createDataFrame([(1.0, 10.0), (3.0, 20.0), (5.0, 30.0)], "a double, b double")
    _, values = cleaning.handle_missing(train)
    test = spark.createDataFrame([(None, None)], "a double, b double")
    assert cleaning.handle_missing(test, values)[0].first()[:] == (3.0, 20.0)


def test_whole_number_column_holds_a_half(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    filled, _ = cleaning.handle_missing(df)
    assert sorted(r["a"] for r in filled.collect()) == [1.0, 1.5, 2.0]


def test_coordinate_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, "d")], "lat double, lon double, time string")
    assert cleaning.normalise_coordinates(df).columns == ["latitude", "longitude", "time"]
    with pytest.raises(ValueError, match="None of"):
        cleaning.detect_column(df, ["x"])


def test_period_keeps_the_last_day(spark):
    from datetime import date

    df = spark.sql("select timestamp'2020-01-31 23:59:59' as time union all select timestamp'2020-02-01 00:00:00'")
    assert cleaning.inside_period(df, date(2020, 1, 1), date(2020, 1, 31)).count() == 1


def test_unknown_table_type(spark):
    with pytest.raises(ValueError, match="Unknown table type"):
        cleaning.clean_table(spark.range(1), "trees", ["id"])


def test_the_session_names_the_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return "/shared/stages" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert shared_folder(Session()) == "/shared/stages"
    # a local test has none: one temporary folder is made and kept
    assert shared_folder(spark) == shared_folder(spark)
    assert stabilise(spark.range(5)).count() == 5
