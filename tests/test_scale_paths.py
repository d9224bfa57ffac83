"""The ways taken past the size limits give the same rows as the direct ones."""

import random
import time
from collections import defaultdict

import numpy as np
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from harrow.operators import grids, sampling
from harrow.operators.cleaning import first_per_key
from harrow.operators.lookup import bounded, lookup_join, with_group_stats
from harrow.operators.quantiles import exact_percentiles
from harrow.runtime import release, shared_folder, stabilise
from harrow.operators.series import fill_short_gaps, weather_sequences


def same(a, b):
    columns = sorted(a.columns)
    rows = [sorted(map(str, d.select(*columns).collect())) for d in (a, b)]
    assert rows[0] == rows[1]
    return len(rows[0])


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on one key, some rows without a key."""
    return spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 97).cast("int").alias("k"),
        (F.col("id") % 11).cast("double").alias("x"),
    )


def test_bounded(spark):
    assert bounded(spark.range(10), 9) is None
    assert bounded(spark.range(10), 10).count() == 10


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_with_hot_keys(spark, skewed, how):
    lookup = spark.range(5, 200).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    small = lookup_join(skewed, lookup, "k", how)
    large = lookup_join(skewed, lookup, "k", how, max_rows=3, hot_share=10)
    assert same(small, large) == small.count()


def test_group_stats_match_window(spark, skewed):
    a = with_group_stats(skewed, "k", m=F.avg("x"), n=F.count(F.lit(1)))
    b = with_group_stats(skewed, "k", max_rows=3, m=F.avg("x"), n=F.count(F.lit(1)))
    same(a, b)
    brute = defaultdict(list)
    for r in skewed.collect():
        brute[r["k"]].append(r["x"])
    for r in a.collect():
        assert r["m"] is None if r["k"] is None else r["m"] == pytest.approx(np.mean(brute[r["k"]]))


@pytest.mark.parametrize("max_values,direct_rows", [(20_000, 1_000_000), (20_000, 0), (20, 0)])
def test_exact_percentiles(spark, max_values, direct_rows):
    rng = random.Random(5)
    values = [rng.choice([1.0, 2.0, rng.gauss(0, 1), rng.lognormvariate(0, 8)]) for _ in range(3001)]
    rows = [(v if i % 7 else None, float(i % 2), None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_percentiles(df, ["a", "b", "c"], ps, accuracy=50, max_values=max_values, direct_rows=direct_rows)
    a = [r[0] for r in rows if r[0] is not None]
    assert got["a"] == pytest.approx(list(np.quantile(a, ps)), rel=1e-12)
    assert got["b"] == pytest.approx(list(np.quantile([r[1] for r in rows], ps)))
    assert got["c"] == [None] * len(ps)


def test_exact_percentiles_survive_a_wrong_sketch(spark, monkeypatch):
    """Counting catches brackets that miss the rank."""
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"))
    monkeypatch.setattr(F, "percentile_approx", lambda c, ps, accuracy: F.array(F.lit(1.0), F.lit(2.0)))
    assert exact_percentiles(df, ["a"], [0.5], direct_rows=10)["a"] == [499.5]


@pytest.mark.parametrize("quota", [0, 1, 37, 999, 1000, 5000])
def test_bounded_sample_is_exact(spark, quota):
    df = spark.range(1000).select(F.col("id").alias("key"))
    picked = {r[0] for r in sampling.bounded_sample(df, ["key"], quota).collect()}
    hashes = sorted((r["h"], r["key"]) for r in df.withColumn("h", sampling.row_hash(["key"], 42)).collect())
    assert picked == {k for _, k in hashes[:quota]}


def test_sample_with_short_prefix(spark, monkeypatch):
    """Many rows share the prefix that crosses the quota."""
    df = spark.range(1000).select(F.col("id").alias("key"))
    direct = sorted(sampling.bounded_sample(df, ["key"], 333).collect())
    monkeypatch.setattr(sampling, "DIGITS", 1)
    monkeypatch.setattr(sampling, "RANKED_ROWS", 5)
    assert sorted(sampling.bounded_sample(df, ["key"], 333).collect()) == direct and len(direct) == 333


def test_long_prefixes_per_stratum(spark, monkeypatch):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("z"), F.col("id") % 5)).alias("zone"))
    direct = sampling.stratified_split(df, ["id"], "zone")
    monkeypatch.setattr(sampling, "DIGITS", 1)
    monkeypatch.setattr(sampling, "RANKED_ROWS", 5)
    same(direct, sampling.stratified_split(df, ["id"], "zone"))


def test_copies_of_a_key_stay_together(spark):
    df = spark.range(900).select((F.col("id") % 300).alias("key"), "id")
    split = sampling.validation_split(df, ["key"], 0.2)
    sides = split.groupBy("key").agg(F.count_distinct("is_validation").alias("n")).where("n > 1").count()
    assert sides == 0 and split.where("is_validation").count() <= 180


def test_stratified_split(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("z"), F.col("id") % 7)).alias("zone"))
    split = sampling.stratified_split(df, ["id"], "zone", 0.15)
    assert split.count() == 5000
    gaps = sampling.stratified_split(df.withColumn("zone", F.when(F.col("zone") != "hot", F.col("zone"))), ["id"], "zone")
    missing = gaps.where("zone is null").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).first()
    assert missing["t"] == round(missing["n"] * 0.15)
    for r in split.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r["t"] == round(r["n"] * 0.15)
    plain = sampling.stratified_split(df.drop("zone"), ["id"], "zone", 0.15)
    assert plain.where("is_test").count() == 750


def test_group_split(spark):
    df = spark.range(1000).select("id", (F.col("id") % 9).cast("string").alias("agroecological_zone"))
    split = sampling.group_split(df)
    sides = {tuple(r) for r in split.select("agroecological_zone", "is_test").distinct().collect()}
    assert len(sides) == 9 and sum(t for _, t in sides) == 2


def test_first_per_key_limits_before_the_shuffle(spark, skewed, capsys):
    plan = first_per_key(skewed, "k", ["id"])
    plan.explain()
    text = capsys.readouterr().out
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")
    assert plan.where("k = 7").first()["id"] == 0


def test_sequences_keep_every_day(spark):
    df = spark.range(500).selectExpr("id % 400 div 399 as k", "date_add(date'2020-01-01', cast(id as int)) as d", "cast(id as double) as x")
    rows = {r["k"]: r for r in weather_sequences(df, "k", "d", ["x"]).collect()}
    assert rows[0]["length"] == 499 and [s[0] for s in rows[0]["sequence"]] == [float(i) for i in range(500) if i != 399]
    assert rows[1]["length"] == 1 and len(rows[1]["sequence"]) == 499 and rows[1]["sequence"][1] == [0.0]
    short = weather_sequences(df.limit(3), "k", "d", ["x"], 5).first()
    assert short["length"] == 3 and [s[0] for s in short["sequence"]] == [0.0, 1.0, 2.0, 0.0, 0.0]
    with pytest.raises(Exception, match="is longer than 180"):
        weather_sequences(df, "k", "d", ["x"], 180).collect()


def test_gaps_keep_rows_and_columns(spark):
    days = spark.createDataFrame(
        [("a", 1, 1.0, "x"), ("a", 3, 3.0, "y"), ("a", 4, None, "z"), ("a", 5, 5.0, "u"), ("a", 12, None, "v"), ("a", 20, 9.0, "w"), (None, 2, None, "n")],
        "s string, n int, v double, note string",
    ).selectExpr("s", "date_add(date'2020-01-01', n) as d", "v", "note")
    rows = sorted(((r["s"], r["d"].day, r["v"], r["note"], r["is_filled"]) for r in fill_short_gaps(days, "s", "d", "v").collect()), key=str)
    assert rows == sorted([
        ("a", 2, 1.0, "x", False), ("a", 3, 2.0, None, True), ("a", 4, 3.0, "y", False), ("a", 5, 4.0, "z", True), ("a", 6, 5.0, "u", False),
        ("a", 13, None, "v", False), ("a", 21, 9.0, "w", False), (None, 3, None, "n", False),
    ], key=str)


def test_sample_takes_its_number_from_ties(spark):
    one_key = spark.range(10).selectExpr("1 as key", "id")
    picked = [r["id"] for r in sampling.bounded_sample(one_key, ["key"], 5).collect()]
    assert sorted(picked) == [0, 1, 2, 3, 4]
    some = spark.range(100).selectExpr("id % 4 as key", "id")
    assert sampling.bounded_sample(some, ["key"], 60).count() == 60 and sampling.bounded_sample(some, ["key"], 200).count() == 100


def test_coordinates_beyond_half_circles(spark):
    cells = spark.createDataFrame([(t, 0.5, lon, 1.0) for t in (1, 2) for lon in (169.5, 170.0, 200.5)], "time int, latitude double, longitude double, v double")
    boxes = spark.createDataFrame([("east", -5.0, 5.0, 190.0, 210.0)], "zone string, lat_min double, lat_max double, lon_min double, lon_max double")
    assert {r["longitude"] for r in grids.zone_join(cells, boxes).collect()} == {200.5}
    points = spark.createDataFrame([(1, 0.0, 190.0), (2, 80.0, 300.0), (3, -80.0, -20.0)], "point_id int, latitude double, longitude double")
    near = {r["point_id"]: r["cell_longitude"] for r in grids.nearest_cells(points, cells).collect()}
    assert near == {1: 200.5, 2: 200.5, 3: 169.5}
    west = cells.where("longitude < 180")
    assert {r["cell_longitude"] for r in grids.nearest_cells(points.where("point_id = 1"), west).collect()} == {170.0}


# --- grids --------------------------------------------------------------------------------
def brute_dry_spell(values):
    best = run = 0
    for v in values:
        if v is None:
            continue
        run = run + 1 if v < 1 else 0
        best = max(best, run)
    return best


def test_dry_spells_against_brute_force(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for cell in range(60):
        days = sorted(rng.sample(range(1, 32), rng.randint(1, 31)))
        series = [rng.choice([0.0, 0.5, 1.0, 30.0, None]) for _ in days]
        rows += [(float(cell), 1.0, f"2020-01-{d:02d}", v) for d, v in zip(days, series)]
        known = [v for v in series if v is not None]
        expected[cell] = (
            brute_dry_spell(series), sum(known), sum(v > 20 for v in known), sum(v >= 1 for v in known),
            float(np.std(known)) if known else None, max(known, default=None),
        )
    df = spark.createDataFrame(rows, "latitude double, longitude double, d string, precipitation_daily double")
    got = grids.monthly_rain_stats(df.withColumn("time", F.to_date("d")).drop("d").repartition(7)).collect()
    assert len(got) == 60
    for r in got:
        spell, total, heavy, wet, std, top = expected[int(r["latitude"])]
        assert (r["max_dry_spell"], r["precipitation_daily"], r["heavy_rain_days"], r["wet_days"]) == (spell, total, heavy, wet)
        assert r["rain_intensity_max"] == top
        assert r["precipitation_std"] == (None if std is None else pytest.approx(std))


def test_monthly_stats_are_one_shuffle_without_window(spark, capsys):
    df = spark.range(10).selectExpr("1.0D latitude", "1.0D longitude", "date'2020-01-01' time", "2.0D precipitation_daily")
    grids.monthly_rain_stats(df).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Sort" not in plan


def _grid(spark):
    return spark.range(400).selectExpr(
        "date'2020-01-01' time", "cast(id div 20 as double) * 0.5 as latitude", "cast(id % 20 as double) * 0.7 + 8 as longitude", "cast(id as double) v"
    )


@pytest.mark.parametrize("max_rows", [50_000, 3])
def test_zone_join(spark, max_rows):
    zones = [("a", 1.0, 4.25, 8.0, 12.0), ("b", 3.0, 9.0, 9.4, 20.0), ("none", 50.0, 60.0, 0.0, 1.0), ("empty", 5.0, 4.0, 8.0, 9.0)]
    table = spark.createDataFrame(zones, "zone string, lat_min double, lat_max double, lon_min double, lon_max double")
    got = sorted((r["zone"], r["v"]) for r in grids.zone_join(_grid(spark), table, max_rows).collect())
    cells = [(r["latitude"], r["longitude"], r["v"]) for r in _grid(spark).collect()]
    assert got == sorted((z, v) for z, a, b, c, d in zones for lat, lon, v in cells if a <= lat <= b and c <= lon <= d)


@pytest.mark.parametrize("salts", [1, 7])
def test_nearest_cells(spark, salts):
    points = [(1, 2.25, 9.05), (2, -3.0, 30.0), (3, 9.5, 8.0), (4, 0.1, 21.3), (5, 4.74, 10.45), (6, 100.0, 8.35)]
    table = spark.createDataFrame(points, "point_id int, latitude double, longitude double")
    lats, lons = [i * 0.5 for i in range(20)], [i * 0.7 + 8 for i in range(20)]
    got = {r["point_id"]: (r["cell_latitude"], r["cell_longitude"]) for r in grids.nearest_cells(table, _grid(spark), salts).collect()}
    for p, lat, lon in points:
        if lat <= 90:
            assert got[p] == (min(lats, key=lambda c: (abs(c - lat), -c)), min(lons, key=lambda c: (abs(c - lon), -c)))
    assert got[1][0] == 2.5  # halfway: the larger coordinate


def test_slopes(spark):
    rows = [("two", 1, 1.0, 9.0, 1.0), ("two", 2, 1.0, 9.1, 5.0)]
    rows += [("flat", i, 1.0 + i, 9.0, 7.0) for i in range(3)]
    rows += [("rising", i, 1.0 + i / 100, 9.0, 100.0 * i) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, i int, latitude double, longitude double, elevation double")
    got = {r["g"]: r["slope_degrees"] for r in grids.spatial_slopes(df, "g", ["i"]).collect()}
    assert got["two"] is None and got["flat"] == 0.0 and got["rising"] > 0


def test_merge_keeps_cells_of_any_variable(spark):
    key = "date'2020-01-01' time, cast(id as double) latitude, 1.0D longitude"
    a = spark.range(0, 3).selectExpr(*key.split(", "), "1.0D a")
    b = spark.range(2, 5).selectExpr(*key.split(", "), "2.0D b")
    rows = {r["latitude"]: (r["a"], r["b"]) for r in grids.merge_variables([a, b]).collect()}
    assert rows == {0.0: (1.0, None), 1.0: (1.0, None), 2.0: (1.0, 2.0), 3.0: (None, 2.0), 4.0: (None, 2.0)}


# --- scratch folder -------------------------------------------------------------------------
def test_stages_are_released(spark):
    stage = stabilise(spark.range(5))
    assert stage.count() == 5
    release(stage)
    assert not Path(stage._harrow_stage).exists()
    with pytest.raises(ValueError):
        release(spark.range(1))


def test_a_cluster_names_its_folder(monkeypatch, spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_each_query_derives_the_rows_once(tables):
    """Splits, spikes, anomalies and sequences read what they need of the tables in one pass each, not once for every step."""
    from harrow.catalog import QUERIES
    from harrow.operators import series

    days = tables.daily.select("station_id", "observation_date", "temperature_mean", "precipitation_daily")
    key = ("station_id", "observation_date")
    for out in (
        series.flag_spikes(days, "station_id", "temperature_mean"), series.monthly_anomalies(days, *key, "temperature_mean", "precipitation_daily"),
        series.weather_sequences(days, *key, ["temperature_mean"]),
    ):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("l_shipdate") <= days._jdf.queryExecution().optimizedPlan().toString().count("l_shipdate")
    for name in ("e3_stratified_split", "e6_validation_split", "m1_baseline_mean"):
        out = QUERIES[name](tables.spark, tables.folder)
        assert "l_shipdate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_stored_results_leave_no_shuffle_files(spark):
    def kept():
        folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for folder in folders for f in Path(folder).rglob("shuffle_*.data")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key), kept()
    stored = stabilise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):  # executors delete them when they are told to
        if not kept() - before:
            break
        time.sleep(0.1)
    assert not kept() - before and stored.count() == 7 and spark.conf.get(key) == setting
