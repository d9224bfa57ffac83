"""Neighbours, interpolation, autocorrelation and the drought index against plain versions."""

import math
import random
from datetime import date
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from harrow.operators import drought, spatial


def _points(n, dense, seed=3):
    """Scattered points, a third of all in one small square, and several at one place."""
    rng = random.Random(seed)
    rows = [(k, rng.uniform(8, 16), rng.uniform(2, 13), rng.gauss(20, 3)) for k in range(n)]
    rows += [(n + k, 10 + rng.random() / 1e4, 5 + rng.random() / 1e4, 25.0) for k in range(dense)]
    rows += [(n + dense + k, 12.0, 7.0, 30.0 + k) for k in range(40)]
    return rows


def _nearest(x, y, points, k, own=None):
    near = sorted(((b - y) * (b - y) + (a - x) * (a - x), i) for i, a, b, _ in points if i != own)
    return [(i, math.sqrt(d)) for d, i in near[:k]]


@pytest.mark.parametrize("leaf_points", [2, 16, 5000])
def test_nearest_stations_are_exact(spark, leaf_points):
    points = _points(150, 250)
    rng = random.Random(1)
    asked = [(k, rng.uniform(5, 19), rng.uniform(0, 15)) for k in range(30)] + [(100, 10.00005, 5.00005), (101, 12.0, 7.0), (102, 8.0, 5.0), (103, None, 1.0)]
    stations = spark.createDataFrame([*points, (9999, None, 3.0, 1.0)], "sid int, longitude double, latitude double, v double").repartition(3)
    targets = spark.createDataFrame(asked, "tid int, longitude double, latitude double")
    got = {}
    for r in spatial.nearest_stations(targets, stations, 5, "tid", "sid", leaf_points=leaf_points).orderBy("tid", "rank").collect():
        got.setdefault(r.tid, []).append((r.sid, r.distance))
    assert set(got) == {k for k, x, _ in asked if x is not None}
    for k, x, y in asked:
        if x is not None:
            want = _nearest(x, y, points, 5)
            assert [i for i, _ in got[k]] == [i for i, _ in want]
            assert [d for _, d in got[k]] == pytest.approx([d for _, d in want], abs=1e-15)


def test_nearest_others_few_stations_and_none(spark):
    points = _points(40, 60, 8)
    stations = spark.createDataFrame(points, "sid int, longitude double, latitude double, v double")
    targets = stations.withColumnRenamed("sid", "tid").drop("v")
    got = {}
    for r in spatial.nearest_stations(targets, stations, 3, "tid", "sid", others_only=True, leaf_points=8).orderBy("tid", "rank").collect():
        got.setdefault(r.tid, []).append(r.sid)
    assert got == {i: [j for j, _ in _nearest(x, y, points, 3, i)] for i, x, y, _ in points}
    assert spatial.nearest_stations(targets, stations.limit(2), 3, "tid", "sid").groupBy("tid").count().where("count != 2").count() == 0
    none = spatial.nearest_stations(targets, stations.limit(0), 3, "tid", "sid")
    assert none.count() == 0 and none.columns == ["tid", "sid", "rank", "distance"]


def test_inverse_distance(spark):
    points = [(1, 0.0, 0.0, 10.0), (2, 1.0, 0.0, 20.0), (3, 0.0, 2.0, 40.0), (4, 0.0, 0.0, 14.0), (5, 0.1, 0.1, None)]
    stations = spark.createDataFrame(points, "sid int, longitude double, latitude double, v double")
    targets = spark.createDataFrame([(1, 0.5, 0.0), (2, 0.0, 0.0), (3, 0.0, 1.0)], "tid int, longitude double, latitude double")
    got = {r.tid: (r.v, r.n_stations) for r in spatial.inverse_distance(targets, stations, "v", 3, "tid", "sid").collect()}
    assert got[1] == (pytest.approx((4 * 10 + 4 * 20 + 4 * 14) / 12), 3)
    assert got[2] == (12.0, 3)  # two stations at the place
    assert got[3] == (pytest.approx((10 + 40 + 14) / 3), 3)


@pytest.mark.parametrize("leaf_points, radius", [(64, 1.0), (3, 1.0), (3, 0.00005), (1, 0.37)])
def test_morans_i(spark, leaf_points, radius):
    points = _points(80, 60, 4)
    table = spark.createDataFrame([*points, (1, None, 2.0, 3.0), (1, 9.0, 9.0, None)], "id int, longitude double, latitude double, v double").repartition(3)
    got = spatial.morans_i(table, "v", radius, leaf_points=leaf_points).collect()
    assert len(got) == 1
    mean = sum(p[3] for p in points) / len(points)
    pairs = [(a[3] - mean) * (b[3] - mean) for a in points for b in points if a[0] != b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= radius**2]
    spread = sum((p[3] - mean) ** 2 for p in points)
    assert (got[0].n_points, got[0].n_pairs) == (len(points), len(pairs))
    assert got[0].morans_i == pytest.approx(len(points) * sum(pairs) / (len(pairs) * spread), rel=1e-9)
    assert got[0].expected == pytest.approx(-1 / (len(points) - 1))


def test_morans_i_without_neighbours(spark):
    table = spark.createDataFrame([(0.0, 0.0, 1.0), (50.0, 50.0, 2.0)], "longitude double, latitude double, v double")
    row = spatial.morans_i(table, "v", 1.0).first()
    assert (row.n_points, row.n_pairs, row.morans_i, row.expected) == (2, 0, None, -1.0)
    empty = spatial.morans_i(table.limit(0), "v", 1.0).first()
    assert (empty.n_points, empty.n_pairs, empty.morans_i, empty.expected) == (0, 0, None, None)


@pytest.mark.parametrize("shape, x", [(0.3, 0.01), (0.9, 2.0), (1.0, 1.0), (4.5, 3.0), (20.0, 35.0), (140.0, 120.0)])
def test_gamma_probability(one, shape, x):
    import numpy as np

    t = (np.arange(400_000) + 0.5) / 400_000
    if shape < 1:  # the substitution u = x t^(1/shape) removes the pole at 0
        want = float(np.mean(np.exp(-x * t ** (1 / shape)))) * x**shape / math.gamma(shape + 1)
    else:
        want = float(np.mean(np.exp((shape - 1) * np.log(x * t) - x * t - math.lgamma(shape)))) * x
    assert one(drought.gamma_probability(F.lit(shape), F.lit(x))) == pytest.approx(want, rel=1e-6)
    assert one(drought.log_gamma(F.lit(shape))) == pytest.approx(math.lgamma(shape), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("shape", [0.01, 1.0, 2.5, 7.0, 40.0, 149.0])
def test_log_gamma_is_good_to_rounding(one, shape):
    """An error of 1e-10 moves deviates over a rounding edge once a table has many rows."""
    assert one(drought.log_gamma(F.lit(shape))) == pytest.approx(math.lgamma(shape), rel=1e-14, abs=1e-14)


@pytest.mark.parametrize("p", [0.001, 0.2, 0.5, 0.9, 0.9999])
def test_normal_deviate(one, p):
    z = NormalDist().inv_cdf(p)
    assert one(drought.normal_deviate(F.lit(p))) == pytest.approx(z, abs=4.6e-4)
    assert one(drought.normal_probability(F.lit(z))) == pytest.approx(p, abs=1e-9)


def test_standardised_precipitation(spark):
    rng = random.Random(6)
    rows = [("a", date(y, m, 1), rng.gammavariate(2.0, 30.0)) for y in range(1980, 2011) for m in range(1, 13)]
    rows += [("b", date(y, m, 1), 0.0 if rng.random() < 0.4 else rng.gammavariate(1.5, 10.0)) for y in range(1980, 2011) for m in range(1, 13) if (y, m) != (1990, 5)]
    rows += [("dry", date(2000 + k, 1, 1), 0.0) for k in range(5)] + [("gap", date(2000, 1, 1), None)]
    table = spark.createDataFrame(rows, "station_id string, month date, rain double").repartition(3)
    got = drought.standardised_precipitation(table, rain="rain").collect()
    by = {(r.station_id, r.month, r.scale): r for r in got}
    assert len(by) == len(got) and all(r.spi is None for r in got if r.station_id == "dry") and ("gap", date(2000, 1, 1), 1) not in by
    # three months need all of them
    assert ("b", date(1990, 6, 1), 3) not in by and ("b", date(1990, 8, 1), 3) in by and ("a", date(1980, 2, 1), 3) not in by
    total = {k: v for *k, v in [(s, m, x) for s, m, x in rows if x is not None] for k in [tuple(k)]}
    r = by[("a", date(1995, 4, 1), 3)]
    assert r.total == pytest.approx(total[("a", date(1995, 4, 1))] + total[("a", date(1995, 3, 1))] + total[("a", date(1995, 2, 1))])
    values = [x.spi for x in got if x.station_id == "a" and x.scale == 1]
    assert abs(sum(values) / len(values)) < 0.05 and 0.85 < (sum(v * v for v in values) / len(values)) ** 0.5 < 1.15
    zero = [x for x in got if x.station_id == "b" and x.scale == 1 and x.total == 0]
    assert zero and all(x.spi == pytest.approx(NormalDist().inv_cdf(x.zero_share), abs=1e-3) for x in zero)


def test_search_shuffles_squares_not_targets(spark):
    """A level of the search keeps a few pairs for each small square of targets, however many targets it holds."""
    rng = random.Random(5)
    table = spark.createDataFrame([(k, rng.random(), rng.random()) for k in range(3000)], "s int, x double, y double")
    squares = spatial._Squares(table.select(F.col("s").alias("_sid"), F.col("x").alias("_x"), F.col("y").alias("_y")), 64)
    root = squares.counts[0]
    pairs = root.select(F.lit(0).alias("t_level"), F.col("_ix").alias("t_ix"), F.col("_iy").alias("t_iy"), F.col("n").alias("t_n")).crossJoin(
        root.select(F.lit(0).alias("s_level"), F.col("_ix").alias("s_ix"), F.col("_iy").alias("s_iy"), F.col("n").alias("s_n"))
    )
    for level in range(len(squares.counts) - 1):
        pairs = spatial._within_reach(spatial._open(spatial._open(pairs, squares, level, "t"), squares, level, "s"), squares, squares, 4).localCheckpoint()
    leaves = squares.leaves().groupBy("_level", "_ix", "_iy").count()
    assert leaves.agg(F.max("count")).first()[0] <= 64 and leaves.agg(F.sum("count")).first()[0] == 3000
    assert pairs.select("t_level", "t_ix", "t_iy").distinct().count() == leaves.count() < 300
    assert pairs.count() < 30 * leaves.count()
