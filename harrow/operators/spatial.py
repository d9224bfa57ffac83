"""Neighbours, interpolation and autocorrelation of point tables.

Distances are planar, in the units of the coordinates. Points are kept in nested squares; a square with many points is split, so a place
where a third of all points stand is many small squares and never one group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.runtime import release, stabilise

# Points a square may hold before it is split, and levels at most
LEAF_POINTS = 64
LEVELS = 40
# Places of targets that one task compares with the stations around them
PLACES_PER_TASK = 4_000


class _Squares:
    """Points (``_x``, ``_y``) in nested squares of half the side each: ``counts[level]`` per square, and the level at which a square is small enough."""

    def __init__(self, points: DataFrame, leaf_points: int):
        self.leaf_points = leaf_points
        row = points.agg(*[f(c) for c in ("_x", "_y") for f in (F.min, F.max)]).first()
        self.empty = row[0] is None
        if self.empty:
            return
        self.x, self.y = row[0], row[2]
        # a little wider than the extent, so that the largest coordinate is inside the last square
        self.side = max(row[1] - row[0], row[3] - row[2], 1e-9) * (1 + 1e-9)
        finest = self.side / 2**LEVELS
        self.points = points.withColumns(
            {f"_i{c}": F.floor((F.col(f"_{c}") - F.lit(origin)) / F.lit(finest)).cast("long") for c, origin in (("x", self.x), ("y", self.y))}
        )
        self.counts, most = [], leaf_points + 1
        while most > leaf_points and len(self.counts) <= LEVELS:
            up = LEVELS - len(self.counts)
            level = self.points.groupBy(F.shiftright("_ix", up).alias("_ix"), F.shiftright("_iy", up).alias("_iy")).agg(F.count("*").alias("n"))
            self.counts.append(stabilise(level))
            most = self.counts[-1].agg(F.max("n")).first()[0]

    def leaves(self) -> DataFrame:
        """The points with ``_level``, ``_ix``, ``_iy`` of their smallest counted square that is not split."""
        rows, level = self.points, F.lit(0)
        for k, counted in enumerate(self.counts[:-1]):
            split = counted.where(F.col("n") > self.leaf_points).select(F.col("_ix").alias("_px"), F.col("_iy").alias("_py"), F.lit(1).alias(f"_split{k}"))
            up = LEVELS - k
            rows = rows.join(split, (F.shiftright("_ix", up) == F.col("_px")) & (F.shiftright("_iy", up) == F.col("_py")), "left").drop("_px", "_py")
            level = level + F.coalesce(f"_split{k}", F.lit(0))
        rows = rows.withColumn("_level", level).drop(*[f"_split{k}" for k in range(len(self.counts) - 1)])
        return rows.withColumns({c: F.expr(f"{c} >> ({LEVELS} - _level)") for c in ("_ix", "_iy")})

    def children(self, level: int, prefix: str) -> DataFrame:
        """Squares one level down, with the square they are in as ``_px``, ``_py``."""
        return self.counts[level + 1].select(
            F.shiftright("_ix", 1).alias("_px"), F.shiftright("_iy", 1).alias("_py"), F.lit(level + 1).alias(f"{prefix}_level"),
            F.col("_ix").alias(f"{prefix}_ix"), F.col("_iy").alias(f"{prefix}_iy"), F.col("n").alias(f"{prefix}_n"),
        )

    def corner(self, prefix: str) -> tuple[Column, Column, Column]:
        """Lower corner and side of a square."""
        side = F.lit(self.side) / F.pow(F.lit(2.0), F.col(f"{prefix}_level"))
        return F.lit(self.x) + F.col(f"{prefix}_ix") * side, F.lit(self.y) + F.col(f"{prefix}_iy") * side, side


_SQUARE = ("_level", "_ix", "_iy")
_T, _S = [f"t{c}" for c in _SQUARE], [f"s{c}" for c in _SQUARE]


def _open(pairs: DataFrame, squares: _Squares, level: int, prefix: str) -> DataFrame:
    """Pairs with the squares of this level that hold too many points replaced by those inside them."""
    if level + 1 >= len(squares.counts):
        return pairs
    split = (F.col(f"{prefix}_level") == level) & (F.col(f"{prefix}_n") > squares.leaf_points)
    mine = [f"{prefix}{c}" for c in (*_SQUARE, "_n")]
    outer = pairs.where(split).withColumns({"_px": F.col(f"{prefix}_ix"), "_py": F.col(f"{prefix}_iy")}).drop(*mine)
    inner = outer.join(squares.children(level, prefix), ["_px", "_py"]).select(*pairs.columns)
    return pairs.where(~split).unionByName(inner)


def _within_reach(pairs: DataFrame, targets: _Squares, stations: _Squares, k: int) -> DataFrame:
    """Pairs that may hold one of the ``k`` nearest of some target: not beyond the distance within which squares surely hold ``k`` stations."""
    (tx, ty, ts), (sx, sy, ss) = targets.corner("t"), stations.corner("s")
    gaps = [F.greatest(s - t - ts, t - s - ss, F.lit(0.0)) for t, s in ((tx, sx), (ty, sy))]
    spans = [F.greatest(s + ss - t, t + ts - s) for t, s in ((tx, sx), (ty, sy))]
    whole = Window.partitionBy(*_T)
    return (
        pairs.withColumns({"_near": gaps[0] * gaps[0] + gaps[1] * gaps[1], "_far": spans[0] * spans[0] + spans[1] * spans[1]})
        .withColumn("_upto", F.sum("s_n").over(whole.orderBy("_far")))
        # a hair more, as the squares' edges are rounded
        .withColumn("_limit", F.min(F.when(F.col("_upto") >= k, F.col("_far"))).over(whole) * (1 + 1e-9) + 1e-18)
        .where(F.col("_limit").isNull() | (F.col("_near") <= F.col("_limit")))
        .select(*pairs.columns)
    )


def nearest_stations(
    targets: DataFrame, stations: DataFrame, k: int, target_id: str, station_id: str, x: str = "longitude", y: str = "latitude",
    others_only: bool = False, leaf_points: int = LEAF_POINTS,
) -> DataFrame:
    """The ``k`` nearest stations of every target: ``target_id``, ``station_id``, ``rank``, ``distance``; ties go to the smaller station id.

    Places of targets and stations stand in nested squares of their own. The search goes down both at once over pairs of squares; a pair is left out
    once nearer squares hold ``k`` stations for every place of the target square. So what is shuffled are pairs of squares, and each small square of targets meets the
    points of a few small squares, however dense they are elsewhere. Both ids are unique; of stations at one place only those with the smallest ids can be among the nearest.
    ``others_only`` leaves out the station with the target's id. Rows without a coordinate take no part; with fewer stations all are returned.
    """
    wanted = k + 1 if others_only else k
    if target_id == station_id:
        raise ValueError("name the ids of targets and stations differently")

    def located(df: DataFrame, id_: str, name: str) -> DataFrame:
        return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
            F.col(id_).alias(name), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
        )

    first = F.row_number().over(Window.partitionBy("_x", "_y").orderBy("_sid"))
    placed = stabilise(located(stations, station_id, "_sid").withColumn("_nth", first).where(F.col("_nth") <= wanted).drop("_nth"))
    asked = located(targets, target_id, "_tid")
    places = stabilise(asked.select("_x", "_y").distinct())
    # stations at one place are never told apart by smaller squares
    there, here = _Squares(placed, max(leaf_points, wanted)), _Squares(places, leaf_points)
    if there.empty or here.empty:
        empty = F.lit(None)
        return asked.where(F.lit(False)).select(
            F.col("_tid").alias(target_id), empty.cast(stations.schema[station_id].dataType).alias(station_id), empty.cast("int").alias("rank"), empty.cast("double").alias("distance")
        )

    def root(squares: _Squares, prefix: str) -> DataFrame:
        return squares.counts[0].select(F.lit(0).alias(f"{prefix}_level"), *[F.col(c).alias(f"{prefix}{c}") for c in ("_ix", "_iy")], F.col("n").alias(f"{prefix}_n"))

    pairs = root(here, "t").crossJoin(F.broadcast(root(there, "s")))  # one row
    for level in range(max(len(here.counts), len(there.counts)) - 1):
        opened = _open(_open(pairs, here, level, "t"), there, level, "s")
        before, pairs = pairs, stabilise(_within_reach(opened, here, there, wanted))
        if level:
            release(before)
    met = there.leaves().groupBy(*_SQUARE).agg(F.collect_list(F.struct("_sid", "_x", "_y")).alias("_met"))
    met = pairs.join(met.withColumnsRenamed(dict(zip(_SQUARE, _S))), _S).groupBy(*_T).agg(F.flatten(F.collect_list("_met")).alias("_met"))

    def distances(s: Column) -> Column:
        dx, dy = F.col("_x") - s["_x"], F.col("_y") - s["_y"]
        return F.struct((dy * dy + dx * dx).alias("d2"), s["_sid"].alias("sid"))

    # tasks by places: a few bytes of targets are much work, so their bytes do not tell how many tasks it needs
    tasks = max(1, math.ceil(places.count() / PLACES_PER_TASK))
    met = met.withColumnsRenamed(dict(zip(_T, _SQUARE))).repartition(tasks, *_SQUARE)
    near = here.leaves().repartition(tasks, *_SQUARE).join(met, list(_SQUARE)).select(
        "_x", "_y", F.slice(F.sort_array(F.transform("_met", distances)), 1, wanted).alias("_near")
    )
    found = asked.join(near, ["_x", "_y"]).select("_tid", F.posexplode(F.slice(F.filter("_near", lambda s: s["sid"] != F.col("_tid")) if others_only else F.col("_near"), 1, k)))
    return found.select(
        F.col("_tid").alias(target_id), F.col("col.sid").alias(station_id), (F.col("pos") + 1).alias("rank"), F.sqrt("col.d2").alias("distance")
    )


def inverse_distance(
    targets: DataFrame, stations: DataFrame, value: str, k: int, target_id: str, station_id: str, power: float = 2.0, **options
) -> DataFrame:
    """Interpolated ``value`` of every target from its ``k`` nearest stations, weighted by ``distance ** -power``.

    ``n_stations`` of them have a value; a station at the very place decides alone (several: their mean).
    """
    known = stations.where(F.col(value).isNotNull())
    near = nearest_stations(targets, known, k, target_id, station_id, **options).join(known.select(station_id, value), station_id)
    weight = F.pow("distance", F.lit(-float(power)))
    here = F.avg(F.when(F.col("distance") == 0, F.col(value)))
    away = F.when(F.col("distance") > 0, weight)
    return near.groupBy(target_id).agg(
        F.coalesce(here, F.sum(away * F.col(value)) / F.sum(away)).alias(value), F.count("*").alias("n_stations")
    )


def _offsets(cells: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Steps between squares of side ``radius / cells``: all pairs of points within the radius, and those where it depends on the points."""
    inside, partly = [], []
    for dx in range(-cells - 1, cells + 2):
        for dy in range(-cells - 1, cells + 2):
            near = max(abs(dx) - 1, 0) ** 2 + max(abs(dy) - 1, 0) ** 2
            far = (abs(dx) + 1) ** 2 + (abs(dy) + 1) ** 2
            if far < cells**2:
                inside.append((dx, dy))
            elif near <= cells**2:
                partly.append((dx, dy))
    return inside, partly


def _steps(offsets: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets]))


def morans_i(
    points: DataFrame, value: str, radius: float, x: str = "longitude", y: str = "latitude", leaf_points: int = LEAF_POINTS, most_cells: int = 16,
) -> DataFrame:
    """Moran's I of ``value``, neighbours being all other points within ``radius``: ``n_points``, ``n_pairs`` (ordered), ``morans_i``, ``expected``.

    Squares have a side of ``radius / 2`` or less, halved while one holds more than ``leaf_points`` (down to ``radius / most_cells``). Two squares that lie
    within the radius of each other add the product of their sums; only where the radius cuts through a pair of squares are points compared,
    and their products are summed before anything leaves the task. Rows without a value or coordinate take no part; null without pairs or spread.
    """
    rows = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(value).isNotNull()).select(
        F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(value).cast("double").alias("_v")
    )
    rows = stabilise(rows)
    mean = rows.agg(F.avg("_v")).first()[0] or 0.0
    rows = rows.withColumn("_z", F.col("_v") - F.lit(mean))

    def squared(cells: int) -> DataFrame:
        side = radius / cells
        return rows.withColumns({"_cx": F.floor(F.col("_x") / F.lit(side)), "_cy": F.floor(F.col("_y") / F.lit(side))})

    cells = 2
    while cells < most_cells and (squared(cells).groupBy("_cx", "_cy").count().agg(F.max("count")).first()[0] or 0) > leaf_points:
        cells *= 2
    inside, partly = _offsets(cells)
    placed = stabilise(squared(cells).select("_x", "_y", "_z", "_cx", "_cy"))
    sums = stabilise(placed.groupBy("_cx", "_cy").agg(F.count("*").alias("n"), F.sum("_z").alias("s")))
    other = sums.select(F.col("_cx").alias("_ox"), F.col("_cy").alias("_oy"), F.col("n").alias("on"), F.col("s").alias("os"))

    def beside(offsets: list[tuple[int, int]]) -> DataFrame:
        stepped = sums.select("*", _steps(offsets).alias("step"))
        return stepped.select("_cx", "_cy", "n", "s", (F.col("_cx") + F.col("step.dx")).alias("_ox"), (F.col("_cy") + F.col("step.dy")).alias("_oy"))

    close = beside(inside).join(other, ["_ox", "_oy"]).agg(
        F.sum(F.col("n") * F.col("on")).alias("pairs"), F.sum(F.col("s") * F.col("os")).alias("products")
    )
    cut = beside(partly).join(other.select("_ox", "_oy"), ["_ox", "_oy"]).select("_cx", "_cy", "_ox", "_oy")
    theirs = placed.select(F.col("_cx").alias("_ox"), F.col("_cy").alias("_oy"), F.col("_x").alias("_x2"), F.col("_y").alias("_y2"), F.col("_z").alias("_z2"))
    dx, dy = F.col("_x") - F.col("_x2"), F.col("_y") - F.col("_y2")
    compared = placed.join(cut, ["_cx", "_cy"]).join(theirs, ["_ox", "_oy"]).where(dy * dy + dx * dx <= F.lit(radius * radius)).agg(
        F.count("*").alias("pairs"), F.sum(F.col("_z") * F.col("_z2")).alias("products")
    )
    totals = close.unionByName(compared).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("products"), F.lit(0.0)).alias("products"))
    own = rows.agg(F.count("*").alias("n_points"), F.coalesce(F.sum(F.col("_z") * F.col("_z")), F.lit(0.0)).alias("spread"))
    pairs = F.col("pairs") - F.col("n_points")  # a point is no neighbour of itself
    return totals.crossJoin(F.broadcast(own)).select(
        "n_points", pairs.cast("long").alias("n_pairs"),
        F.try_divide(F.col("n_points") * (F.col("products") - F.col("spread")), F.when(pairs > 0, pairs) * F.col("spread")).alias("morans_i"),
        F.try_divide(F.lit(-1.0), F.when(F.col("n_points") > 1, F.col("n_points") - 1)).alias("expected"),
    )
