"""Climate grids as long tables: merge, monthly statistics, zones, nearest cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.lookup import BROADCAST_ROWS, SALTS, bucket_join
from harrow.runtime import stabilise

CELL = ("latitude", "longitude")


def concat_parts(parts: list[DataFrame]) -> DataFrame:
    """Parts of one grid (such as years) along time; a variable absent from a part is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_variables(parts: list[DataFrame], keys: tuple[str, ...] = ("time", *CELL)) -> DataFrame:
    """Outer merge of one-variable grids: a cell present in any of them survives.

    One union and one aggregate, so one shuffle however many variables there are.
    """
    merged = concat_parts(parts)
    values = [c for c in merged.columns if c not in keys]
    return merged.groupBy(*keys).agg(*[F.max(v).alias(v) for v in values])


def _month(time: str) -> Column:
    return F.trunc(F.col(time), "MM")


def daily_to_monthly(
    df: DataFrame, cell: tuple[str, ...] = CELL, time: str = "time", rain: str = "precipitation_daily"
) -> DataFrame:
    """Rain is summed (0 without any value), every other variable averaged."""
    values = [c for c in df.columns if c not in (*cell, time)]
    aggs = [F.coalesce(F.sum(v), F.lit(0.0)).alias(v) if v == rain else F.avg(v).alias(v) for v in values]
    return df.groupBy(*cell, _month(time).alias("month")).agg(*aggs)


def _longest_dry_run(dry: Column, seen: Column) -> Column:
    """Longest run of dry days in two 31-bit day masks; days without value do not break a run."""

    def step(acc: Column, day: Column) -> Column:
        is_seen = F.getbit(seen, day) == 1
        is_dry = F.getbit(dry, day) == 1
        run = F.when(~is_seen, acc["run"]).when(is_dry, acc["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), start, step, lambda acc: acc["best"])


def monthly_rain_stats(
    df: DataFrame,
    cell: tuple[str, ...] = CELL,
    time: str = "time",
    rain: str = "precipitation_daily",
    heavy: float = 20.0,
    wet: float = 1.0,
) -> DataFrame:
    """Rain statistics and longest dry spell per cell and month from one row per cell and day.

    The dry spell needs the order of days. It is carried as two day bit masks
    through the same partial aggregation as the sums, so the whole job is one
    shuffle without any sort or window.
    """
    p = F.col(rain)
    bit = F.expr(f"shiftleft(1L, dayofmonth(`{time}`) - 1)")
    stats = df.groupBy(*cell, _month(time).alias("month")).agg(
        F.coalesce(F.sum(p), F.lit(0.0)).alias(rain),
        F.count_if(p > heavy).alias("heavy_rain_days"),
        F.count_if(p >= wet).alias("wet_days"),
        F.max(p).alias("rain_intensity_max"),
        F.stddev_pop(p).alias("precipitation_std"),
        F.coalesce(F.bit_or(F.when(p < wet, bit)), F.lit(0)).alias("_dry"),
        F.coalesce(F.bit_or(F.when(p >= wet, bit)), F.lit(0)).alias("_wet"),
        F.coalesce(F.bit_or(F.when(p.isNotNull(), bit)), F.lit(0)).alias("_seen"),
    )
    # a day with a wet and a dry reading is wet
    dry = F.col("_dry").bitwiseAND(F.bitwise_not("_wet"))
    return stats.withColumn("max_dry_spell", _longest_dry_run(dry, F.col("_seen"))).drop("_dry", "_wet", "_seen")


def max_dry_spell(df: DataFrame, **options) -> DataFrame:
    cell = options.get("cell", CELL)
    return monthly_rain_stats(df, **options).select(*cell, "month", "max_dry_spell")


def dry_run_counter(
    df: DataFrame, cell: tuple[str, ...] = CELL, time: str = "time", rain: str = "precipitation_daily", wet: float = 1.0
) -> DataFrame:
    """Running length of the dry run on every day, restarted by wet days and by months.

    A window holds one cell-month, at most 31 daily rows.
    """
    days = df.where(F.col(rain).isNotNull()).withColumn("month", _month(time))
    by_day = Window.partitionBy(*cell, "month").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    is_dry = F.col(rain) < wet
    island = days.withColumn("_island", F.sum((~is_dry).cast("int")).over(by_day))
    in_island = Window.partitionBy(*cell, "month", "_island").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("dry_run", F.sum(is_dry.cast("int")).over(in_island)).drop("_island")


# --- zone boxes ------------------------------------------------------------------
def _degrees(low: Column, high: Column, least: int | None, most: int | None) -> Column:
    """Degrees of a box that the data reach."""
    low, high = F.greatest(F.floor(low), F.lit(least)), F.least(F.floor(high), F.lit(most))
    # an empty box yields no bucket at all
    return F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))))


def _extent(df: DataFrame, *names: str) -> list[int | None]:
    """Lowest and highest whole degree of each coordinate; None for a table without one."""
    row = df.agg(*[f(F.floor(n)).cast("int").alias(f"{n}_{k}") for n in names for k, f in enumerate((F.min, F.max))]).first()
    return list(row)


def zone_join(grid: DataFrame, zones: DataFrame, max_rows: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """Cells x boxes that contain them (ends inclusive); overlapping boxes repeat a cell.

    Boxes are spread over the one-degree squares they touch, which turns the
    range join into an equality join plus an exact check.
    """
    south, north, west, east = _extent(grid, "latitude", "longitude")
    squares = zones.withColumn("_lat", _degrees(F.col("lat_min"), F.col("lat_max"), south, north)).withColumn(
        "_lon", _degrees(F.col("lon_min"), F.col("lon_max"), west, east)
    )
    cells = grid.withColumn("_lat", F.floor("latitude").cast("int")).withColumn("_lon", F.floor("longitude").cast("int"))
    inside = F.col("latitude").between(F.col("lat_min"), F.col("lat_max")) & F.col("longitude").between(
        F.col("lon_min"), F.col("lon_max")
    )
    return bucket_join(cells, squares, ["_lat", "_lon"], inside, max_rows, salts).drop(
        "_lat", "_lon", "lat_min", "lat_max", "lon_min", "lon_max"
    )


def zonal_means(grid: DataFrame, zones: DataFrame, **options) -> DataFrame:
    """Unweighted mean of every variable per zone and time."""
    values = [c for c in grid.columns if c not in ("time", *CELL)]
    return zone_join(grid, zones, **options).groupBy("zone", "time").agg(*[F.avg(v).alias(v) for v in values])


# --- nearest cell --------------------------------------------------------------------
def _nearest(points: DataFrame, cells: DataFrame, name: str, salts: int) -> DataFrame:
    """Add ``cell_<name>``, the nearest coordinate of the axis: a merge of points and axis values in their common order.

    Ranges of one degree are merged on their own; what lies before and after a degree comes from a table of one row per degree. The points of a
    degree are dealt over ``salts`` merges, each of which gets the axis values of the degree, so a crowd at one place is spread.
    """
    axis = cells.select(F.col(name).cast("double").alias("_x")).where(F.col("_x").isNotNull()).distinct()
    degree = F.floor("_x").cast("int").alias("_deg")
    placed = points.where(F.col(name).isNotNull()).withColumn("_x", F.col(name).cast("double")).select("*", degree)
    salted = placed.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int"))
    ends = axis.select("_x", degree).groupBy("_deg").agg(F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    degrees = ends.unionByName(placed.select("_deg").distinct(), allowMissingColumns=True).groupBy("_deg").agg(
        F.max("_least").alias("_least"), F.max("_most").alias("_most")
    )
    along = Window.orderBy("_deg")
    around = degrees.select(
        "_deg", F.last("_most", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_least", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    values = axis.select("_x", degree, F.col("_x").alias("_axis")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # beside a point of the same coordinate the axis value comes first in both directions
    merged = salted.unionByName(values, allowMissingColumns=True)
    range_ = Window.partitionBy("_deg", "_salt")
    upward = range_.orderBy("_x", F.col("_axis").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    downward = range_.orderBy(F.desc("_x"), F.col("_axis").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = (
        merged.withColumn("_lo", F.last("_axis", ignorenulls=True).over(upward))
        .withColumn("_hi", F.last("_axis", ignorenulls=True).over(downward))
        .where(F.col("_axis").isNull())
        .join(F.broadcast(around), "_deg")  # one row per degree
        .withColumn("_lo", F.coalesce("_lo", "_before")).withColumn("_hi", F.coalesce("_hi", "_after"))
    )
    # a tie goes to the larger coordinate
    upper = F.col("_lo").isNull() | (F.col("_hi") - F.col("_x") <= F.col("_x") - F.col("_lo"))
    pick = F.when(upper, F.col("_hi")).otherwise(F.col("_lo"))
    return met.select(*points.columns, pick.alias(f"cell_{name}")).where(F.col(f"cell_{name}").isNotNull())


def nearest_cells(points: DataFrame, grid: DataFrame, salts: int = SALTS) -> DataFrame:
    """Nearest latitude and nearest longitude of the grid for every point, chosen independently.

    Both axes come from one stored table of the grid's cells. Points without a coordinate have no cell.
    """
    cells = stabilise(grid.select(*CELL).distinct())
    out = _nearest(points, cells, "latitude", salts)
    return _nearest(out, cells, "longitude", salts)


def point_timeseries(grid: DataFrame, points: DataFrame, max_rows: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """All times of the cell nearest to each point (``point_id, latitude, longitude``)."""
    cells = nearest_cells(points, grid, salts).select(
        "point_id", F.col("cell_latitude").alias("latitude"), F.col("cell_longitude").alias("longitude")
    )
    return bucket_join(grid, cells, list(CELL), F.lit(True), max_rows)


def year_span(df: DataFrame, time: str = "time") -> DataFrame:
    return df.agg(F.min(F.year(time)).alias("first_year"), F.max(F.year(time)).alias("last_year"))


def spatial_slopes(points: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Inclination between the lowest and highest point of each group.

    The first point in ``order`` wins ties; fewer than three points give NULL.
    """
    from harrow.functions.geo import haversine_km, slope_degrees

    point = F.struct("latitude", "longitude", "elevation")
    keys = [F.col(c) for c in order]
    ends = points.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min_by(point, F.struct("elevation", *keys)).alias("low"),
        # the highest elevation with the earliest order key: smallest (-elevation, key)
        F.min_by(point, F.struct(-F.col("elevation"), *keys)).alias("high"),
    )
    run = haversine_km("low.latitude", "low.longitude", "high.latitude", "high.longitude") * 1000
    slope = slope_degrees(F.col("high.elevation") - F.col("low.elevation"), run)
    return ends.select(group, "n_points", F.when(F.col("n_points") >= 3, slope).alias("slope_degrees"))
