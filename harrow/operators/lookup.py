"""Joins that stay balanced when one key holds a large share of the rows.

A side is broadcast only after its row count was checked. Past the limit the
join shuffles, with the hot keys split off (``lookup_join``) or the large side
salted (``bucket_join``). Both ways give the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000
HOT_KEY_SHARE = 1_000
SALTS = 32


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """``df`` as a local relation if it has at most ``max_rows`` rows, else None.

    At most ``max_rows + 1`` rows ever reach the driver.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows:
        return None
    return df.sparkSession.createDataFrame(head, df.schema)


def _any_null(names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    hot_share: int = HOT_KEY_SHARE,
) -> DataFrame:
    """Join a table to a lookup that has one row per key (``how``: left or inner)."""
    on = [on] if isinstance(on, str) else list(on)
    columns = list(df.columns) + [c for c in lookup.columns if c not in on]
    small = bounded(lookup, max_rows)
    if small is not None:
        return df.join(F.broadcast(small), on, how).select(*columns)

    # A key is hot when it holds more than 1/hot_share of the rows, so there are
    # fewer than hot_share of them: their lookup rows may be broadcast.
    counts = df.where(~_any_null(on)).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("t")).scalar()
    hot = df.sparkSession.createDataFrame(
        counts.where(F.col("_n") * hot_share > total).select(*on).toArrow(), lookup.select(*on).schema
    )
    hot_lookup = lookup.join(F.broadcast(hot), on, "left_semi")
    hot_rows = df.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(hot_lookup), on, how)
    cold_rows = df.where(~_any_null(on)).join(F.broadcast(hot), on, "left_anti").join(lookup, on, how)
    out = hot_rows.select(*columns).unionByName(cold_rows.select(*columns))
    if how == "left":
        # rows without a key never meet in one shuffle partition
        out = out.unionByName(df.where(_any_null(on)), allowMissingColumns=True)
    return out.select(*columns)


def bucket_join(
    rows: DataFrame,
    ranges: DataFrame,
    on: list[str],
    condition: Column,
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Inner range join on shared bucket columns plus an exact condition.

    ``ranges`` already has one row per bucket it touches. Past ``max_rows`` the
    row side is salted and the ranges are repeated per salt, so a bucket that
    holds a third of all rows is spread over ``salts`` shuffle partitions; AQE
    splits those further by size, since this is a plain sort-merge join.
    """
    small = bounded(ranges, max_rows)
    if small is not None:
        return rows.join(F.broadcast(small), on).where(condition)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    repeated = ranges.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, on + ["_salt"]).where(condition).drop("_salt")


def with_group_stats(df: DataFrame, keys: str | list[str], max_rows: int = BROADCAST_ROWS, **stats: Column) -> DataFrame:
    """Attach aggregates of each row's group to the row (missing group: missing values).

    Partial aggregation followed by a lookup join: no group is ever gathered in
    one task, as a partition window would do.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    table = df.where(~_any_null(keys)).groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return lookup_join(df, table, keys, "left", max_rows)


def constant_lookup(df: DataFrame, key: str, table: dict, column: str) -> DataFrame:
    """Map a column through a fixed dictionary; unknown keys give NULL. No join."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return df.withColumn(column, F.try_element_at(F.create_map(*pairs), F.col(key)))
