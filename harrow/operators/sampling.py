"""Seeded splits and samples by hash threshold.

A row's place is fixed by ``md5(key|seed)``. The n rows with the lowest hashes
are found by counting hash prefixes, so no stratum is sorted in one task. The
prefix that crosses the quota is split by longer prefixes until few rows share
it, and only those are ranked. Rows that share
a key share a hash and stay on one side of a split; a tie that would exceed the quota is
left out there, and cut by the other columns in a sample.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.lookup import bounded, lookup_join

DIGITS = 3  # hex digits per step: 4,096 hash ranges per stratum
RANKED_ROWS = 1_000_000  # most rows of one stratum that are ranked together


def row_hash(keys: list[str], seed: int) -> Column:
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def _edges(counts: DataFrame, key: list[str]) -> tuple[DataFrame, bool, int]:
    """(edges, whether they are counted small, most rows in one of them).

    An edge is per stratum the prefix ``_edge`` that crosses the quota, with ``_left`` of the quota and ``_n`` rows in it.

    ``counts`` has at most ``16**DIGITS`` rows per stratum.
    """
    running = Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    crossing = counts.withColumn("_upto", F.sum("_n").over(running)).where(F.col("_upto") > F.col("_quota"))
    edges = (
        crossing.groupBy(*key)
        .agg(F.min(F.struct("_upto", "_p", "_n", "_quota")).alias("e"))
        .select(
            *key, F.col("e._p").alias("_edge"), F.col("e._n").alias("_n"),
            (F.col("e._quota") - F.col("e._upto") + F.col("e._n")).alias("_left"),
        )
    )
    small = bounded(edges)
    table = edges if small is None else small
    return table, small is not None, table.agg(F.max("_n")).first()[0] or 0


def _cutoffs(df: DataFrame, strata: list[str], quota: Callable[[Column], Column]) -> DataFrame:
    """One row per stratum: the highest hash ``_cut`` that is still inside the quota.

    ``df`` has the strata columns and ``_h``. A stratum whose quota covers all
    its rows has no row here.
    """
    key = strata or ["_all"]
    if not strata:
        df = df.withColumn("_all", F.lit(0))
    digits = DIGITS
    counts = df.groupBy(*key, F.substring("_h", 1, digits).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*key))
    edges, small, most = _edges(counts.withColumn("_quota", quota(total).cast("long")), key)

    def inside() -> DataFrame:
        table = edges.select(*key, "_edge", F.col("_left").alias("_quota"))
        rows = df.join(F.broadcast(table), key) if small else lookup_join(df, table, key, "inner")
        return rows.where(F.substring("_h", 1, digits) == F.col("_edge"))

    while most > RANKED_ROWS and digits < 32:
        rows, digits = inside(), min(32, digits + DIGITS)
        longer = rows.groupBy(*key, "_quota", F.substring("_h", 1, digits).alias("_p"))
        edges, small, most = _edges(longer.agg(F.count(F.lit(1)).alias("_n")), key)

    ties = inside().groupBy(*key, "_edge", "_quota", "_h").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*key).orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ties.withColumn("_upto", F.sum("_n").over(run))
        .groupBy(*key, "_edge")
        .agg(F.max(F.when(F.col("_upto") <= F.col("_quota"), F.col("_h"))).alias("_h"))
        # below the first hash of the edge prefix sorts the bare prefix itself
        .select(*key, F.coalesce("_h", "_edge").alias("_cut"))
    )


def lowest_hashes(
    df: DataFrame, keys: list[str], seed: int, quota: Callable[[Column], Column], strata: list[str] | None = None
) -> DataFrame:
    """Add ``selected``: is the row among the ``quota(n)`` lowest hashes of its stratum."""
    hashed = df.withColumn("_h", row_hash(keys, seed))
    if strata:
        # as text, each with its length, so that a missing stratum is a stratum too
        texts = [F.col(c).cast("string") for c in strata]
        hashed = hashed.withColumn("_stratum", F.concat(*[F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-")) for c in texts]))
        cuts = _cutoffs(hashed.select("_stratum", "_h"), ["_stratum"], quota)
        joined = lookup_join(hashed, cuts, "_stratum", "left")
        # a stratum whose quota covers every row has no edge
        inside = F.col("_cut").isNull() | (F.col("_h") <= F.col("_cut"))
        return joined.withColumn("selected", inside).drop("_h", "_cut", "_stratum")
    row = _cutoffs(hashed.select("_h"), [], quota).first()
    return df.withColumn("selected", F.lit(True) if row is None else row_hash(keys, seed) <= F.lit(row["_cut"]))


def _half_even(share: float) -> Callable[[Column], Column]:
    return lambda n: F.rint(n * F.lit(float(share)))


def stratified_split(
    df: DataFrame, keys: list[str], stratum: str | None = "agroecological_zone", share: float = 0.15, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: ``round(share * n)`` rows of every stratum (of all rows without one)."""
    strata = [stratum] if stratum and stratum in df.columns else []
    return lowest_hashes(df, keys, seed, _half_even(share), strata).withColumnRenamed("selected", "is_test")


def validation_split(df: DataFrame, keys: list[str], share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_validation`` inside a training table, without strata."""
    return lowest_hashes(df, keys, seed, _half_even(share)).withColumnRenamed("selected", "is_validation")


def group_split(df: DataFrame, group: str = "agroecological_zone", share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: whole groups go to test, ``ceil(share * groups)`` of them."""
    groups = df.select(group).distinct()
    picked = _cutoffs(
        groups.select(row_hash([group], seed).alias("_h")), [], lambda n: F.ceil(n * F.lit(float(share)))
    ).first()
    test = F.lit(True) if picked is None else row_hash([group], seed) <= F.lit(picked["_cut"])
    return df.withColumn("is_test", test)


def bounded_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, the same ones on every run; all rows of a smaller table.

    Of rows that share the key at the edge as many as are missing are taken, in the order of all their columns.
    """
    hashed = df.withColumn("_h", row_hash(keys, seed))
    edge = _cutoffs(hashed.select("_h"), [], lambda _: F.lit(int(n))).first()
    if edge is None:
        return df
    head = hashed.where(F.col("_h") <= F.lit(edge["_cut"]))
    missing = n - head.count()
    if missing:
        tied = hashed.where(F.col("_h") > F.lit(edge["_cut"])).agg(F.min("_h").alias("h")).first()["h"]
        rest = hashed.where(F.col("_h") == F.lit(tied)).orderBy(F.to_json(F.struct(*df.columns))).limit(missing)
        head = head.unionByName(rest)
    return head.drop("_h")
