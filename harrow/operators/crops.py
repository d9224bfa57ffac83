"""Crop attributes attached to a crop name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.constants import CROP_PROFILE
from harrow.operators.lookup import bucket_join

PROFILE_FIELDS = ("cycle_min", "cycle_max", "cycle_optimal", "yield_min", "yield_max", "yield_average")


def with_crop_profile(df: DataFrame, crop: str = "crop_name") -> DataFrame:
    """Cycle days and yield potential (t/ha) of each crop; missing for an unknown crop."""
    types = ("int",) * 3 + ("double",) * 3
    pairs = []
    for name, values in CROP_PROFILE.items():
        fields = [F.lit(v).cast(k).alias(f) for v, k, f in zip(values, types, PROFILE_FIELDS)]
        pairs += [F.lit(name), F.struct(*fields)]
    profile = F.try_element_at(F.create_map(*pairs), F.col(crop))
    return df.withColumn("_profile", profile).select(
        *df.columns, *[F.col(f"_profile.{f}").alias(f) for f in PROFILE_FIELDS]
    )


def crop_varieties(df: DataFrame, varieties: DataFrame, crop: str = "crop_name") -> DataFrame:
    """Rows x varieties of their crop, from a table ``(crop, varieties ARRAY<STRING>)``; unknown crops give none."""
    listed = varieties.select(F.col(varieties.columns[0]).alias(crop), F.explode(varieties.columns[1]).alias("variety"))
    return bucket_join(df, listed, [crop], F.lit(True))
