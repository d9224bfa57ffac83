"""Readers and writers: feature files, delimited text, JSON, yearly grids."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions.constants import CATEGORY_COLUMNS, FEATURE_FILE_DROP, LEAKAGE_COLUMNS
from harrow.functions.nulls import nan_to_null
from harrow.operators.cleaning import narrow_floats

log = logging.getLogger(__name__)


def load_feature_csv(spark: SparkSession, path: str, schema: T.StructType, target: str = "yield_kg_ha") -> DataFrame:
    """Feature CSV that must hold the target, the leakage and the dropped columns."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    missing = {target, *LEAKAGE_COLUMNS, *FEATURE_FILE_DROP} - set(df.columns)
    if missing:
        raise ValueError(f"Missing expected columns: {sorted(missing)}")
    return df


def load_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet or CSV by suffix; NaN becomes missing."""
    if path.endswith(".parquet"):
        return nan_to_null(spark.read.parquet(path))
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        return nan_to_null(reader.csv(path))
    raise ValueError(f"Unsupported format: {path}. Use .csv or .parquet")


def save_parquet(df: DataFrame, path: str, compression: str = "zstd") -> str:
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return path


def csv_to_parquet(
    spark: SparkSession, source: str, target: str | None = None, compression: str = "zstd",
    schema: T.StructType | None = None,
) -> str:
    """CSV to Parquet with doubles narrowed to floats."""
    if compression not in ("zstd", "snappy"):
        raise ValueError(f"Unsupported compression: {compression}")
    target = target or source.removesuffix(".csv") + ".parquet"
    return save_parquet(narrow_floats(load_dataset(spark, source, schema)), target, compression)


def read_delimited(
    spark: SparkSession, path: str, columns: list[str], delimiter: str = ",", encoding: str = "UTF-8"
) -> DataFrame:
    """Delimited text with a header; every column is a string."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).options(header=True, sep=delimiter, encoding=encoding).csv(path)


def write_delimited(
    df: DataFrame, path: str, columns: list[str] | None = None, delimiter: str = ",", encoding: str = "UTF-8", compression: str = "none"
) -> str:
    """Delimited text with a header; an empty table is refused.

    Rows are counted while they are written, so ``df`` is derived once; only where it would replace a file its first row is sought before.
    """
    target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    if folder.exists(target) and df.isEmpty():
        raise ValueError("No data to write")
    written = Observation()
    df.select(*(columns or df.columns)).observe(written, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").options(
        header=True, sep=delimiter, encoding=encoding, compression=compression
    ).csv(path)
    if not written.get["rows"]:
        folder.delete(target, True)
        raise ValueError("No data to write")
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def typed_survey(df: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Types of the survey CSV: date, text categories, boolean, byte flag."""
    casts = {
        "observation_date": F.to_date("observation_date", date_format),
        "irrigation_applied": F.col("irrigation_applied").cast("boolean"),
        "data_quality_flag": F.col("data_quality_flag").cast("tinyint"),
        **{c: F.col(c).cast("string") for c in CATEGORY_COLUMNS},
    }
    return df.withColumns({c: e for c, e in casts.items() if c in df.columns})


# --- yearly grids ----------------------------------------------------------------------
def write_by_year(df: DataFrame, path: str, time: str = "time", mode: str = "overwrite") -> str:
    """One partition folder per calendar year that has rows.

    The rebalance hint lets Spark split a year that is much larger than others
    over several files instead of one task per year.
    """
    df.withColumn("year", F.year(time)).hint("rebalance", "year").write.mode(mode).partitionBy("year").parquet(path)
    return path


def years_present(spark: SparkSession, path: str) -> set[int]:
    """Years already written; an absent path has none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        return set()
    names = [s.getPath().getName() for s in files.listStatus(target)]
    return {int(n.removeprefix("year=")) for n in names if n.startswith("year=")}


def append_new_years(df: DataFrame, path: str, time: str = "time") -> str:
    """Append only the years that are not there yet."""
    spark = df.sparkSession
    known = spark.createDataFrame([(y,) for y in sorted(years_present(spark, path))], "year int")
    fresh = df.withColumn("year", F.year(time)).join(F.broadcast(known), "year", "left_anti").drop("year")
    return write_by_year(fresh, path, time, mode="append")


def collect_years(
    spark: SparkSession, years: Iterable[int], load_year: Callable[[int], DataFrame], path: str, time: str = "time"
) -> list[int]:
    """Load and append the years not written yet; a year that fails is logged and skipped."""
    present, done = years_present(spark, path), []
    for year in years:
        if year in present:
            continue
        try:
            write_by_year(load_year(year), path, time, mode="append")
            done.append(year)
        except Exception as error:  # noqa: BLE001 - one bad year must not stop the others
            log.warning("Year %s skipped: %s", year, error)
    return done
