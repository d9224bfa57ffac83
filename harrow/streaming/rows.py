"""Row-wise operators on a stream of Parquet files.

Everything here is stateless, so the batch functions take a streaming
DataFrame as they are; no watermark or state store is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from harrow.operators.quality import Model, validate


def read_files(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def validated(stream: DataFrame, model: Model) -> DataFrame:
    return validate(stream, model)


def write_available(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; the checkpoint makes a restart go on where it ended."""
    return (
        stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
