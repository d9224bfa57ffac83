"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. They are session settings, so a cluster may set
# its own shuffle width; AQE coalesces small partitions and splits skewed ones.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # wide projections make methods the JIT refuses (over 8,000 bytes of code);
    # past that size Spark splits the projection into methods that are compiled
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Put the settings on a session somebody else made."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash a scan over all cores when it has fewer splits than there are cores.

    A table in many files has more splits than that and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("harrow")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    A temporary folder is set up only in local mode, where driver and executors are
    one process; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    folder = tempfile.mkdtemp(prefix="harrow-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created or removed here."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stabilise(df: DataFrame, file_per_task: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several jobs read one intermediate result: the files outlive any
    executor and the lineage before them is cut. With ``file_per_task`` the table belongs to a session that never packs
    several files into one task, so a task holds the rows of one written part, however well they are compressed.
    """
    path = scratch_path(df.sparkSession, "stage")
    # what the job shuffled goes as soon as the files are there, not when the driver happens to collect garbage
    before = df.sparkSession.conf.get(SHUFFLES_GO, "false")
    df.sparkSession.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.set(SHUFFLES_GO, before)
    reader = df.sparkSession
    if file_per_task:
        reader = configure(reader.newSession())
        reader.conf.set("spark.sql.files.openCostInBytes", reader.conf.get("spark.sql.files.maxPartitionBytes"))
    stored = reader.read.schema(df.schema).parquet(path)
    stored._harrow_stage = path
    return stored


def release(df: DataFrame) -> None:
    """Delete what ``stabilise`` wrote for ``df`` once nothing reads it any more."""
    path = getattr(df, "_harrow_stage", None)
    if path is None:
        raise ValueError("only a frame that stabilise() returned can be released")
    jvm = df.sparkSession.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
