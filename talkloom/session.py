"""Session and cluster helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("talkloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only on one machine where none is set (tests)."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        named = "file://" + tempfile.mkdtemp(prefix="talkloom-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir() or named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any scheme."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder of any file system holds a written Parquet table."""
    fs, where = file_system(spark, path)
    return fs.exists(where) and any(f.getPath().getName().endswith(".parquet") or f.isDirectory() for f in fs.listStatus(where))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy row work when the scan yields fewer tasks than cores.

    Large inputs already have more tasks than cores and pass unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="talkloom-"), "talkloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("talkloom", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def bounded_sample(df: DataFrame, by: list[str], bound: int, text: str | None = None, most_bytes: int | None = None) -> list:
    """About ``bound`` rows (all, where there are no more), chosen by a hash of ``by``.

    With ``text`` and ``most_bytes`` the sample also keeps to that many bytes of the column. The
    share is taken from exact counts, so that each task sends its share only, however many tasks
    there are; rows of equal keys stay together, and every run chooses the same rows.
    """
    size = F.sum(F.octet_length(text)) if text else F.lit(0)
    total, size = df.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    share = min(1.0, bound / max(1, total), (most_bytes or size or 1) / max(1, size))
    if share < 1.0:
        kept = F.col("__h").bitwiseAND(F.lit((1 << 63) - 1)) < F.lit(int(share * (1 << 63)))
        df = df.withColumn("__h", F.xxhash64(*by)).filter(kept).drop("__h")
    return df.collect()
