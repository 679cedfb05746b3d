"""Session settings and staging of intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_staged: list[str] = []
_local_folders: dict[str, str] = {}


def build_session(app: str = "lexispark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for (AQE on, UTC)."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for staged tables, as the session names it in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder of its own; on a
    cluster the folder has to be reachable from every executor, so it must be named.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = "file://" + tempfile.mkdtemp(prefix="lexispark-")
    return _local_folders[application]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = os.path.join(shared_folder(spark), "lexispark", f"{name}-{uuid.uuid4().hex}")
    _staged.append(path)
    return path


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables this process has staged, once their readers are done."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(hadoop).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Delete one table that `stage` has returned, once nothing reads it any more."""
    path = getattr(df, "_staged_at", None)
    if path in _staged:
        _staged.remove(path)
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, fixes values that depend on
    the partitioning, and gives the optimizer the true size of the table: whether the
    table is broadcast in a later join is then decided by Spark's own size threshold.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def small_table(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A literal table (lexicon, stop list, grid). Arrow input gives it known statistics."""
    return spark.createDataFrame(pa.table(columns))


def spread_scan(scan: DataFrame, key: str) -> DataFrame:
    """Distribute a table scan with fewer splits than cores by its key, so that row-local text work runs in parallel.

    A table of many files or row groups is returned as it is. Only for plain scans: counting the splits
    of a plan with joins would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan
