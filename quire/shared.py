"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The shuffles of a table that is written go with it: nothing reads them again, and the driver's garbage collector may leave them for long.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only in local sessions that leave it unset (tests), below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_quire_folder", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark._quire_folder = "file://" + tempfile.mkdtemp(prefix="quire-")
    return f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table written below the shared folder and read again: a cut of the lineage that survives lost executors."""
    spark, path = df.sparkSession, f"{folder(df.sparkSession)}/{name}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def remove(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave, once all that reads them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._quire_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path.getParent(), True)
