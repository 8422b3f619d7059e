"""Written intermediate tables for iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a folder of our own where it is unset (local runs)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quarry.work.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("quarry.work.dir", root)
    return root.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, written to the work folder and read again: lineage ends here and lost executors cost nothing. Spark drops the shuffles that the table replaces."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/quarry-work/{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
