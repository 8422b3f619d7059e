"""Test tables as relations of the engine (which stands for which: see README)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(files: DataFrame, text: str = "text", carry: tuple[str, ...] = ("path",)) -> DataFrame:
    """carry, line_no (from 1) and line of every line of a text; none for a null text."""
    return files.select(*carry, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).select(*carry, (F.col("pos") + 1).alias("line_no"), "line")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as text files: path ``source/doc_id``, language."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), "source", "text")
