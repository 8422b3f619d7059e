"""Ranking, running and capping operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in a total order. Spark prunes to one row a task before the shuffle (window group limit)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def latest_by(df: DataFrame, keys: list[str], when: list[str], columns: list[str]) -> DataFrame:
    """The row of the largest ``when`` of each key, by one partial aggregation."""
    last = F.max_by(F.struct(*columns), F.struct(*when)).alias("x")
    return df.groupBy(*keys).agg(last).select(*keys, *[f"x.{c}" for c in columns])


def top_with_cap(df: DataFrame, group: str, order: list[Column], per_group: int, overall: int) -> DataFrame:
    """At most ``per_group`` rows a group, then the best ``overall``."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= per_group).drop("__n")
    return ranked.orderBy(*order).limit(overall)


def duplicates_flag(df: DataFrame, keys: list[str], name: str = "duplicate") -> DataFrame:
    """Whether a row's key occurs more than once: counted first, then joined, so a hot key is not gathered."""
    often = df.groupBy(*keys).agg((F.count("*") > 1).alias(name))
    return df.join(often, keys)


def within_budget(df: DataFrame, keys: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows, with used, until the running size exceeds the budget of the key."""
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(running)).where(F.col("used") <= budget)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def batches(df: DataFrame, keys: list[str], order: list[Column], size: int, name: str = "batch") -> DataFrame:
    """Chunks of ``size`` consecutive rows within a key, from 0."""
    return numbered(df, keys, order, "__n").withColumn(name, F.floor((F.col("__n") - 1) / size)).drop("__n")


def capped_list(df: DataFrame, keys: list[str], order: list[Column], limit: int, label: str) -> DataFrame:
    """keys, position, label: the first rows of each key and, if there are more, one remainder row."""
    ranked = numbered(df.select(*keys, label), keys, [F.col(label)] if not order else order, "position")
    kept = ranked.where(F.col("position") <= limit).select(*keys, "position", label)
    more = df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys, F.lit(limit + 1).alias("position"), F.concat(F.lit("… "), (F.col("count") - limit).cast("string"), F.lit(" more")).alias(label))
    return kept.unionByName(more)
