"""Relational store operations as pure functions from tables to tables; a caller publishes a result by an atomic overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.windows import first_by


def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """stored and, of the new rows whose key it lacks, the first of each key. Null key parts compare as equal."""
    first = first_by(new, keys, order)
    renamed = stored.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = part if same is None else same & part
    return stored.unionByName(first.join(renamed, same, "left_anti"))


def partial_update(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """stored with the non-null values of changes (columns of stored); of several rows a key the greatest value of each column counts."""
    changed = [c for c in changes.columns if c != key]
    renamed = changes.groupBy(key).agg(*[F.max(c).alias(f"__{c}") for c in changed])
    return stored.join(renamed, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in changed else F.col(c) for c in stored.columns])


def upsert(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows replace stored rows of the same key; the others stay."""
    return stored.join(rows.select(key), key, "left_anti").unionByName(rows)


def fail_stale(reviews: DataFrame, status: str, created: str, cut_off: Column, active: list[str], error: str) -> DataFrame:
    """Active rows created before the cut-off become failed and get the error; the rest is unchanged."""
    stale = F.col(status).isin(active) & (F.col(created) < cut_off)
    return reviews.withColumn("error", F.when(stale, F.lit(error))).withColumn(status, F.when(stale, F.lit("failed")).otherwise(F.col(status)))


def delete_cascade(parents: DataFrame, gone: DataFrame, key: str, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """parents without the keys in gone, and each child table without rows of those keys."""
    return {name: t.join(gone.select(key).distinct(), key, "left_anti") for name, t in {"parents": parents, **children}.items()}


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The 1-based page in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


#: What may follow each status of a review.
TRANSITIONS = {"pending": ["running", "failed", "skipped"], "running": ["completed", "failed", "skipped"], "completed": [], "failed": [], "skipped": []}


def move_status(reviews: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Applies (key, new_status) where the transition is allowed; adds accepted (null: no change asked for). Several changes of one key are one
    that is refused: in what order they came is not known."""
    allowed = F.lit(False)
    for before, after in TRANSITIONS.items():
        allowed = allowed | ((F.col("status") == before) & F.col("new_status").isin(after or ["-"]))
    one = changes.groupBy(key).agg(F.when(F.countDistinct("new_status") > 1, "-").otherwise(F.max("new_status")).alias("new_status"))
    joined = reviews.join(one, key, "left")
    return joined.withColumn("accepted", F.when(F.col("new_status").isNotNull(), allowed)).withColumn("status", F.when(allowed, F.col("new_status")).otherwise(F.col("status"))).drop("new_status")


def summaries(parents: DataFrame, children: DataFrame, key: str, when: list[str], columns: list[str]) -> DataFrame:
    """parents with the latest child's columns and n_children (0 without any): one aggregation, one join."""
    latest = children.groupBy(key).agg(F.count("*").alias("n_children"), F.max_by(F.struct(*columns), F.struct(*when)).alias("x")).select(key, "n_children", *[F.col(f"x.{c}").alias(c) for c in columns])
    return parents.join(latest, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
