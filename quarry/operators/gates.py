"""Controls that are missing where they apply: a rule dimension divided by what the code shows.

A gate has alternatives, an alternative conditions; a gate is open if all conditions of one of its alternatives are met. A condition counts what a pattern finds in the
texts, or reads a number that another relation gives. A control is missing if its gate is open and no text holds its evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.joins import absent

# Gates by alternative; what is counted in texts (pattern) or given (fact), and how often it must occur.
PERSONAL = r"(?i)\b(email|phone|address|date_of_birth|dob|national_id|ssn|passport|resume|patient|customer|employee|applicant|salary|iban|card_number)\b"
SCORES = r"(?i)\bdef\s+\w*(score|rank|rerank|classify|approve|decide|eligib|rating|risk)\w*\s*\("
STATE = r"(?i)sqlalchemy|psycopg|asyncpg|chromadb|pymongo|redis|create_engine|qdrant|faiss"
CONDITIONS = [
    ("pii", 1, PERSONAL, None, 5), ("scoring", 1, SCORES, None, 1), ("scoring", 1, None, "models", 1), ("stateful", 1, STATE, None, 1), ("llm", 1, None, "models", 1), ("uploads", 1, None, "uploads", 1),
    ("jobs", 1, None, "uploads", 1), ("jobs", 2, None, "model_calls", 1), ("env", 1, "getenv|environ", None, 1),
]
CONDITION = "gate string, alternative int, pattern string, fact string, least int"


def conditions(spark: SparkSession, rows: list[tuple] = CONDITIONS) -> DataFrame:
    return spark.createDataFrame(rows, CONDITION)


def open_gates(rules: DataFrame, texts: DataFrame, facts: DataFrame, text: str = "text") -> DataFrame:
    """(gate, alternative, n): alternatives all of whose conditions (CONDITION; at most 1000) are met, and how many these are. facts: fact, n. Texts are read once; matches are
    counted per pattern, not emitted."""
    patterns = [r[0] for r in rules.where("pattern is not null").select("pattern").distinct().limit(1001).collect()]
    if len(patterns) > 1000:
        raise ValueError("each pattern is a column of the one pass over the texts; give at most 1000")
    found = texts.agg(*[F.coalesce(F.sum(F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))), F.lit(0)).alias(f"n{i}") for i, p in enumerate(patterns)], F.count("*").alias("texts"))
    none = F.array().cast("array<struct<pattern: string, n: bigint>>")
    counted = found.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"n{i}").cast("long").alias("n")) for i, p in enumerate(patterns)]) if patterns else none).alias("x")).select("x.pattern", F.col("x.n").alias("seen"))
    given = facts.groupBy("fact").agg(F.sum("n").alias("told"))
    met = rules.join(counted, "pattern", "left").join(given, "fact", "left")
    good = F.coalesce(F.when(F.col("pattern").isNotNull(), F.col("seen")).otherwise(F.col("told")), F.lit(0)) >= F.col("least")
    return met.groupBy("gate", "alternative").agg(F.bool_and(good).alias("all_met"), F.count("*").alias("n")).where("all_met").select("gate", "alternative", "n")


def missing_controls(controls: DataFrame, rules: DataFrame, code: DataFrame, facts: DataFrame, infrastructure: DataFrame | None = None) -> DataFrame:
    """The controls (gate, evidence, further columns) whose gate is open and whose evidence neither code (text) nor infrastructure files (text) hold."""
    searched = code.select("text") if infrastructure is None else code.select("text").union(infrastructure.select("text"))
    gates = open_gates(rules, code, facts).select("gate").distinct()
    return absent(controls, searched, "evidence", "text").join(gates, "gate", "left_semi")
