"""Signals over the relation of syntax nodes that concern a function as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import test_path
from quarry.operators.patterns import shown

# Calls that open a session or connection; what a test asserts with.
OPENS = r"(?i)session|connect|engine\.begin|pool\.acquire"
ASSERTS = r"assert|pytest\.raises"


def leaky_sessions(nodes: DataFrame) -> DataFrame:
    """(path, line, name): functions that yield and open a session or connection themselves, with neither a ``finally`` nor a ``with`` of their own. What
    a nested function does is its own."""
    own = lambda cond: nodes.where(cond).select("path", F.col("scope").alias("node")).distinct()
    functions = nodes.where("kind in ('FunctionDef', 'AsyncFunctionDef')").select("path", "node", "line", F.col("value").alias("name"))
    opening = own((F.col("field") == "func") & F.regexp_like(F.substr(shown(), F.lit(3)), F.lit(OPENS)))
    closing = own(F.col("kind").isin("With", "AsyncWith") | ((F.col("kind") == "Try") & (F.element_at("sizes", "finalbody") > 0)))
    yielding = own(F.col("kind").isin("Yield", "YieldFrom"))
    return functions.join(yielding, ["path", "node"], "left_semi").join(opening, ["path", "node"], "left_semi").join(closing, ["path", "node"], "left_anti").select("path", "line", "name")


def toothless_tests(files: DataFrame) -> DataFrame:
    """(path): Python test files (path, text) in which nothing is asserted. A null text asserts nothing."""
    return files.where(test_path(F.col("path")) & F.endswith("path", F.lit(".py")) & ~F.coalesce("text", F.lit("")).rlike(ASSERTS)).select("path")
