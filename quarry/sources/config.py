"""Review configuration: a TOML file to small dimension tables, with referential checks."""

from __future__ import annotations

import hashlib
import tomllib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


class ConfigError(ValueError):
    pass


def parse(raw: bytes) -> dict:
    """The configuration and its content hash. Category and KPI ids and codes must be unique; tool owners must be categories."""
    data = tomllib.loads(raw.decode("utf-8"))
    categories, kpis, owners = data.get("categories", []), data.get("kpis", []), data.get("tool_owners", {})
    wrong = []
    for what, values in (("category id", [c["id"] for c in categories]), ("category code", [c["code"] for c in categories]), ("KPI id", [k["id"] for k in kpis])):
        twice = sorted({v for v in values if values.count(v) > 1})
        wrong += [f"{what} {v} occurs more than once" for v in twice]
    known = {c["id"] for c in categories}
    wrong += [f"owner {owner} of {tool} is no category" for tool, owner in sorted(owners.items()) if owner not in known]
    if wrong:
        raise ConfigError("; ".join(wrong))
    return data | {"content_hash": hashlib.sha256(raw).hexdigest()}


@lru_cache(maxsize=16)
def _load(path: str) -> str:
    with open(path, "rb") as f:
        return f.read().decode("latin-1")


def load(path: str) -> dict:
    return parse(_load(path).encode("latin-1"))


def dimensions(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """categories (with place, the report order, and effort for launching), kpis, tool_owners."""
    cats = [(i, c["id"], c["code"], c.get("label", c["id"]), int(c.get("effort", 1))) for i, c in enumerate(config.get("categories", []), 1)]
    return {
        "categories": spark.createDataFrame(cats, "place int, category string, code string, label string, effort int"),
        "kpis": spark.createDataFrame([(k["id"], k.get("title", "")) for k in config.get("kpis", [])], "kpi string, title string"),
        "tool_owners": spark.createDataFrame(sorted(config.get("tool_owners", {}).items()), "tool string, category string"),
    }


def launch_order(categories: DataFrame) -> DataFrame:
    """Longest work first, in report order among equals."""
    from pyspark.sql import functions as F

    return categories.orderBy(F.desc("effort"), "place")
