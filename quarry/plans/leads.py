"""Leads: labelled groups of places that a lane must look at, built from relations by a table of specifications, and which of them are still open."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.joins import near_spans


@dataclass(frozen=True)
class LeadSpec:
    """lanes, label, relation it reads, SQL filter over it, whether a place is a line or a file, SQL expression of the row's text."""

    lanes: tuple[str, ...]
    label: str
    relation: str
    where: str = "true"
    by_line: bool = True
    text: str = "''"


def _signal(lanes: str, kind: str, label: str, where: str = "true", by_line: bool = True) -> LeadSpec:
    return LeadSpec(tuple(lanes.split()), label, "signals", f"kind = '{kind}' and ({where})", by_line, "text")


#: Specifications in report order; register more by appending.
LEADS: list[LeadSpec] = [
    LeadSpec(("security",), "identity asserted by the client", "routes", "array_contains(flags, 'CLIENT-ASSERTED IDENTITY')", False, "concat(method, ' ', path)"),
    LeadSpec(("security",), "object ids in the path without user verification", "routes", "path rlike '(?i)[{][^}]*(id|thread|key|name)[^}]*[}]' and not user_token_verified", False, "concat(method, ' ', path)"),
    LeadSpec(("auth",), "authentication entry points", "routes", "array_contains(flags, 'AUTH ENTRY POINT')", False, "concat(method, ' ', path)"),
    LeadSpec(("inputs",), "uploads", "routes", "accepts_upload", False, "concat(method, ' ', path)"),
    LeadSpec(("llm",), "chat and agent routes", "routes", "path rlike '(?i)chat|agent|assistant|ask|conversation'", False, "concat(method, ' ', path)"),
    LeadSpec(("integration", "testing"), "client calls without a route", "unmatched_calls", "true", False, "path"),
    LeadSpec(("secrets",), "environment files with flags or duplicates", "env_files", "size(flags) > 0 or size(lines) > 1", False, "key"),
    LeadSpec(("maintainability",), "large duplicated blocks", "clone_sizes", "lines >= 30", False, "concat(lines, ' lines')"),
    LeadSpec(("correctness",), "functions that combine effects", "hotspots", "true", False, "name"),
    LeadSpec(("security",), "handlers that combine effects", "hotspots", "handler", False, "name"),
    LeadSpec(("dependencies",), "families declared twice", "duplicate_families", "true", False, "family"),
    LeadSpec(("dependencies",), "dependencies that nothing imports", "unused_dependencies", "true", False, "package"),
    _signal("performance", "python-blocking-call-in-async-def", "blocking calls in async functions"),
    _signal("correctness", "python-random-identifier", "random identifiers"),
    _signal("correctness", "fire_and_forget_tasks", "tasks nobody awaits"),
    _signal("auth", "naive_datetimes", "naive datetimes in authentication code", "file rlike '(?i)(auth|security|jwt|token|otp|session|password|login)'"),
    _signal("correctness", "naive_datetimes", "naive datetimes", "not file rlike '(?i)(auth|security|jwt|token|otp|session|password|login)'"),
    _signal("inputs", "subprocess_no_timeout", "processes without timeout"),
    _signal("observability", "print_live", "prints in live code", by_line=False),
    _signal("testing", "pipeline_hygiene", "pipelines that cannot fail"),
    _signal("integration", "schema_marked_not_migrated", "schemas marked instead of migrated"),
    _signal("dependencies", "supply_chain", "unpinned images"),
    _signal("secrets", "packaged_artifacts", "whole folders copied into images"),
    _signal("security", "deploy_env", "privileged services"),
]


def build(relations: dict[str, DataFrame], specs: list[LeadSpec] = LEADS) -> DataFrame:
    """(lane, label, file, line, text): line is null where a place is a whole file. Specifications of relations that are not given are left out."""
    out = None
    for spec in specs:
        if spec.relation not in relations:
            continue
        rows = relations[spec.relation].where(spec.where)
        file = F.col("file") if "file" in rows.columns else F.col("source_file") if "source_file" in rows.columns else F.lit(None).cast("string")
        line = F.col("line").cast("int") if spec.by_line and "line" in rows.columns else F.lit(None).cast("int")
        one = rows.select(F.explode(F.array(*map(F.lit, spec.lanes))).alias("lane"), F.lit(spec.label).alias("label"), file.alias("file"), line.alias("line"), F.expr(spec.text).cast("string").alias("text")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def open_leads(leads: DataFrame, spans: DataFrame, dismissed: DataFrame, any_lane: bool = False, tolerance: int = 15, small: int = 25) -> DataFrame:
    """Leads that neither a citation (spans: lane, file, low, high) comes near nor a dismissal (lane, label) covers. In groups of over ``small``
    places one cited place settles the group; in smaller ones each place is asked for."""
    keys = ["file"] if any_lane else ["lane", "file"]
    cited = spans if not any_lane else spans.drop("lane")
    key = F.concat_ws("\0", *keys)
    spread = cited.withColumn("k", key).select("k", "low", "high").distinct()
    placed = leads.withColumn("k", key)
    by_line = near_spans(placed.where("line is not null").select("k", "line").distinct(), spread, "k", "line", "low", "high", tolerance).select("k", "line").distinct().withColumn("hit", F.lit(True))
    by_file = spread.select("k").distinct().withColumn("file_hit", F.lit(True))
    marked = placed.join(by_line, ["k", "line"], "left").join(by_file, "k", "left").withColumn("met", F.when(F.col("line").isNull(), F.coalesce("file_hit", F.lit(False))).otherwise(F.coalesce("hit", F.lit(False))))
    groups = marked.groupBy("lane", "label").agg(F.count("*").alias("n"), F.bool_or("met").alias("any_met"))
    left = marked.join(groups, ["lane", "label"]).where(~F.col("met") & ~((F.col("n") > small) & F.col("any_met")))
    return left.join(dismissed, ["lane", "label"], "left_anti").select("lane", "label", "file", "line", "text")


def kpi_leads(findings: DataFrame, mapping: DataFrame) -> DataFrame:
    """(kpi, id, file, line): tool findings of rules that a KPI asks about, by the last part of the rule's name."""
    return findings.withColumn("rule", F.element_at(F.split("category", r"\."), -1)).join(mapping, "rule").select(F.explode("kpis").alias("kpi"), "id", "file", "line")


def clone_sizes(findings: DataFrame) -> DataFrame:
    """(file, lines): duplicated lines a file, summed from the duplicate finder's messages."""
    n = F.regexp_extract("message", r"\((\d+) lines", 1).try_cast("int")
    return findings.where("tool = 'jscpd'").groupBy("file").agg(F.sum(n).alias("lines"))


def absent_leads(controls: DataFrame, lane_of: str = "lane") -> DataFrame:
    """Leads without a place: controls (lane, label) for which there is no evidence anywhere."""
    return controls.select(F.col(lane_of).alias("lane"), F.concat(F.lit("absent: "), "label").alias("label"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.lit("").alias("text"))
