"""Report tables and their Markdown: every line is a row (section, position, line), so a report of any size is written without collecting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalars import CONFIDENCES, SEVERITIES, evidence_label, rank_of


def assemble(findings: DataFrame, floor: str = "medium") -> DataFrame:
    """Findings that are reported: no duplicates, confidence at the floor or above."""
    return findings.where(F.col("duplicate_of").isNull() & (rank_of(F.col("confidence"), CONFIDENCES) >= CONFIDENCES.index(floor)))


def numbered_sections(findings: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds section: place of the category . rank by severity, then finding number. A category is one lane of one review (capped)."""
    order = Window.partitionBy("category").orderBy(rank_of(F.col("severity"), SEVERITIES), F.regexp_extract("id", r"(\d+)$", 1).try_cast("int"), "id")
    return findings.join(categories, "category").withColumn("section", F.concat_ws(".", F.col("place").cast("string"), F.row_number().over(order).cast("string")))


def issues_summary(findings: DataFrame) -> DataFrame:
    """(kind, name, n): by severity, by category, and in total."""
    return findings.groupingSets([["severity"], ["category"], []], "severity", "category").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).select(F.when(F.col("g") == 1, "severity").when(F.col("g") == 2, "category").otherwise("total").alias("kind"), F.coalesce("severity", "category", F.lit("all")).alias("name"), "n")


def _cell(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def citations(evidence: Column, cap: int = 12) -> Column:
    """Labels of the first citations and how many more there are."""
    labels = F.transform(F.slice(evidence, 1, cap), lambda e: F.concat(F.lit("`"), evidence_label(e["file"], e["line_start"], e["line_end"]), F.lit("`")))
    return F.concat(F.array_join(labels, ", "), F.when(F.size(evidence) > cap, F.concat(F.lit(" +"), (F.size(evidence) - cap).cast("string"), F.lit(" more"))).otherwise(""))


def markdown(findings: DataFrame, categories: DataFrame, title: str) -> DataFrame:
    """(block, position, line): heading, counts, and for each finding its heading, severity, citations, description and impact."""
    shown = numbered_sections(findings, categories)
    counts = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count("*").alias("all"))
    text = F.concat(F.lit("**Findings:** "), F.concat_ws(", ", *[F.concat(F.col(s).cast("string"), F.lit(f" {s}")) for s in SEVERITIES]), F.lit(" — "), F.col("all").cast("string"), F.lit(" total"))
    head = counts.select(F.explode(F.array(F.struct(F.lit(0).alias("p"), F.lit(f"# {title} — Full Engineering Review").alias("line")), F.struct(F.lit(1).alias("p"), F.lit("").alias("line")), F.struct(F.lit(2).alias("p"), text.alias("line")), F.struct(F.lit(3).alias("p"), F.lit("").alias("line")))).alias("x")).select(F.lit(0).alias("block"), F.col("x.p").cast("long").alias("position"), "x.line")
    lanes = shown.groupBy("category", "label", "place").count().select(F.col("place").alias("block"), F.lit(0).cast("long").alias("position"), F.concat(F.lit("\n## "), F.col("place").cast("string"), F.lit(". "), "label").alias("line"))
    rank = F.element_at(F.split("section", r"\."), -1).cast("long")
    own = F.array(
        F.concat(F.lit("\n### "), "section", F.lit(" "), _cell(F.col("title"))), F.concat(F.lit("**Severity:** "), "severity", F.lit(" · **Confidence:** "), "confidence"),
        F.concat(F.lit("**Evidence:** "), citations(F.col("evidence"))), F.coalesce("description", F.lit("")), F.concat(F.lit("**Impact:** "), F.coalesce("impact", F.lit(""))),
    )
    body = shown.select(F.col("place").alias("block"), rank.alias("r"), F.posexplode(own).alias("p", "line")).select("block", (F.col("r") * 10 + F.col("p")).alias("position"), "line")
    return head.unionByName(lanes).unionByName(body)


def write_markdown(lines: DataFrame, folder: str) -> None:
    """Text files in reading order."""
    lines.repartitionByRange("block", "position").sortWithinPartitions("block", "position").select("line").write.mode("overwrite").text(folder)


def route_map(routes: DataFrame) -> DataFrame:
    """(block, position, line): a Markdown table of routes in path order."""
    head = routes.sparkSession.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("p"), F.lit("| Method | Path | Auth | Flags | Handler |").alias("line")), F.struct(F.lit(1).alias("p"), F.lit("|---|---|---|---|---|").alias("line")))).alias("x")).select(F.lit(0).alias("block"), F.col("x.p").cast("string").alias("position"), "x.line")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "method", _cell(F.col("path")), "auth", F.array_join("flags", ", "), F.concat(F.lit("`"), "file", F.lit(":"), F.col("line").cast("string"), F.lit("` "), "handler")), F.lit(" |"))
    return head.unionByName(routes.select(F.lit(1).alias("block"), F.concat_ws(" ", "path", "method").alias("position"), row.alias("line")))


def lines_with_rest(signals: DataFrame, cap: int = 40) -> DataFrame:
    """(kind, position, text): each kind's first places and a row that counts the rest."""
    from quarry.operators.windows import capped_list

    rows = signals.select("kind", F.concat(F.lit("`"), "file", F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")), F.lit("` "), F.coalesce("text", F.lit(""))).alias("text"))
    return capped_list(rows, ["kind"], [F.col("text")], cap, "text")
