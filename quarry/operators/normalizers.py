"""Tool payloads to one finding schema: tool, file, line, severity, category, message, with content ids.

Each normaliser takes a DataFrame with a JSON column ``payload`` (one tool result a row) and explodes it with a declared schema.
Payloads that do not parse give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import finding_id, repo_relative

Normalizer = Callable[[DataFrame], DataFrame]
NORMALIZERS: dict[str, Normalizer] = {}


def register_normalizer(tool: str):
    """Adds a tool: a function from payloads to (file, line, severity, category, message)."""

    def add(f: Normalizer) -> Normalizer:
        NORMALIZERS[tool] = f
        return f

    return add


def _or(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def _mapped(value: Column, pairs: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in pairs.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def _each(raw: DataFrame, schema: str) -> DataFrame:
    return raw.select(F.explode(F.from_json("payload", schema)).alias("x"))


def _row(file: Column, line: Column, severity: Column, category: Column, message: Column) -> list[Column]:
    return [file.alias("file"), line.cast("int").alias("line"), severity.alias("severity"), category.alias("category"), message.alias("message")]


@register_normalizer("ruff")
def ruff(raw: DataFrame) -> DataFrame:
    x = _each(raw, "array<struct<filename: string, code: string, message: string, location: struct<row: int>>>")
    return x.select(*_row(F.col("x.filename"), F.col("x.location.row"), F.lit("warning"), _or(F.col("x.code"), "unknown"), F.col("x.message")))


@register_normalizer("pyright")
def pyright(raw: DataFrame) -> DataFrame:
    """Lines are taken as they come (from 0)."""
    x = raw.select(F.explode(F.from_json("payload", "generalDiagnostics array<struct<file: string, severity: string, rule: string, message: string, range: struct<start: struct<line: int>>>>").generalDiagnostics).alias("x"))
    return x.select(*_row(F.col("x.file"), F.col("x.range.start.line"), _mapped(F.col("x.severity"), {"error": "error", "warning": "warning", "information": "info"}, "error"), _or(F.col("x.rule"), "unknown"), F.col("x.message")))


def radon(raw: DataFrame, ignore_complexity: tuple[str, ...] = ("A", "B"), ignore_index: tuple[str, ...] = ("A",)) -> DataFrame:
    """Per-file values may be an error text instead of a list: both maps are read as strings and then typed."""
    top = raw.select(F.from_json("payload", "complexity map<string, string>, maintainability map<string, string>").alias("p"))
    blocks = top.select(F.explode("p.complexity").alias("file", "v")).select("file", F.explode(F.from_json("v", "array<struct<type: string, name: string, rank: string, complexity: int, lineno: int>>")).alias("x")).where(F.col("x.rank").isNotNull() & ~F.col("x.rank").isin(*ignore_complexity))
    index = top.select(F.explode("p.maintainability").alias("file", "v")).select("file", F.from_json("v", "mi string, rank string").alias("x")).where(F.col("x.rank").isNotNull() & ~F.col("x.rank").isin(*ignore_index))
    a = blocks.select(*_row(F.col("file"), F.col("x.lineno"), F.when(F.col("x.rank") == "C", "warning").otherwise("error"), F.concat(F.lit("complexity_"), "x.rank"), F.format_string("%s '%s' has complexity rank %s (score %d)", F.coalesce("x.type", F.lit("function")), F.coalesce("x.name", F.lit("?")), "x.rank", "x.complexity")))
    b = index.select(*_row(F.col("file"), F.lit(None), F.when(F.col("x.rank") == "B", "warning").otherwise("error"), F.concat(F.lit("maintainability_"), "x.rank"), F.format_string("Maintainability index rank %s (score %s)", "x.rank", "x.mi")))
    return a.unionByName(b)


register_normalizer("radon")(radon)


@register_normalizer("vulture")
def vulture(raw: DataFrame) -> DataFrame:
    x = _each(raw, "array<struct<file: string, line: string, message: string, confidence: string>>")
    return x.select(*_row(F.col("x.file"), F.col("x.line").try_cast("int"), F.lit("warning"), F.lit("dead_code"), F.format_string("%s (%s%% confidence)", F.coalesce("x.message", F.lit("")), F.coalesce("x.confidence", F.lit("?")))))


@register_normalizer("jscpd")
def jscpd(raw: DataFrame) -> DataFrame:
    """A duplicated pair is one finding in each of its two files."""
    side = "struct<name: string, startLoc: struct<line: int>>"
    x = _each(raw, f"array<struct<firstFile: {side}, secondFile: {side}, lines: int, tokens: int>>")
    y = x.select("x.lines", "x.tokens", F.explode(F.array("x.firstFile", "x.secondFile")).alias("side"))
    return y.select(*_row(F.coalesce("side.name", F.lit("")), F.col("side.startLoc.line"), F.lit("warning"), F.lit("duplicate_code"), F.format_string("Duplicate code block (%s lines, %s tokens)", F.coalesce(F.col("lines").cast("string"), F.lit("?")), F.coalesce(F.col("tokens").cast("string"), F.lit("?")))))


def lizard(raw: DataFrame, error_above: int = 20) -> DataFrame:
    x = _each(raw, "array<struct<file: string, function: string, line: string, ccn: string>>")
    ccn = F.col("x.ccn").try_cast("int")
    return x.select(*_row(F.col("x.file"), F.col("x.line").try_cast("int"), F.when(ccn > error_above, "error").otherwise("warning"), F.lit("cyclomatic_complexity"), F.format_string("Function '%s' has cyclomatic complexity %s", F.coalesce("x.function", F.lit("?")), "x.ccn")))


register_normalizer("lizard")(lizard)


@register_normalizer("pip_audit")
def pip_audit(raw: DataFrame) -> DataFrame:
    """Advisories without a fixed version are critical."""
    schema = "dependencies array<struct<name: string, version: string, source_file: string, source_line: int, vulns: array<struct<id: string, description: string, fix_versions: array<string>>>>>"
    x = raw.select(F.explode(F.from_json("payload", schema).dependencies).alias("d")).select("d.name", "d.version", "d.source_file", "d.source_line", F.explode("d.vulns").alias("v"))
    return x.select(*_row(F.coalesce("source_file", F.lit("requirements.txt")), F.col("source_line"), F.when(F.size(F.coalesce("v.fix_versions", F.array().cast("array<string>"))) == 0, "critical").otherwise("high"), F.coalesce("v.id", F.lit("cve")), F.concat(F.concat_ws(" ", "name", "version"), F.lit(": "), F.coalesce(F.nullif("v.description", F.lit("")), "v.id", F.lit("")))))


@register_normalizer("semgrep")
def semgrep(raw: DataFrame) -> DataFrame:
    x = _each(raw, "array<struct<check_id: string, path: string, start: struct<line: int>, extra: struct<severity: string, message: string>>>")
    return x.select(*_row(F.col("x.path"), F.col("x.start.line"), _mapped(F.lower("x.extra.severity"), {"error": "high", "warning": "medium", "info": "low"}, "low"), F.coalesce("x.check_id", F.lit("semgrep_rule")), F.coalesce("x.extra.message", F.lit(""))))


@register_normalizer("bandit")
def bandit(raw: DataFrame) -> DataFrame:
    x = _each(raw, "array<struct<filename: string, line_number: int, issue_severity: string, test_id: string, issue_text: string>>")
    return x.select(*_row(F.col("x.filename"), F.col("x.line_number"), F.lower(_or(F.col("x.issue_severity"), "low")), F.coalesce("x.test_id", F.lit("bandit_rule")), F.col("x.issue_text")))


@register_normalizer("gitleaks")
def gitleaks(raw: DataFrame) -> DataFrame:
    x = _each(raw, "array<struct<File: string, StartLine: int, RuleID: string, Description: string>>")
    return x.select(*_row(F.col("x.File"), F.col("x.StartLine"), F.lit("critical"), F.coalesce("x.RuleID", F.lit("secret")), F.coalesce("x.Description", F.lit("Potential hardcoded secret detected"))))


def normalize(results: DataFrame, root: str = "") -> DataFrame:
    """All tools at once: (tool, status, payload) to findings with repository-relative paths and ids. Only successful results count."""
    done = results.where("status = 'success'")
    out = None
    for tool, f in NORMALIZERS.items():
        rows = f(done.where(F.col("tool") == tool)).select(F.lit(tool).alias("tool"), (repo_relative(F.col("file"), root) if root else F.col("file")).alias("file"), "line", "severity", "category", "message")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("id", finding_id(F.col("tool"), F.col("category"), F.col("file"), F.col("line"), F.col("message")))


def lizard_csv(rows: DataFrame, least: int) -> DataFrame:
    """(file, function, line, ccn) of a value column with the tool's CSV lines, from a complexity on; other lines are dropped."""
    cells = F.from_csv(F.col("value"), F.lit("c0 string, c1 string, c2 string, c3 string, c4 string, c5 string, c6 string, c7 string, c8 string, c9 string, c10 string"))
    return rows.select(cells.alias("c")).select(F.col("c.c6").alias("file"), F.col("c.c7").alias("function"), F.col("c.c9").try_cast("int").alias("line"), F.col("c.c1").try_cast("int").alias("ccn")).where(F.col("ccn") >= least)
