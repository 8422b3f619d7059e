"""Line-pattern detectors over text files: (kind, file, line, text), one pass over the lines for all rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Own rules by kind: (kind, file pattern, line pattern). Comment lines are skipped where the third item says so.
RULES: list[tuple[str, str, str, bool]] = [
    ("supply_chain", r"(^|/)[^/]*Dockerfile[^/]*$", r"(?i)^\s*FROM\s+\S+(:latest)?\s*$|^\s*FROM\s+[^:@\s]+(\s+AS\s+\S+)?\s*$", True),
    ("packaged_artifacts", r"(^|/)[^/]*Dockerfile[^/]*$", r"(?i)^\s*COPY\s+\.\s", True),
    ("pipeline_hygiene", r"(^|/)(\.github/workflows/[^/]+\.ya?ml|\.gitlab-ci\.yml|Jenkinsfile)$", r"(?i)continue-on-error:\s*true|allow_failure:\s*true|\|\|\s*true\s*$", True),
    ("schema_marked_not_migrated", r"\.(sh|ya?ml|py|toml|md)$|(^|/)Dockerfile$", r"alembic\s+stamp|--fake(-initial)?\b|migrate\s+--fake", True),
    ("deploy_env", r"(^|/)(docker-)?compose[^/]*\.ya?ml$", r"^\s*privileged:\s*true", True),
    ("ci_without_checks", r"(^|/)(\.github/workflows/[^/]+\.ya?ml|\.gitlab-ci\.yml)$", r"(?i)skip[-_ ]?tests", True),
    *[(kind, r"\.(jsx?|tsx?|mjs|cjs|vue|html?)$", line, True) for kind, line in (
        ("web-dangerously-set-inner-html", r"dangerouslySetInnerHTML"), ("web-innerhtml-or-document-write", r"\.innerHTML\s*=[^=]|document\.write\("), ("web-raw-html-markdown", r"rehypeRaw|allowDangerousHtml|skipHtml=\{false\}"),
        ("web-credential-in-url", r"(?i)[?&](access_?token|token|api_?key|password)=\$?\{?"), ("web-postmessage-any-origin", r"postMessage\([^)]*,\s*['\"]\*['\"]"), ("web-redirect-from-url-param", r"location(\.href)?\s*=\s*.*(searchParams|URLSearchParams|query\.)"),
        ("web-iframe-sandbox-escape", r"sandbox=.*allow-scripts.*allow-same-origin|sandbox=.*allow-same-origin.*allow-scripts"), ("web-secret-in-client-env", r"(VITE_|NEXT_PUBLIC_|REACT_APP_|EXPO_PUBLIC_|NUXT_PUBLIC_)\w*(SECRET|PASSWORD|PRIVATE|TOKEN|API_?KEY)"),
        ("web-eval", r"\beval\(|new Function\("), ("web-credential-in-web-storage", r"(?i)(localStorage|sessionStorage)\.setItem\(\s*['\"`][^'\"`]*(token|secret|password|jwt)"), ("web-spreadsheet-export", r"XLSX\.|json_to_sheet|ExcelJS"),
    )],
]


def register_text_rule(kind: str, files: str, line: str, skip_comments: bool = True) -> None:
    RULES.append((kind, files, line, skip_comments))


def signals(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Matching lines; files that no rule concerns are dropped before their text is split."""
    wanted = F.lit(False)
    for _, names, _, _ in RULES:
        wanted = wanted | F.col(path).rlike(names)
    each = files.where(wanted & F.col(text).isNotNull()).select(F.col(path).alias("file"), F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    comment = F.col("raw").rlike(r"^\s*(#|//)")
    hits = F.array_compact(F.array(*[F.when(F.col("file").rlike(names) & F.col("raw").rlike(line) & (~comment if skip else F.lit(True)), F.lit(kind)) for kind, names, line, skip in RULES]))
    return each.select(F.explode(hits).alias("kind"), "file", (F.col("pos") + 1).alias("line"), F.trim("raw").alias("text"))


def absent_lockfiles(files: DataFrame) -> DataFrame:
    """Dependency manifests without a lock file in the same folder."""
    folder, name = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), F.element_at(F.split("path", "/"), -1)
    manifests = files.where(name.isin("package.json", "pyproject.toml", "Pipfile")).select("path", folder.alias("folder"))
    locks = files.where(name.isin("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "Pipfile.lock", "pdm.lock")).select(folder.alias("folder")).distinct()
    return manifests.join(locks, "folder", "left_anti").select("path")


def duplicate_families(dependencies: DataFrame, families: DataFrame) -> DataFrame:
    """(source_file, family, members): two or more packages of one family declared in one file."""
    met = dependencies.join(families, "package")
    return met.groupBy("source_file", "family").agg(F.array_sort(F.collect_set("package")).alias("members")).where(F.size("members") > 1)


def unused_dependencies(dependencies: DataFrame, imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """Declared packages that no file imports, by the import name an alias gives or the name itself."""
    named = dependencies.join(aliases, "package", "left").withColumn("module", F.coalesce("module", F.replace("package", F.lit("-"), F.lit("_"))))
    used = imports.select(F.element_at(F.split("name", r"\."), 1).alias("module")).where("module <> ''").distinct()
    return named.join(used, "module", "left_anti").select("package", "source_file")


def parallel_implementations(functions: DataFrame, modifiers: list[str], call_edges: DataFrame) -> DataFrame:
    """(core, names, files, lines): top-level functions of the same core words (two or more) with distinct bodies that do not call each other."""
    from quarry.functions.scalars import core_tokens

    rows = functions.where(~F.contains("qualname", F.lit("."))).where(F.col("end_line") - F.col("start_line") >= 6).withColumn("core", core_tokens(F.col("name"), modifiers)).where(F.size("core") >= 2)
    within = call_edges.join(rows.select(F.col("id").alias("caller_id"), F.col("core").alias("a")), "caller_id").join(rows.select(F.col("id").alias("callee_id"), F.col("core").alias("b")), "callee_id").where("a = b and caller_id <> callee_id").select(F.col("a").alias("core")).distinct()
    groups = rows.groupBy("core").agg(F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set("file")).alias("files"), F.countDistinct("content_hash").alias("bodies"), F.count("*").alias("members"), F.sum("loc").alias("lines"))
    return groups.where("members >= 2 and bodies >= 2 and (size(files) > 1 or size(names) > 1)").join(within, "core", "left_anti").select("core", "names", "files", "lines")


def document_claims(files: DataFrame, cap: int = 40) -> DataFrame:
    """(file, line, claim): bulleted or numbered lines of system documents, or their headings where there are none; the first ``cap`` a file."""
    from quarry.operators.windows import numbered

    docs = files.where(F.lower(F.element_at(F.split("path", "/"), -1)) == "agents.md").select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    bullet, heading = F.col("raw").rlike(r"^\s*([-*+]|\d+[.)])\s+\S"), F.col("raw").rlike(r"^#+\s+\S")
    rows = docs.withColumn("tier", F.when(bullet, 0).when(heading, 1)).where("tier is not null")
    best = rows.groupBy("file").agg(F.min("tier").alias("best"))
    kept = rows.join(best, "file").where("tier = best")
    claim = F.trim(F.regexp_replace("raw", r"^\s*([-*+]|\d+[.)]|#+)\s+", ""))
    return numbered(kept, ["file"], [F.col("pos")], "n").where(F.col("n") <= cap).select("file", (F.col("pos") + 1).alias("line"), claim.alias("claim"))


#: Runtime, file pattern, line pattern with the version in group 1.
RUNTIMES = [
    ("python", r"(^|/)\.python-version$", r"^\s*(\d[\w.]*)"), ("python", r"(^|/)pyproject\.toml$", r"^\s*requires-python\s*=\s*['\"]([^'\"]+)"), ("python", r"(^|/)[^/]*Dockerfile[^/]*$", r"(?i)^\s*FROM\s+python:(\S+)"),
    ("node", r"(^|/)\.nvmrc$", r"^\s*v?(\d[\w.]*)"), ("node", r"(^|/)package\.json$", r"\"node\"\s*:\s*\"([^\"]+)"), ("node", r"(^|/)[^/]*Dockerfile[^/]*$", r"(?i)^\s*FROM\s+node:(\S+)"),
]


def declared_runtimes(files: DataFrame) -> DataFrame:
    """(runtime, version, file, line) of version files, manifests and images."""
    wanted = F.lit(False)
    for _, names, _ in RUNTIMES:
        wanted = wanted | F.col("path").rlike(names)
    each = files.where(wanted & F.col("text").isNotNull()).select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    found = F.array_compact(F.array(*[F.when(F.col("file").rlike(names) & F.col("raw").rlike(line), F.struct(F.lit(r).alias("runtime"), F.regexp_extract("raw", line, 1).alias("version"))) for r, names, line in RUNTIMES]))
    return each.select(F.explode(found).alias("x"), "file", (F.col("pos") + 1).alias("line")).select("x.runtime", "x.version", "file", "line")
