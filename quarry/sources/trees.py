"""Source-tree scans: file lists with pruned folders, languages, sensitive files, dependency manifests, environment files."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import env_flags, line_count, package_name
from quarry.shared import written

# Folders not entered, source roots, root configuration files, languages by extension.
IGNORED = """.git .hg .svn node_modules __pycache__ .venv venv env .env.d dist build .pytest_cache .mypy_cache .ruff_cache .tox .nox target
    .idea .vscode .next .cache vendor coverage htmlcov site-packages cloned_repos .grimp_cache""".split()
SOURCE_ROOTS = "src app backend server api service services lib core".split()
ROOT_CONFIG = "pyproject.toml requirements.txt setup.py setup.cfg package.json Pipfile poetry.lock go.mod Cargo.toml".split()
LANGUAGES = {
    "Python": "py pyi", "JavaScript": "js mjs cjs jsx", "TypeScript": "ts tsx", "Java": "java", "Go": "go", "Ruby": "rb", "PHP": "php", "Rust": "rs", "C": "c h", "C++": "cpp cc hpp", "C#": "cs",
    "HTML": "html htm", "CSS": "css", "SCSS": "scss", "JSON": "json", "YAML": "yaml yml", "TOML": "toml", "Markdown": "md", "SQL": "sql", "Shell": "sh",
}


def language(path: Column) -> Column:
    """By lower-cased extension; null if unknown."""
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    out = None
    for name, endings in LANGUAGES.items():
        hit = ext.isin(endings.split())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def sensitive(path: Column) -> Column:
    """Environment files, which are never opened or listed; an example file is none."""
    return path.rlike(r"(^|/)\.env(\.[^/]*)?$") & ~path.rlike(r"(^|/)\.env\.example$")


def list_tree(spark: SparkSession, root: str, timeout: float = 30.0, partitions: int = 32) -> DataFrame:
    """(folder, path, kind, size_bytes, error), written: what lies below a folder that all executors share. kind: file, folder (entered), unreadable (a folder,
    or an entry of it, with its error), unlisted (a folder that time did not suffice for).

    The walk goes level by level: the folders of a level are rows, tasks list them, and those found are the next level, so the driver holds no names and rounds are as
    many as the tree is deep. Ignored folders and links to folders are not entered. Spark's file source is no help here: it hides names that begin with _ or a dot.
    """
    until = time.time() + timeout
    schema = "folder string, path string, kind string, size_bytes long, error string"

    def below(folder: str) -> Iterator[tuple]:
        if time.time() > until:
            yield folder, folder, "unlisted", None, None
            return
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError as e:
            yield folder, folder, "unreadable", None, str(e.strerror or e)
            return
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            try:
                if not entry.is_dir():
                    yield folder, path, "file", entry.stat().st_size, None
                elif not (entry.is_symlink() or entry.name in IGNORED or entry.name.endswith(".egg-info")):
                    yield folder, path, "folder", None, None
            except OSError as e:
                yield folder, path, "unreadable", None, str(e.strerror or e)

    def level(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [r for folder in batch.column(0).to_pylist() for r in below(folder)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=["folder", "path", "kind", "size_bytes", "error"])

    frontier, found = spark.createDataFrame([("",)], "folder string"), None
    while True:
        here = written(frontier.mapInArrow(level, schema))
        found = here if found is None else found.unionByName(here)
        entered = here.where("kind = 'folder'").select(F.col("path").alias("folder"))
        width = entered.count()
        if not width:
            return found
        frontier = entered.repartition(min(partitions, -(-width // 16)))


def scan_tree(spark: SparkSession, root: str, max_bytes: int = 2_000_000, timeout: float = 30.0, partitions: int = 32) -> DataFrame:
    """The files of ``scan``, all of them: raises TimeoutError if the walk ran out of time."""
    files, _, ran_out = scan(spark, root, max_bytes, timeout, partitions)
    if ran_out:
        raise TimeoutError(f"{root}: not walked within {timeout} s")
    return files


def scan(spark: SparkSession, root: str, max_bytes: int = 2_000_000, timeout: float = 30.0, partitions: int = 32) -> tuple[DataFrame, DataFrame, bool]:
    """((path, language, size_bytes, lines, skipped_due_to_size, text) of the files below a folder that driver and executors share; (folder, error)
    of folders that could not be read; whether the walk ran out of time, so that files are missing).

    Sensitive environment files are left out before anything is opened. Text is null for oversize and unreadable files; a BOM is dropped,
    undecodable bytes become replacement characters.
    """
    listed = list_tree(spark, root, timeout, partitions)
    paths = listed.where("kind = 'file'").where(~sensitive(F.col("path"))).select("path", "size_bytes").repartition(partitions)

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    texts.append(open(os.path.join(root, path), "rb").read().decode("utf-8-sig", "replace") if size <= max_bytes else None)
                except OSError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["path", "size_bytes", "text"])

    found = paths.mapInArrow(read, "path string, size_bytes long, text string")
    files = found.select("path", language(F.col("path")).alias("language"), "size_bytes", line_count(F.col("text")).alias("lines"), (F.col("size_bytes") > max_bytes).alias("skipped_due_to_size"), "text")
    unreadable = listed.where("kind = 'unreadable'").select(F.when(F.col("path") == "", ".").otherwise(F.col("path")).alias("folder"), "error")
    return files, unreadable, not listed.where("kind = 'unlisted'").isEmpty()


def surface(files: DataFrame) -> DataFrame:
    """(source_roots, root_configs): candidate roots among the top folders ('.' if none), configuration files at the top."""
    top = F.element_at(F.split("path", "/"), 1)
    deep = F.contains("path", F.lit("/"))
    found = files.agg(F.array_sort(F.collect_set(F.when(deep & top.isin(SOURCE_ROOTS), top))).alias("r"), F.array_sort(F.collect_set(F.when(~deep & F.col("path").isin(ROOT_CONFIG), F.col("path")))).alias("root_configs"))
    return found.select(F.when(F.size("r") > 0, F.col("r")).otherwise(F.array(F.lit("."))).alias("source_roots"), "root_configs")


def requirements(files: DataFrame) -> DataFrame:
    """(name, version, source_file, line) of requirements files: comments, options and URLs are skipped, markers cut."""
    name = F.element_at(F.split("path", "/"), -1)
    each = files.where(name.rlike(r"^requirements.*\.txt$")).select("path", F.posexplode(F.split("text", "\r?\n")).alias("pos", "raw"))
    line = F.trim(F.regexp_replace("raw", r"(^|\s)#.*$", ""))
    cut = F.trim(F.element_at(F.split(line, ";"), 1))
    spec = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(.*)$"
    rows = each.where((line != "") & ~line.rlike(r"^(-|https?:|git\+)") & cut.rlike(spec))
    return rows.select(F.regexp_extract(cut, spec, 1).alias("name"), F.nullif(F.trim(F.regexp_extract(cut, spec, 2)), F.lit("")).alias("version"), F.col("path").alias("source_file"), (F.col("pos") + 1).alias("line"))


def package_json(files: DataFrame) -> DataFrame:
    """(name, version, source_file) of dependencies and devDependencies."""
    maps = files.where(F.element_at(F.split("path", "/"), -1) == "package.json").select("path", F.from_json("text", "dependencies map<string, string>, devDependencies map<string, string>").alias("p"))
    both = F.explode(F.concat(F.map_entries(F.coalesce("p.dependencies", F.create_map().cast("map<string,string>"))), F.map_entries(F.coalesce("p.devDependencies", F.create_map().cast("map<string,string>"))))).alias("e")
    return maps.select("path", both).select(F.col("e.key").alias("name"), F.col("e.value").alias("version"), F.col("path").alias("source_file"))


def pyproject(files: DataFrame) -> DataFrame:
    """(name, version, source_file) of PEP 621 and Poetry tables; files that do not parse give none. TOML has no reader in Spark, so Python parses it."""

    def rows(batches):
        import re
        import tomllib

        import pyarrow as pa

        for batch in batches:
            out = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    data = tomllib.loads(text or "")
                except tomllib.TOMLDecodeError:
                    continue
                for raw in (data.get("project") or {}).get("dependencies") or []:
                    if m := re.match(r"([A-Za-z0-9][A-Za-z0-9._-]*)\s*(.*)$", raw.split(";")[0].strip()):
                        out.append((m[1], m[2].strip() or None, path))
                poetry = ((data.get("tool") or {}).get("poetry") or {}).get("dependencies") or {}
                out += [(k, v if isinstance(v, str) else v.get("version") if isinstance(v, dict) else None, path) for k, v in poetry.items() if k.lower() != "python"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], names=["name", "version", "source_file"])

    return files.where(F.element_at(F.split("path", "/"), -1) == "pyproject.toml").select("path", "text").mapInArrow(rows, "name string, version string, source_file string")


def declared_dependencies(files: DataFrame) -> DataFrame:
    """One row for each normalised package name: where it is first declared (by path, then name)."""
    from quarry.operators.windows import first_by

    every = requirements(files).drop("line").unionByName(pyproject(files)).unionByName(package_json(files))
    return first_by(every.withColumn("package", package_name(F.col("name"))), ["package"], [F.col("source_file"), F.col("name"), F.asc_nulls_last("version")])


def env_files(files: DataFrame) -> DataFrame:
    """(file, key, lines, flags) of environment files in a (path, text) table; values are used for the flags and never returned."""
    each = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("pos", "raw"))
    entry = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=(.*)$"
    rows = each.where(F.col("raw").rlike(entry)).select("path", (F.col("pos") + 1).alias("line"), F.regexp_extract("raw", entry, 1).alias("key"), F.trim(F.regexp_extract("raw", entry, 2)).alias("value"))
    flagged = rows.withColumn("f", env_flags(F.col("key"), F.col("value")))
    return flagged.groupBy(F.col("path").alias("file"), "key").agg(F.array_sort(F.collect_list("line")).alias("lines"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))).alias("flags"))


def js_env_reads(files: DataFrame) -> DataFrame:
    """(file, line, key, fallback) of import.meta.env and process.env reads."""
    # Fixed value: how scripts read variables, with a fallback.
    pattern = r"(?:import\.meta\.env|process\.env)\.([A-Z][A-Z0-9_]*)(?:\s*(?:\|\||\?\?)\s*(['\"`])(.*?)\2)?"
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).where(F.col("raw").rlike(r"(?:import\.meta|process)\.env\."))
    groups = lambda i: F.regexp_extract_all("raw", F.lit(pattern), F.lit(i))
    found = lines.select("path", "pos", F.explode(F.arrays_zip(groups(1).alias("key"), groups(3).alias("fallback"))).alias("m"))
    return found.select(F.col("path").alias("file"), (F.col("pos") + 1).alias("line"), "m.key", F.nullif("m.fallback", F.lit("")).alias("fallback"))
