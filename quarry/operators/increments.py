"""Upkeep of derived relations: what a change of some files touches is done again, the rest is kept.

A store is a folder of versions. A version holds the table of all its files (path, content hash, the version that parsed it) and the rows of what it parsed;
its rows are those of all versions that a file still points to. Files whose hash is as before are neither read by the parser nor rewritten.
Import edges are redone for files that changed and for those whose imports name a module that came or went. What is reachable is mended from the edges that came and
went: what hung on lost edges is taken out, what the rest still reaches is put back, and new edges are followed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.graphs import reachable
from quarry.shared import written


@dataclass(frozen=True)
class Change:
    """files: path, hash, version of all files now; parsed: paths parsed in this version; gone: paths that changed or went."""

    files: DataFrame
    parsed: DataFrame
    gone: DataFrame


class Store:
    """Rows derived from each file alone, by version, under ``root`` (a folder that driver and executors share)."""

    def __init__(self, spark: SparkSession, root: str, derive: Callable[[DataFrame], DataFrame]):
        self.spark, self.root, self.derive = spark, root.rstrip("/"), derive

    def _exists(self, path: str) -> bool:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there)

    def latest(self) -> int:
        """The last complete version, 0 if there is none. Spark's commit marker of the table of files, written last, tells complete ones."""
        n = 0
        while self._exists(f"{self.root}/{n + 1}/files/_SUCCESS"):
            n += 1
        return n

    def files(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{version}/files")

    def rows(self, version: int) -> DataFrame:
        """The derived rows of all files of a version. Each of its versions' folders is read with the paths that still point to it."""
        known = self.files(version)
        at = [r["version"] for r in known.select("version").distinct().orderBy("version").collect()]  # versions, not files
        held = self.spark.read.option("basePath", self.root).parquet(*[f"{self.root}/{v}/rows" for v in at]) if at else None
        if held is None:
            return self.spark.read.parquet(f"{self.root}/{version}/rows")
        origin = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)/rows/[^/]+$", 1).cast("int")
        rows = held.withColumn("version", origin)
        return rows.join(known.select("path", "version"), ["path", "version"], "left_semi").drop("version")

    def update(self, files: DataFrame) -> tuple[int, Change]:
        """(version, change) after the files (path, text, further columns) have been brought in. Nulls in text count as the empty text;
        rows without path are left out. A run that fails leaves no version; the next one writes over what it left."""
        before, now = self.latest(), self.latest() + 1
        hashed = files.where(F.col("path").isNotNull()).withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
        none = self.spark.createDataFrame([], "path string, old string, version int")
        old = self.files(before).select("path", F.col("hash").alias("old"), "version") if before else none
        state = written(hashed.select("path", "hash").join(old, "path", "full").select("path", "hash", "old", "version", F.coalesce(F.col("hash") == F.col("old"), F.lit(False)).alias("same")))
        fresh = state.where("not same and hash is not null").select("path")
        self.derive(files.join(fresh, "path", "left_semi")).write.mode("overwrite").parquet(f"{self.root}/{now}/rows")
        state.where("hash is not null").select("path", "hash", F.when(F.col("same"), F.col("version")).otherwise(now).alias("version")).write.mode("overwrite").parquet(f"{self.root}/{now}/files")
        return now, Change(self.files(now), fresh, state.where("not same and old is not null").select("path"))


def module_names(paths: DataFrame) -> DataFrame:
    """(path, module): every dotted name, short or long, under which a Python file can be imported."""
    parts = F.split(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/")
    return paths.where(F.endswith("path", F.lit(".py"))).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 1 << 20), "."))).alias("module"))


def touched_importers(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """(path): files whose imports end in the name of a module that came or went (``moved``: path). An import names a module if the names' last parts agree, so relative
    imports are found, too; some files are done again for nothing."""
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    stems = moved.select(last(F.regexp_replace(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/", ".")).alias("stem")).distinct()
    said = rows.where("kind = 'import'").select("path", F.explode(F.array_union(F.array(last("name")), F.coalesce("literals", F.array().cast("array<string>")))).alias("stem"))
    packages = rows.where("kind = 'import'").where(F.col("name").rlike(r"^\.+$")).select("path")  # from . import x: the package itself
    return said.join(stems, "stem", "left_semi").select("path").union(packages.join(moved.where(F.endswith("path", F.lit("__init__.py"))).limit(1).select(F.lit(1).alias("__one")), F.lit(True), "left_semi")).distinct()


def updated_edges(old: DataFrame, change: Change, rows: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, lost, gained): import edges (src, dst) after a change. ``rows``: all rows now; ``before``: the files (path) of the version before."""
    from quarry.operators.python_ast import import_edges

    now = change.files.select("path")
    moved = written(now.join(before, "path", "left_anti").union(before.join(now, "path", "left_anti")))
    again = written(change.parsed.union(change.gone).union(touched_importers(rows, moved)).distinct())
    redone = written(import_edges(rows.join(again, "path", "left_semi"), now))
    stale = written(old.join(again.withColumnRenamed("path", "src"), "src", "left_semi"))
    kept = old.join(again.withColumnRenamed("path", "src"), "src", "left_anti")
    return kept.unionByName(redone), stale.join(redone, ["src", "dst"], "left_anti"), redone.join(stale, ["src", "dst"], "left_anti")


def updated_reach(seen: DataFrame, edges: DataFrame, lost: DataFrame, gained: DataFrame, roots: DataFrame, old_roots: DataFrame) -> DataFrame:
    """(node): what the roots reach over ``edges``, from what was reached before. Work follows what hangs on the lost edges and what the new ones lead to."""
    nodes = written(seen.select("node").distinct())
    gone = old_roots.select("node").join(roots, "node", "left_anti")
    start = written(lost.join(nodes, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).union(gone).join(nodes, "node", "left_semi").distinct())
    if start.isEmpty():
        kept = nodes
    else:
        inner = edges.unionByName(lost).join(nodes, F.col("src") == F.col("node"), "left_semi").join(nodes, F.col("dst") == F.col("node"), "left_semi")
        doubtful = written(reachable(inner, start).select("node"))
        sure = nodes.join(doubtful, "node", "left_anti")
        into = edges.join(doubtful, F.col("dst") == F.col("node"), "left_semi")
        again = into.join(sure, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).union(roots.select("node").join(doubtful, "node", "left_semi"))
        back = reachable(into, again.distinct()).select("node")
        kept = written(sure.union(back).distinct())
    ahead = gained.join(kept, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).union(roots.select("node")).join(kept, "node", "left_anti").distinct()
    known = written(ahead)
    if known.isEmpty():
        return kept
    frontier, out = known, [kept, known]
    while not frontier.isEmpty():
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        for have in out:
            step = step.join(have, "node", "left_anti")
        frontier = written(step)
        out.append(frontier)
        if len(out) > 8:  # a partition a round, gathered now and then
            out = [out[0], written(_all(out[1:]))]
    return _all(out)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
