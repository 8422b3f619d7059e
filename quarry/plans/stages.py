"""Stage results kept under a content key, and the plan of a whole run over a source tree."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stage_key(head: str, engine: str, *parts: str) -> str:
    return hashlib.sha256(":".join((head, engine, *parts)).encode()).hexdigest()


def cached(spark: SparkSession, root: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table under root/key, made and written first if it is not complete there. Spark's commit marker tells complete ones."""
    path = f"{root.rstrip('/')}/{key}"
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def analyse(spark: SparkSession, files: DataFrame) -> dict[str, DataFrame]:
    """All relations of a (path, language, text) table by name; the parse is written once and read by each."""
    from quarry.operators import python_ast as P
    from quarry.operators import routes as R
    from quarry.operators import text_signals as X
    from quarry.shared import written
    from quarry.sources import trees

    python = files.where("language = 'Python'")
    scripts = files.where("language in ('JavaScript', 'TypeScript')")
    tree = written(P.nodes(python))
    out = {name: getattr(P, name)(tree) for name in ("functions", "classes", "contains_edges", "call_edges", "env_reads", "endpoints", "process_state", "background_jobs")}
    out["signals"] = P.signals(tree).select("kind", "file", "line", "text").unionByName(X.signals(files))
    out["imports"] = P.import_edges(tree, python)
    out["entrypoints"] = P.entrypoints(tree, python)
    out["routes"] = written(R.routes(tree))
    out["hotspots"] = R.hotspots(tree, out["routes"])
    out["js_env_reads"] = trees.js_env_reads(scripts)
    out["dependencies"] = trees.declared_dependencies(files)
    out["failures"] = tree.where("kind in ('error', 'skipped')").select("path", "kind", "detail")
    return out


def unreachable(relations: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """(file): Python files that no entry point reaches over imports; a visited file also visits its packages' __init__ files. Empty if
    there is no entry point; tests and empty __init__ files are not reported."""
    from pyspark.sql import functions as F

    from quarry.functions.scalars import test_path
    from quarry.operators.graphs import reachable

    paths = files.where("language = 'Python'").select("path")
    parts = F.split("path", "/")
    inits = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, 1, i - 1), F.lit("__init__.py")))).alias("dst"))
    package = inits.join(paths.withColumnRenamed("path", "dst"), "dst", "left_semi").where("path <> dst").select(F.col("path").alias("src"), "dst")
    roots = relations["entrypoints"].where("kind <> 'main_guard'").select(F.col("path").alias("node"))
    seen = reachable(relations["imports"].unionByName(package), roots).select(F.col("node").alias("path"))
    empty = files.where(F.endswith("path", F.lit("__init__.py")) & (F.length(F.trim("text")) == 0)).select("path")
    some = roots.limit(1).select(F.lit(True).alias("some"))
    return paths.where(~test_path(F.col("path"))).join(seen, "path", "left_anti").join(empty, "path", "left_anti").join(F.broadcast(some)).select(F.col("path").alias("file"))
