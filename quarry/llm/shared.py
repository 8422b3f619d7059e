"""Plumbing the training-data operators share: the shared folder, table access, row maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = " \t\n\r\x0b\x0c"


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; in local mode a temporary one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quarry.shared.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("quarry.shared.dir", root)
    return root.rstrip("/")


class Scratch:
    """Written tables in the shared folder. A table survives lost executors and cuts the lineage. Operators delete the tables that
    their results do not read; the rest goes with ``clear``, by whoever wrote the results elsewhere, or with the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.name = f"{label}-{uuid.uuid4().hex}"
        self.spark, self.home, self.paths = spark, f"{shared_root(spark)}/quarry/{self.name}", []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.home}/{len(self.paths) + 1}"
        self.paths.append(path)
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, "false")
        conf.set(key, "true")  # the written table stands in for the shuffles that made it
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(key, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def holds(self, df: DataFrame) -> bool:
        return getattr(df, "_scratch_path", None) in self.paths

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables of this scratch space that no later plan reads."""
        for df in frames:
            self._delete(df._scratch_path)

    def drop_path(self, path: str) -> None:
        """Delete files that an operator has put under ``home`` itself."""
        self._delete(path)

    def drop_all_but(self, *frames: DataFrame) -> None:
        """Delete all tables but these, which are all that the result reads."""
        read = {df._scratch_path for df in frames}
        for path in self.paths:
            if path not in read:
                self._delete(path)

    def clear(self) -> None:
        """Delete all of it, once what was made from it has been written elsewhere."""
        self._delete(self.home)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Memos of this worker process by owner, and how to empty them. Workers outlive tasks and serve one operator after another.
MEMOS: dict[str, Callable[[], None]] = {}


def release_memos(owner: str | None = None) -> None:
    """Empty the memos of all owners but this one."""
    for name in [n for n in MEMOS if n != owner]:
        MEMOS.pop(name)()


def map_rows(df: DataFrame, text: str, made: list[tuple[str, T.DataType]], rows: Callable[[list], list[list]], carry: list[str] | None = None, fan_out: bool = False, memo: str | None = None) -> DataFrame:
    """Add columns computed in Python from one string column, batch by batch.

    ``rows`` gets the list of texts (None for null) and returns one list of values for each made column;
    with ``fan_out`` it first returns, for every made row, the index of the text that it came from.
    ``carry`` names the columns that go along unchanged (all but the text, if None). ``memo``: the owner whose memo stays
    in the worker; those of operators that ran before are emptied.
    """
    carry = [c for c in df.columns if c != text] if carry is None else carry
    source = "__text"
    inner = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(f"`{text}`").alias(source))
    schema = T.StructType([T.StructField(f"c{i}", inner.schema[f"c{i}"].dataType) for i in range(len(carry))] + [T.StructField(f"m{i}", t) for i, (_, t) in enumerate(made)])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(t) for _, t in made]
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memos(memo)
        for batch in batches:
            values = rows(batch.column(n).to_pylist())
            kept = batch.columns[:n]
            if fan_out:
                at = pa.array(values[0], pa.int64())
                kept, values = [c.take(at) for c in kept], values[1:]
            cells = [*kept, *(v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(values, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(cells, names=[f"c{i}" for i in range(n)] + [f"m{i}" for i in range(len(kinds))])

    out = inner.mapInArrow(run, schema)
    return out.toDF(*carry, *[name for name, _ in made])


def join_spread(scratch: Scratch, left: DataFrame, right: DataFrame, on: list[str], least: int = 2_000) -> DataFrame:
    """Inner join with a right side that has one row a key. Keys that hold more than a ten-thousandth of the left rows (so at most
    10,000; none below ``least`` rows) meet by a broadcast, the others by a shuffle: no task gets a whole common key."""
    often = max(least, left.count() // 10_000)
    common = scratch.keep(left.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > often).select(*on))
    if common.isEmpty():
        return left.join(right, on)
    few = F.broadcast(common)
    hot = left.join(F.broadcast(right.join(few, on, "left_semi")), on)
    return hot.unionByName(left.join(few, on, "left_anti").join(right.join(few, on, "left_anti"), on))


def global_order(scratch: Scratch, df: DataFrame, by: list[str]) -> DataFrame:
    """df, written, with ord: the rank from 0 of each row in the order of ``by`` (nulls last), by range partitions and their sizes."""
    keys = [k for c in by for k in (F.col(c).isNull(), F.col(c))]
    spread = scratch.keep(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    sizes = spread.groupBy(part.alias("__p")).agg(F.count("*").alias("n")).withColumn("__before", F.sum("n").over(Window.orderBy("__p")) - F.col("n")).drop("n")
    placed = spread.withColumn("__p", part).join(F.broadcast(sizes), "__p")  # one row a partition
    return scratch.keep(placed.select(*df.columns, (F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).alias("ord")))
