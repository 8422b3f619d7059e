"""SimHash near-duplicates by covering locality-sensitive hashing.

Masks: every bit position i gets a vector m(i) of r + 1 bits, not all zero, dealt evenly. For each of
the 2^(r+1) - 1 nonzero vectors v the table of v compares the positions with odd <m(i), v>. r differing
positions span at most r dimensions, so some v is orthogonal to all of them: in that table the pair
agrees. Every pair within radius r therefore collides in at least one table, with certainty.

In a table's bucket of few distinct fingerprints the links are checked at once and only a spanning
forest of them is handed on. In a larger bucket nothing is gathered: fingerprints meet at the points
between them. With the free positions of that table, x and y differ in at most r places if and only if
some z is within floor(r/2) of one and ceil(r/2) of the other; each z links all that come that near to
the least one of the nearer kind, which takes one grouped minimum.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.components import components
from quarry.llm.shared import Scratch, join_spread, map_rows

BITS = 64
SEED = 42


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text: majority bits over the XXH64 of its word 3-shingles.

    Null and wordless texts: 0. One or two words: the single shingle of all words.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    grams = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= 3 else [b" ".join(words)]
    n = max(1, len(words) - 2)
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        set_bits += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n, bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def masks(radius: int) -> list[int]:
    """The covering masks as unsigned numbers."""
    span = (1 << (radius + 1)) - 1
    given = [1 + i % span for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if bin(given[i] & v).count("1") % 2) for v in range(1, span + 1)]


def add_fingerprints(docs: DataFrame, text: str = "text", carry: list[str] | None = None, name: str = "fp") -> DataFrame:
    """docs' columns of ``carry`` and the signed 64-bit fingerprint of the whole text."""
    return map_rows(docs, text, [(name, T.LongType())], lambda texts: [[signed(fingerprint(t)) for t in texts]], carry)


def _forest(fps: list[int], radius: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the fingerprints within the radius."""
    x = np.array(fps, np.int64).view(np.uint64)
    n = len(x)
    root = np.arange(n)
    a, b = [], []
    for i in range(1, n):
        near = np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= radius)
        groups, first = np.unique(root[near], return_index=True)
        for r, j in zip(groups.tolist(), near[first].tolist(), strict=True):
            a.append(fps[i])
            b.append(fps[j])
            root[root == r] = i
    return a, b


def links(scratch: Scratch, fps: DataFrame, radius: int = 3, small: int = 4096) -> DataFrame:
    """(a, b): links between distinct fingerprints of column fp, at most ``radius`` bits apart, that join the same
    components as all such links do. ``small``: the most fingerprints of a bucket that are gathered."""
    tables = masks(radius)
    keyed = scratch.keep(
        fps.select("fp", F.explode(F.array([F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(tables)])).alias("t"))
        .select("t.k", "t.key", "fp")
    )
    sizes = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    large = scratch.keep(sizes.where(F.col("n") > small))

    few = (
        keyed.join(F.broadcast(large.select("k", "key")) if large.count() < 10_000 else large.select("k", "key"), ["k", "key"], "left_anti")
        .groupBy("k", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    )

    def forest(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = [], []
            for x in batch.column(0).to_pylist():
                for side, found in zip((a, b), _forest(x, radius), strict=True):
                    side += found
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    out = few.mapInArrow(forest, "a long, b long")
    if large.isEmpty():
        return out

    near, far = radius // 2, radius - radius // 2
    free = [[i for i in range(BITS) if not m >> i & 1] for m in tables]
    flips = [[(signed(sum(1 << i for i in c)), size) for size in range(far + 1) for c in combinations(f, size)] for f in free]

    def points(batches):
        import pyarrow as pa

        turned = [(np.array([f for f, _ in x], np.int64), np.array([s <= near for _, s in x])) for x in flips]
        for batch in batches:
            ks, xs = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for at, k in enumerate(ks):
                f, is_near = turned[k]
                z = f ^ xs[at]
                n = len(z)
                x = np.full(n, xs[at], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(z), pa.array(x), pa.array(x, mask=~is_near)], names=["k", "z", "x", "near"])

    crowded = keyed.join(large.select("k", "key"), ["k", "key"], "left_semi").select("k", "fp")
    met = crowded.mapInArrow(points, "k int, z long, x long, near long")
    hub = met.groupBy("k", "z").agg(F.min("near").alias("a"), F.min("x").alias("b"), F.max("x").alias("c"), F.count("*").alias("n")).where("a is not null and n > 1")
    simple = hub.where("n = 2").select("a", F.when(F.col("b") == F.col("a"), F.col("c")).otherwise(F.col("b")).alias("b"))
    crowds = met.join(hub.where("n > 2").select("k", "z", "a"), ["k", "z"]).select("a", F.col("x").alias("b"))
    return out.union(simple.union(crowds).where("a <> b").distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, fp, component_id for every row.

    component_id is the least doc_id reachable over fingerprints at most ``radius`` bits apart. Null and empty texts have
    fingerprint 0 and link like any other. A null doc_id takes part and is nobody's component_id unless the whole
    component has none (then it is null). Repeated rows give repeated result rows; an empty table gives none.
    """
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark, "simhash")
    prints = scratch.keep(add_fingerprints(docs, text, [doc_id]).withColumnRenamed(doc_id, "__id"))
    return _with_components(scratch, prints, "__id", radius).withColumnRenamed("__id", doc_id)


def _with_components(scratch: Scratch, prints: DataFrame, doc_id: str, radius: int) -> DataFrame:
    least = scratch.keep(prints.groupBy("fp").agg(F.min(doc_id).alias("least")))
    found = components(scratch, links(scratch, least.select("fp"), radius), "a", "b")
    rooted = least.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = scratch.keep(rooted.join(best, "root").select("fp", "component_id"))
    scratch.drop_all_but(prints, by_fp)
    return join_spread(scratch, prints, by_fp, ["fp"])


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """The columns of docs, one row of every group of near-duplicates: the one of the least doc_id (null last), and
    of rows that share it the first in the order of the input's partitions."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash-keep")
    names = docs.columns
    plain = docs.toDF(*[f"d{i}" for i in range(len(names))])
    at = {n: f"d{i}" for i, n in enumerate(names)}
    numbered = scratch.keep(add_fingerprints(plain.withColumn("__row", F.monotonically_increasing_id()).withColumn("__copy", F.col(at[text])), "__copy", [*plain.columns, "__row"], "__fp"))
    prints = numbered.select("__row", F.col("__fp").alias("fp"), F.col(at[doc_id]).alias("__id"))
    rank = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    least = scratch.keep(prints.groupBy("fp").agg(F.min(rank).alias("least")))
    found = components(scratch, links(scratch, least.select("fp"), radius), "a", "b")
    rooted = least.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = scratch.keep(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("__row")))
    scratch.drop_all_but(numbered, kept)
    return numbered.join(kept, "__row", "left_semi").select(*[F.col(c).alias(n) for n, c in at.items()])
