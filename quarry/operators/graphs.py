"""Traversal over edge tables. Frontiers are written tables, so lineage stays short and a lost executor costs one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.shared import written


def reachable(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", node: str = "node", rounds: int | None = None) -> DataFrame:
    """(node, depth): nodes reached from the roots, and by how many edges at least; roots have depth 0. Null nodes are ignored."""
    seen = written(roots.select(F.col(node)).where(F.col(node).isNotNull()).distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while rounds is None or depth < rounds:
        depth += 1
        reached = frontier.join(edges, F.col(node) == F.col(src)).select(F.col(dst).alias(node)).where(F.col(node).isNotNull()).distinct()
        frontier = written(reached.join(seen.select(node), node, "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier) if depth % 8 else written(seen.union(frontier))
    return seen


#: Edges that a task of ``within_two`` holds, and that pass by it.
HELD, PASSING = 12_000_000, 6_000_000


def within_two(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """(root, node) of everything one or two edges away.

    A pair may be reached by very many paths, so these are never rows: roots are parted into bands and end nodes into stripes, and each task gets the roots of a band,
    each with its neighbours (and itself, for paths of one edge), and the edges into a stripe. It marks the ends of all paths of one root after the other.
    """
    links = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where(F.col("s").isNotNull()).distinct()
    n = edges.count()
    bands, stripes = max(6, -(-n // PASSING)), max(1, -(-n // HELD))
    ids = roots.select(F.col(node).alias("key")).where(F.col("key").isNotNull()).distinct()
    part = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    ends = F.collect_list("d") if edges.where(F.col(dst).isNull()).isEmpty() else F.transform(F.collect_list(F.struct("d")), lambda x: x["d"])  # a list alone leaves nulls out
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    starts = links.join(ids, F.col("s") == F.col("key"), "left_semi").groupBy("s").agg(ends.alias("ends"))
    starts = starts.select(part("s", bands).alias("band"), F.lit(1).alias("kind"), F.col("s").alias("key"), F.array_append("ends", F.col("s")).alias("ends")).withColumn("stripe", every(stripes))
    held = links.groupBy(F.col("s").alias("key"), part("d", stripes).alias("stripe")).agg(ends.alias("ends")).select(F.lit(0).alias("kind"), "key", "ends", "stripe").withColumn("band", every(bands))
    dealt = starts.unionByName(held).repartition(4 * bands * stripes, "band", "stripe").sortWithinPartitions("band", "stripe", "kind").select("band", "stripe", "kind", "key", "ends")
    kinds = dict(dealt.dtypes)
    found = dealt.mapInArrow(_ends_of_paths, f"root {kinds['key']}, nodes {kinds['ends']}")
    return found.select(F.col("root").cast(dict(roots.dtypes)[node]).alias("root"), F.explode(F.col("nodes").cast(f"array<{dict(edges.dtypes)[dst]}>")).alias("node"))


def _ends_of_paths(batches):
    """(root, nodes) from rows (band, stripe, kind, key, ends): after the edges of a stripe (kind 0) come the roots of a band (kind 1)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    group, held, parts = None, [], None
    for batch in batches:
        band, stripe, kind = (batch.column(i).to_numpy() for i in range(3))
        cuts = np.flatnonzero(np.diff(band) | np.diff(stripe) | np.diff(kind)) + 1
        for at, stop in zip([0, *cuts], [*cuts, len(band)], strict=True):
            if stop == at:
                continue
            if group != (band[at], stripe[at]):
                group, held, parts = (band[at], stripe[at]), [], None
            keys, ends = batch.column(3).slice(at, stop - at), batch.column(4).slice(at, stop - at)
            if kind[at] == 0:
                held.append((keys, np.diff(ends.offsets.to_numpy()), ends.flatten()))
                continue
            if not held:
                continue
            if parts is None:
                mids = pa.concat_arrays([k for k, _, _ in held])
                coded = pa.concat_arrays([e for _, _, e in held]).dictionary_encode(null_encoding="encode")
                nodes, codes = coded.dictionary, coded.indices.to_numpy()
                parts = np.split(codes, np.cumsum(np.concatenate([n for _, n, _ in held]))[:-1])
                seen = np.zeros(len(nodes), bool)
            near = pc.fill_null(pc.index_in(ends.flatten(), value_set=mids), -1).to_numpy()
            of, out, rows, size = np.concatenate([[0], np.cumsum(np.diff(ends.offsets.to_numpy()))]), [], [], 0
            for i in range(len(keys)):
                mine = near[of[i] : of[i + 1]]
                mine = mine[mine >= 0].tolist()
                if mine:
                    reached = np.concatenate([parts[m] for m in mine])
                    if len(reached) * 16 < len(seen):
                        reached = np.unique(reached)
                    else:
                        seen[reached] = True
                        reached = np.flatnonzero(seen)
                        seen[reached] = False
                    out.append(reached)
                    rows.append(i)
                    size += len(reached)
                if out and (size > 1_000_000 or i == len(keys) - 1):
                    stops = np.cumsum([0, *map(len, out)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(stops), nodes.take(pa.array(np.concatenate(out))))], names=["root", "nodes"])
                    out, rows, size = [], [], 0


def mutual_pairs(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(a, b), a < b: pairs with edges both ways, from one aggregation over unordered pairs."""
    pairs = edges.where(f"`{src}` <> `{dst}`").select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"), (F.col(src) < F.col(dst)).alias("up"))
    return pairs.groupBy("a", "b").agg(F.bool_or("up").alias("up"), F.bool_or(~F.col("up")).alias("down")).where("up and down").select("a", "b")


def chain_roots(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, root): the end of each chain of one-parent links, by pointer jumping; nodes of a cycle are rejected (left out)."""
    now = written(links.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).groupBy(child).agg(F.min(parent).alias("root")))
    left = now.count()
    steps = 0
    while steps <= max(1, left).bit_length():
        steps += 1
        up = now.select(F.col(child).alias("__c"), F.col("root").alias("__r"))
        now = written(now.join(up, F.col("root") == F.col("__c"), "left").select(child, F.coalesce("__r", "root").alias("root")))
    on_chain = links.select(F.col(child).alias("__c")).distinct()
    return now.join(on_chain, F.col("root") == F.col("__c"), "left_anti")


def closure_with(edges: DataFrame, roots: DataFrame, facts: DataFrame) -> DataFrame:
    """(root, any_verified, any_shared, identities): facts (node, verified, shared, identity array) joined over all that a root depends on."""
    pairs = written(roots.select(F.col("node").alias("root"), F.col("node")).distinct())
    frontier = pairs
    while not frontier.isEmpty():
        step = frontier.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = written(step.join(pairs, ["root", "node"], "left_anti"))
        pairs = written(pairs.union(frontier))
    known = pairs.join(facts, "node")
    return known.groupBy("root").agg(F.bool_or("verified").alias("any_verified"), F.bool_or("shared").alias("any_shared"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("identity")))).alias("identities"))
