"""Hard negatives by dual-tree search.

Rows stand in the order of (label, width, signs of seeded random projections) and are cut into shards; anchors, in the same order, into chunks. Each shard
and each chunk has a tree: a node is a run of rows with the least and the largest value of every component and of the label; nodes of
several labels are split between labels, others at the median of their widest component.

A search asks, for every anchor and slot, for the k best rows of the same label (or of others) with scores from ``need`` to ``top``. A pair of nodes has
an interval of inner products, from the corners of their boxes; the pair goes, for its whole group of anchors, if the interval lies below all
needs or above all tops of the group, or if no label can fit. Pairs that stay are split down to leaves, and leaf pairs are scored exactly,
best bound first, while needs rise to the k-th score found. Roots of chunks and shards are paired first, in packets, so only pairs of trees that
can matter meet; each chunk starts with its best shard, whose scores make the needs for all others.

Positives are a search in the same label without a top, negatives one in other labels with a slot for every positive.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch, global_order
from quarry.llm.topk import LOOKED_AT, SIGNS, _better, _exact, _matrix, usable

FLOOR, TOP = -(1 << 63), (1 << 63) - 1
#: Rows of a leaf, trees whose roots are paired at once, chunks that one task takes with a shard, leaves scored at once.
LEAF, PACKET, TOGETHER, BATCH = 64, 64, 16, 16

TREE = "tree long, n int, width int, lo array<double>, hi array<double>, label_lo long, label_hi long, ids binary, rows binary, labels binary, matrix binary, nodes binary"


class Tree(NamedTuple):
    """Rows in tree order, and nodes (start, stop, left, right; leaves have left = -1), parents first, with their boxes."""

    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray
    nodes: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    label_lo: np.ndarray
    label_hi: np.ndarray


def grow(matrix: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, nodes)."""
    order, nodes, todo = np.arange(len(labels)), [], [(0, len(labels), -1, 0)]
    while todo:
        start, stop, parent, side = todo.pop()
        here = len(nodes)
        nodes.append([start, stop, -1, -1])
        if parent >= 0:
            nodes[parent][2 + side] = here
        if stop - start <= leaf:
            continue
        mine = order[start:stop]
        kinds = labels[mine]
        if kinds.min() < kinds.max():
            mine = mine[np.argsort(kinds, kind="stable")]
            turns = np.flatnonzero(np.diff(labels[mine])) + 1
            cut = int(turns[np.argmin(np.abs(turns - len(mine) // 2))])
        else:
            at = matrix[mine]
            cut = len(mine) // 2
            mine = mine[np.argpartition(at[:, int(np.argmax(np.ptp(at, axis=0)))], cut)] if at.shape[1] else mine
        order[start:stop] = mine
        todo += [(start + cut, stop, here, 1), (start, start + cut, here, 0)]
    return order, np.array(nodes, np.int32).reshape(-1, 4)


def boxed(ids, rows, labels, matrix, nodes) -> Tree:
    n = len(nodes)
    lo, hi = np.zeros((n, matrix.shape[1])), np.zeros((n, matrix.shape[1]))
    label_lo, label_hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n - 1, -1, -1):
        start, stop, left, right = nodes[i]
        if left < 0:
            lo[i], hi[i] = matrix[start:stop].min(axis=0), matrix[start:stop].max(axis=0)
            label_lo[i], label_hi[i] = labels[start:stop].min(), labels[start:stop].max()
        else:
            lo[i], hi[i] = np.minimum(lo[left], lo[right]), np.maximum(hi[left], hi[right])
            label_lo[i], label_hi[i] = min(label_lo[left], label_lo[right]), max(label_hi[left], label_hi[right])
    return Tree(ids, rows, labels, matrix, nodes, lo, hi, label_lo, label_hi)


def intervals(a_lo, a_hi, b_lo, b_hi) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest inner product of any two vectors from paired boxes (row by row); a missing component is zero."""
    width = min(a_lo.shape[1], b_lo.shape[1])
    corners = [x[:, :width] * y[:, :width] for x in (a_lo, a_hi) for y in (b_lo, b_hi)]
    low, high = np.minimum.reduce(corners).sum(axis=1), np.maximum.reduce(corners).sum(axis=1)
    size = np.maximum.reduce([np.abs(c) for c in corners]).sum(axis=1)
    slack = np.where(size >= 2**53, size * 1e-9, 0)  # beyond that sums are rounded
    return low - slack, high + slack


def _may(same: bool, a_lo, a_hi, b_lo, b_hi) -> np.ndarray:
    """Whether labels between these can be equal (same) or different."""
    return (a_lo <= b_hi) & (b_lo <= a_hi) if same else ~((a_lo == a_hi) & (b_lo == b_hi) & (a_lo == b_lo))


def leaf_pairs(a: Tree, b: Tree, need: np.ndarray, top: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node of a, node of b, bound) of the leaf pairs that can matter. need, top: of each row of a."""
    needs = np.array([need[s:e].min() for s, e in a.nodes[:, :2]], float)
    tops = np.array([top[s:e].max() for s, e in a.nodes[:, :2]], float)
    left, right, out = np.zeros(1, int), np.zeros(1, int), []
    while len(left):
        low, high = intervals(a.lo[left], a.hi[left], b.lo[right], b.hi[right])
        stay = (high >= needs[left]) & (low <= tops[left]) & _may(same, a.label_lo[left], a.label_hi[left], b.label_lo[right], b.label_hi[right])
        left, right, high = left[stay], right[stay], high[stay]
        a_leaf, b_leaf = a.nodes[left, 2] < 0, b.nodes[right, 2] < 0
        done = a_leaf & b_leaf
        out.append((left[done], right[done], high[done]))
        size = lambda t, x: t.nodes[x, 1] - t.nodes[x, 0]
        split_a = ~done & ~a_leaf & (b_leaf | (size(a, left) >= size(b, right)))
        split_b = ~done & ~split_a
        left, right = (
            np.concatenate([a.nodes[left[split_a], 2], a.nodes[left[split_a], 3], left[split_b], left[split_b]]),
            np.concatenate([right[split_a], right[split_a], b.nodes[right[split_b], 2], b.nodes[right[split_b], 3]]),
        )
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def search(a: Tree, b: Tree, tasks: np.ndarray, same: bool, k: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """((row, slot, id, score) of the k best of each task in b, leaf pairs scored). tasks: row, slot, need, top, in columns."""
    place = np.argsort(a.rows)
    at = place[np.searchsorted(a.rows, tasks[:, 0], sorter=place)]
    need, top = np.full(len(a.rows), TOP), np.full(len(a.rows), FLOOR)
    needs = tasks[:, 2].copy()
    np.minimum.at(need, at, needs)
    np.maximum.at(top, at, tasks[:, 3])
    mine: dict[int, list[int]] = {}
    for t, i in enumerate(at.tolist()):
        mine.setdefault(i, []).append(t)
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in tasks]
    left, right, bound = leaf_pairs(a, b, need, top, same)
    width, scored = min(a.matrix.shape[1], b.matrix.shape[1]), 0
    for node in np.unique(left):
        start, stop = a.nodes[node, :2]
        pairs = np.flatnonzero(left == node)
        pairs = pairs[np.argsort(-bound[pairs], kind="stable")]
        for s in range(0, len(pairs), BATCH):
            now = pairs[s : s + BATCH]
            now = now[bound[now] >= need[start:stop].min()]
            if not len(now):
                break
            scored += len(now)
            cells = np.concatenate([np.arange(*b.nodes[x, :2]) for x in right[now]])
            scores = _exact(a.matrix[start:stop, :width], b.matrix[cells, :width])
            fits = (a.labels[start:stop, None] == b.labels[None, cells]) == same
            fits &= (scores >= need[start:stop, None]) & (scores <= top[start:stop, None]) & (a.rows[start:stop, None] != b.rows[None, cells])
            hit_rows, hit_cells = np.nonzero(fits)
            for i in np.unique(hit_rows).tolist():
                hits = hit_cells[hit_rows == i]
                ids, found = b.ids[cells[hits]], scores[i, hits]
                for t in mine[start + i]:
                    good = (found >= needs[t]) & (found <= tasks[t, 3])
                    if good.any():
                        best[t] = _better(best[t], ids[good], found[good], k)
                        if len(best[t][1]) == k:
                            needs[t] = max(needs[t], best[t][1][-1])
                need[start + i] = min(needs[t] for t in mine[start + i])
    return [(int(r), int(slot), int(i), int(s)) for (r, slot), (ids, scores) in zip(tasks[:, :2].tolist(), best, strict=True) for i, s in zip(ids, scores, strict=True)], scored


def _tree_of(row: dict) -> Tree:
    ids, rows, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "rows", "labels"))
    return boxed(ids, rows, labels, np.frombuffer(row["matrix"], np.float64).reshape(row["n"], row["width"]), np.frombuffer(row["nodes"], np.int32).reshape(-1, 4))


def _trees(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """A row with its tree for each value of ``tree``; rows: tree, row, id, label, v."""
    import pyarrow as pa

    def plant(group: pa.Table) -> pa.Table:
        m = _matrix(group.column("v"))
        ids, rows, labels = (group.column(c).to_numpy().astype(np.int64) for c in ("id", "row", "label"))
        first = np.argsort(rows, kind="stable")
        order, nodes = grow(m[first], labels[first])
        order = first[order]
        cells = {"tree": group.column("tree")[0].as_py(), "n": len(ids), "width": m.shape[1], "lo": m.min(axis=0).tolist(), "hi": m.max(axis=0).tolist(), "label_lo": int(labels.min()), "label_hi": int(labels.max())}
        cells |= {"ids": ids[order].tobytes(), "rows": rows[order].tobytes(), "labels": labels[order].tobytes(), "matrix": np.ascontiguousarray(m[order]).tobytes(), "nodes": nodes.tobytes()}
        kinds = {"tree": pa.int64(), "n": pa.int32(), "width": pa.int32(), "lo": pa.list_(pa.float64()), "hi": pa.list_(pa.float64()), "label_lo": pa.int64(), "label_hi": pa.int64()}
        return pa.table({c: pa.array([v], kinds.get(c, pa.binary())) for c, v in cells.items()})

    return scratch.keep(rows.select("tree", "row", "id", "label", "v").groupBy("tree").applyInArrow(plant, TREE))


def _packets(roots: DataFrame, size: int = PACKET) -> DataFrame:
    """packet and the roots (structs) of up to ``size`` trees of consecutive numbers."""
    return roots.groupBy(F.floor(F.col("no") / size).alias("packet")).agg(F.collect_list(F.struct(*[c for c in roots.columns if c != "no"])).alias("roots"))


def _root_pairs(anchors: DataFrame, shards: DataFrame, same: bool) -> DataFrame:
    """chunk, shard, bound of the pairs of trees that can matter: the stated anchors against all rows, in blocks of blocks."""
    import pyarrow as pa

    left = _packets(anchors).withColumnRenamed("roots", "a")
    last = left.agg(F.max("packet")).first()[0]
    right = _packets(shards).withColumnRenamed("roots", "b").drop("packet")
    met = right.withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long")))).join(left, "packet").select("a", "b")

    def sides(roots):
        wide = max(len(r["lo"]) for r in roots)
        box = lambda c: np.array([[*r[c], *[0.0] * (wide - len(r[c]))] for r in roots]).reshape(len(roots), wide)
        return np.array([r["tree"] for r in roots]), box("lo"), box("hi"), np.array([r["label_lo"] for r in roots]), np.array([r["label_hi"] for r in roots])

    def pair(batches):
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (a_tree, a_lo, a_hi, a_l, a_h), (b_tree, b_lo, b_hi, b_l, b_h) = sides(a), sides(b)
                i, j = (x.ravel() for x in np.indices((len(a), len(b))))
                low, high = intervals(a_lo[i], a_hi[i], b_lo[j], b_hi[j])
                need, top = (np.array([r[c] for r in a], float) for c in ("need", "top"))
                stay = (high >= need[i]) & (low <= top[i]) & _may(same, a_l[i], a_h[i], b_l[j], b_h[j])
                yield pa.RecordBatch.from_arrays([pa.array(a_tree[i[stay]], pa.int64()), pa.array(b_tree[j[stay]], pa.int64()), pa.array(high[stay], pa.float64())], names=["chunk", "shard", "bound"])

    return met.mapInArrow(pair, "chunk long, shard long, bound double")


def _run(cells: DataFrame, chunks: DataFrame, shards: DataFrame, tasks: DataFrame, same: bool, k: int) -> DataFrame:
    """row, slot, vec_id, score: the k best of every task in every cell (chunk, shard)."""
    import pyarrow as pa

    asked = tasks.groupBy("chunk").agg(F.collect_list(F.struct("row", "slot", "need", "top")).alias("tasks"))  # a chunk's anchors by its slots
    left = cells.join(chunks.join(asked, F.col("tree") == F.col("chunk")).drop("chunk").withColumnRenamed("tree", "chunk"), "chunk").withColumn("part", F.floor(F.col("no") / TOGETHER)).select("shard", "part", "n", "width", "ids", "rows", "labels", "matrix", "nodes", "tasks")
    left = left.toDF(*[f"q_{c}" for c in left.columns])
    wanted = cells.join(chunks.select(F.col("tree").alias("chunk"), "no"), "chunk").select("shard", F.floor(F.col("no") / TOGETHER).alias("part")).distinct()
    right = wanted.join(shards.withColumnRenamed("tree", "shard"), "shard").select("shard", "part", "n", "width", "ids", "rows", "labels", "matrix", "nodes")

    def meet(some: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        for b in map(_tree_of, rows.to_pylist()):
            for chunk in ({c.removeprefix("q_"): v for c, v in x.items()} for x in some.to_pylist()):
                todo = np.array([[t["row"], t["slot"], t["need"], t["top"]] for t in chunk["tasks"]], np.int64)
                out += search(_tree_of(chunk), b, todo, same, k)[0]
        return pa.table({c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate(("row", "slot", "vec_id", "score"))})

    return left.groupBy("q_shard", "q_part").cogroup(right.groupBy("shard", "part")).applyInArrow(meet, "row long, slot long, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row", "slot").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k)


def _searched(scratch: Scratch, chunks: DataFrame, shards: DataFrame, tasks: DataFrame, same: bool, k: int) -> DataFrame:
    """row, slot, vec_id, score, rank: the k best rows of every task (chunk, row, slot, need, top)."""
    roots = lambda tasks: chunks.join(tasks.groupBy(F.col("chunk").alias("tree")).agg(F.min("need").alias("need"), F.max("top").alias("top")), "tree").select("no", "tree", "lo", "hi", "label_lo", "label_hi", "need", "top")
    b = shards.select("no", "tree", "lo", "hi", "label_lo", "label_hi")
    start = scratch.keep(_root_pairs(roots(tasks), b, same).groupBy("chunk").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard")))
    begun = scratch.keep(_run(start, chunks, shards, tasks, same, k))
    kth = begun.groupBy("row", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("row", "slot", "least")
    raised = scratch.keep(tasks.join(kth, ["row", "slot"], "left").withColumn("need", F.greatest("need", F.coalesce("least", "need"))).select("chunk", "row", "slot", "need", "top"))
    rest = scratch.keep(_root_pairs(roots(raised), b, same).select("chunk", "shard").join(start, ["chunk", "shard"], "left_anti"))
    return _first(begun.unionAll(_run(rest, chunks, shards, raised, same, k)), k)


def mine(table: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, shard: int = 4096, chunk: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For every row where ``is_anchor`` holds: its best other rows of the same label, and for each of these the best rows of other labels with low %
    to 100 % of the positive's score. Components count as floor(scale * x), scores are integer inner products, ties go to the smaller id.
    Rows without id, label or vector, or with a null or non-finite component, take no part. Shorter vectors count as followed by zeros; empty ones score 0.
    Repeated rows are rows of their own: each can be a positive of the other and each gives its own results. A negative positive score leaves no room for
    negatives. Scores beyond 64 bits are held there. Other columns are ignored; an empty table gives no rows. ``shard``, ``chunk``: rows and anchors
    of up to 64 components that a tree holds; half as many for each doubling of the width.
    """
    import pyarrow as pa

    scratch = Scratch(table.sparkSession, "negatives")
    plain = table.select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.transform(F.col(f"`{vector}`"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("q"), usable(F.col(f"`{vector}`")).alias("ok"),
    ).where("ok and id is not null and label is not null").drop("ok")
    signs = np.random.default_rng(7).standard_normal((SIGNS, LOOKED_AT))

    def near(batches):
        for batch in batches:
            m = _matrix(batch.column(2))[:, :LOOKED_AT]
            code = ((m @ signs[:, : m.shape[1]].T > 0) @ (1 << np.arange(SIGNS)[::-1])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=["id", "label", "v", "q", "code"])

    coded = plain.mapInArrow(near, "id long, label long, v array<double>, q boolean, code long").withColumn("wide", F.ceil(F.log2(F.greatest(F.size("v"), F.lit(1)))).cast("int"))
    many = lambda n: F.greatest(F.lit(1), F.least(F.lit(n), F.expr(f"shiftright({64 * n}L, wide)")))
    tree = lambda n: F.col("wide").cast("long") * (1 << 40) + F.floor(F.col("row") / many(n))
    placed = global_order(scratch, coded, ["label", "wide", "code", "id"]).withColumnRenamed("ord", "row")
    asks = global_order(scratch, placed.where("q").select("row", "id", "label", "v", "wide"), ["row"])
    numbered = lambda trees: global_order(scratch, trees, ["tree"]).withColumnRenamed("ord", "no")
    shards = numbered(_trees(scratch, placed.withColumn("tree", tree(shard))))
    chunks = numbered(_trees(scratch, asks.withColumn("tree", F.col("wide").cast("long") * (1 << 40) + F.floor(F.col("ord") / many(chunk)))))
    members = asks.select(F.col("row"), F.col("id").alias("anchor_id"), (F.col("wide").cast("long") * (1 << 40) + F.floor(F.col("ord") / many(chunk))).alias("chunk"))

    alike = _searched(scratch, chunks, shards, members.select("chunk", "row", F.lit(0).cast("long").alias("slot"), F.lit(FLOOR).alias("need"), F.lit(TOP).alias("top")), True, positives)
    chosen = scratch.keep(alike.select("row", F.col("rank").cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(members, "row"))
    # low * s / 100, rounded up, without leaving 64 bits
    least = F.expr(f"(positive_score - pmod(positive_score, 100L)) div 100 * {low} + ceil({low} * pmod(positive_score, 100L) / 100D)")
    tasks = chosen.where("positive_score >= 0").select("chunk", "row", "slot", least.cast("long").alias("need"), F.col("positive_score").alias("top"))
    unlike = _searched(scratch, chunks, shards, scratch.keep(tasks), False, negatives)
    result = scratch.keep(unlike.join(chosen, ["row", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    scratch.drop_all_but(result)
    return result


def oracle() -> str:
    """The same in DuckDB, every anchor against all rows."""
    return """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS alike, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
        FROM v AS q, v AS c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS r
        FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
    SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 5"""
