"""Exact top-k inner-product search with block-at-a-time pruning.

Rows are put in an order that keeps like vectors together (width, then the signs of seeded random projections), cut into blocks of
``block`` consecutive rows, and each block keeps its forward index (the matrix of its rows) and, for every term (component), the largest
and smallest value. A query's bound for a block is the sum over terms of the larger of weight x maximum and weight x minimum. Blocks are
taken in falling order of bound; a block is scored through its forward index; a query is done when the next bound is below its
k-th best score so far (a bound equal to it may still win on the id, so it is scored).

Blocks are grouped in shards. A query first searches the shard that it lies in; its k-th best score there is where it starts in all
others. Shards have maxima and minima, too: a query goes only to those whose bound reaches its score. Queries go there in chunks, so
a task holds one shard and one chunk, whatever the size of the table. Wide vectors stand in shards of their own, of fewer rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch, global_order

#: Projections that order the rows, and the components that they look at.
SIGNS, LOOKED_AT = 16, 256


def _exact(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Integer inner products, in floating point while that is exact and in Python integers beyond; held to 64 bits."""
    if not len(q) or not len(m):
        return np.zeros((len(q), len(m)), np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * max(1, q.shape[1]) < 2**53:
        return np.rint(q @ m.T).astype(np.int64)
    whole = [[int(x) for x in r] for r in q], [[int(x) for x in r] for r in m]
    top = (1 << 63) - 1
    return np.array([[max(-top, min(top, sum(a * b for a, b in zip(x, y, strict=True)))) for y in whole[1]] for x in whole[0]], np.int64)


def _better(best: tuple[np.ndarray, np.ndarray], ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    i, s = np.concatenate([best[0], ids]), np.concatenate([best[1], scores])
    if len(s) > 4 * k:  # only what reaches the k-th score can stay
        near = s >= np.partition(s, len(s) - k)[len(s) - k]
        i, s = i[near], s[near]
    at = np.lexsort((i, -s))[:k]
    return i[at], s[at]


def _bounds(queries: np.ndarray, highs: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """Bounds of queries for blocks with these maxima and minima; what one side lacks in width is zero."""
    width = min(queries.shape[1], highs.shape[1])
    q, highs, lows = queries[:, :width], highs[:, :width], lows[:, :width]
    bounds = np.maximum(q, 0) @ highs.T + np.minimum(q, 0) @ lows.T
    return bounds + np.abs(bounds) * 1e-9 if np.abs(bounds).max(initial=0) >= 2**53 else bounds


def search_shard(query_rows: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int, block: int, floors: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """(best (ids, scores) of every query over one shard, number of (query, block) pairs scored). Rows number the table's rows,
    so that a query leaves out itself and no other row. ``floors``: scores below these are of no use to the queries."""
    n = len(ids)
    floors = np.full(len(query_rows), -np.inf) if floors is None else floors
    starts = range(0, n, block)
    highs = np.array([matrix[s : s + block].max(axis=0) for s in starts])
    lows = np.array([matrix[s : s + block].min(axis=0) for s in starts])
    bounds = _bounds(queries, highs, lows)
    order = np.argsort(-bounds, axis=1, kind="stable")
    width = min(queries.shape[1], matrix.shape[1])
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_rows]
    scored, live, need = 0, np.arange(len(query_rows)), floors.copy()
    for turn in range(len(starts)):
        live = live[bounds[live, order[live, turn]] >= need[live]]
        if not len(live):
            break
        for b in np.unique(order[live, turn]):
            mine = live[order[live, turn] == b]
            s = b * block
            scores = _exact(queries[mine, :width], matrix[s : s + block, :width])
            for i, line in zip(mine, scores, strict=True):
                useful = (rows[s : s + block] != query_rows[i]) & (line >= need[i])
                if useful.any():
                    best[i] = _better(best[i], ids[s : s + block][useful], line[useful], k)
                    if len(best[i][1]) == k:
                        need[i] = max(floors[i], best[i][1][-1])
            scored += len(mine)
    return best, scored


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def top_k(table: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256, block: int = 128, shard: int = 4096, chunk: int = 4096, sent: int = 1 << 25) -> DataFrame:
    """query_id, rank, vec_id, score: for every row where ``is_query`` holds its k best other rows, ties to the smaller vec_id.

    Components count as floor(scale * x). Vectors that are null or hold a null or non-finite component take no part, nor do rows
    without vec_id; shorter vectors count as followed by zeros, empty ones score 0 with all. Repeated rows are rows of their own: each is
    a candidate for the others, and each that is a query gives its own results. Scores beyond 64 bits are held there. Other columns are
    ignored; an empty table gives no rows. ``shard`` and ``chunk``: rows and queries of up to 64 components that one task holds, about;
    ``sent``: the most bytes of maxima and minima that are broadcast to choose shards; beyond it queries go to all shards.
    """
    import pyarrow as pa

    scratch = Scratch(table.sparkSession, "topk")
    plain = table.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.transform(F.col(f"`{vector}`"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), usable(F.col(f"`{vector}`")).alias("ok")).where("ok and id is not null").drop("ok")
    signs = np.random.default_rng(7).standard_normal((SIGNS, LOOKED_AT))

    def near(batches):
        for batch in batches:
            m = _matrix(batch.column(1))[:, :LOOKED_AT]
            code = ((m @ signs[:, : m.shape[1]].T > 0) @ (1 << np.arange(SIGNS)[::-1])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=["id", "v", "q", "code"])

    # As wide as the next power of two; for each doubling beyond 64 half as many rows.
    coded = plain.mapInArrow(near, "id long, v array<double>, q boolean, code long").withColumn("wide", F.ceil(F.log2(F.greatest(F.size("v"), F.lit(1)))).cast("int"))
    many = lambda n: F.greatest(F.lit(1), F.least(F.lit(n), F.expr(f"shiftright({64 * n}L, wide)")))
    group = lambda n: F.col("wide").cast("long") * (1 << 40) + F.floor(F.col("row") / many(n))
    placed = global_order(scratch, coded, ["wide", "code", "id"]).withColumnRenamed("ord", "row").withColumn("shard", group(shard)).withColumn("chunk", group(50 * chunk)).select("shard", "chunk", "row", "id", "v", "q")
    numbers = lambda t, c: t.column(c).to_numpy().astype(np.int64)

    def at_home(rows):
        m, ids, at = _matrix(rows.column("v")), numbers(rows, "id"), numbers(rows, "row")
        order = np.argsort(at, kind="stable")
        asks = np.flatnonzero(rows.column("q").to_numpy(zero_copy_only=False))
        best = [x for s in range(0, len(asks), chunk) for x in search_shard(at[asks[s : s + chunk]], m[asks[s : s + chunk]], at[order], ids[order], m[order], k, block)[0]]
        lists = [[x[i].tolist() for x in best] for i in (0, 1)]
        out = {"chunk": numbers(rows, "chunk")[asks], "row": at[asks], "id": ids[asks], "v": rows.column("v").take(asks).combine_chunks(), "ids": lists[0], "scores": lists[1]}
        shard_row = {"highs": [m.max(axis=0).tolist()], "lows": [m.min(axis=0).tolist()]}
        schema = pa.schema([("shard", pa.int64()), *((c, pa.int64()) for c in ("chunk", "row", "id")), *((c, pa.list_(pa.float64())) for c in ("v", "highs", "lows")), *((c, pa.list_(pa.int64())) for c in ("ids", "scores"))])
        home = rows.column("shard")[0].as_py()
        parts = [pa.table({f.name: pa.array([home] * n, f.type) if f.name == "shard" else pa.array(x[f.name], f.type) if f.name in x else pa.nulls(n, f.type) for f in schema}, schema=schema) for x, n in ((out, len(asks)), (shard_row, 1))]
        return pa.concat_tables(parts)

    home = scratch.keep(placed.groupBy("shard").applyInArrow(at_home, "shard long, chunk long, row long, id long, v array<double>, highs array<double>, lows array<double>, ids array<long>, scores array<long>"))
    asked = home.where("row is not null").select("shard", "chunk", "row", "id", "v", F.when(F.size("scores") >= k, F.element_at("scores", k)).alias("floor"))
    limits = home.where("row is null").select("shard", "highs", "lows")
    size = limits.agg(F.sum(16 * F.size("highs") + 32)).first()[0] or 0
    if size <= sent:
        known = sorted((r["shard"], r["highs"], r["lows"]) for r in limits.collect())  # at most ``sent`` bytes
        every = np.array([x[0] for x in known], np.int64)
        widest = max((len(x[1]) for x in known), default=0)
        highs, lows = (_matrix_of([x[i] for x in known], widest) for i in (1, 2))

        def choose(batches):
            for batch in batches:
                q = _matrix(batch.column(4))
                floors = np.array(batch.column(5).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), float)
                reach = _bounds(q, highs, lows) >= floors[:, None]
                reach &= every != batch.column(0).to_numpy()[:, None]
                targets = pa.array([every[r] for r in reach], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, targets], names=[*batch.schema.names, "targets"])

        sought = asked.mapInArrow(choose, "shard long, chunk long, row long, id long, v array<double>, floor long, targets array<long>").withColumn("to", F.explode("targets")).drop("targets")
    else:
        spots = limits.select(F.col("shard").alias("to"))
        sought = asked.join(spots, F.col("shard") != F.col("to"))  # the stated query set against all rows, in blocks
    sought = sought.select("chunk", F.col("to").alias("shard"), "row", "id", "v", "floor")
    cells = scratch.keep(sought.select("chunk", "shard").distinct())
    if cells.limit(10_001).count() <= 10_000:
        cells = F.broadcast(cells)
    right = placed.select("shard", "row", "id", "v").join(cells, "shard").select("chunk", "shard", "row", "id", "v")

    def meet(queries, rows):
        q, m = _matrix(queries.column("q_v")), _matrix(rows.column("v"))
        order = np.argsort(numbers(rows, "row"), kind="stable")
        floors = np.array(queries.column("q_floor").combine_chunks().fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), float)
        out = []
        for s in range(0, len(q), chunk):
            best, _ = search_shard(numbers(queries, "q_row")[s : s + chunk], q[s : s + chunk], numbers(rows, "row")[order], numbers(rows, "id")[order], m[order], k, block, floors[s : s + chunk])
            for r, i, (ids, scores) in zip(numbers(queries, "q_row")[s : s + chunk], numbers(queries, "q_id")[s : s + chunk], best, strict=True):
                out += [(int(r), int(i), int(a), int(b)) for a, b in zip(ids, scores, strict=True)]
        return pa.table({n: pa.array([x[j] for x in out], pa.int64()) for j, n in enumerate(("row", "query_id", "vec_id", "score"))})

    left = sought.toDF("q_chunk", "q_shard", "q_row", "q_id", "q_v", "q_floor")
    abroad = left.groupBy("q_chunk", "q_shard").cogroup(right.groupBy("chunk", "shard")).applyInArrow(meet, "row long, query_id long, vec_id long, score long")
    here = home.where("row is not null").select("row", F.col("id").alias("query_id"), F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("row", "query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    ranked = here.unionAll(abroad).withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix_of(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _matrix(column) -> np.ndarray:
    """Rows of a column of lists of floats, as wide as the longest; what shorter ones lack is zero."""
    import pyarrow as pa

    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    n, values = len(lists), lists.flatten().to_numpy(zero_copy_only=False)
    lengths = np.array(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    width = int(lengths.max(initial=0))
    if len(values) == n * width:
        return values.reshape(n, width).astype(np.float64)
    out = np.zeros((n, width))
    out[np.arange(width) < lengths[:, None]] = values
    return out
