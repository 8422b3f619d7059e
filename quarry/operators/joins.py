"""Joins beyond plain equality: unique names, ranges, intervals, patterns, set similarity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.shared import drop, written


def resolve_names(calls: DataFrame, definitions: DataFrame, name: str, target: str) -> DataFrame:
    """calls with candidates and resolution: ``external`` (no definition has the name), ``unique`` (with resolved_id), ``ambiguous``.
    Definitions are aggregated by name before the join, so no call is multiplied. A null name is external."""
    table = definitions.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("candidates"), F.min(target).alias("only"))
    found = calls.join(table, name, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    kind = F.when(F.col("candidates") == 0, "external").when(F.col("candidates") == 1, "unique").otherwise("ambiguous")
    return found.withColumn("resolution", kind).withColumn("resolved_id", F.when(F.col("candidates") == 1, F.col("only"))).drop("only")


def _nodes(first: Column, last: Column) -> Column:
    """The (level, node) of the fewest dyadic intervals that make up first to last; node n of a level holds n * 2^level and the 2^level - 1 numbers behind it."""
    start = F.struct(first.cast("long").alias("l"), last.cast("long").alias("r"), F.array().cast("array<struct<level: int, node: bigint>>").alias("out"))

    def level_up(state: Column, level: Column) -> Column:
        left, right = state["l"], state["r"]
        some, at = left <= right, lambda n: F.array(F.struct(level.alias("level"), n.alias("node")))
        odd = some & (F.pmod(left, F.lit(2)) == 1)
        even = some & (F.pmod(right, F.lit(2)) == 0) & ~(odd & (left == right))
        none = F.array().cast("array<struct<level: int, node: bigint>>")
        out = F.concat(state["out"], F.when(odd, at(left)).otherwise(none), F.when(even, at(right)).otherwise(none))
        up = lambda n: F.shiftright(n, 1)
        return F.struct(up(left + F.when(odd, 1).otherwise(0)).alias("l"), F.when(some, up(right - F.when(even, 1).otherwise(0))).otherwise(up(left) - 1).alias("r"), out.alias("out"))

    one = F.array(F.struct(F.lit(0).alias("level"), first.cast("long").alias("node")))
    return F.when(first == last, one).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(62)), start, level_up, lambda s: s["out"]))


def _stabbed(points: DataFrame, spans: DataFrame, on: list[str], at: str, low: str, high: str, width: int) -> DataFrame:
    """Points joined with the spans of their key whose cells of ``width`` hold them; each pair meets once at most.

    A span is a few dyadic intervals of cells (two for each doubling of its length), a point one node of each level that spans use, so neither a long span
    nor a hot key makes many rows: short spans use the lowest levels only. The levels are 63 at most.
    """
    spread = spans.where(F.col(low) <= F.col(high)).withColumn("__n", F.explode(_nodes(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))).select(*spans.columns, F.col("__n.level").alias("__level"), F.col("__n.node").alias("__node"))
    levels = sorted(r["__level"] for r in spread.select("__level").distinct().collect())
    cell = F.floor(F.col(at) / width).cast("long")
    nodes = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(cell, n).alias("node")) for n in levels or [0]])
    placed = points.where(F.col(at).isNotNull()).withColumn("__n", F.explode(nodes)).select(*points.columns, F.col("__n.level").alias("__level"), F.col("__n.node").alias("__node"))
    return placed.join(spread, [*on, "__level", "__node"]).drop("__level", "__node")


def near_spans(points: DataFrame, spans: DataFrame, key: str, at: str, low: str, high: str, tolerance: int = 15, width: int = 64) -> DataFrame:
    """Inner join of points and spans of one key with at in [low - tolerance, high + tolerance].

    The join is by key and dyadic interval (``_stabbed``), so a hot key is spread and a span of any length makes few rows; each pair meets exactly once.
    Nulls on either side never match.
    """
    reach = spans.withColumns({"__low": F.col(low) - tolerance, "__high": F.col(high) + tolerance})
    return _stabbed(points, reach, [key], at, "__low", "__high", width).where(F.col(at).between(F.col("__low"), F.col("__high"))).drop("__low", "__high")


def overlapping_pairs(spans: DataFrame, key: str, ident: str, low: str, high: str, tolerance: int = 5, width: int = 64) -> DataFrame:
    """(key, a, b) with a < b: spans of one key that overlap when each is stretched by the tolerance at its end. Of two such spans the one
    that starts later starts within the other, stretched; of two that start together, the one of the larger ident counts as later."""
    side = lambda n: spans.select(key, F.col(ident).alias(n), F.col(low).alias(f"{n}_low"), F.col(high).alias(f"{n}_high"))
    reach = side("x").withColumn("x_end", F.col("x_high") + tolerance)
    met = _stabbed(side("y"), reach, [key], "y_low", "x_low", "x_end", width)
    later = (F.col("x_low") < F.col("y_low")) | ((F.col("x_low") == F.col("y_low")) & (F.col("x") < F.col("y")))
    touch = (F.col("x_low") - tolerance <= F.col("y_high")) & (F.col("y_low") - tolerance <= F.col("x_high"))
    return met.where(later & touch).select(key, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _route_shapes(patterns: DataFrame) -> DataFrame:
    """(shape, key) of route patterns (path, below): a shape is the number of segments, which of them are parameters, and whether anything may follow; the key is the path with
    parameters blanked."""
    pieces = F.split(F.regexp_replace("path", "/+$", ""), "/")
    hole = lambda x: x.rlike(r"^\{[^}]*\}$")
    holes = F.transform(pieces, hole)
    return patterns.where(F.col("path").isNotNull()).select(F.struct(F.size(pieces).alias("n"), holes.alias("holes"), F.col("below").alias("below")).alias("shape"), F.array_join(F.transform(pieces, lambda x: F.when(hole(x), "{}").otherwise(x)), "/").alias("key")).distinct()


def matching_paths(paths: DataFrame, patterns: DataFrame, sent: int = 100_000) -> DataFrame:
    """The paths (path) that a pattern (path, below) matches: a segment ``{x}`` or ``{}`` of a pattern stands for any one segment, a trailing slash is optional, and with
    ``below`` anything may follow. A path is blanked in the way of each shape that patterns of its length have, and met by equality, so the number of
    patterns does not count. Shapes are broadcast up to ``sent``."""
    table = _route_shapes(patterns)
    shapes = table.select("shape", F.col("shape.n").alias("n")).distinct()
    if shapes.limit(sent + 1).count() <= sent:
        shapes = F.broadcast(shapes)
    pieces = F.split(F.regexp_replace("path", "/$", ""), "/")
    cut = paths.where(F.col("path").isNotNull()).select("path").distinct().select("path", pieces.alias("pieces"), F.size(pieces).alias("of")).withColumn("n", F.explode(F.sequence(F.lit(1), F.col("of"))))
    met = cut.join(shapes, "n").where((F.col("n") == F.col("of")) | F.col("shape.below"))
    blank = F.zip_with(F.slice("pieces", 1, F.col("n")), "shape.holes", lambda p, h: F.when(~h, p).when(p != "", "{}"))  # a parameter is no empty segment
    return met.where(F.forall(blank, lambda x: x.isNotNull())).select("path", "shape", F.array_join(blank, "/").alias("key")).join(table, ["shape", "key"], "left_semi").select("path").distinct()


def match_routes(calls: DataFrame, routes: DataFrame, call_path: str, route_path: str, how: str = "left_anti") -> DataFrame:
    """Calls without (left_anti) or with (left_semi) a matching route; parameters in the route match one segment."""
    found = matching_paths(calls.select(F.col(call_path).alias("path")), routes.select(F.col(route_path).alias("path"), F.lit(False).alias("below")))
    return calls.join(found.withColumnRenamed("path", "__path"), F.col(call_path) == F.col("__path"), how)


def similar_sets(sets: DataFrame, ident: str, terms: str, least: float, within: tuple[str, ...] = ()) -> DataFrame:
    """(within, a, b, similarity), a < b: rows, of equal ``within``, whose term sets have a Jaccard similarity of ``least`` or more. Empty and null sets match nothing.

    Exact, by prefix filter: terms are ordered by how many sets hold them, rarest first. Two sets that have o terms in common share l of them among the first
    size - o + l of each; o follows from both sizes (which classes of sizes part), and l grows with the size, so that few pairs share that many by chance and whole sets are fetched for these only.
    Terms are numbers of that order from there on; those of one set only are left out. Give it distinct sets (``distinct_sets``), or equal ones make pairs in plenty.
    """
    keys, of = [*within, ident], [*within, "t"]
    some = sets.where(F.size(terms) > 0).select(*keys, F.size(terms).alias("n"), F.explode(terms).alias("t"))
    rank = some.groupBy(*of).agg(F.count("*").alias("sets")).where("sets > 1")
    order = ["sets", *of]
    numbers = written(rank.repartitionByRange(*order).sortWithinPartitions(*order).select(*of, "sets", F.monotonically_increasing_id().alias("o")))
    often = F.col("sets") > (numbers.agg(F.sum("sets")).first()[0] or 0) // 10_000  # at most 10,000 terms, which need not be dealt out
    common, number = F.broadcast(numbers.where(often).drop("sets")), numbers.where(~often).drop("sets")
    numbered = some.join(common, of).unionByName(some.join(common, of, "left_anti").join(number, of)).select(*keys, "n", "o")
    ordered = written(numbered.groupBy(*keys, "n").agg(F.array_sort(F.collect_list("o")).alias("ts")))
    drop(numbers)
    shared = lambda n: 1 + F.floor(n / 40)
    prefix = F.slice("ts", 1, F.greatest(F.lit(0), F.size("ts") - F.ceil(F.col("n") * least - 1e-9) + shared(F.col("n") / least)).cast("int"))
    keyed = ordered.select(*keys, "n", F.posexplode(prefix).alias("i", "o"), F.size("ts").alias("left")).withColumn("left", F.col("left") - F.col("i"))  # this one and those after it
    side = lambda x: keyed.select("o", *[F.col(c).alias(f"{c}_{x}") for c in within], F.col(ident).alias(x), F.col("n").alias(f"n_{x}"), F.col("left").alias(f"left_{x}"))
    shorter = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    common = F.ceil((F.col("n_a") + F.col("n_b")) * (least / (1 + least)) - 1e-9)
    few = shared(F.col("n_b"))
    of_size = lambda n: F.floor(F.log(n) / (-math.log(least) * (1 + 1e-9) if least < 1 else 1e-9)).cast("int")  # noqa: E731  a set meets those of its own size class and of the next one
    small = side("a").where(F.col("left_a") > F.ceil(F.col("n_a") * (2 * least / (1 + least)) - 1e-9) - shared(F.col("n_a") / least)).withColumn("size", of_size(F.col("n_a")))
    large = side("b").withColumn("size", F.explode(F.array(of_size(F.col("n_b")), of_size(F.col("n_b")) - 1)))
    met = small.join(large, ["o", "size"]).where(shorter & (F.col("n_a") >= least * F.col("n_b") - 1e-9) & (F.least("left_a", "left_b") > common - few))
    pairs = written(met.groupBy(*[F.col(f"{c}_a").alias(c) for c in within], "a", "b").agg(F.count("*").alias("k"), F.first(few).alias("few")).where("k >= few").select(*within, "a", "b"))
    full = lambda x: ordered.select(*within, F.col(ident).alias(x), F.col("n").alias(f"n_{x}"), F.col("ts").alias(f"ts_{x}"))
    both = F.size(F.array_intersect("ts_a", "ts_b"))
    verified = pairs.join(full("a"), [*within, "a"]).join(full("b"), [*within, "b"]).withColumn("similarity", both / (F.col("n_a") + F.col("n_b") - both)).where(F.col("similarity") >= least)
    return verified.select(*within, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def distinct_sets(sets: DataFrame, ident: str, terms: str) -> DataFrame:
    """(digest, ident, terms, members): one row for each distinct set, under its least ident; digest: SHA-256 of the set, which rows may have already."""
    digest = F.col("digest") if "digest" in sets.columns else set_digest(F.col(terms))
    return sets.groupBy(digest.alias("digest")).agg(F.min(ident).alias(ident), F.first(terms).alias(terms), F.count("*").alias("members"))


def set_digest(terms: Column) -> Column:
    return F.unhex(F.sha2(F.to_json(terms), 256))


def absent(dimension: DataFrame, corpus: DataFrame, pattern: str, text: str) -> DataFrame:
    """Rows of a (small, fixed) rule dimension whose pattern matches no text. One pass; matches are aggregated per rule, not emitted."""
    rules = dimension.limit(1001).collect()
    if len(rules) > 1000:
        raise ValueError("each rule is a column of the one pass over the corpus; give at most 1000")
    hits = corpus.agg(*[F.coalesce(F.bool_or(F.col(text).rlike(r[pattern])), F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)])
    flat = hits.select(F.explode(F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in dimension.columns], F.col(f"r{i}").alias("hit")) for i, r in enumerate(rules)])).alias("x"))
    return flat.where("not x.hit").select(*[f"x.{c}" for c in dimension.columns])


def first_match(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order: candidates ranked by tier."""
    from quarry.operators.windows import first_by

    return first_by(df, keys, order)
