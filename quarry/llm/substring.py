"""Repeated passages by de Bruijn compaction.

Every window of ``k`` words is an edge of a de Bruijn graph over token k-mers. A window that occurs once can be left out, and most
are, before anything is shuffled by window: each window stands under the least of its short word grams, equal windows under equal
ones, so only windows whose least gram occurs at two places or more (a table of about one gram in seven words) become edges.
Edges are grouped into first and last place and number of places. Repeated non-branching paths are compacted: an edge goes on with the path
of the edge one place before its first place if both occur equally often and last one place apart, too. Only the first edge of each path is joined back to its
occurrences; every occurrence but the first is a repeated span, the whole path long. Spans are then verified against the text at
their source coordinates. As counts are equal along a path, a verified path holds all occurrences of its edges. Should a path
fail (counts were equal by chance, or hashes collided), its edges are taken one by one and verified again.

Window hashes have 64 bits, so verification may also find windows that only share a hash; all occurrences of such a hash are grouped
again, by a 128-bit digest of their words. Places are one number: rank of the document in the order of (doc_id, text digest), nulls last,
times 2^bits, plus the word position; bits: 24, or more if a text has that many words.

A window that is very common is one path that very many places hold. Hashes with more than a ten-thousandth of all places (so at most
10,000 of them) meet their places by a broadcast, all others by a shuffle on the hash.
"""

from __future__ import annotations

import functools
import hashlib
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import Scratch, global_order, map_rows, release_memos

#: The least number of bits for a word's position, and of places for a window to be dealt with as common.
BITS, COMMON = 24, 20_000
GRAM = 8
BASE = 0x9E3779B97F4A7C15
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2^64."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _runs(x: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Mixed polynomial hashes of x[start:stop]."""
    up, down = _powers(1 << max(16, len(x).bit_length()))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[: len(x)], out=sums[1:])
    return _mix((sums[stops] - sums[starts]) * down[starts])


def _codes(text: str) -> np.ndarray:
    """A hash of each word."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    turn = np.diff(WHITE[raw], prepend=True, append=True)
    bounds = np.flatnonzero(turn)
    return _runs(raw.astype(np.uint64) + np.uint64(1), bounds[::2], bounds[1::2])


def _grams(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    at = np.arange(max(0, len(codes) - width + 1))
    return _runs(codes, at, at + width)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over all runs of ``width``."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[: len(x) - step], x[step:])
        have += step
    return x


def _least(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(short grams, least short gram of each window)."""
    grams = _grams(codes, min(GRAM, k))
    return grams, _slide(grams, k - min(GRAM, k) + 1, np.minimum)


def anchors(text: str | None, k: int) -> tuple[int, np.ndarray]:
    """(words, grams that are the least of some window, once for each place)."""
    codes = _codes(text) if text else np.zeros(0, np.uint64)
    if len(codes) < k:
        return len(codes), np.zeros(0, np.int64)
    grams, least = _least(codes, k)
    width = k - min(GRAM, k) + 1
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return len(codes), grams[_slide(around, width, np.maximum) == grams].view(np.int64)


def edges(text: str, k: int, repeated: np.ndarray, hash_bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the windows whose least gram is among ``repeated``."""
    codes = _codes(text)
    _, least = _least(codes, k)
    at = np.flatnonzero(np.isin(least.view(np.int64), repeated))
    return at, (_grams(codes, k)[at] >> np.uint64(64 - hash_bits)).view(np.int64)


def removed_mask(n_words: int, spans: list[tuple[int, int]], k: int) -> np.ndarray:
    """Which words the spans (first word, windows) cover. A span that is not true, to be found out by its digest, may reach too far."""
    turn = np.zeros(n_words + 1, np.int64)
    for at, windows in spans:
        turn[at] += 1
        turn[min(n_words, at + windows + k - 1)] -= 1
    return np.cumsum(turn[:-1]) > 0


def _ranked(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(__id, __dh, ord) of the distinct documents."""
    return global_order(scratch, docs.select("__id", "__dh").distinct(), ["__id", "__dh"])


def _same(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    b = b.withColumnsRenamed({"__id": "__id2", "__dh": "__dh2"})
    return a.join(b, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__dh") == F.col("__dh2")), how).drop("__id2", "__dh2")


def repeated_spans(scratch: Scratch, docs: DataFrame, k: int, bits: int = BITS, hash_bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """From columns __id, __dh, __text: (spans: at, windows, source; edges: at, h; documents: __id, __dh, ord; bits of a position)."""
    import pyarrow as pa

    def mark(texts: list) -> list:
        sizes, found = zip(*[anchors(t, k) for t in texts]) if texts else ((), ())
        stops = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return [list(sizes), pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))]

    marked = scratch.keep(map_rows(docs, "__text", [("size", T.LongType()), ("anchors", T.ArrayType(T.LongType()))], mark, ["__id", "__dh"]).where(F.size("anchors") > 0))
    bits = max(bits, int(marked.agg(F.max("size")).first()[0] or 0).bit_length())
    often = marked.select(F.explode("anchors").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    shared = marked.select("__id", "__dh", F.explode(F.array_distinct("anchors")).alias("g")).join(often.hint("shuffle_hash"), "g")
    listed = scratch.keep(shared.groupBy("__id", "__dh").agg(F.collect_list("g").alias("grams")))
    order = _ranked(scratch, marked.select("__id", "__dh"))
    scratch.drop(marked)
    per_doc = _same(listed, order, "inner")

    def rows(batches):
        for batch in batches:
            texts, ords, grams = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False), batch.column(1)
            values, stops = grams.values.to_numpy(zero_copy_only=False), grams.offsets.to_numpy()
            parts, size = ([], []), 0
            for i in range(len(texts)):
                at, h = edges(texts[i].as_py(), k, values[stops[i] : stops[i + 1]], hash_bits)
                parts[0].append(at + (ords[i] << bits))
                parts[1].append(h)
                size += len(at)
                if size > 200_000 or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=["at", "h"])
                    parts, size = ([], []), 0

    found = scratch.keep(_same(docs, per_doc, "inner").select("__text", "grams", "ord").mapInArrow(rows, "at long, h long"))
    scratch.drop(listed)

    grouped = _grouped(found)
    here = Window.partitionBy(F.shiftright("source", bits)).orderBy("source")
    goes_on = lambda step, move: F.coalesce((move("source").over(here) == F.col("source") + step) & (move("n").over(here) == F.col("n")) & (move("last").over(here) == F.col("last") + step), F.lit(False))
    often = _often(found)
    ends = grouped.withColumn("head", ~goes_on(-1, F.lag)).withColumn("tail", ~goes_on(1, F.lead)).where((F.col("n") > often) | F.expr("head or tail"))
    next_tail = F.expr(f"lead(case when tail then source end) ignore nulls over (partition by shiftright(source, {bits}) order by source)")
    windows = F.when(F.col("tail"), 1).otherwise(next_tail - F.col("source") + 1).cast("int")
    paths = scratch.keep(ends.withColumn("windows", windows).where((F.col("n") > often) | F.col("head")).select("h", "source", "windows", "n", "head"))
    spans = scratch.keep(_occurrences(found, paths.where("head"), paths.where(F.col("n") > often)))
    scratch.drop(paths)
    return spans, found, order, bits


def _grouped(found: DataFrame) -> DataFrame:
    return found.groupBy("h").agg(F.count("*").alias("n"), F.min("at").alias("source"), F.max("at").alias("last")).where("n > 1")


def _often(found: DataFrame) -> int:
    return max(COMMON, found.count() // 10_000)


def _occurrences(found: DataFrame, paths: DataFrame, common: DataFrame) -> DataFrame:
    """The places of the paths' first edges (h, source, windows, n: places) but for the sources. common: edges (h) with more than
    ``_often`` places, be they first ones of a path or not; at most 10,000."""
    often, held, out = _often(found), found, []
    if not common.isEmpty():
        out.append(found.join(F.broadcast(paths.where(F.col("n") > often)), "h"))
        held = found.join(F.broadcast(common.select("h").distinct()), "h", "left_anti")
        paths = paths.where(F.col("n") <= often)
    out.append(held.join(paths.hint("shuffle_hash"), "h"))
    return functools.reduce(DataFrame.unionByName, [x.where("at > source").select("at", "windows", "source") for x in out]).distinct()


def _digest(words: list[bytes], at: int, n: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words[at : at + n]))


def _single_digests(scratch: Scratch, plain: DataFrame, order: DataFrame, sources: DataFrame, k: int, bits: int) -> DataFrame:
    """(source, windows, original): digests of spans at their source coordinates."""
    asked = sources.groupBy(F.shiftright("source", bits).alias("ord")).agg(F.collect_list(F.struct("source", "windows")).alias("asked")).join(order, "ord").drop("ord")
    texts = _same(plain.select("__id", "__dh", "__text"), asked, "inner").select("asked", "__text")

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for asked, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _words(t)
                out += [(x["source"], x["windows"], _digest(words, x["source"] & (1 << bits) - 1, x["windows"] + k - 1)) for x in asked]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["source", "windows", "original"])

    return scratch.keep(texts.mapInArrow(rows, "source long, windows int, original binary").distinct())


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 20, carry: list[str] | None = None, with_text: bool = True, bits: int = BITS, hash_bits: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """The columns of ``carry`` (doc_id, if None) and n_words, n_removed, kept_sha256 and, if asked for, kept_text of every row.

    Words covered by a window of k words that also starts earlier (a smaller doc_id, null last, or earlier in the same document) go;
    the rest is joined by one space. Null and empty texts have no words; texts of fewer than k words lose none. Rows that share
    doc_id and text are one document and get the same result; rows that share only doc_id are ordered by a digest of the text. Columns
    not carried are ignored. An empty table gives no rows. ``hash_bits``: bits of a window hash that count; results are the same for any.
    """
    scratch = scratch or Scratch(docs.sparkSession, "substring")
    carry = [doc_id] if carry is None else carry
    plain = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(carry)], F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("__dh"))
    spans, found, order, bits = repeated_spans(scratch, plain.select("__id", "__dh", "__text"), k, bits, hash_bits)
    kept = [f"k{i}" for i in range(len(carry))]

    def finish(plain: DataFrame, spans: DataFrame) -> DataFrame:
        by_doc = spans.groupBy(F.shiftright("at", bits).alias("ord")).agg(F.collect_list(F.struct(F.col("at").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("at"), "windows", "source")).alias("spans"))
        sources = spans.select("source", "windows").distinct().groupBy(F.shiftright("source", bits).alias("ord")).agg(F.collect_list(F.struct("source", "windows")).alias("sources"))
        asked = by_doc.join(sources, "ord", "full").join(order, "ord").drop("ord")
        joined = _same(plain, asked, "left").select(*kept, "__id", "__dh", "spans", "sources", "__text")
        check = "array<struct<source: bigint, windows: int, digest: binary>>"
        made = "n_words long, n_removed long, kept_sha256 string, kept_text string, own " + check + ", used " + check
        schema = T.StructType([*joined.select(*kept, "__id", "__dh").schema.fields, *T.StructType.fromDDL(made).fields])
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(T.StructType.fromDDL(made))]
        n = len(kept) + 2

        def rows(batches):
            import pyarrow as pa

            release_memos()
            for batch in batches:
                out = [[] for _ in range(6)]
                for found, own, t in zip(*(batch.column(n + i).to_pylist() for i in range(3)), strict=True):
                    words = _words(t)
                    gone = removed_mask(len(words), [(s["at"], s["windows"]) for s in found or ()], k)
                    left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if found else words)
                    out[0].append(len(words))
                    out[1].append(int(gone.sum()))
                    out[2].append(hashlib.sha256(left).hexdigest())
                    out[3].append(left.decode("utf-8", "replace") if with_text else None)
                    out[4].append([(s["source"], s["windows"], _digest(words, s["source"] & (1 << bits) - 1, s["windows"] + k - 1)) for s in own or ()])
                    out[5].append([(s["source"], s["windows"], _digest(words, s["at"], s["windows"] + k - 1)) for s in found or ()])
                out[4:] = [[[dict(zip(("source", "windows", "digest"), x, strict=True)) for x in cell] for cell in column] for column in out[4:]]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(c, kind) for c, kind in zip(out, kinds, strict=True))], names=schema.names)

        return scratch.keep(joined.mapInArrow(rows, schema))

    def false_of(done: DataFrame) -> DataFrame:
        own = done.select(F.explode("own").alias("s")).select("s.source", "s.windows", F.col("s.digest").alias("original")).distinct()
        used = done.select(F.explode("used").alias("s")).select("s.source", "s.windows", "s.digest").distinct()
        return scratch.keep(used.join(own, ["source", "windows"]).where("digest <> original").select("source", "windows").distinct())

    done = finish(plain, spans)
    false = false_of(done)
    if not false.isEmpty():  # the documents of those paths again, edge by edge; what collides even so is not removed
        one_by_one = false.select(F.explode(F.sequence("source", F.col("source") + F.col("windows") - 1)).alias("source")).distinct()
        single = _grouped(found).join(one_by_one, "source").select("h", "source", F.lit(1).alias("windows"), "n")
        singles = scratch.keep(_occurrences(found, single, single.where(F.col("n") > _often(found))))
        checked = _single_digests(scratch, plain, order, singles.select("source", "windows").union(singles.select("at", "windows")).distinct(), k, bits)
        told = checked.select(F.col("source").alias("at"), F.col("original").alias("digest"))
        collided = scratch.keep(singles.join(told, "at").join(checked, ["source", "windows"]).where("digest <> original").select("source").distinct())
        if not collided.isEmpty():  # places of one hash with different words: grouped by these
            all_of = singles.join(collided, "source", "left_semi")
            places = all_of.select("source", "at").union(collided.select("source", F.col("source").alias("at"))).join(told, "at")
            parted = places.join(places.groupBy("source", "digest").agg(F.min("at").alias("least")), ["source", "digest"]).where("at > least").select("at", F.lit(1).alias("windows"), F.col("least").alias("source"))
            singles = scratch.keep(singles.join(collided, "source", "left_anti").select("at", "windows", "source").union(parted).distinct())
        wrong = spans.join(false, ["source", "windows"], "left_semi")
        ords = scratch.keep(wrong.select("at").union(singles.select("at")).select(F.shiftright("at", bits).alias("ord")).distinct())
        touched = scratch.keep(order.join(ords, "ord").select("__id", "__dh"))
        mine = spans.join(false, ["source", "windows"], "left_anti").unionByName(singles).withColumn("ord", F.shiftright("at", bits)).join(ords, "ord", "left_semi").drop("ord")
        again = finish(_same(plain, touched, "left_semi"), scratch.keep(mine))
        done = scratch.keep(_same(done, touched, "left_anti").unionByName(again))
    scratch.drop_all_but(done)
    names = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(carry)], *names)
