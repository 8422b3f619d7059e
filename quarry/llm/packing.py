"""Best-fit packing by the configuration linear program.

The pieces' length histogram (at most ``capacity`` numbers, whatever the corpus) is all that reaches the driver. The program:
least number of sequences, over all configurations (multisets of lengths that fit one), so that every length is covered as
often as it occurs. Multiplicative weights solve it: each length has a price; a knapsack dynamic program over the capacity finds
the best-priced filling of every remainder, hence the best configuration through each length; these take a share of the round;
lengths covered less than their due get dearer by a factor, the others cheaper. Rounding: each configuration's share is rounded
down and what is left over, a number bounded by that of configurations, is solved again (see ``plan``).

Pieces find their place without a join on the plan: a piece's rank among those of its length, counted within salted parts and
shifted by the parts' sums, selects the slot.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import Scratch, map_rows
from quarry.llm.word_tokens import shared_tokenizer

Pattern = tuple[tuple[int, int], ...]


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing over a histogram, many equal pieces at a time: pattern -> sequences."""
    room: dict[int, list] = {}
    order: list[int] = []

    def put(free: int, pattern: Pattern, n: int) -> None:
        if free not in room:
            room[free] = []
            insort(order, free)
        room[free].append([pattern, n])

    def place(free: int, pattern: Pattern, n: int, length: int, left: int) -> tuple[int, int]:
        """Fill up to n sequences of that free room; (pieces left, sequences used)."""
        each = free // length
        full = min(n, left // each)
        if full:
            put(free - each * length, (*pattern, (length, each)), full)
            left -= full * each
        used = full
        if left and used < n:
            put(free - left * length, (*pattern, (length, left)), 1)
            left, used = 0, used + 1
        return left, used

    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        left = counts[length]
        while left and (at := bisect_left(order, length)) < len(order):
            free = order[at]
            pattern, n = room[free].pop()
            if not room[free]:
                del room[free]
                order.pop(at)
            left, used = place(free, pattern, n, length, left)
            if used < n:
                put(free, pattern, n - used)
        if left:
            place(capacity, (), -(-left // (capacity // length)), length, left)
    out: Counter = Counter()
    for groups in room.values():
        for pattern, n in groups:
            out[pattern] += n
    return out


def _knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for every room and the length to take first there (0: nothing fits or pays)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        value = best[room - 1 :: -1] + price[1 : room + 1]  # length l leaves room - l
        at = int(value.argmax())
        if value[at] > best[room - 1]:
            best[room], take[room] = value[at], at + 1
        else:
            best[room] = best[room - 1]
    return best, take


def solve(counts: dict[int, int], capacity: int, rounds: int = 24, rate: float = 1.0) -> tuple[Counter, float]:
    """(configuration -> share, lower bound) of the linear program for a histogram of lengths from 1 to capacity."""
    need = np.zeros(capacity + 1)
    for length, n in counts.items():
        need[length] = n
    lengths = [int(x) for x in np.flatnonzero(need)[::-1]]
    if not lengths:
        return Counter(), 0.0
    price = np.where(need > 0, np.arange(capacity + 1) / capacity, 0.0)
    covered = np.zeros(capacity + 1)
    shares: Counter = Counter()
    bound = float(sum(k * n for k, n in counts.items())) / capacity
    for done in range(1, rounds + 1):
        best, take = _knapsack(price, capacity)
        bound = max(bound, float((price * need).sum() / best[capacity]))
        due = need * done / rounds
        for length in lengths:
            lack = due[length] - covered[length]
            if lack <= 0:
                continue
            pattern, room = Counter({length: 1}), capacity - length
            while room and best[room] > 0:
                t = int(take[room])
                pattern.update([t] * bool(t))
                room -= t or 1
            amount = lack / pattern[length]
            for t, a in pattern.items():
                covered[t] += a * amount
            shares[tuple(sorted(pattern.items(), reverse=True))] += amount
        ratio = covered[lengths] / due[lengths]
        price[lengths] *= np.exp(rate / done * np.clip(1 - ratio, -1, 1))
    return shares, bound


class Stock:
    """Pieces left by length, with a bit for each length that is left."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: n for k, n in counts.items() if n > 0}
        self.bits = sum(1 << k for k in self.left)

    def use(self, pattern: Pattern, n: int) -> None:
        for k, a in pattern:
            self.left[k] -= n * a
            if not self.left[k]:
                del self.left[k]
                self.bits ^= 1 << k

    def fits(self, pattern: Pattern) -> int:
        return min(self.left.get(k, 0) // a for k, a in pattern)

    def topped_up(self, pattern: Pattern, capacity: int) -> Pattern:
        """What is left of a configuration's pieces, and others that fill the room: one or two of just its size, or else the longest and so on."""
        held = {k: min(a, self.left[k]) for k, a in pattern if k in self.left}
        room, bits = capacity - sum(k * a for k, a in held.items()), self.bits
        for k, a in held.items():
            if a == self.left[k]:
                bits ^= 1 << k

        def add(k: int) -> None:
            nonlocal room, bits
            held[k] = held.get(k, 0) + 1
            room -= k
            if held[k] == self.left[k]:
                bits ^= 1 << k

        while low := bits & ((2 << room) - 2):
            longest = low.bit_length() - 1
            if longest < room:
                first = longest
                while 2 * first >= room and not bits >> (room - first) & 1:
                    low ^= 1 << first
                    first = low.bit_length() - 1
                if 2 * first > room or 2 * first == room and self.left[first] > held.get(first, 0) + 1:
                    longest = first
            add(longest)
        return tuple(sorted(held.items(), reverse=True))


def plan(counts: dict[int, int], capacity: int, rounds: int = 24, again: int = 6) -> tuple[Counter, float]:
    """(pattern -> sequences, lower bound of the linear program) for a histogram of lengths.

    Shares are rounded down; then, longest pieces first, each configuration gives one sequence more, pieces that it lacks replaced by
    others that fill its room. What is left is solved again, in ``again`` rounds. Only configurations that leave little room take part: none
    at first, and more each time that nothing came of it, up to the whole sequence; so all pieces get their place. Of the ways to end
    after each round of this, that with the remnant packed best-fit included, the one with the fewest sequences counts.
    """
    stock, out, lowest, spare = Stock(counts), Counter(), 0.0, 0
    best: tuple[int, Counter] | None = None
    waste = lambda pattern: capacity - sum(k * a for k, a in pattern)
    while stock.left:
        shares, bound = solve(stock.left, capacity, again if lowest else rounds)
        lowest, before = lowest or bound, sum(out.values())
        ordered = sorted(shares.items(), reverse=True)
        for pattern, share in ordered:
            if share >= 1 and waste(pattern) <= spare and (n := min(int(share), stock.fits(pattern))) > 0:
                out[pattern] += n
                stock.use(pattern, n)
        for pattern, _ in ordered:
            filled = stock.topped_up(pattern, capacity)
            if filled and waste(filled) <= spare:
                out[filled] += 1
                stock.use(filled, 1)
        if sum(out.values()) == before:
            spare = min(capacity, 2 * spare + 1)
        ended = out + best_fit(stock.left, capacity)
        if best is None or sum(ended.values()) < best[0]:
            best = sum(ended.values()), ended
        if best[0] <= lowest + 1 - 1e-9:
            break  # no plan has fewer
    return best[1] if best else out, lowest


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, doc_id: str, text: str, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every piece."""
    end = np.array([end_id], "<u4").tobytes()

    def rows(texts: list) -> list[list]:
        encode = shared_tokenizer(tokenizer)
        out: list[list] = [[] for _ in range(6 if with_ids else 5)]
        for i, t in enumerate(texts):
            raw = encode(t) + end
            for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at : at + 4 * capacity]
                values = (i, piece, at // 4, len(part) // 4, zlib.crc32(part))
                for column, value in zip(out, (*values, np.frombuffer(part, "<u4").tolist()) if with_ids else values, strict=True):
                    column.append(value)
        return out

    made = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())] + [("ids", T.ArrayType(T.LongType()))] * with_ids
    return map_rows(docs, text, made, rows, [doc_id], fan_out=True, memo="chunks")


def pack_pieces(scratch: Scratch, pieces: DataFrame, order: list[str], capacity: int, part: int = 200_000) -> DataFrame:
    """Adds sequence_id and offset to a written table with a column length. ``order`` names columns that tell pieces apart (it
    only makes the result the same on every run); ``part``: pieces that one salted part of a length holds, about."""
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    found, _ = plan(counts, capacity)
    slots, base = [], 0
    for pattern, n in sorted(found.items(), reverse=True):
        offset = 0
        for length, each in sorted(pattern, reverse=True):
            slots.append((length, each, n * each, base, offset))
            offset += length * each
        base += n
    slots.sort()
    table = np.array(slots or [(0, 1, 0, 0, 0)], np.int64)
    before = np.cumsum(table[:, 2]) - table[:, 2]
    first = np.r_[True, table[1:, 0] != table[:-1, 0]]
    within = before - np.maximum.accumulate(np.where(first, before, 0))
    key = (table[:, 0] << 44) + within
    sent = pieces.sparkSession.sparkContext.broadcast((key, table, within))

    parts = max(1, -(-max(counts.values(), default=0) // part))
    salt = F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")
    salted = pieces.withColumn("__salt", salt)
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)) - 1)
    shift = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)))
    placed = ranked.join(shift.select("length", "__salt", F.coalesce("__before", F.lit(0)).alias("__before")), ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__salt", "__before")

    columns = [c for c in placed.columns if c != "__rank"]
    ask = placed.select(*columns, "__rank")
    schema = T.StructType([*ask.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at_length, n = columns.index("length"), len(columns)

    def place(batches):
        import pyarrow as pa

        key, table, within = sent.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at_length, n))
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            row, along = table[at], rank - within[at]
            cells = [*batch.columns[:n], pa.array(row[:, 3] + along // row[:, 1]), pa.array(row[:, 4] + along % row[:, 1] * length)]
            yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    return ask.mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, with_ids: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is the one id ``end_id``. Null doc_ids and repeated rows are packed like any others; other columns are
    ignored; an empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    plain = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__t"))
    pieces = scratch.keep(tokenized_pieces(plain, tokenizer, capacity, "__id", "__t", end_id, with_ids))
    return pack_pieces(scratch, pieces, ["__id", "piece", "ids_crc32"], capacity).withColumnRenamed("__id", doc_id)
