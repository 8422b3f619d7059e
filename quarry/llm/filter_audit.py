"""Filter interaction audit: what each filter of a chain removes, in every order of the filters.

Five filters fail a text: A (few words), B (few distinct words), C (many capitals), D (marks), E (a copy of a text with a smaller id).
Every document becomes a mask of the filters that it fails. All that the audit tells of an order follows from the number of documents,
good ones and toxic ones of each mask, so orders cost nothing per document: masks are counted by part first.

E comes from partition refinement. Texts start in classes by length in code points; each round splits the classes by the hash of one more
block of the text, blocks growing eightfold, and rows that are alone in their class leave. What is left when the blocks are used up is compared in full
with the text of the class's least id; rows that differ from it (hashes may collide) go on among themselves until none is left. Rounds carry
ids and hashes only, classes are counted by partial aggregation, and a class of very many copies meets its count by a broadcast.
A copy moves a count from its mask to the mask with E: the marked rows are added there and taken off here, without a join to the rest.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch, join_spread

#: The filters; a filter's bit in a mask is 1 << its place here.
LETTERS = "ABCDE"
#: Code points of the first block, and how much longer each next block is.
FIRST, GROWTH = 64, 8
#: The most classes that are broadcast to pick the texts to compare (a number each); more meet their texts by a shuffle.
SENT = 1_000_000


def fails(text: Column) -> Column:
    """The mask of A to D for a text that is not null."""
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    n, distinct, size = F.size(words), F.size(F.array_distinct(words)), F.length(text)
    capitals = size - F.length(F.regexp_replace(text, "[A-Z]", ""))
    tests = (n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * size, text.rlike("[#$%&*|]"))
    return sum((F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)), F.lit(0)).cast("int")


def _blocks(text: Column) -> Column:
    """Hashes of the successive blocks of a text; block i starts where block i - 1 ends."""
    edge = lambda i: F.least(F.lit(FIRST) * (F.pow(F.lit(GROWTH), i) - 1) / (GROWTH - 1), F.lit((1 << 31) - 2)).cast("int")
    count = F.floor(F.log(float(GROWTH), F.length(text) * (GROWTH - 1) / F.lit(FIRST) + 1) + 1e-9).cast("int") + 1
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(F.substring(text, edge(i) + 1, edge(i + 1) - edge(i))))


def _crowded(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """The rows that are not alone in their class, written."""
    sizes = rows.groupBy("class").agg(F.count("*").alias("__of")).where("__of > 1").select("class")
    return scratch.keep(join_spread(scratch, rows, sizes, ["class"]))


def refined(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """The rows (n_chars, blocks, further columns) that share length and all block hashes with another row, with ``class``."""
    live = _crowded(scratch, rows.withColumn("class", F.col("n_chars").cast("long")))
    settled, turn = None, 1
    while not live.isEmpty():
        split = _crowded(scratch, live.withColumn("class", F.xxhash64("class", F.get("blocks", F.lit(turn - 1)))))
        scratch.drop(live)
        done = scratch.keep(split.where(F.size("blocks") <= turn))
        live = scratch.keep(split.where(F.size("blocks") > turn))
        scratch.drop(split)
        settled = done if settled is None else settled.unionByName(done)
        turn += 1
    return live if settled is None else settled


def _final_class(n_chars: Column, blocks: Column) -> Column:
    """The class that the rounds of refinement end in."""
    return F.aggregate(blocks, n_chars.cast("long"), lambda c, b: F.xxhash64(c, b))


def copies(scratch: Scratch, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``rows`` (id, n_chars, blocks, further columns) whose text also stands under a smaller id. ``texts``: (id, text).

    Rows of one class are compared with the text of its least id; those that differ are compared among themselves in the next turn.
    Texts of classes with more than a ten-thousandth of all rows are broadcast: together at most 10,000 times the mean text.
    """
    left = refined(scratch, rows).drop("n_chars", "blocks")
    classes = scratch.keep(left.select("class").distinct())
    near = F.broadcast(classes) if classes.count() <= SENT else classes
    read = texts.withColumn("class", _final_class(F.length("text"), _blocks(F.col("text")))).join(near, "class", "left_semi")
    read = scratch.keep(read.select("class", "id", "text").distinct())
    found = None
    while not read.isEmpty():
        first = scratch.keep(read.groupBy("class").agg(F.min(F.struct("id", "text")).alias("first")))
        same = F.col("text") == F.col("first.text")
        met = scratch.keep(join_spread(scratch, read, first, ["class"]).select("class", "id", same.alias("same"), (F.col("id") > F.col("first.id")).alias("later"), F.when(~same, F.col("text")).alias("text")))
        more = met.where("same and later").select("class", "id")
        found = more if found is None else found.union(more)
        scratch.drop(read)
        read = scratch.keep(met.where("not same").select("class", "id", "text"))
    if found is None:
        return left.where("false").drop("class")
    return left.join(found.distinct(), ["class", "id"], "left_semi").drop("class")


def steps(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and what happens there, from (part, mask, n, good, toxic)."""
    bits = range(len(LETTERS))
    whole = (1 << len(LETTERS)) - 1
    orders = ["".join(p) for p in permutations(LETTERS)]
    sets = [(before, f) for before in range(whole + 1) for f in bits if not before >> f & 1]
    spark = counts.sparkSession
    cells = counts.withColumn("cell", F.explode(F.array([F.struct(F.lit(b).alias("before"), F.lit(f).alias("f")) for b, f in sets]))).select("*", "cell.before", F.expr("shiftleft(1, cell.f)").alias("bit"))
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    hit, clean = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) == 0
    add = lambda when, what="n": F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).cast("long")
    sums = cells.groupBy("part", "before", "bit").agg(
        add(clean & ~hit).alias("kept"), add(clean & hit).alias("removed"), add(~clean & hit).alias("redundant"), add(mask == bit).alias("unique_fails"),
        add(clean & hit, "good").alias("good_lost"), add(clean & hit, "toxic").alias("toxic_lost"),
        add(hit, "share").alias("shapley"),
    )
    rows = [(o, s + 1, sum(1 << LETTERS.index(x) for x in o[:s]), 1 << LETTERS.index(o[s])) for o in orders for s in bits]
    plan = spark.createDataFrame(rows, "filter_order string, step int, before int, bit int")  # five a permutation, whatever the input
    return sums.join(F.broadcast(plan), ["before", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row per part, order and step.

    Null texts are empty, a null part is the empty one. A row without doc_id is no copy and makes none; rows that share doc_id and text
    do not make copies of each other, but of every larger id. Each row counts. Of several labels of an id each counts that is 1; labels without
    an id or with nulls tell nothing. The documents' other columns are not read. An empty table gives no rows. ``shapley``: documents removed by the
    filter, summed over all orders: a document of a mask of m filters is removed by each of them in one m-th of the orders.
    """
    scratch = scratch or Scratch(docs.sparkSession, "filter-audit")
    plain = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    narrow = plain.select("id", "part", fails(F.col("text")).alias("mask"), F.length("text").alias("n_chars"), _blocks(F.col("text")).alias("blocks"))
    rows = scratch.keep(narrow.join(told, "id", "left").na.fill(0, ["good", "toxic"]))
    marked = copies(scratch, rows.where("id is not null"), plain.where("id is not null").select("id", "text"))
    e = 1 << LETTERS.index("E")
    moved = marked.select("part", F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.lit(-1).alias("n")), F.struct((F.col("mask") + e).alias("mask"), F.lit(1).alias("n")))).alias("x"), "good", "toxic").select("part", "x.mask", "x.n", "good", "toxic")
    weighed = rows.select("part", "mask", F.lit(1).alias("n"), "good", "toxic").union(moved)
    counts = weighed.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    counts = scratch.keep(counts.withColumn("share", F.expr(f"n * {factorial(len(LETTERS))} div greatest(bit_count(mask), 1)")))
    scratch.drop_all_but(counts)
    return steps(counts)


def oracle() -> str:
    """The same in DuckDB: copies by equal texts, sums by condition."""
    return r"""
    WITH base AS (SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS text,
            (SELECT max(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) FROM labels AS l WHERE l.doc_id = d.doc_id) AS good,
            (SELECT max(CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END) FROM labels AS l WHERE l.doc_id = d.doc_id) AS toxic FROM documents AS d),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM base),
    m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
            CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
            + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 4 ELSE 0 END
            + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM w),
    c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
    f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)),
    o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f AS a, f AS b, f AS c, f AS d, f AS e
        WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
    s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, f.bit, CAST(coalesce((SELECT sum(g.bit) FROM f AS g WHERE instr(left(filter_order, i - 1), g.letter) > 0), 0) AS INTEGER) AS before
        FROM o, (SELECT unnest(range(1, 6)) AS i) AS t, f WHERE f.letter = substr(filter_order, i, 1)),
    r AS (SELECT part, filter_order, step, bit,
            CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
            CAST(sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
            CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
        FROM c, s GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""
