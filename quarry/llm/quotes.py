"""Quotation linking for chats and mail, in DataFrame functions only.

A line that starts with '>' marks (blanks between them allowed) is quoted, as deep as it has marks. Adjacent lines of one depth form a
passage. Passages and the messages' own texts are normalised (lower case, white space to one space), cut into units (the whole,
each line, and each sentence whatever its line breaks) and hashed. Quoted units are joined to own units of earlier turns of the same conversation; of several messages
that hold a unit the earliest is its original. A message replies to the original of its shallowest, then whole before line, then first
linked unit; whole comes before line before sentence; without one it starts a thread. Threads are followed to their roots by pointer doubling over written tables, and
messages are numbered in reply order: threads by the turn of their root, each in the order of turns, where a reply always
follows what it answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch, global_order, join_spread

MARKS = r"^[ \t]*(>[> \t]*)"
#: A line that announces a quotation, if a deeper line follows it.
INTRO = r"^\s*(?:On\b.*\bwrote|Am\b.*\bschrieb.*|Le\b.*\ba écrit\s?|El\b.*\bescribió)\s?:\s*$"
SPACE = r"\s+"
SENTENCE = r"(?<=[.!?]) "
#: Words that a quoted line or sentence has at least to be sought alone; shorter ones ("Thanks!") say nothing of their origin.
LEAST = 3


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def _lines(text: Column) -> Column:
    """array<struct<level, body>> of the lines of a text."""

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 1)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("body"))

    return F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), line)


def _own(lines: Column) -> Column:
    """The unquoted lines, without those that announce a quotation."""

    def kept(x: Column, i: Column) -> Column:
        following = F.get(lines, i + 1)
        announces = x["body"].rlike(INTRO) & F.coalesce(following["level"] > 0, F.lit(False))
        return (x["level"] == 0) & ~announces

    return F.transform(F.filter(lines, kept), lambda x: x["body"])


def _passages(lines: Column) -> Column:
    """array<struct<level, bodies>>: adjacent lines of one depth, quoted ones only, cut out between the places where the depth turns."""
    turns = lambda x, i: (i == 0) | (F.get(lines, i - 1)["level"] != x["level"])
    starts = F.array_compact(F.transform(lines, lambda x, i: F.when(turns(x, i), i)))
    stops = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(lines)))
    quoted = F.filter(F.arrays_zip(starts.alias("at"), stops.alias("upto")), lambda r: F.get(lines, r["at"])["level"] > 0)
    cut = lambda r: F.slice(lines, r["at"] + 1, r["upto"] - r["at"])
    return F.transform(quoted, lambda r: F.struct(F.get(lines, r["at"])["level"].alias("level"), F.transform(cut(r), lambda x: x["body"]).alias("bodies")))


def _units(bodies: Column, least: int = 0) -> Column:
    """array<struct<part, hash>>: the whole (part 0), each line (part 1) and each sentence of the whole (part 2), normalised; empty
    ones left out, and lines and sentences of fewer than ``least`` words."""
    joined = _plain(F.array_join(bodies, " "))
    whole = F.array(F.struct(F.lit(0).alias("part"), joined.alias("t")))
    each = F.transform(bodies, lambda x: F.struct(F.lit(1).alias("part"), _plain(x).alias("t")))
    sentences = F.transform(F.split(joined, SENTENCE), lambda x: F.struct(F.lit(2).alias("part"), x.alias("t")))
    enough = lambda u: (u["t"] != "") & ((u["part"] == 0) | (F.size(F.split(u["t"], " ")) >= least))
    return F.transform(F.filter(F.concat(whole, each, sentences), enough), lambda u: F.struct(u["part"].alias("part"), F.sha2(u["t"], 256).alias("hash")))


def link(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, own_text, n_passages, n_linked, parent_turn, root_turn, depth, position of every row.

    own_text is the message without quotations, trimmed; null texts give an empty one. parent_turn is null for what starts a thread
    (root_turn is then its own turn, depth 0). Messages without conversation or turn are never linked and keep those nulls. Repeated
    rows are linked alike and get positions of their own; rows that share conversation and turn count as one place to reply to.
    position counts from 0 within the conversation. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    lines = _lines(F.coalesce(F.col("text"), F.lit("")))
    plain = messages.select(F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    split = plain.withColumn("key", F.xxhash64("text")).withColumn("lines", lines)
    quoted = F.exists("lines", lambda x: x["level"] > 0)
    parsed = scratch.keep(split.select("conv", "turn", "role", "key", _own(F.col("lines")).alias("own"), F.when(quoted, _passages(F.col("lines"))).otherwise(F.array().cast("array<struct<level:int,bodies:array<string>>>")).alias("passages")))

    quoting = parsed.where(F.size("passages") > 0).where("conv is not null and turn is not null").select("conv", "turn", "key", F.posexplode("passages").alias("passage", "p"))
    sought = quoting.select("conv", "turn", "key", "passage", F.col("p.level").alias("level"), F.posexplode(_units(F.col("p.bodies"), LEAST)).alias("at", "u")).select("conv", "turn", "key", "passage", "level", "at", "u.part", "u.hash").distinct()
    asked = scratch.keep(sought)
    links = None
    if asked.isEmpty():
        summed = None
    else:
        wanted = asked.select("conv", "hash").distinct()
        origins = parsed.where("conv is not null and turn is not null").select("conv", "turn", F.explode(F.array_distinct(F.transform(_units(F.col("own")), lambda u: u["hash"]))).alias("hash")).join(wanted, ["conv", "hash"], "left_semi").groupBy("conv", "hash").agg(F.min("turn").alias("origin"))
        met = asked.join(origins, ["conv", "hash"]).where(F.col("origin") < F.col("turn"))
        summed = scratch.keep(met.groupBy("conv", "turn", "key").agg(F.min(F.struct("level", "part", "passage", "at", "origin")).alias("best"), F.countDistinct("passage").cast("long").alias("n_linked")).select("conv", "turn", "key", F.col("best.origin").alias("parent"), "n_linked"))
        links = summed.groupBy("conv", "turn").agg(F.min("parent").alias("parent"))

    shape = parsed.withColumn("own_text", F.trim(F.regexp_replace(F.array_join("own", "\n"), r"^\s+|\s+$", ""))).withColumn("n_passages", F.size("passages").cast("long"))
    if summed is None:
        rows = shape.select("conv", "turn", "role", "own_text", "n_passages", F.lit(0).cast("long").alias("n_linked"), F.lit(None).cast(parsed.schema["turn"].dataType).alias("parent_turn"), F.col("turn").alias("root_turn"), F.lit(0).cast("long").alias("depth"))
    else:
        rooted = _roots(scratch, links)
        rows = (
            shape.join(summed.withColumnRenamed("parent", "parent_turn"), ["conv", "turn", "key"], "left").join(rooted, ["conv", "turn"], "left")
            .select("conv", "turn", "role", "own_text", "n_passages", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent_turn", F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"))
        )
    ordered = global_order(scratch, rows, ["conv", "root_turn", "turn", "role", "own_text"])
    keyed = ordered.withColumn("known", F.struct("conv"))  # a struct is never null
    first = keyed.groupBy("known").agg(F.min("ord").alias("first"))
    placed = join_spread(scratch, keyed, first, ["known"]).withColumn("position", F.col("ord") - F.col("first"))
    return placed.select(F.col("conv").alias(conv_id), F.col("turn").alias(turn), F.col("role").alias(role), "own_text", "n_passages", "n_linked", "parent_turn", "root_turn", "depth", "position")


def _roots(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) of every linked place. Parents are earlier turns, so there are no cycles."""
    now = scratch.keep(links.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("root2"), F.col("depth").alias("depth2"))
        joined = scratch.keep(now.drop("moved").join(up, ["conv", "root"], "left").select("conv", "turn", F.coalesce("root2", "root").alias("root"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("root2").isNotNull().alias("moved")))
        scratch.drop(now)
        now = joined
        if now.where("moved").isEmpty():
            return now.drop("moved")
