"""Definitions, uses and flows inside functions, over the relation of syntax nodes.

A use sees the last assignment before it in its own or an enclosing block (an as-of join over the order of the source), and all
later ones in blocks that lie beside it: branches are kept, but for the other arm of the same ``if``. Assignments take effect when their statement is over.
Flows follow assignments from sources to sinks, unless a cleaner encloses them, as reachability over definitions. What a loop's end hands to its start
is not followed, nor what calls hand over.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graphs import reachable
from quarry.operators.patterns import match
from quarry.shared import written

KEYS = ["path", "scope", "name"]


def definitions(nodes: DataFrame) -> DataFrame:
    """(path, scope, name, def, stmt, after, block, line): assigned names and parameters."""
    return nodes.where("store and kind in ('Name', 'arg')").select("path", "scope", F.col("value").alias("name"), F.col("node").alias("def"), "stmt", "after", "block", "line")


def uses(nodes: DataFrame) -> DataFrame:
    """(path, scope, name, use, use_stmt, use_block, use_line): names that are read."""
    return nodes.where("not store and kind = 'Name'").select("path", "scope", F.col("value").alias("name"), F.col("node").alias("use"), F.col("stmt").alias("use_stmt"), F.col("block").alias("use_block"), F.col("line").alias("use_line"))


def _prefixes(block):
    """The block itself and all that enclose it, the function's own last."""
    parts = F.split(block, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def _other_arm(a, b):
    """Whether the blocks part ways at the arms of one if."""
    x, y = F.split(a, "/"), F.split(b, "/")
    pairs = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: F.coalesce(p["x"] != p["y"], F.lit(False)))
    first = F.get(pairs, F.lit(0))
    node = lambda s: F.regexp_extract(s, r"^(\d+)\?", 1)
    return F.coalesce((node(first["x"]) != "") & (node(first["x"]) == node(first["y"])), F.lit(False))


def def_use(nodes: DataFrame) -> DataFrame:
    """(path, scope, name, def, stmt, use, use_stmt, use_line): which assignments a use can see."""
    defs, reads = definitions(nodes), uses(nodes)
    # The last assignment in each enclosing block: one sorted pass over definitions and uses of a name in a block.
    asked = reads.select(*KEYS, F.explode(_prefixes(F.col("use_block"))).alias("block"), F.col("use").alias("at"), F.col("use"), F.lit(None).cast("int").alias("after"))
    made = defs.select(*KEYS, "block", F.col("after").alias("at"), F.lit(None).cast("int").alias("use"), "after")
    order = Window.partitionBy(*KEYS, "block").orderBy("at", F.col("use").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    last = asked.unionByName(made).withColumn("seen", F.last("after", ignorenulls=True).over(order)).where("use is not null").groupBy(*KEYS, "use").agg(F.max("seen").alias("seen"))
    met = reads.join(last, [*KEYS, "use"]).join(defs.drop("line"), KEYS).where((F.col("after") < F.col("use")) & (F.col("after") >= F.coalesce("seen", F.lit(-1))))
    return met.where(~_other_arm(F.col("block"), F.col("use_block"))).select(*KEYS, "def", "stmt", "use", "use_stmt", "use_line")


@dataclass(frozen=True)
class Flow:
    """Code that must not reach a sink: patterns of sources, of sinks (what is reached is $SINK), of cleaners; sinks' metavariables by regular expression."""

    name: str
    severity: str
    sources: tuple[str, ...]
    sinks: tuple[str, ...]
    cleaners: tuple[str, ...] = ()
    but: tuple[str, ...] = ()
    where: dict[str, str] = field(default_factory=dict)


def flows(nodes: DataFrame, rules: list[Flow]) -> DataFrame:
    """(rule, severity, path, line): sinks that a source reaches, itself or through assigned names."""
    roles = ("sources", "sinks", "cleaners", "but")
    patterns = {f"{r.name}|{role}|{i}": p for r in rules for role in roles for i, p in enumerate(getattr(r, role))}
    parts = F.split("key", r"\|")
    likes = {f"{r.name}|sinks|{i}": r.where for r in rules for i in range(len(r.sinks))}
    found = written(match(nodes, patterns, likes).select(parts[0].alias("rule"), parts[1].alias("role"), "path", "node", "last", "line", "binds", "places"))
    table = F.broadcast(nodes.sparkSession.createDataFrame([(r.name, r.severity) for r in rules], "rule string, severity string"))
    cleaned = found.where("role = 'cleaners'").select("rule", "path", F.col("node").alias("c_node"), F.col("last").alias("c_last"))

    def outside(points: DataFrame) -> DataFrame:
        cond = (F.col("p.rule") == F.col("c.rule")) & (F.col("p.path") == F.col("c.path")) & F.col("p.at").between(F.col("c_node"), F.col("c_last"))
        return points.alias("p").join(cleaned.alias("c"), cond, "left_anti")

    statements = nodes.select("path", F.col("node").alias("at"), "stmt")
    sound = found.where("role = 'but'").select("rule", "path", "node")
    starts = outside(found.where("role = 'sources'").join(sound, ["rule", "path", "node"], "left_anti").select("rule", "path", F.col("node").alias("at")).distinct()).join(statements, ["path", "at"])
    seen = def_use(nodes)
    named = seen.withColumn("at", F.col("use")).withColumn("rule", F.explode(F.array(*[F.lit(r.name) for r in rules])))
    read = written(outside(named).select("rule", "path", "def", "at", F.col("use_stmt").alias("stmt")))
    made = definitions(nodes).where("def <> after").select("path", "stmt", "def")  # assignments, not parameters
    ident = lambda d: F.concat_ws("|", "rule", "path", F.col(d).cast("string"))
    edges = read.join(made.withColumnRenamed("def", "next"), ["path", "stmt"]).select(ident("def").alias("src"), ident("next").alias("dst"))
    roots = starts.join(made, ["path", "stmt"]).select(ident("def").alias("node"))
    tainted = reachable(edges, roots).select("node")
    carried = read.withColumn("node", ident("def")).join(tainted, "node", "left_semi").select("rule", "path", "at")
    points = starts.select("rule", "path", "at").union(carried)
    sinks = found.where("role = 'sinks'").join(table, "rule")
    spans = nodes.select("path", F.col("node").alias("s_node"), F.col("last").alias("s_last"))
    sinks = sinks.withColumn("s_node", F.element_at("places", "SINK")).join(spans, ["path", "s_node"])
    hit = (F.col("s.rule") == F.col("p.rule")) & (F.col("s.path") == F.col("p.path")) & F.col("p.at").between(F.col("s.s_node"), F.col("s.s_last"))
    return sinks.alias("s").join(points.alias("p"), hit, "left_semi").select("rule", "severity", "path", "line").distinct()
