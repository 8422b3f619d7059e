"""Code patterns with metavariables and ellipses, matched by joins over a relation of syntax nodes.

A pattern is Python with ``$X`` (any expression, or any name where only a name can stand; equal ``$X`` are equal code), ``...`` (any further arguments,
entries or statements), ``"..."`` and ``f"..."`` (any string, any f-string) and ``"$X"`` (any string, kept); of several handlers of a ``try`` each is tried. It becomes steps, one per
pattern node; a table of all steps of all patterns is small, whatever the sources hold.

All patterns run at once. Each has an anchor, its node of a fixed name nearest to the root; the nodes that can be anchors are found by one join on (kind, value), and
their ancestors give the roots. From there every round joins the next step's node to the candidates on (file, parent), so rounds are as many as the largest
pattern has steps and only candidates go from round to round. Rules combine matches: any of several, none of others, inside or outside of others, names by regular expression.
"""

from __future__ import annotations

import ast
import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.windows import first_by

NODE = "path string, node int, parent int, up array<int>, field string, pos int, kind string, value string, shape string, sizes map<string,int>, line int, end_line int, last int, scope int, block string, store boolean, stmt int, after int"
#: Ancestors that a node knows: anchors lie at most so deep in a pattern.
NEAR = 6
SKIPPED = (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop)
BLOCKS = ("body", "orelse", "finalbody", "handlers", "cases")
#: Expressions of so many nodes, and strings of so many characters, at most are known by their code, longer ones by a hash of it.
SHOWN, LONG = 24, 100
#: Patterns of so many steps at most go through the rounds together, so that short ones are not carried through the rounds of long ones.
LENGTHS = (3, 6)
COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def _value(node: ast.AST) -> str | None:
    """What is written in a node itself."""
    if isinstance(node, ast.Constant):
        text = f"s:{node.value}" if isinstance(node.value, str) else f"c:{node.value!r}"
        return text if len(text) <= LONG else f"{text[:LONG]} {hashlib.md5(text.encode('utf-8', 'replace')).hexdigest()}"
    if isinstance(node, ast.BinOp | ast.UnaryOp | ast.BoolOp | ast.AugAssign):
        return type(node.op).__name__
    if isinstance(node, ast.Compare):
        return ",".join(type(o).__name__ for o in node.ops)
    if isinstance(node, ast.keyword) and node.arg is None:
        return "**"
    for name in ("id", "attr", "arg", "name", "module"):
        if isinstance(found := getattr(node, name, None), str):
            return found
    return None


DEFINES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)
AT = {c: i for i, c in enumerate(COLUMNS)}


def _rows(path: str, source: str) -> list[list]:
    """The rows of a file, as lists in the order of the columns."""
    from quarry.operators.python_ast import tolerant

    out: list[list] = []
    last, shape_at, after, stmt_at, kind_at, sizes_at = (AT[c] for c in ("last", "shape", "after", "stmt", "kind", "sizes"))

    def code(row: list) -> str:
        """What a node is known by, see ``shown``."""
        return row[shape_at] or (f"n:{row[AT['value']]}" if row[kind_at] == "Name" else row[AT["value"]] or "")

    def visit(node: ast.AST, up: list[int], name: str, pos: int, scope: int, block: str, stmt: int) -> list:
        here = len(out)
        leaf = isinstance(node, ast.Name | ast.Constant)
        if isinstance(node, ast.stmt):
            stmt = here
        named = isinstance(node, ast.Name | ast.arg)
        store = isinstance(node, ast.arg) or isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store)
        row = [path, here, up[0] if up else None, up[: NEAR + 1], name, pos, type(node).__name__, _value(node), None, (), getattr(node, "lineno", None), getattr(node, "end_lineno", None), here, scope, block if named else None, store, stmt, None]
        out.append(row)
        if leaf:
            return row
        inner = here if isinstance(node, DEFINES) else scope
        sizes, below_us, plain = [], [here, *up[:NEAR]], True
        parts = [row[kind_at], row[AT["value"]] or ""]
        for key in node._fields:
            value = getattr(node, key, None)
            if isinstance(value, list):
                if value:
                    sizes.append((key, len(value)))
                held = [(i, v) for i, v in enumerate(value) if isinstance(v, ast.AST) and not isinstance(v, SKIPPED)]
            elif isinstance(value, ast.AST) and not isinstance(value, SKIPPED):
                held = [(0, value)]
                if key == "type" and isinstance(node, ast.ExceptHandler):
                    sizes.append((key, 1))
            else:
                continue
            if key in BLOCKS:
                mark = "?" if isinstance(node, ast.If) else "."
                below = f"/{here}{mark}{key}" if inner != scope else f"{block}/{here}{mark}{key}"
            elif key == "target" and isinstance(node, ast.For | ast.AsyncFor):
                below = f"{block}/{here}.body"  # an empty loop assigns nothing
            else:
                below = "" if inner != scope else block
            parts.append(f"{key}{len(held)}")
            for i, v in held:
                c = code(visit(v, below_us, key, i, inner, below, stmt))
                plain = plain and c[:1] != "h"
                parts.append(c)
        row[last], row[sizes_at] = len(out) - 1, sizes
        if isinstance(node, ast.Attribute) and parts[-1][:2] in ("n:", "e:"):
            row[shape_at] = f"e:{parts[-1][2:]}.{node.attr}"
        elif isinstance(node, ast.expr) and plain and len(out) - here <= SHOWN:
            row[shape_at] = f"e:{ast.unparse(node)}"
        else:
            row[shape_at] = "h:" + hashlib.md5("|".join(parts).encode("utf-8", "replace")).hexdigest()
        return row

    try:
        visit(tolerant(source)[0], [], "", 0, 0, "", 0)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        out.clear()  # python_ast.nodes reports files that do not parse
    for row in out:  # assignments take effect when their statement is over, other names at once
        whole = out[row[stmt_at]]
        row[after] = whole[last] if whole[kind_at] in ("Assign", "AugAssign", "AnnAssign") else row[1]
    return out


def shown(kind: str = "kind", value: str = "value", shape: str = "shape") -> Column:
    """The code that a node stands for: n:name, s:string, c:constant, e:code, or h: and a hash of longer code."""
    return F.coalesce(F.col(shape), F.when(F.col(kind) == "Name", F.concat(F.lit("n:"), F.col(value))).otherwise(F.col(value)))


def syntax_nodes(files: DataFrame, path: str = "path", text: str = "text", limit: int = 2_000_000) -> DataFrame:
    """Every syntax node (NODE) of the Python files of a (path, text) table, in the order of the source: parent, the field and place in it, kind, value, the code below
    (a hash, if it is long; null where the value says it), numbers of nodes in its lists, lines, the last node below it, enclosing definition, block (of names) and statement. Of strings of
    over ``LONG`` characters the value is the start and a hash. Files without path or text, over ``limit`` characters, or that do not parse, have no rows. Write it once: every match below reads it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(NODE))

    def batch_of(rows: list[list]):
        import pyarrow as pa

        columns = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def parse(batches) -> Iterator:
        for batch in batches:
            rows: list[list] = []
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += _rows(p, t)
                if len(rows) > 50_000:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)

    return files.where(F.col(path).isNotNull() & (F.length(text) <= limit)).select(path, text).mapInArrow(parse, NODE)


# ---- patterns to steps

STEP = "struct<like: string, parent: int, field: string, kinds: array<string>, value: string, any_string: boolean, bind: string, bind_from: string, pos: int, after: int, beside: int, sizes: map<string,int>>"
META, REST = "META_", "REST__"
UNSAID = {"ctx", "type_comment", "type_params", "returns", "kind", "conversion", "simple", "decorator_list", "annotation"}


def _meta(name: object) -> str | None:
    return name[len(META) :] if isinstance(name, str) and name.startswith(META) else None


def _is_rest(node: object) -> bool:
    if isinstance(node, ast.Expr):
        node = node.value
    if isinstance(node, ast.keyword) and node.arg is None:
        node = node.value
    return isinstance(node, ast.Constant) and node.value is ... or isinstance(node, ast.Name) and node.id == REST


def read_pattern(text: str) -> ast.AST:
    """The syntax tree of a pattern; an expression if it is one. ``...`` after keywords and in dictionaries stands for ``**``."""
    text = re.sub(r"\$([A-Z][A-Z0-9_]*)", rf"{META}\1", text)
    pieces = re.split(r"""((?<!["'}\w.])\.\.\.(?!["'{\w.]))""", text)
    holes = range(1, len(pieces), 2)
    for choice in itertools.product(("...", f"**{REST}"), repeat=len(holes)):
        for at, what in zip(holes, choice, strict=True):
            pieces[at] = what
        try:
            body = ast.parse("".join(pieces)).body
        except SyntaxError:
            continue
        if len(body) != 1:
            raise ValueError(f"a pattern is one statement or expression: {text}")
        return body[0].value if isinstance(body[0], ast.Expr) else body[0]
    raise ValueError(f"not a pattern: {text}")


def steps_of(text: str) -> list[dict]:
    """The steps of a pattern, root first, each after its parent."""
    steps: list[dict] = []

    def add(node: ast.AST, parent: int | None, name: str, pos=None, after=None, beside=None) -> int:
        here = len(steps)
        step = {"parent": parent, "field": name, "kinds": [type(node).__name__], "value": _value(node), "any_string": False, "bind": None, "bind_from": None, "pos": pos, "after": after, "beside": beside, "sizes": {}}
        steps.append(step)
        if isinstance(node, ast.Name) and (meta := _meta(node.id)):
            step.update(kinds=None, value=None, bind=meta, bind_from="shape")
            return here
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            if node.value == "..." or _meta(node.value):
                step.update(value=None, any_string=True, bind=_meta(node.value), bind_from="value")
            return here
        if meta := _meta(step["value"]):
            step.update(value=None, bind=meta, bind_from="name")
        fields = dict(ast.iter_fields(node))
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda) and not node.args.args:
            fields.pop("args")  # any parameters
        if isinstance(node, ast.ClassDef) and any(map(_is_rest, node.bases)):
            fields["bases"] = [b for b in node.bases if not _is_rest(b)]
        open_call = isinstance(node, ast.Call) and any(map(_is_rest, [*node.args, *node.keywords]))
        if isinstance(node, ast.JoinedStr):
            fields = {"values": [v for v in node.values if isinstance(v, ast.FormattedValue)]}
        if isinstance(node, ast.Dict):
            if not any(k is None and _is_rest(v) for k, v in zip(node.keys, node.values, strict=True)):
                step["sizes"] = {"keys": len(node.keys)}
            for key, value in zip(node.keys, node.values, strict=True):
                if key is not None:
                    add(value, here, "values", beside=add(key, here, "keys"))
            return here
        for key, value in fields.items():
            if isinstance(node, ast.ExceptHandler) and key == "type" and value is None:
                step["sizes"]["type"] = 0
            if key in UNSAID and not (key == "annotation" and isinstance(node, ast.AnnAssign)) or isinstance(value, SKIPPED) or _is_rest(value):
                continue
            if isinstance(value, ast.AST):
                add(value, here, key, 0)
            elif isinstance(value, list):
                rest = any(map(_is_rest, value)) or open_call or isinstance(node, ast.JoinedStr | ast.ClassDef) or key == "handlers" or key in ("orelse", "finalbody") and not value
                if not rest:
                    step["sizes"][key] = len(value)
                before, loose = None, key in ("keywords", "handlers") or isinstance(node, ast.JoinedStr)
                for i, v in enumerate(value):
                    if _is_rest(v):
                        loose = True
                    elif isinstance(v, ast.AST) and not isinstance(v, SKIPPED):
                        added = add(v, here, key, None if loose else i, before if loose and key != "keywords" else None)
                        before = added
        return here

    add(read_pattern(text), None, "")
    return steps


def _anchor(steps: list[dict]) -> tuple[int, int]:
    """(step, depth below the root) to start from: a fixed name, of the least depth; else a metavariable that must fit an expression; else the root."""
    depth = [0] * len(steps)
    for i, s in enumerate(steps[1:], 1):
        depth[i] = depth[s["parent"]] + 1
    near = [i for i in range(len(steps)) if depth[i] <= NEAR]
    named = [i for i in near if steps[i]["kinds"] and steps[i]["value"] is not None and not steps[i]["value"].startswith("c:")]
    liked = [i for i in near if i and steps[i].get("like") and steps[i]["bind_from"] == "shape"]
    at = min(named or liked, key=lambda i: (depth[i], i), default=0)
    if at == 0 and steps[at]["kinds"] is None:
        raise ValueError("a pattern of nothing but a metavariable matches everything")
    return at, depth[at]


def match(nodes: DataFrame, patterns: dict[str, str], likes: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(key, path, node, last, line, end_line, binds, places): every match of every pattern (key to text). binds: what the metavariables stand for (a name is n:name, a string
    s:text, a number c:number, other code e:code or, if long, h:hash); places: their nodes. A node may match in several ways. ``likes``: for a key, regular
    expressions that metavariables must fit."""
    spark = nodes.sparkSession
    compiled = {key: steps_of(text) for key, text in patterns.items()}
    starts, fitting = [], []
    for no, (key, steps) in enumerate(compiled.items()):
        for step in steps:
            step["like"] = (likes or {}).get(key, {}).get(step["bind"])
        at, depth = _anchor(steps)
        if steps[at]["kinds"]:
            starts += [(no, kind, steps[at]["value"], depth) for kind in steps[at]["kinds"]]
        else:
            fitting.append((no, steps[at]["field"], steps[at]["like"], depth))
    # Both are as large as the rules.
    anchors, names = F.broadcast(spark.createDataFrame(starts, "no int, kind string, value string, depth int")), F.broadcast(spark.createDataFrame(fitting, "no int, field string, like string, depth int"))
    fixed = nodes.alias("n").join(anchors.alias("p"), (F.col("n.kind") == F.col("p.kind")) & (F.col("p.value").isNull() | (F.col("n.value") == F.col("p.value"))))
    fit = nodes.alias("n").join(names.alias("p"), (F.col("n.field") == F.col("p.field")) & F.regexp_like(F.substr(shown("n.kind", "n.value", "n.shape"), F.lit(3)), F.col("p.like")))
    root = F.when(F.col("p.depth") == 0, F.col("n.node")).otherwise(F.get("n.up", F.col("p.depth") - 1))
    above = F.coalesce(F.get("n.up", F.col("p.depth")), F.lit(-1))
    rooted = lambda df: df.select("p.no", "n.path", root.alias("root"), above.alias("root_parent"))
    start = rooted(fixed).unionAll(rooted(fit)).where("root is not null").distinct()
    empty = F.array().cast("array<int>")
    start = start.select("*", empty.alias("at"), empty.alias("places"), F.create_map().cast("map<string,string>").alias("binds"), F.create_map().cast("map<string,int>").alias("spots"))
    # The root is met as a child of its parent, like all other nodes; so is what stands in for steps that a short pattern lacks.
    # Every round reads the same columns of it, so it is shuffled once for all of them.
    side = nodes.select(F.col("path").alias("n_path"), F.coalesce("parent", F.lit(-1)).alias("n_parent"), "node", "field", "pos", "kind", "value", "shape", "sizes")
    done = None
    for low, high in itertools.pairwise((0, *LENGTHS, max(map(len, compiled.values()), default=0))):
        some = {no: steps for no, steps in enumerate(compiled.values()) if low < len(steps) <= high}
        if some:
            found = _rounds(start.where(F.col("no").isin(*some)), side, some)
            done = found if done is None else done.unionAll(found)
    ends = nodes.select("path", F.col("node").alias("root"), "last", "line", "end_line")
    key = F.get(F.array(*map(F.lit, compiled)), F.col("no"))
    return done.join(ends, ["path", "root"]).select(key.alias("key"), "path", F.col("root").alias("node"), "last", "line", "end_line", "binds", F.col("spots").alias("places"))


def _rounds(found: DataFrame, side: DataFrame, compiled: dict[int, list[dict]]) -> DataFrame:
    """The candidates that all steps of their pattern (by its number) fit, a join for each step of the longest one. A round's steps are a constant of the plan."""
    for i in range(max(map(len, compiled.values()))):
        of_round = [compiled[no][i] if no in compiled and i < len(compiled[no]) else None for no in range(max(compiled) + 1)]
        s, first = F.col("step"), F.lit(i == 0)
        live = found.withColumn("step", F.get(F.from_json(F.lit(json.dumps(of_round)), f"array<{STEP}>"), F.col("no"))).withColumn("over", s.isNull())
        live = live.withColumn("want", F.when(F.col("over") | first, F.col("root_parent")).otherwise(F.get("at", s["parent"])))
        got = F.when(s["bind_from"] == "shape", shown()).when(s["bind_from"] == "name", F.concat(F.lit("n:"), "value")).when(s["bind_from"] == "value", F.col("value"))
        held = F.element_at("binds", s["bind"])
        fits = (
            (s["kinds"].isNull() | F.array_contains(s["kinds"], F.col("kind")))
            & (s["value"].isNull() | (s["value"] == F.col("value")))
            & (~s["any_string"] | F.startswith("value", F.lit("s:")))
            & (s["pos"].isNull() | (s["pos"] == F.col("pos")))
            & (s["after"].isNull() | (F.get("places", s["after"]) < F.col("pos")))
            & (s["beside"].isNull() | (F.get("places", s["beside"]) == F.col("pos")))
            & F.coalesce(F.forall(F.map_entries(s["sizes"]), lambda e: F.coalesce(F.element_at("sizes", e["key"]), F.lit(0)) == e["value"]), F.lit(True))
            & (s["bind"].isNull() | (got.isNotNull() & (held.isNull() | (held == got))))
            & (s["like"].isNull() | F.regexp_like(F.substr(got, F.lit(3)), s["like"]))
        )
        stay = F.col("node") == F.col("root")
        here = F.when(F.col("over"), stay).when(first, stay & F.col("field").isNotNull() & fits).otherwise((F.col("field") == s["field"]) & fits)
        joined = live.join(side, (F.col("path") == F.col("n_path")) & (F.col("want") == F.col("n_parent")) & F.coalesce(here, F.lit(False)))
        news = ~F.col("over") & s["bind"].isNotNull() & held.isNull()
        found = joined.select(
            "no", "path", "root", "root_parent", F.when(F.col("over"), F.col("at")).otherwise(F.array_append("at", F.col("node"))).alias("at"), F.when(F.col("over"), F.col("places")).otherwise(F.array_append("places", F.col("pos"))).alias("places"),
            F.when(news, F.map_concat("binds", F.create_map(F.coalesce(s["bind"], F.lit("")), got))).otherwise(F.col("binds")).alias("binds"),
            F.when(news, F.map_concat("spots", F.create_map(F.coalesce(s["bind"], F.lit("")), F.col("node")))).otherwise(F.col("spots")).alias("spots"),
        )
    return found


# ---- rules


@dataclass(frozen=True)
class Rule:
    """any: one of these; but: none of these at the same node; inside, outside: within a match of one, of none; where: metavariables by regular expression."""

    name: str
    severity: str
    any: tuple[str, ...]
    but: tuple[str, ...] = ()
    inside: tuple[str, ...] = ()
    outside: tuple[str, ...] = ()
    where: dict[str, str] = field(default_factory=dict)


def _agree(a: str, b: str):
    """Whether two matches give the same meaning to the metavariables that both have."""
    return F.forall(F.map_keys(a), lambda k: F.coalesce(F.element_at(b, k) == F.element_at(a, k), F.lit(True)))


def run_rules(nodes: DataFrame, rules: list[Rule], keep=lambda df: df) -> DataFrame:
    """(rule, severity, path, line, end_line, node, last, binds, places) of all rules' hits, one row a node and rule. ``keep`` writes the matches, which are read several times."""
    roles = ("any", "but", "inside", "outside")
    patterns = {f"{r.name}|{role}|{i}": p for r in rules for role in roles for i, p in enumerate(getattr(r, role))}
    parts = F.split("key", r"\|")
    likes = {f"{r.name}|any|{i}": r.where for r in rules for i in range(len(r.any))}
    found = keep(match(nodes, patterns, likes).withColumns({"rule": parts[0], "role": parts[1]}).drop("key"))
    table = nodes.sparkSession.createDataFrame([(r.name, r.severity, sorted(r.where), bool(r.inside), bool(r.outside)) for r in rules], "rule string, severity string, wheres array<string>, needs boolean, shuns boolean")
    hits = found.where("role = 'any'").join(F.broadcast(table), "rule")
    hits = hits.where(F.forall("wheres", lambda v: F.array_contains(F.map_keys("binds"), v)))
    but = found.where("role = 'but'").select("rule", "path", "node").distinct()
    hits = hits.join(but, ["rule", "path", "node"], "left_anti")
    around = lambda role: found.where(F.col("role") == role).select(F.col("rule").alias("o_rule"), F.col("path").alias("o_path"), F.col("node").alias("o_node"), F.col("last").alias("o_last"), F.col("binds").alias("o_binds"))
    within = (F.col("rule") == F.col("o_rule")) & (F.col("path") == F.col("o_path")) & (F.col("node") > F.col("o_node")) & (F.col("node") <= F.col("o_last")) & _agree("binds", "o_binds")
    hits = hits.where("not needs").unionByName(hits.where("needs").join(around("inside"), within, "left_semi"))
    hits = hits.where("not shuns").unionByName(hits.where("shuns").join(around("outside"), within, "left_anti"))
    return first_by(hits, ["rule", "path", "node"], [F.to_json("binds"), F.to_json("places")]).select("rule", "severity", "path", "line", "end_line", "node", "last", "binds", "places")
