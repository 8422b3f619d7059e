"""Patterns against a plain matcher in loops, rules, definitions and uses, flows."""

import ast

import pytest

from quarry.operators import dataflow, node_signals, pattern_rules, patterns
from quarry.operators.patterns import Rule
from quarry.plans import derived_sources
from quarry.shared import written

CODE = '''import subprocess
def run(cmd, *rest, flag=None):
    subprocess.run(cmd, check=True, shell=True)
    subprocess.run("ls", shell=True)
    jwt.decode(t, key, options={"a": 1, "verify_signature": False})
    x = x
    y = z
    s = f"abc{cmd}def" + f"plain"
    f(1, 2)
    f(1)
    f(1, b=2)
    f(g(1), g(1))
    return {"a": 1, "k": str(e)}
async def other():
    try:
        foo()
    except OSError:
        pass
    except Exception as e:
        raise HTTPException(400, detail=str(e))
    "..."
class A(B):
    f(g(1), g(2))
'''

WANTED = {
    "subprocess.$FN($CMD, ..., shell=True, ...)": [3, 4], 'subprocess.$FN("...", ..., shell=True, ...)': [4], 'jwt.decode(..., options={..., "verify_signature": False, ...}, ...)': [5], "$X = $X": [6], 'f"...{$X}..."': [8],
    'f"..."': [8, 8], "f($X)": [10], "f($X, ...)": [9, 10, 11, 12, 23], "f($X, $X)": [12], "f($X, $Y)": [9, 12, 23], "f(..., b=$B)": [11], "f(..., 2, ...)": [9], "f(...)": [9, 10, 11, 12, 23], "$F(1)": [10, 12, 12, 23],
    "try:\n    ...\nexcept $T as $E:\n    ...": [15], "try:\n    ...\nexcept $T:\n    pass": [15], "except_me(...)": [], "return {..., $K: str($E), ...}": [13], 'return {"a": $V}': [], "def $F(...):\n    ...": [2],
    "async def $F(...):\n    ...": [14], "class $C:\n    ...": [22], "HTTPException(400, detail=str($E))": [20], "HTTPException(detail=str($E))": [],
}


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [("a.py", CODE), ("broken.py", "def f(:\n"), ("none.py", None), (None, "x = 1"), ("empty.py", "")]
    return written(patterns.syntax_nodes(spark.createDataFrame(rows, "path string, text string")))


def test_match_finds_the_lines_by_hand(nodes):
    keys = {str(i): p for i, p in enumerate(WANTED)}
    found = patterns.match(nodes, keys).select("key", "path", "node", "line").distinct().collect()
    got = {p: sorted(r["line"] for r in found if keys[r["key"]] == p) for p in WANTED}
    assert got == WANTED and {r["path"] for r in found} == {"a.py"}


def test_match_keeps_what_metavariables_stand_for(nodes):
    found = patterns.match(nodes, {"k": "subprocess.$FN($CMD, ..., shell=True, ...)", "e": "try:\n    ...\nexcept $T as $E:\n    ..."}).collect()
    assert sorted((r["line"], r["binds"]["FN"], r["binds"]["CMD"]) for r in found if r["key"] == "k") == [(3, "n:run", "n:cmd"), (4, "n:run", "s:ls")]
    assert [r["binds"] for r in found if r["key"] == "e"] == [{"T": "n:Exception", "E": "n:e"}]


def test_nodes_are_the_tree(nodes):
    rows = {r["node"]: r for r in nodes.where("path = 'a.py'").collect()}
    plain = [n for n in ast.walk(ast.parse(CODE)) if not isinstance(n, patterns.SKIPPED)]
    assert len(rows) == len(plain) and sorted(rows) == list(range(len(rows)))
    for r in rows.values():
        assert r["parent"] is None or r["parent"] < r["node"] <= r["last"] <= rows[r["parent"]]["last"]
        assert rows[r["stmt"]]["node"] <= r["node"]
    assert nodes.where("path <> 'a.py'").select("path", "kind").collect() == [("empty.py", "Module")]


def test_patterns_that_say_nothing_are_refused(nodes):
    with pytest.raises(ValueError, match="nothing but a metavariable"):
        patterns.match(nodes, {"k": "$X"})
    with pytest.raises(ValueError, match="not a pattern"):
        patterns.read_pattern("f(")


def test_rules_combine_matches(nodes):
    rules = [
        Rule("but", "ERROR", ("subprocess.$FN($CMD, ..., shell=True, ...)",), ('subprocess.$FN("...", ..., shell=True, ...)',)),
        Rule("inside", "WARNING", ("f($X, $Y)",), inside=("class $C:\n    ...",)),
        Rule("outside", "WARNING", ("f($X, $Y)",), outside=("class $C:\n    ...",)),
        Rule("same", "WARNING", ("HTTPException(..., detail=str($E), ...)", "return {..., $K: str($E), ...}"), inside=("try:\n    ...\nexcept $T as $E:\n    ...",)),
        Rule("where", "INFO", ("f($X, ...)",), where={"X": r"^g\("}),
    ]
    got = {(r["rule"], r["line"]) for r in patterns.run_rules(nodes, rules, written).collect()}
    assert got == {("but", 3), ("inside", 23), ("outside", 9), ("outside", 12), ("same", 20), ("where", 12), ("where", 23)}


def test_every_rule_has_a_pair_and_fires_on_one_half(spark):
    names = {r.name for r in [*pattern_rules.RULES, *pattern_rules.FLOWS]}
    pairs = [p for p in derived_sources.PAIRS if p[0] in names]
    assert len(names) == len(pairs) == len(derived_sources.PAIRS) - 1  # the last one is of a signal
    rows = [(f"{rule}/{half}.py", code) for rule, fires, _, safe in pairs for half, code in (("fires", fires), ("safe", safe))]
    tree = written(patterns.syntax_nodes(spark.createDataFrame(rows, "path string, text string")))
    found = patterns.run_rules(tree, pattern_rules.RULES, written).select("rule", "path", "line").unionByName(dataflow.flows(tree, pattern_rules.FLOWS).select("rule", "path", "line"))
    assert sorted(map(tuple, found.distinct().collect())) == sorted((rule, f"{rule}/fires.py", line) for rule, _, lines, _ in pairs for line in lines)


FLOW = '''def f(a, c):
    x = 1
    use(x)
    if c:
        x = 2
        use(x)
    else:
        use(x)
        x = 3
    use(x)
    x = x + a
    use(x)
    for x in y:
        use(x)
    try:
        x = 5
        g()
    except E:
        use(x)
    with open(a) as x:
        use(x)
    return x
def g():
    return x
'''


def test_uses_see_the_assignments_that_reach_them(spark):
    tree = written(patterns.syntax_nodes(spark.createDataFrame([("f.py", FLOW)], "path string, text string")))
    lines = {r["node"]: r["line"] for r in tree.where("line is not null").collect()}
    seen = {}
    for r in dataflow.def_use(tree).where("name = 'x'").collect():
        seen.setdefault(r["use_line"], set()).add(lines[r["def"]])
    assert seen == {3: {2}, 6: {5}, 8: {2}, 10: {2, 5, 9}, 11: {2, 5, 9}, 12: {11}, 14: {13}, 19: {11, 13, 16}, 21: {20}, 22: {20}}


def test_flows_follow_assignments(spark):
    code = "def f(u):\n    a = u.filename\n    b = a\n    c = clean(b)\n    open(c)\n    open(b)\n    d = (b, c)\n    open(d)\n    b = 'x'\n    open(b)\n    open(u.filename)\n    open(clean(u.filename))\n"
    tree = written(patterns.syntax_nodes(spark.createDataFrame([("f.py", code), ("g.py", "def g(a):\n    open(a)\n")], "path string, text string")))
    rule = dataflow.Flow("r", "ERROR", ("$F.filename",), ("open($SINK)",), ("clean(...)",))
    assert sorted(r["line"] for r in dataflow.flows(tree, [rule]).collect()) == [6, 8, 11]


def test_leaky_sessions_and_toothless_tests(spark):
    _, leaks, lines, safe = derived_sources.PAIRS[-1]
    tree = written(patterns.syntax_nodes(spark.createDataFrame([("a.py", leaks), ("b.py", safe)], "path string, text string")))
    assert sorted((r["path"], r["line"], r["name"]) for r in node_signals.leaky_sessions(tree).collect()) == [("a.py", lines[0], "get_db"), ("a.py", lines[1], "inner")]
    files = [("tests/test_a.py", "def test_a():\n    run()"), ("tests/test_b.py", "assert 1"), ("tests/test_c.py", "with pytest.raises(E): f()"), ("tests/test_d.py", None), ("src/a.py", "run()"), ("tests/data.json", "{}")]
    assert sorted(r["path"] for r in node_signals.toothless_tests(spark.createDataFrame(files, "path string, text string")).collect()) == ["tests/test_a.py", "tests/test_d.py"]
