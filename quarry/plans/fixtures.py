"""Queries over a small source tree and tool payloads held in code: operators whose input is source text, which the tables do not hold.
SQL cannot parse Python, so their oracles are the rows that the rules give for this tree, worked out by hand."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.catalogue import query, quoted

TREE = {
    "app/__init__.py": "",
    "app/main.py": "from fastapi import FastAPI, Depends\nfrom app import items\napp = FastAPI(dependencies=[Depends(require_api_key)])\napp.include_router(items.router, prefix='/api')\n@app.get('/health')\ndef health():\n    return {'ok': True}\n@app.post('/login')\nasync def login(user_id: str):\n    time.sleep(1)\n",
    "app/items.py": (
        "import os, requests\nrouter = APIRouter(prefix='/items')\nCACHE = {}\nTOKEN = os.getenv('API_TOKEN', 'abc123')\n@router.get('/{user_id}')\ndef read(user_id, limit: int = 10, user=Depends(get_user)):\n    CACHE[user_id] = 1\n    save(user_id)\n"
        "    return requests.get('http://x')\n@router.post('/up')\nasync def up(f: UploadFile = File(...)):\n    asyncio.create_task(save(1))\ndef get_user(token=Depends(oauth)):\n    return jwt.decode(token)\ndef oauth():\n    pass\ndef save(x):\n    try:\n        session.commit()\n    except Exception:\n        pass\n"
    ),
    "app/dead.py": "def nobody():\n    return eval('1' + x)\n",
    "app/models.py": "class Base:\n    pass\nclass Item(Base):\n    def total(self):\n        return 1\n",
    "tests/test_items.py": "def test_read():\n    assert True\n",
    "web/client.ts": "const a = `/api/items/${id}`;\nfetch('/api/nothing?x=1');\nconst k = import.meta.env.VITE_API_KEY || 'none';\nel.innerHTML = a;\n",
    "web/package.json": '{"dependencies": {"react": "18"}, "devDependencies": {"vite": "5"}}',
    "requirements.txt": "fastapi>=0.1\nrequests==2.0 ; python_version > '3'\nhttpx\n# note\n",
    "Dockerfile": "FROM python\nCOPY . /app\n",
    "AGENTS.md": "# Rules\n- every route is authenticated\n",
}

PAYLOADS = [
    ("ruff", "success", [{"filename": "app/items.py", "code": "E501", "message": "Line too long", "location": {"row": 3}}, {"filename": "app/main.py", "code": "F401", "message": "unused import", "location": {"row": 1}}]),
    ("bandit", "success", [{"filename": "app/dead.py", "line_number": 2, "issue_severity": "HIGH", "test_id": "B307", "issue_text": "eval"}]),
    ("jscpd", "success", [{"firstFile": {"name": "app/items.py", "startLoc": {"line": 1}}, "secondFile": {"name": "app/main.py", "startLoc": {"line": 2}}, "lines": 31, "tokens": 90}]),
    ("pip_audit", "success", {"dependencies": [{"name": "requests", "version": "2.0", "vulns": [{"id": "CVE-1", "fix_versions": []}]}]}),
    ("semgrep", "error", None),
]


def tree_files(spark: SparkSession) -> DataFrame:
    from pyspark.sql import functions as F

    from quarry.sources.trees import language

    return spark.createDataFrame(sorted(TREE.items()), "path string, text string").withColumn("language", language(F.col("path")))


@lru_cache(maxsize=1)
def relations(spark: SparkSession) -> dict[str, DataFrame]:
    """All relations of the tree; its fixpoints are written once a session."""
    from quarry.operators import routes as R
    from quarry.plans.stages import analyse
    from pyspark.sql import functions as F

    files = tree_files(spark)
    out = analyse(spark, files)
    scripts = files.where("language in ('JavaScript', 'TypeScript')")
    first = out["routes"].select(F.element_at(F.split("path", "/"), 2).alias("segment")).distinct()
    out["client_calls"] = R.client_calls(scripts, first)
    out["unmatched_calls"] = R.unmatched_calls(out["client_calls"], out["routes"])
    return out


class Sql(str):
    """An expression, as it is."""


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, list):
        return f"[{', '.join(map(_literal, value))}]"
    return str(value) if isinstance(value, Sql | bool | int | float) else quoted(value)


def expected(columns: str, *rows: tuple) -> str:
    """SQL for given rows; columns: names and types."""
    parts = [c.split() for c in columns.split(", ")]
    names = [f"c{i}" for i in range(len(parts))]
    casts = ", ".join(f"CAST({c} AS {kind}) AS {name}" for c, (name, kind) in zip(names, parts, strict=True))
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS v({', '.join(names)})"


def _span(path: str, first: int, last: int) -> Sql:
    """The hash of lines of a source."""
    return Sql(f"sha256({quoted(''.join(TREE[path].splitlines(keepends=True)[first - 1 : last]))})")


def _function(path: str, name: str, first: int, last: int, params: list, decorators: list = [], is_async: bool = False, owner: str = "") -> tuple:
    return (f"{path}::{owner}{name}", name, owner + name, path, first, last, is_async, decorators, params, _span(path, first, last), last - first + 1)


def _finding(tool: str, file: str, line: int | None, severity: str, category: str, message: str) -> tuple:
    return (tool, file, line, severity, category, message, Sql(f"substring(sha256({quoted('|'.join((tool, category, file, str(line), message)))}), 1, 16)"))


_ITEMS, _MAIN = "app/items.py", "app/main.py"
EXPECTED = {
    "functions": expected(
        "id VARCHAR, name VARCHAR, qualname VARCHAR, file VARCHAR, start_line INTEGER, end_line INTEGER, is_async BOOLEAN, decorators VARCHAR[], params VARCHAR[], content_hash VARCHAR, loc INTEGER",
        _function("app/dead.py", "nobody", 1, 2, []), _function(_ITEMS, "read", 6, 9, ["user_id", "limit", "user"], ["router.get"]), _function(_ITEMS, "up", 11, 12, ["f"], ["router.post"], True), _function(_ITEMS, "get_user", 13, 14, ["token"]),
        _function(_ITEMS, "oauth", 15, 16, []), _function(_ITEMS, "save", 17, 21, ["x"]), _function(_MAIN, "health", 6, 7, [], ["app.get"]), _function(_MAIN, "login", 9, 10, ["user_id"], ["app.post"], True),
        _function("app/models.py", "total", 4, 5, ["self"], owner="Item."), _function("tests/test_items.py", "test_read", 1, 2, []),
    ),
    "classes": expected(
        "id VARCHAR, name VARCHAR, qualname VARCHAR, file VARCHAR, start_line INTEGER, end_line INTEGER, content_hash VARCHAR, loc INTEGER, method_count BIGINT",
        ("app/models.py::Base", "Base", "Base", "app/models.py", 1, 2, _span("app/models.py", 1, 2), 2, 0), ("app/models.py::Item", "Item", "Item", "app/models.py", 3, 5, _span("app/models.py", 3, 5), 3, 1),
    ),
    "contains_edges": expected(
        "parent_id VARCHAR, child_id VARCHAR", *[(f, f"{f}::{n}") for f, ns in {"app/dead.py": ["nobody"], _ITEMS: ["read", "up", "get_user", "oauth", "save"], _MAIN: ["health", "login"], "app/models.py": ["Base", "Item"], "tests/test_items.py": ["test_read"]}.items() for n in ns],
        ("app/models.py::Item", "app/models.py::Item.total"),
    ),
    "call_edges": expected("caller_id VARCHAR, callee_id VARCHAR, line INTEGER, col INTEGER", (f"{_ITEMS}::read", f"{_ITEMS}::save", 8, 4), (f"{_ITEMS}::up", f"{_ITEMS}::save", 12, 24)),
    "env_reads": expected("key VARCHAR, file VARCHAR, line INTEGER, default VARCHAR, required BOOLEAN".replace("default", '"default"'), ("API_TOKEN", _ITEMS, 4, "'abc123'", False)),
    "endpoints": expected(
        "method VARCHAR, endpoint VARCHAR, handler VARCHAR, file VARCHAR, line INTEGER, duplicate BOOLEAN",
        ("GET", "/health", "health", _MAIN, 5, False), ("POST", "/login", "login", _MAIN, 8, False), ("GET", "/{user_id}", "read", _ITEMS, 5, False), ("POST", "/up", "up", _ITEMS, 10, False),
    ),
    "imports": expected("src VARCHAR, dst VARCHAR", (_MAIN, "app/__init__.py"), (_MAIN, _ITEMS)),
    "entrypoints": expected("path VARCHAR, kind VARCHAR, detail VARCHAR", (_MAIN, "framework_app_instance", "app")),
    "js_env_reads": expected("file VARCHAR, line INTEGER, key VARCHAR, fallback VARCHAR", ("web/client.ts", 3, "VITE_API_KEY", "none")),
    "dependencies": expected(
        "name VARCHAR, version VARCHAR, source_file VARCHAR, package VARCHAR",
        ("fastapi", ">=0.1", "requirements.txt", "fastapi"), ("httpx", None, "requirements.txt", "httpx"), ("requests", "==2.0", "requirements.txt", "requests"), ("react", "18", "web/package.json", "react"), ("vite", "5", "web/package.json", "vite"),
    ),
    "process_state": expected("file VARCHAR, name VARCHAR, line INTEGER, kind VARCHAR", (_ITEMS, "CACHE", 3, "mutated")),
    "background_jobs": expected("job VARCHAR, kind VARCHAR, file VARCHAR, line INTEGER, started_at VARCHAR[]", ("save", "task", _ITEMS, 17, [f"{_ITEMS}:12"])),
    "client_calls": expected("path VARCHAR, file VARCHAR, line INTEGER", ("/api/items/{}", "web/client.ts", 1), ("/api/nothing", "web/client.ts", 2)),
    "unmatched_calls": expected("path VARCHAR, file VARCHAR, line INTEGER", ("/api/nothing", "web/client.ts", 2)),
    "signals": expected(
        "kind VARCHAR, file VARCHAR, line INTEGER, text VARCHAR",
        ("fire_and_forget_tasks", _ITEMS, 12, "asyncio.create_task"), ("packaged_artifacts", "Dockerfile", 2, "COPY . /app"), ("python-blocking-call-in-async-def", _MAIN, 10, "time.sleep"), ("python-eval-exec-non-literal", "app/dead.py", 2, "eval"),
        ("python-exception-swallowed", _ITEMS, 20, "Exception"), ("python-http-request-without-timeout", _ITEMS, 9, "requests.get"), ("python-insecure-secret-default", _ITEMS, 4, "API_TOKEN"), ("python-jwt-decode-without-algorithms", _ITEMS, 14, "jwt.decode"),
        ("supply_chain", "Dockerfile", 1, "FROM python"), ("web-innerhtml-or-document-write", "web/client.ts", 4, "el.innerHTML = a;"), ("web-secret-in-client-env", "web/client.ts", 3, "const k = import.meta.env.VITE_API_KEY || 'none';"),
    ),
    "hotspots": expected(
        'file VARCHAR, line INTEGER, name VARCHAR, kinds VARCHAR[], handler BOOLEAN, broad BOOLEAN, loc INTEGER, score DOUBLE',
        (_ITEMS, 11, "up", ["background work", "db write"], True, False, 2, 2 * 2 + 3 + 2 / 40), (_ITEMS, 6, "read", ["db write", "network"], True, False, 4, 2 * 2 + 3 + 4 / 40),
    ),
    "routes": expected(
        "method VARCHAR, path VARCHAR, handler VARCHAR, file VARCHAR, line INTEGER, dependencies VARCHAR[], identity_inputs VARCHAR[], user_token_verified BOOLEAN, shared_key BOOLEAN, accepts_upload BOOLEAN, paginated BOOLEAN, auth VARCHAR, flags VARCHAR[]",
        ("GET", "/api/items/{user_id}", "read", _ITEMS, 5, ["get_user", "oauth", "require_api_key"], ["param:user", "param:user_id", "path:user_id"], True, True, False, True, "user token", []),
        ("GET", "/health", "health", _MAIN, 5, ["require_api_key"], [], False, True, False, False, "shared API key only", []),
        ("POST", "/api/items/up", "up", _ITEMS, 10, ["require_api_key"], [], False, True, True, False, "shared API key only", ["FILE UPLOAD"]),
        ("POST", "/login", "login", _MAIN, 8, ["require_api_key"], ["param:user_id"], False, True, False, False, "shared API key only", ["AUTH ENTRY POINT"]),
    ),
    "unreachable": expected("file VARCHAR", ("app/dead.py",), ("app/models.py",)),
    "tool_findings": expected(
        "tool VARCHAR, file VARCHAR, line INTEGER, severity VARCHAR, category VARCHAR, message VARCHAR, id VARCHAR",
        _finding("bandit", "app/dead.py", 2, "high", "B307", "eval"), _finding("jscpd", _ITEMS, 1, "warning", "duplicate_code", "Duplicate code block (31 lines, 90 tokens)"), _finding("jscpd", _MAIN, 2, "warning", "duplicate_code", "Duplicate code block (31 lines, 90 tokens)"),
        _finding("pip_audit", "requirements.txt", None, "critical", "CVE-1", "requests 2.0: CVE-1"), _finding("ruff", _ITEMS, 3, "warning", "E501", "Line too long"), _finding("ruff", _MAIN, 1, "warning", "F401", "unused import"),
    ),
    "tool_triage": expected("id VARCHAR, verdict VARCHAR, reason VARCHAR", (_finding("ruff", _ITEMS, 3, "", "E501", "Line too long")[-1], "low_value", "formatting only")),
    "action_fold": expected(
        "lane VARCHAR, finding VARCHAR, number BIGINT, severity VARCHAR, title VARCHAR, live BOOLEAN",
        ("auth", "g", 1, "Medium", "t", True), ("security", "f0", 1, "High", "title 0", True), ("security", "f1", 2, "High", "title 1", False), ("security", "f2", 3, "Low", "title 2", True), ("security", "f3", None, "High", "title 3", False),
    ),
    "duplicate_fold": expected("review VARCHAR, id VARCHAR, duplicate_of VARCHAR", ("r", "BUG-1", None), ("r", "INP-1", "SEC-1"), ("r", "SEC-1", None), ("r", "WEB-1", "SEC-1")),
}


def _relation(name: str, doc: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return relations(spark)[name]

    run.__name__, run.__doc__ = f"tree_{name}", doc
    query(EXPECTED[name])(run)


for _name, _doc in {
    "functions": "X1: functions of a source tree.", "classes": "X1: classes.", "contains_edges": "X1: containment.", "call_edges": "J1, X1: calls resolved to functions.", "env_reads": "X13: environment reads.", "endpoints": "X3, W2: function-based endpoints.",
    "signals": "D*: rule signals.", "imports": "J24, G1: file import graph.", "entrypoints": "X5: entry points.", "routes": "X7, X9, X10, J7, J8, G4: the route map.", "hotspots": "D16, D17, G8, W5: functions that combine effects.",
    "js_env_reads": "X14: environment reads in scripts.", "dependencies": "S17-S20: declared dependencies.", "process_state": "X18: process-local state.", "background_jobs": "X17: background jobs.", "client_calls": "X16: calls of clients.", "unmatched_calls": "J4: client calls without a route.",
}.items():
    _relation(_name, _doc)


@query(EXPECTED["unreachable"])
def tree_unreachable(spark: SparkSession, d: str) -> DataFrame:
    """Files that no entry point reaches."""
    from quarry.plans.stages import unreachable

    return unreachable(relations(spark), tree_files(spark))


@query()
def tree_leads(spark: SparkSession, d: str) -> DataFrame:
    """C14: leads of all lanes."""
    from quarry.plans.leads import build

    return build(relations(spark))


@query(EXPECTED["tool_findings"])
def tool_findings(spark: SparkSession, d: str) -> DataFrame:
    """Normalised findings of all tools."""
    from quarry.operators.normalizers import normalize

    raw = spark.createDataFrame([(t, s, json.dumps(p)) for t, s, p in PAYLOADS], "tool string, status string, payload string")
    return normalize(raw)


@query(EXPECTED["tool_triage"])
def tool_triage(spark: SparkSession, d: str) -> DataFrame:
    """Automatic triage of formatting findings."""
    from quarry.operators.collector import triage_formatting

    return triage_formatting(tool_findings(spark, d), spark.createDataFrame([], "id string, verdict string, reason string"))


@query(EXPECTED["action_fold"])
def action_fold(spark: SparkSession, d: str) -> DataFrame:
    """The ordered fold of agent actions."""
    from quarry.operators.collector import fold_actions

    rows = [("security", i, "record_finding", f"f{i}", "High", f"title {i}") for i in range(4)] + [("security", 4, "withdraw_finding", "f1", None, None), ("security", 5, "update_finding", "f2", "Low", None), ("auth", 1, "record_finding", "g", "Medium", "t")]
    return fold_actions(spark.createDataFrame(rows, "lane string, seq long, tool string, finding string, severity string, title string"), cap=3)


@query(EXPECTED["duplicate_fold"])
def duplicate_fold(spark: SparkSession, d: str) -> DataFrame:
    """Greedy folding of duplicate findings."""
    from quarry.operators.collector import fold_duplicates

    rows = [("r", "SEC-1", "High", True, ["cors", "wild"], [("f", 1, 2)]), ("r", "WEB-1", "Low", False, ["cors", "open"], [("f", 4, 5), ("f", 40, 41)]), ("r", "INP-1", "Low", False, ["cors", "late"], [("f", 44, 45)]), ("r", "BUG-1", "Low", False, ["other"], [("f", 44, 45)])]
    return fold_duplicates(spark.createDataFrame(rows, "review string, id string, severity string, verified boolean, terms array<string>, spans array<struct<file: string, low: int, high: int>>"))
