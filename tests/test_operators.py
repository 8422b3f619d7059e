"""Operators on small relations: edge rows, ties, nulls."""

import json

from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import collector, graphs, joins, normalizers, python_ast, store, windows
from quarry.shared import written
from quarry.sources import trees


def one(spark, expr, **values):
    return spark.range(1).select(expr(*[F.lit(v) for v in values.values()]).alias("x")).first().x


def test_scalar_functions(spark):
    assert one(spark, S.client_path, p="/items{}?q=1") == "/items" and one(spark, S.client_path, p="/a/{}") == "/a/{}" and one(spark, S.client_path, p="?x") == "/"
    assert one(spark, S.framework_path, p="a//<int:id>/{k:\\d+}/") == "/a/{id}/{k}/"
    assert one(spark, S.package_name, p=" My_Pkg[extra] ") == "my-pkg"
    assert one(spark, S.line_count, p="") == 0 and one(spark, S.line_count, p="a\n") == 1 and one(spark, S.line_count, p="a\nb") == 2
    assert spark.range(1).select(S.percent(F.lit(1), F.lit(8)), S.percent(F.lit(1), F.lit(0)), S.percent(F.lit(25), F.lit(1000))).first()[:] == (12, 0, 2)
    assert one(spark, S.repo_relative_path if hasattr(S, "repo_relative_path") else lambda p: S.repo_relative(p, "/r"), p="/r/a/b.py") == "a/b.py"
    flags = lambda k, v: spark.range(1).select(S.env_flags(F.lit(k), F.lit(v)).alias("x")).first().x
    assert flags("VITE_API_KEY", "") == ["secret-named key exposed to the browser bundle", "empty"]
    assert flags("DB_PASSWORD", "admin") == ["weak/well-known secret value"] and flags("TOKEN_TTL", "30") == [] and flags("URL", "http://10.0.0.1") == ["contains a private IP address"]
    import hashlib

    made = spark.range(1).select(S.finding_id(F.lit("t"), F.lit("c"), F.lit("f"), F.lit(None).cast("int"), F.lit("m")).alias("x")).first().x
    assert made == hashlib.sha256(b"t|c|f|None|m").hexdigest()[:16]
    assert S.glob_pattern("src/*.py") == r"^src/.*\.py$"


def test_route_predicates(spark):
    none = F.array().cast("array<string>")
    got = spark.range(1).select(S.route_auth(none, F.lit(False), F.lit(False)), S.route_flags(F.lit("/items"), F.lit("f"), none, F.array(F.lit("x")), F.lit(False), F.lit(True)), S.unpaginated_listing(F.lit("GET"), F.lit("/items/"), F.lit("h"), F.lit(False)), S.unpaginated_listing(F.lit("GET"), F.lit("/items/{id}"), F.lit("h"), F.lit(False))).first()
    assert got[0] == "NONE" and got[1] == ["CLIENT-ASSERTED IDENTITY", "FILE UPLOAD", "NO AUTH DEPENDENCY"] and got[2] and not got[3]


def test_joins(spark):
    calls = spark.createDataFrame([("a",), ("b",), ("zz",), (None,)], "name string")
    defs = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "name string, id long")
    assert {(r.name, r.resolution, r.resolved_id) for r in joins.resolve_names(calls, defs, "name", "id").collect()} == {("a", "unique", 1), ("b", "ambiguous", None), ("zz", "external", None), (None, "external", None)}
    routes = spark.createDataFrame([("/items/{id}",), ("/a.b",), (None,)], "route string")
    paths = spark.createDataFrame([("/items/7",), ("/items/7/x",), ("/axb",), ("/a.b/",)], "path string")
    assert {r.path for r in joins.match_routes(paths, routes, "path", "route").collect()} == {"/items/7/x", "/axb"}
    sets = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "c", "d"]), (3, []), (4, None), (5, ["x"])], "id long, terms array<string>")
    assert [(r.a, r.b, r.similarity) for r in joins.similar_sets(sets, "id", "terms", 0.7).collect()] == [(1, 2, 0.75)]
    points = spark.createDataFrame([("f", 100), ("f", 131), ("f", None), ("g", 100)], "file string, line long")
    spans = spark.createDataFrame([("f", 110, 115), ("f", 0, 500), (None, 1, 2)], "file string, low long, high long")
    assert joins.near_spans(points, spans, "file", "line", "low", "high").count() == 3


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (None, 9)], "src long, dst long")
    roots = spark.createDataFrame([(1,), (None,)], "node long")
    assert {(r.node, r.depth) for r in graphs.reachable(edges, roots).collect()} == {(1, 0), (2, 1), (3, 2)}
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "child string, parent string")
    assert {tuple(r) for r in graphs.chain_roots(links, "child", "parent").collect()} == {("a", "c"), ("b", "c")}
    assert [tuple(r) for r in graphs.mutual_pairs(spark.createDataFrame([(1, 2), (2, 1), (1, 3), (4, 4)], "src long, dst long")).collect()] == [(1, 2)]
    facts = spark.createDataFrame([(2, True, False, ["x"]), (3, False, True, ["y"])], "node long, verified boolean, shared boolean, identity array<string>")
    got = graphs.closure_with(edges.where("src is not null"), roots.where("node = 1"), facts).first()
    assert got.any_verified and got.any_shared and got.identities == ["x", "y"]


def test_store(spark):
    reviews = spark.createDataFrame([(1, "pending"), (2, "running"), (3, "completed")], "id long, status string")
    changes = spark.createDataFrame([(1, "completed"), (2, "failed")], "id long, new_status string")
    assert {(r.id, r.status, r.accepted) for r in store.move_status(reviews, changes, "id").collect()} == {(1, "pending", False), (2, "failed", True), (3, "completed", None)}
    rows = spark.createDataFrame([(2, "x"), (9, "new")], "id long, status string")
    assert {tuple(r) for r in store.upsert(reviews, rows, "id").collect()} == {(1, "pending"), (2, "x"), (3, "completed"), (9, "new")}
    assert [r.id for r in store.page(reviews, [F.desc("id")], 2, 2).collect()] == [1]


def test_collector(spark):
    actions = [("a", i, "record_finding", f"f{i}", "High", f"t{i}") for i in range(3)] + [("a", 3, "withdraw_finding", "f0", None, None), ("a", 4, "record_finding", "f4", "Low", "late"), ("a", 5, "update_finding", "f1", "Low", None)]
    got = {r.finding: r for r in collector.fold_actions(spark.createDataFrame(actions, "lane string, seq long, tool string, finding string, severity string, title string"), cap=2).collect()}
    assert got["f2"].number is None and not got["f0"].live and got["f4"].number == 3 and (got["f1"].severity, got["f1"].title) == ("Low", "t1")
    spans = "array<struct<file: string, low: int, high: int>>"
    rows = [("r", "A-1", "High", True, ["cors", "wild"], [("f", 1, 2)]), ("r", "B-1", "Low", False, ["cors", "open"], [("f", 4, 5), ("f", 40, 41)]), ("r", "C-1", "Low", False, ["cors", "late"], [("f", 44, 45)]), ("r", "D-1", "Low", False, ["other"], [("f", 44, 45)])]
    folded = {r.id: r.duplicate_of for r in collector.fold_duplicates(spark.createDataFrame(rows, f"review string, id string, severity string, verified boolean, terms array<string>, spans {spans}")).collect()}
    assert folded == {"A-1": None, "B-1": "A-1", "C-1": "A-1", "D-1": None}
    findings = spark.createDataFrame([("i1", "ruff", "E501", "a.py", 3), ("i2", "ruff", "F401", "a.py", 9), ("i3", "bandit", "B1", "a.py", None)], "id string, tool string, category string, file string, line int")
    triage = spark.createDataFrame([], "id string, verdict string, reason string")
    assert [r.id for r in collector.triage_formatting(findings, triage).collect()] == ["i1"]
    cited = spark.createDataFrame([("a.py", 10, 12, 1, "SEC-1")], "file string, low int, high int, finding_seq int, finding_id string")
    assert [(r.id, r.reason) for r in collector.triage_cited(findings, cited, triage).collect()] == [("i2", "cited by SEC-1")]


def test_normalizers(spark):
    payloads = [
        ("ruff", "success", [{"filename": "/r/a.py", "code": None, "message": "m", "location": {"row": 3}}]),
        ("pyright", "success", {"generalDiagnostics": [{"file": "/r/a.py", "severity": "odd", "message": "m", "range": {"start": {"line": 0}}}]}),
        ("radon", "success", {"complexity": {"a.py": [{"type": "method", "name": "f", "rank": "C", "complexity": 12, "lineno": 4}, {"name": "g", "rank": "A"}], "b.py": "error text"}, "maintainability": {"a.py": {"mi": 15.5, "rank": "B"}, "c.py": "bad"}}),
        ("vulture", "success", [{"file": "a.py", "line": "7", "message": "unused", "confidence": "60"}, {"file": "a.py", "line": "?", "message": "u"}]),
        ("jscpd", "success", [{"firstFile": {"name": "a", "startLoc": {"line": 1}}, "secondFile": {"name": "b", "startLoc": {"line": 2}}, "lines": 30, "tokens": 99}]),
        ("lizard", "success", [{"file": "a.py", "function": "f", "line": "3", "ccn": "21"}]),
        ("pip_audit", "success", {"dependencies": [{"name": "p", "version": "1", "vulns": [{"id": "CVE-1", "fix_versions": []}, {"id": "CVE-2", "description": "d", "fix_versions": ["2"]}]}]}),
        ("semgrep", "success", [{"check_id": "x.y", "path": "a.py", "start": {"line": 2}, "extra": {"severity": "ERROR", "message": "m"}}]),
        ("bandit", "success", [{"filename": "a.py", "line_number": 1, "issue_severity": "HIGH", "test_id": "B1", "issue_text": "t"}]),
        ("gitleaks", "success", [{"File": "a", "StartLine": 1, "RuleID": "r", "Description": "d"}]),
        ("bandit", "error", [{"filename": "zz"}]),
        ("ruff", "success", None),
    ]
    raw = spark.createDataFrame([(t, s, json.dumps(p) if p is not None else "not json") for t, s, p in payloads], "tool string, status string, payload string")
    got = {(r.tool, r.file, r.line, r.severity, r.category, r.message) for r in normalizers.normalize(raw, "/r").collect()}
    assert got == {
        ("ruff", "a.py", 3, "warning", "unknown", "m"), ("pyright", "a.py", 0, "error", "unknown", "m"), ("radon", "a.py", 4, "warning", "complexity_C", "method 'f' has complexity rank C (score 12)"),
        ("radon", "a.py", None, "warning", "maintainability_B", "Maintainability index rank B (score 15.5)"), ("vulture", "a.py", 7, "warning", "dead_code", "unused (60% confidence)"), ("vulture", "a.py", None, "warning", "dead_code", "u (?% confidence)"),
        ("jscpd", "a", 1, "warning", "duplicate_code", "Duplicate code block (30 lines, 99 tokens)"), ("jscpd", "b", 2, "warning", "duplicate_code", "Duplicate code block (30 lines, 99 tokens)"), ("lizard", "a.py", 3, "error", "cyclomatic_complexity", "Function 'f' has cyclomatic complexity 21"),
        ("pip_audit", "requirements.txt", None, "critical", "CVE-1", "p 1: CVE-1"), ("pip_audit", "requirements.txt", None, "high", "CVE-2", "p 1: d"), ("semgrep", "a.py", 2, "high", "x.y", "m"), ("bandit", "a.py", 1, "high", "B1", "t"), ("gitleaks", "a", 1, "critical", "r", "d"),
    }


SOURCE = '''import os, asyncio
from .util import helper as h
from app import models
app = FastAPI()
@app.get("/items/{id}")
async def read(id, x=[]):
    v = os.getenv("TOKEN", "abc")
    w = os.environ["HOME"]
    time.sleep(1)
    asyncio.create_task(h())
    for i in range(3):
        helper(i)
    def inner():
        print(1)
    try:
        subprocess.run("ls", shell=True)
    except Exception:
        pass
class A(View):
    def m(self): return read(1)
if __name__ == "__main__":
    eval(x)
'''


def test_python_sources(spark):
    files = spark.createDataFrame([("src/app/main.py", SOURCE), ("src/app/util.py", "def helper(a):\n    return 1\n"), ("src/app/models.py", ""), ("bad.py", "def ("), ("none.py", None)], "path string, text string")
    tree = written(python_ast.nodes(files))
    assert {r.qualname for r in python_ast.functions(tree).collect()} == {"read", "read.inner", "A.m", "helper"}
    assert {(r.caller_id.split("::")[1], r.callee_id.split("::")[1]) for r in python_ast.call_edges(tree).collect()} == {("read", "helper"), ("A.m", "read")}
    assert {(r.key, r.default, r.required) for r in python_ast.env_reads(tree).collect()} == {("TOKEN", "'abc'", False), ("HOME", None, True)}
    assert [(r.method, r.endpoint, r.handler) for r in python_ast.endpoints(tree).collect()] == [("GET", "/items/{id}", "read")]
    assert {(r.kind, r.detail) for r in python_ast.entrypoints(tree, files).collect()} == {("main_guard", None), ("framework_app_instance", "app")}
    assert {(r.src, r.dst) for r in python_ast.import_edges(tree, files).collect()} == {("src/app/main.py", "src/app/util.py"), ("src/app/main.py", "src/app/models.py")}
    kinds = {r.kind for r in python_ast.signals(tree).collect()}
    assert {"python-subprocess-shell-true", "python-eval-exec-non-literal", "python-blocking-call-in-async-def", "subprocess_no_timeout", "fire_and_forget_tasks", "python-exception-swallowed", "python-mutable-default-argument"} <= kinds
    assert {(r.path, r.kind) for r in tree.where("kind in ('error', 'skipped')").collect()} == {("bad.py", "error"), ("none.py", "skipped")}


def test_tree_scan(spark, tmp_path):
    made = {"src/a.py": "x = 1\n", "src/.venv/skip.py": "", ".env": "TOKEN=secretsecret", ".env.example": "TOKEN=\nTOKEN=changeme\n", "requirements.txt": "# c\nFastAPI>=0.1 ; python_version>'3'\n-r x\nhttps://x\n", "web/package.json": '{"dependencies": {"react": "18"}}', "pyproject.toml": '[project]\ndependencies = ["fast_api[all]>=1", "numpy"]\n', "bad/pyproject.toml": "= =", "pkg.egg-info/x.txt": ""}
    for name, text in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = written(trees.scan_tree(spark, str(tmp_path)))
    assert {r.path for r in files.collect()} == set(made) - {"src/.venv/skip.py", ".env", "pkg.egg-info/x.txt"}
    assert {(r.path, r.language) for r in files.where("language is not null").collect()} >= {("src/a.py", "Python"), ("web/package.json", "JSON")}
    assert trees.surface(files).first()[:] == (["src"], ["pyproject.toml", "requirements.txt"])
    assert {(r.package, r.source_file) for r in trees.declared_dependencies(files).collect()} == {("fastapi", "requirements.txt"), ("fast-api", "pyproject.toml"), ("numpy", "pyproject.toml"), ("react", "web/package.json")}
    env = trees.env_files(files.where("path like '%.env.example'")).collect()
    assert [(r.key, r.lines) for r in env] == [("TOKEN", [1, 2])]


def test_window_operators(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4), ("b", 1, 9)], "k string, id long, s long")
    assert {tuple(r) for r in windows.top_with_cap(rows, "k", [F.desc("s"), F.col("id")], 2, 3).select("k", "id").collect()} == {("b", 1), ("a", 1), ("a", 2)}
    assert [(r.position, r.v) for r in windows.capped_list(rows.select("k", F.col("id").cast("string").alias("v")), ["k"], [F.col("v")], 2, "v").where("k = 'a'").orderBy("position").collect()] == [(1, "1"), (2, "2"), (3, "… 1 more")]
    ranked = collector.part_numbers(rows, ["k"], ["s", "id"], F.floor(F.col("id") / 2))
    assert {(r.k, r.id, r.number) for r in ranked.collect()} == {("a", 3, 1), ("a", 1, 2), ("a", 2, 3), ("b", 1, 1)}


def test_routes_and_hotspots(spark):
    from quarry.operators import routes

    main = "app = FastAPI(dependencies=[Depends(require_api_key)])\napp.include_router(items.router, prefix='/api')\n@app.get('/health')\ndef health(): return 1\n"
    items = (
        "router = APIRouter(prefix='/items')\n@router.get('/{user_id}')\ndef read(user_id, limit: int = 10, user=Depends(get_user)):\n    save()\n    requests.get('x')\n"
        "@router.post('/up')\nasync def up(f: UploadFile = File(...)): pass\ndef get_user(token=Depends(oauth)):\n    return jwt.decode(token)\ndef oauth(): pass\ndef save():\n    session.commit()\n"
    )
    tree = written(python_ast.nodes(spark.createDataFrame([("app/main.py", main), ("app/items.py", items)], "path string, text string")))
    found = written(routes.routes(tree))
    got = {(r.method, r.path): r for r in found.collect()}
    assert set(got) == {("GET", "/health"), ("GET", "/api/items/{user_id}"), ("POST", "/api/items/up")}
    read = got[("GET", "/api/items/{user_id}")]
    assert read.dependencies == ["get_user", "oauth", "require_api_key"] and read.user_token_verified and read.paginated and "path:user_id" in read.identity_inputs
    assert got[("POST", "/api/items/up")].flags == ["FILE UPLOAD"] and got[("GET", "/health")].auth == "shared API key only"
    spots = routes.hotspots(tree, found).collect()
    assert [(r.name, r.kinds, r.handler) for r in spots] == [("read", ["db write", "network"], True)]
    scripts = spark.createDataFrame([("web/a.ts", "fetch(`/api/items/${id}`)\nfetch('/api/nothing?x=1')\nfetch('/api/nothing')"), ("web/b.ts", "x('/other')")], "path string, text string")
    calls = routes.client_calls(scripts, spark.createDataFrame([("api",)], "segment string"))
    assert {(r.path, r.line) for r in calls.collect()} == {("/api/items/{}", 1), ("/api/nothing", 2)}
    assert [r.path for r in routes.unmatched_calls(calls, found).collect()] == ["/api/nothing"]


def test_text_signals(spark):
    from quarry.operators import text_signals as X

    files = spark.createDataFrame([("Dockerfile", "FROM python\n# FROM x\nCOPY . /app"), ("web/package.json", "{}"), ("api/pyproject.toml", ""), ("api/uv.lock", ""), ("none", None)], "path string, text string")
    assert {(r.kind, r.line) for r in X.signals(files).collect()} == {("supply_chain", 1), ("packaged_artifacts", 3)}
    assert [r.path for r in X.absent_lockfiles(files).collect()] == ["web/package.json"]
    deps = spark.createDataFrame([("requests", "r.txt"), ("httpx", "r.txt"), ("pyyaml", "r.txt")], "package string, source_file string")
    fams = spark.createDataFrame([("requests", "http"), ("httpx", "http")], "package string, family string")
    assert [r.members for r in X.duplicate_families(deps, fams).collect()] == [["httpx", "requests"]]
    used = spark.createDataFrame([("yaml.loader",), ("requests",)], "name string")
    assert [r.package for r in X.unused_dependencies(deps, used, spark.createDataFrame([("pyyaml", "yaml")], "package string, module string")).collect()] == ["httpx"]


def test_report(spark, tmp_path):
    from quarry.plans import report

    ev = "array<struct<file: string, line_start: int, line_end: int>>"
    rows = [("SEC-2", "security", "High", "high", "a|b", "d", "i", [("f", 1, 1)], None), ("SEC-1", "security", "Critical", "medium", "t", None, None, [("f", 1, 3)] * 14, None), ("ENV-1", "secrets", "Low", "low", "x", "", "", [], None), ("SEC-3", "security", "Low", "high", "dup", "", "", [], "SEC-1")]
    found = spark.createDataFrame(rows, f"id string, category string, severity string, confidence string, title string, description string, impact string, evidence {ev}, duplicate_of string")
    lanes = spark.createDataFrame([("security", "Security", 1), ("secrets", "Secrets", 2)], "category string, label string, place int")
    kept = report.assemble(found)
    assert {r.id: r.section for r in report.numbered_sections(kept, lanes).collect()} == {"SEC-1": "1.1", "SEC-2": "1.2"}
    assert {(r.kind, r.name, r.n) for r in report.issues_summary(kept).collect()} == {("severity", "High", 1), ("severity", "Critical", 1), ("category", "security", 2), ("total", "all", 2)}
    report.write_markdown(report.markdown(kept, lanes, "demo"), f"{tmp_path}/md")
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*")))
    assert text.startswith("# demo — Full Engineering Review") and "**Findings:** 1 Critical, 1 High, 0 Medium, 0 Low — 2 total" in text
    assert text.index("### 1.1 t") < text.index("### 1.2 a\\|b") and "`f:1-3`" in text and "+2 more" in text


def test_streams(spark, tmp_path):
    from quarry.streaming import progress

    events = [("r1", "clone", "running", 1), ("r1", "clone", "completed", 2), ("r1", "review", "completed", 3), ("r2", "clone", "failed", 1), ("r3", "clone", "running", 1)]
    spark.createDataFrame(events, "run string, stage string, status string, t int").selectExpr("run", "stage", "status", "timestamp_seconds(t) ts").write.parquet(f"{tmp_path}/in")
    batch = progress.fold(spark.read.parquet(f"{tmp_path}/in"))
    assert {(r.run, r.stage) for r in progress.final_stage(batch, "review").collect()} == {("r1", "done"), ("r2", "failed"), ("r3", "clone")}
    stream = spark.readStream.schema("run string, stage string, status string, ts timestamp").parquet(f"{tmp_path}/in")
    q = progress.fold(stream).writeStream.outputMode("complete").format("memory").queryName("folded").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("folded").collect()} == {tuple(r) for r in batch.collect()}
    progress.write_once(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    assert {(r.run, r.state) for r in progress.stale_runs(spark.read.parquet(f"{tmp_path}/in")).collect()} == {("r1", "finished"), ("r2", "finished"), ("r3", "stale")}
    assert progress.stale_runs(stream).isStreaming and progress.window_counts(stream, kind="stage").isStreaming


def test_leads_and_stages(spark, tmp_path):
    from quarry.plans import leads, stages

    sources = [("app/main.py", "Python", "from app import a\napp = FastAPI()\n@app.post('/chat')\nasync def chat(f: UploadFile): time.sleep(1)\n"), ("app/a.py", "Python", "x = 1\n"), ("app/dead.py", "Python", "y = 1\n"), ("app/__init__.py", "Python", ""), ("Dockerfile", None, "FROM python\n")]
    files = spark.createDataFrame(sources, "path string, language string, text string")
    got = stages.analyse(spark, files)
    assert {r.file for r in stages.unreachable(got, files).collect()} == {"app/dead.py"}
    found = written(leads.build(got))
    rows = {(r.lane, r.label): (r.file, r.line) for r in found.collect()}
    assert rows[("inputs", "uploads")] == ("app/main.py", None) and rows[("performance", "blocking calls in async functions")] == ("app/main.py", 4) and ("dependencies", "unpinned images") in rows
    spans = spark.createDataFrame([("performance", "app/main.py", 10, 12), ("inputs", "other.py", 1, 1)], "lane string, file string, low int, high int")
    dismissed = spark.createDataFrame([("dependencies", "unpinned images")], "lane string, label string")
    left = {(r.lane, r.label) for r in leads.open_leads(found, spans, dismissed).collect()}
    assert ("inputs", "uploads") in left and ("performance", "blocking calls in async functions") not in left and ("dependencies", "unpinned images") not in left
    made = []
    for _ in range(2):
        t = stages.cached(spark, f"file://{tmp_path}", stages.stage_key("sha", "1"), lambda: made.append(1) or found)
        assert t.count() == found.count()
    assert made == [1]


def test_config(spark):
    import pytest

    from quarry.sources import config

    raw = b'[[categories]]\nid="a"\ncode="A"\neffort=1\n[[categories]]\nid="b"\ncode="B"\neffort=3\n[[kpis]]\nid="K"\n[tool_owners]\nruff="a"\n'
    tables = config.dimensions(spark, config.parse(raw))
    assert [r.category for r in config.launch_order(tables["categories"]).collect()] == ["b", "a"]
    with pytest.raises(config.ConfigError, match="no category"):
        config.parse(raw.replace(b'ruff="a"', b'ruff="zz"'))


def test_more_rules_and_folds(spark):
    from quarry.operators import text_signals as X

    src = "client = OpenAI()\ndef login(price: float):\n    for x in y:\n        chain.invoke(x)\n    resp.set_cookie('a')\n    k = os.getenv('API_KEY', 'abc123')\n    jwt.decode(t, options=verify_none)\n    redirect(request.args)\n"
    tree = written(python_ast.nodes(spark.createDataFrame([("m.py", src)], "path string, text string")))
    kinds = {r.kind for r in python_ast.signals(tree).collect()}
    assert {"model_clients_at_import", "python-float-for-money", "python-model-call-in-loop", "python-cookie-missing-flags", "python-insecure-secret-default", "python-jwt-verification-disabled", "python-open-redirect"} <= kinds
    web = spark.createDataFrame([("a.tsx", "<div dangerouslySetInnerHTML={x}/>\n// eval(x)\neval(y)\nlocalStorage.setItem('token', t)")], "path string, text string")
    assert {(r.kind, r.line) for r in X.signals(web).collect()} == {("web-dangerously-set-inner-html", 1), ("web-eval", 3), ("web-credential-in-web-storage", 4)}
    files = spark.createDataFrame([("a.py", 10)], "file string, lines int")
    ev = spark.createDataFrame([("a.py", 3, 2, "n"), ("a.py", 11, None, ""), ("b.py", 1, 1, ""), (".env", 1, 1, "")], "file string, line_start int, line_end int, note string")
    assert {(r.file, r.line_start, r.line_end, r.reason) for r in collector.valid_evidence(ev, files).collect()} == {("a.py", 3, None, None), ("a.py", 11, None, "beyond the end of the file"), ("b.py", 1, 1, "no such file"), (".env", 1, 1, "sensitive file")}
    found = spark.createDataFrame([("1", "High"), ("2", "Low"), ("3", "Low")], "id string, severity string")
    acts = spark.createDataFrame([(1, "1", "rejected", None, ""), (2, "1", "adjusted", "Medium", "n"), (3, "2", "rejected", None, "")], "seq long, id string, verdict string, severity string, note string")
    assert {(r.id, r.severity, r.original_severity, r.rejected) for r in collector.verdicts(found, acts).collect()} == {("1", "Medium", "High", False), ("2", "Low", None, True), ("3", "Low", None, False)}
    kpis = spark.createDataFrame([("K1",), ("K2",), ("K3",)], "kpi string")
    told = spark.createDataFrame([(1, "K1", "not_applicable", ["x"]), (2, "K2", "closed", ["f"])], "seq long, kpi string, status string, files array<string>")
    leads = spark.createDataFrame([("K1", "f"), ("K2", "f")], "kpi string, file string")
    assert {tuple(r) for r in collector.kpi_assessments(told, leads, kpis).collect()} == {("K1", "not_verified", False), ("K2", "closed", True), ("K3", "not_verified", None)}
    numbered = collector.audit_batches(spark.createDataFrame([("b", 1), ("a", 2), ("a", 1)], "lane string, seq long"), 1)
    assert {tuple(r) for r in numbered.collect()} == {("a", 1, 1, 0), ("a", 2, 2, 1), ("b", 1, 3, 0)}


def test_state_jobs_claims_runtimes_and_maps(spark):
    from quarry.operators import text_signals as X
    from quarry.plans import report

    src = "CACHE = {}\nN = 0\nLOCK = threading.Lock()\nFIXED = [1]\ndef put(k):\n    global N\n    N = 1\n    CACHE[k] = 1\n    asyncio.create_task(work())\n    Thread(target=other)\nasync def work(): pass\n"
    tree = written(python_ast.nodes(spark.createDataFrame([("m.py", src), ("o.py", "def other(): pass")], "path string, text string")))
    assert {(r.name, r.kind) for r in python_ast.process_state(tree).collect()} == {("CACHE", "mutated"), ("N", "global"), ("LOCK", "sync")}
    assert {(r.job, r.kind, r.file, tuple(r.started_at)) for r in python_ast.background_jobs(tree).collect()} == {("work", "task", "m.py", ("m.py:9",)), ("other", "thread", "o.py", ("m.py:10",))}
    files = spark.createDataFrame([("AGENTS.md", "# Head\n- one\n2. two"), ("a/agents.md", "# Only\ntext"), (".python-version", "3.13\n"), ("Dockerfile", "FROM node:22-slim")], "path string, text string")
    assert {(r.file, r.line, r.claim) for r in X.document_claims(files).collect()} == {("AGENTS.md", 2, "one"), ("AGENTS.md", 3, "two"), ("a/agents.md", 1, "Only")}
    assert {(r.runtime, r.version) for r in X.declared_runtimes(files).collect()} == {("python", "3.13"), ("node", "22-slim")}
    rows = spark.createDataFrame([("GET", "/a|b", "NONE", ["F"], "f.py", 3, "h")], "method string, path string, auth string, flags array<string>, file string, line int, handler string")
    assert [r.line for r in report.route_map(rows).orderBy("block", "position").collect()][-1] == "| GET | /a\\|b | NONE | F | `f.py:3` h |"
    many = spark.createDataFrame([("k", "f", i, "t") for i in range(3)], "kind string, file string, line int, text string")
    assert [r.text for r in report.lines_with_rest(many, 2).orderBy("position").collect()][-1] == "… 1 more"


def test_flask_and_class_routes(spark):
    from quarry.operators import routes

    src = "app = Flask(__name__)\nbp = Blueprint('b', __name__, url_prefix='/own')\napp.register_blueprint(bp, url_prefix='/api')\n@bp.route('/items/<int:id>', methods=['GET', 'POST'])\ndef items(id): pass\n@app.get('/')\ndef root(): pass\nclass V(MethodView):\n    def get(self): pass\n    def delete(self): pass\napp.add_url_rule('/v', view_func=V.as_view('v'))\n"
    tree = written(python_ast.nodes(spark.createDataFrame([("m.py", src)], "path string, text string")))
    assert {(r.method, r.path) for r in routes.blueprint_routes(tree).collect()} == {("GET", "/api/items/{id}"), ("POST", "/api/items/{id}"), ("GET", "/")}
    assert {(r.method, r.endpoint, r.handler) for r in python_ast.class_endpoints(tree).collect()} == {("GET", "/v", "V"), ("DELETE", "/v", "V")}


def test_one_bad_line_does_not_lose_the_file():
    src = 'import os\ndef f():\n    x = = 1\n    return os.getenv("A")\ndef g():\n    try:\n        f()\n    except A, B:\n        pass\n'
    rows = python_ast.parse("m.py", src)
    assert {(r["kind"], r["name"], r["line"]) for r in rows if r["kind"] in ("function", "env_read")} == {("function", "f", 2), ("env_read", "A", 4), ("function", "g", 5)}
    assert [r["kind"] for r in rows if r["kind"] == "error"] == ["error"]
    assert not [r for r in python_ast.parse("m.py", src.replace("x = = 1", "x = 1")) if r["kind"] == "error"]
