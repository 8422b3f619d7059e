"""Detectors and review operators on small sources with known answers."""

import pytest

SOURCES = {
    "app/llm.py": "llm = ChatOpenAI()\ndef ask(q):\n    return llm.invoke(q)\ndef outer(q):\n    return ask(q)\nasync def handler(q):\n    return outer(q)\nasync def direct(q):\n    return llm.invoke(q)\nasync def fine(q):\n    return await llm.ainvoke(q)\n",
    "app/deps.py": "CurrentUser = Annotated[User, Depends(get_current_user)]\nrouter = APIRouter()\n@router.get('/me')\ndef me(user: CurrentUser):\n    return user\n",
    "app/pool.py": "pool = ThreadPoolExecutor(max_workers=1)\ndef inner(): pass\ndef work():\n    pool.submit(inner)\ndef begin():\n    pool.submit(work)\n",
    "app/login.py": "def login(session, user):\n    session['user_id'] = user.id\ndef safe(session, user):\n    session.clear()\n    session['user_id'] = user.id\n@router.get('/x')\ndef find(token: str):\n    return request.args.get('api_key')\n",
    "app/text.py": "import re, openai\ndef clean_text(t):\n    return re.sub('@', ' ', t)\ndef clean_path(t):\n    return t.replace('/', '_')\ndef require_admin(f):\n    return f\ndef rate_limit(f):\n    return f\n@rate_limit\ndef x(): pass\n",
    "app/repo.py": "class Repo:\n    def __init__(self, user_id):\n        self.user_id = user_id\n    def mine(self):\n        return db.query(self._where())\n    def _where(self):\n        return self.user_id\n    def all(self):\n        return db.query(1)\n",
    "app/web.py": "app.router.add_get('/a/{id:\\\\d+}', show)\napp.router.add_route('POST', '/b', save)\nroutes = [Route('/c', endpoint=list_c, methods=['GET', 'POST'])]\nurlpatterns = [path('d/<int:id>/', views.detail)]\n@app.before_request\ndef check():\n    if not user:\n        abort(401)\n@app.before_request\ndef note():\n    log(1)\n",
    "app/tasks.py": "@shared_task\ndef nightly(): pass\nimport_module('app.plugins.extra')\n",
    "app/plugins/extra.py": "x = 1\n",
    "app/management/commands/seed.py": "x = 1\n",
    "app/worker/__main__.py": "x = 1\n",
    "tools/load.py": "x = 1\n",
    "tests/test_a.py": "def test_a(client):\n    client.get('/a')\n",
}
TEXTS = ["CMD uvicorn --port 80 app.web:app", "RUN python -u tools/load.py && python -m app.worker"]


@pytest.fixture(scope="module")
def parsed(spark):
    from quarry.operators import python_ast as P
    from quarry.shared import written
    from quarry.sources.trees import language
    from pyspark.sql import functions as F

    files = spark.createDataFrame(sorted(SOURCES.items()), "path string, text string").withColumn("language", language(F.col("path")))
    return files, written(P.nodes(files.where("language = 'Python'")))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_models_and_blocking_calls(parsed):
    from quarry.operators import detectors as D

    _, tree = parsed
    assert rows(D.model_names(tree)) == [("llm",)]
    assert rows(D.model_calls(tree).select("line", "how")) == [(3, "sync"), (9, "sync"), (11, "async")]
    assert rows(D.blocking_in_async(tree)) == [("app/llm.py", 7, "outer", "app/llm.py:3"), ("app/llm.py", 9, "invoke", "app/llm.py:9")]


def test_structure_sessions_and_text(parsed):
    from quarry.operators import detectors as D

    files, tree = parsed
    assert rows(D.executor_nesting(tree)) == [("app/pool.py", 3, "work")] and rows(D.single_worker_pools(tree)) == [("app/pool.py", 1)]
    assert rows(D.session_fixation(tree)) == [("app/login.py", 2, "user_id")]
    assert rows(D.query_credentials(tree).select("line", "name")) == [(7, "token"), (8, "api_key")]
    assert rows(D.lossy_cleaning(tree)) == [("app/text.py", 3, "@")]
    assert rows(D.unwired_controls(tree, files)) == [("app/text.py", 6, "require_admin")]
    assert rows(D.vendors(tree)) == [("OpenAI", "app/text.py", 1)]


def test_routes_hooks_aliases_and_identity(parsed):
    from quarry.operators import detectors as D
    from quarry.operators import routes as R

    _, tree = parsed
    assert rows(D.call_routes(tree).select("method", "path", "handler")) == [("ANY", "/d/{id}/", "detail"), ("GET", "/a/{id}", "show"), ("GET", "/c", "list_c"), ("POST", "/b", "save"), ("POST", "/c", "list_c")]
    assert rows(D.application_auth(tree).select("name")) == [("check",)]
    me = [r for r in R.routes(tree).collect() if r.path == "/me"][0]
    assert me.dependencies == ["get_current_user"] and me.user_token_verified and me.auth == "user token"
    assert rows(D.identity_unused(tree)) == [("app/repo.py", 8, "Repo", "all")]


def test_launch_commands_and_loaded_modules(spark, parsed):
    from quarry.operators import detectors as D

    files, tree = parsed
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    assert rows(D.launched(files, texts)) == [("app/web.py", "server"), ("app/worker/__main__.py", "script"), ("tools/load.py", "script")]
    assert rows(D.runtime_loaded(tree, files)) == [("app/management/commands/seed.py",), ("app/plugins/extra.py",), ("app/tasks.py",)]
    assert rows(D.testing_inventory(files, spark.createDataFrame([("PyTest", "x"), ("flask", "x")], "package string, source_file string"))) == [("route test", "tests/test_a.py"), ("test file", "tests/test_a.py"), ("test package", "pytest")]


def test_duplicates_fold_into_grown_findings(spark):
    """The second finding is near the first; the third is near the second only, whose citations the first has by then."""
    from quarry.operators.collector import fold_duplicates

    f = [
        ("r", "A-1", "High", True, ["cors", "wild"], [("f", 1, 2)]), ("r", "B-1", "Low", False, ["cors", "open"], [("f", 4, 5), ("f", 40, 41)]), ("r", "C-1", "Low", False, ["cors", "late"], [("f", 44, 45)]),
        ("r", "D-1", "Low", False, ["other"], [("f", 44, 45)]), ("r", "E-1", "Low", False, [], [("f", 44, 45)]), ("s", "A-2", "Low", False, ["cors", "wild"], [("f", 1, 2)]), ("r", "F-1", "Low", False, ["wild", "cors"], []),
    ]
    got = fold_duplicates(spark.createDataFrame(f, "review string, id string, severity string, verified boolean, terms array<string>, spans array<struct<file: string, low: int, high: int>>"))
    assert {r.id: r.duplicate_of for r in got.collect()} == {"A-1": None, "B-1": "A-1", "C-1": "A-1", "D-1": None, "E-1": None, "A-2": None, "F-1": "A-1"}


def test_closure_goes_as_deep_as_it_must(spark):
    from quarry.operators import graphs

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src int, dst int")
    facts = spark.createDataFrame([(40, True, False, ["x"]), (1, False, False, [])], "node int, verified boolean, shared boolean, identity array<string>")
    got = graphs.closure_with(edges, spark.createDataFrame([(0,)], "node int"), facts).first()
    assert got.any_verified and got.identities == ["x"]


def test_a_walk_that_runs_out_of_time_says_so(spark, tmp_path):
    from quarry.sources import trees

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("x = 1\n")
    with pytest.raises(TimeoutError):
        trees.scan_tree(spark, str(tmp_path), timeout=-1.0)
    files, unreadable, ran_out = trees.scan(spark, str(tmp_path))
    assert not ran_out and unreadable.count() == 0 and [r.path for r in files.collect()] == ["a/x.py"]


def test_registered_changes_are_one_a_key(spark):
    from quarry.operators import store

    stored = spark.createDataFrame([(1, "a", "pending"), (2, "b", "pending")], "k int, v string, status string")
    assert rows(store.partial_update(stored, spark.createDataFrame([(1, "x"), (1, None), (1, "y")], "k int, v string"), "k")) == [(1, "y", "pending"), (2, "b", "pending")]
    moved = store.move_status(stored, spark.createDataFrame([(1, "running"), (1, "failed"), (2, "running"), (2, "running")], "k int, new_status string"), "k")
    assert rows(moved.select("k", "status", "accepted")) == [(1, "pending", False), (2, "running", True)]
