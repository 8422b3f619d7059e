"""Queries over the source tree held in code."""

from quarry.plans import fixtures
from quarry.plans.catalogue import QUERIES


def test_tree_queries(spark):
    got = fixtures.relations(spark)
    assert {r.qualname for r in got["functions"].collect()} == {"health", "login", "read", "up", "get_user", "oauth", "save", "nobody", "Item.total", "test_read"}
    assert {(r.method, r.path, r.auth) for r in got["routes"].collect()} == {("GET", "/health", "shared API key only"), ("POST", "/login", "shared API key only"), ("GET", "/api/items/{user_id}", "user token"), ("POST", "/api/items/up", "shared API key only")}
    assert [r.path for r in got["unmatched_calls"].collect()] == ["/api/nothing"]
    assert {"python-eval-exec-non-literal", "python-blocking-call-in-async-def", "web-innerhtml-or-document-write", "supply_chain"} <= {r.kind for r in got["signals"].collect()}
    assert {(r.name, tuple(r.kinds)) for r in got["hotspots"].collect()} == {("read", ("db write", "network")), ("up", ("background work", "db write"))}
    assert {r.package for r in got["dependencies"].collect()} == {"fastapi", "requests", "httpx", "react", "vite"}
    assert {r.file for r in QUERIES["tree_unreachable"](spark, "").collect()} == {"app/dead.py", "app/models.py"}


def test_other_fixture_queries(spark):
    assert QUERIES["tool_findings"](spark, "").count() == 6 and QUERIES["tool_triage"](spark, "").count() == 1
    folded = {r.finding: r for r in QUERIES["action_fold"](spark, "").collect()}
    assert folded["f3"].number is None and not folded["f1"].live and folded["f2"].severity == "Low"
    assert {r.id: r.duplicate_of for r in QUERIES["duplicate_fold"](spark, "").collect()} == {"SEC-1": None, "WEB-1": "SEC-1", "INP-1": "SEC-1", "BUG-1": None}
    assert QUERIES["tree_leads"](spark, "").count() > 5
