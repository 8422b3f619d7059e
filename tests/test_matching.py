"""Containment by q-grams and route matching by shapes, against plain versions."""

import random
import re

import pytest

from quarry.functions.scalars import path_pattern
from quarry.operators import containment, joins, review, routes


@pytest.mark.parametrize("q,sent", [(3, 1_000_000), (5, 0), (1, 10)])
def test_containing_equals_contains(spark, monkeypatch, q, sent):
    monkeypatch.setattr(containment, "SENT", sent)
    rng = random.Random(q)
    word = lambda n: "".join(rng.choice("abä ") for _ in range(n))
    texts = [(rng.choice("xy"), i, word(rng.randrange(40))) for i in range(80)] + [("x", 80, None), ("x", 81, ""), ("y", 0, "again abab"), (None, 82, "abab")]
    needles = [(rng.choice("xy"), word(rng.randrange(9))) for _ in range(40)] + [("x", None), ("x", ""), ("y", "abab"), ("y", "abab"), (None, "ab")]
    t, n = spark.createDataFrame(texts, "lane string, id int, text string"), spark.createDataFrame(needles, "lane string, needle string")
    got = containment.containing(t, "id", "text", n, "needle", ["lane"], q)
    want = {(a, i, s) for a, i, x in texts for b, s in needles if a is not None and a == b and x and s and s in x}
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(want) and len(want) > 100
    anywhere = [tuple(r) for r in containment.containing(t, "id", "text", n, "needle", q=q).collect()]
    assert sorted(anywhere) == sorted({(i, s) for _, i, x in texts for _, s in needles if x and s and s in x})


def test_containing_of_nothing(spark):
    t, n = spark.createDataFrame([(1, "a")], "id int, text string"), spark.createDataFrame([(None,)], "needle string")
    assert containment.containing(t, "id", "text", n, "needle").collect() == []
    assert containment.containing(t.limit(0), "id", "text", spark.createDataFrame([("a",)], "needle string"), "needle").collect() == []


@pytest.mark.parametrize("sent", [100_000, 0])
def test_paths_match_as_their_patterns_say(spark, sent):
    rng = random.Random(9)
    piece = lambda: rng.choice(["a", "b", "{id}", "{}", "", "a.b", "x{y}"])
    path = lambda: "/" + "/".join(piece() for _ in range(rng.randrange(4))) + rng.choice(["", "/", "//"])
    patterns = [(path(), rng.random() < 0.2) for _ in range(25)] + [("/", False), (None, False)]
    paths = [path().replace("{id}", "7") for _ in range(300)] + ["", "/", None]
    df = spark.createDataFrame(patterns, "path string, below boolean")
    got = {r["path"] for r in joins.matching_paths(spark.createDataFrame([(p,) for p in paths], "path string"), df, sent).collect()}
    regex = [(r[0], r[1]) for r in df.where("path is not null").select(path_pattern(df["path"]), path_pattern(df["path"], True), "below").rdd.map(lambda r: (r[1] if r[2] else r[0], r[2])).collect()]
    want = {p for p in paths if p is not None and any(re.match(x, p) for x, _ in regex)}
    assert got == want and 30 < len(want) < 250


def test_calls_and_routes(spark):
    served = spark.createDataFrame([("/api/items/{id}",), ("/api/items",), ("/health",)], "path string")
    calls = spark.createDataFrame([("/api/items/{}", "a"), ("/api", "a"), ("/static/x/y", "a"), ("/api/other", "b"), ("/health/", "c")], "path string, file string")
    mounts = spark.createDataFrame([("/static",)], "path string")
    assert [r["path"] for r in routes.unmatched_calls(calls, served, mounts).collect()] == ["/api/other"]
    assert sorted(r["path"] for r in routes.unmatched_calls(calls, served).collect()) == ["/api/other", "/static/x/y"]
    assert routes.unmatched_calls(calls, served.limit(0)).collect() == []
    assert [r["path"] for r in review.routes_without_client(served, calls).collect()] == ["/api/items"]
    assert review.routes_without_client(served, calls.limit(0)).collect() == []
