"""Spans of any length, and the tree listing by levels, against plain versions."""

import os
import random

from pyspark.sql import functions as F

from quarry.operators import joins
from quarry.sources import trees


def made_spans(rng, n):
    out = []
    for i in range(n):
        low = rng.randrange(-500, 3000)
        length = rng.choice([0, 1, 30, 64, 65, 700, -3, -20]) if i % 10 else 10**9
        out.append((rng.choice("abc") if i % 7 else None, i, None if i % 31 == 0 else low, low + length))
    return out


def test_overlaps_of_short_and_very_long_spans(spark):
    rows = made_spans(random.Random(1), 150)
    got = joins.overlapping_pairs(spark.createDataFrame(rows, "k string, i int, low long, high long"), "k", "i", "low", "high", 5)
    want = sorted((k, a, b) for k, a, l1, h1 in rows for k2, b, l2, h2 in rows if k and k == k2 and a < b and None not in (l1, l2) and l1 - 5 <= h2 and l2 - 5 <= h1)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_points_in_short_and_very_long_spans(spark):
    rng = random.Random(2)
    spans = made_spans(rng, 100)
    points = [(rng.choice("abc"), i, rng.choice([rng.randrange(-600, 4000), 10**9 - 5, None])) for i in range(120)]
    got = joins.near_spans(spark.createDataFrame(points, "k string, p int, at long"), spark.createDataFrame(spans, "k string, i int, low long, high long"), "k", "at", "low", "high", 15)
    want = sorted((p, i) for k, p, at in points for k2, i, low, high in spans if k == k2 and None not in (at, low) and low - 15 <= at <= high + 15)
    assert sorted((r["p"], r["i"]) for r in got.collect()) == want and len(want) > 100


def test_a_long_span_makes_few_rows(spark):
    one = spark.createDataFrame([(0, 10**9), (5, 5), (-3, 12), (-(1 << 40), 1 << 40)], "a long, b long").withColumn("n", joins._nodes(F.col("a"), F.col("b")))
    for r in one.collect():
        held = sorted((n["node"] << n["level"], (n["node"] + 1) << n["level"]) for n in r["n"])
        assert held[0][0] == r["a"] and held[-1][1] == r["b"] + 1 and all(x[1] == y[0] for x, y in zip(held, held[1:])) and len(held) <= 90


def test_listing_equals_a_walk(spark, tmp_path):
    rng = random.Random(3)
    folders = [""]
    for i in range(60):
        folders.append(f"{rng.choice(folders)}/d{i}".lstrip("/"))
    for f in [*folders, "node_modules/x", "d0/__pycache__", "lib.egg-info", "deep/er/than/all/others/by/far"]:
        os.makedirs(tmp_path / f, exist_ok=True)
        for j in range(rng.randrange(3)):
            (tmp_path / f / f"_f{j}.py").write_text("x" * j)
    os.symlink(tmp_path / "deep", tmp_path / "link")
    os.symlink(tmp_path / "nowhere", tmp_path / "dangling")
    want = set()
    for at, below, names in os.walk(tmp_path):
        below[:] = [d for d in below if d not in trees.IGNORED and not d.endswith(".egg-info")]
        want |= {(os.path.relpath(os.path.join(at, n), tmp_path), os.stat(os.path.join(at, n)).st_size) for n in names if os.path.exists(os.path.join(at, n))}
    listed = trees.list_tree(spark, str(tmp_path)).collect()
    assert {(r["path"], r["size_bytes"]) for r in listed if r["kind"] == "file"} == want and len(want) > 20
    assert [(r["path"], r["error"]) for r in listed if r["kind"] == "unreadable"] == [("dangling", "No such file or directory")]
    assert {r["kind"] for r in trees.list_tree(spark, str(tmp_path), timeout=-1.0).collect()} == {"unlisted"}
    gone = trees.list_tree(spark, str(tmp_path / "absent")).collect()
    assert [(r["path"], r["kind"], r["error"]) for r in gone] == [("", "unreadable", "No such file or directory")]
