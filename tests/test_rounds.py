"""The duplicate fold by rounds against the sequential fold, and upkeep after changes against whole runs."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import collector, increments, python_ast
from quarry.operators.graphs import reachable
from quarry.shared import work_folder, written

FINDING = "review string, id string, severity string, verified boolean, terms array<string>, spans array<struct<file: string, low: int, high: int>>"


def plain_fold(rows):
    """One review after the other, one finding after the other."""
    out = {}
    for review in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == review]
        rank = lambda r: (collector.SEVERITIES.index(r[2]), -len(r[5] or []), not r[3], r[1])
        mine.sort(key=rank)
        spans = {r[1]: list(r[5] or []) for r in mine}
        main = {}
        for i, p in enumerate(mine):
            if p[1] in main:
                continue
            main[p[1]] = None
            for o in mine[i + 1 :]:
                if o[1] in main:
                    continue
                a, b = set(p[4] or []), set(o[4] or [])
                if not a & b:
                    continue
                like = len(a & b) / len(a | b)
                near = any(x[0] == y[0] and x[1] <= y[2] + 5 and y[1] <= x[2] + 5 for x in spans[p[1]] for y in o[5] or [])
                same = bool({x[0] for x in spans[p[1]]} & {x[0] for x in o[5] or []})
                if like >= 0.7 or (like >= 0.15 or bool(a & b & set(collector.ANCHOR_TERMS)) if near else same and like >= 0.34):
                    main[o[1]] = p[1]
                    spans[p[1]] += o[5] or []
        out |= {(review, i): m for i, m in main.items()}
    return out


def made_findings(seed, reviews, each, words, files):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + list(collector.ANCHOR_TERMS)[:2]
    rows = []
    for r in range(reviews):
        for i in range(each):
            spans = [(f"f{rng.randrange(files)}", low := rng.randrange(200), low + rng.randrange(20)) for _ in range(rng.randrange(4))]
            rows.append((f"r{r}", f"F-{i}", rng.choice(collector.SEVERITIES), rng.random() < 0.5, [rng.choice(vocabulary) for _ in range(rng.randrange(1, 6))], spans))
    return rows


@pytest.mark.parametrize("seed,reviews,each,words,files", [(1, 3, 40, 12, 4), (2, 1, 600, 60, 15), (3, 8, 25, 4, 2)])
def test_fold_equals_sequential_fold(spark, seed, reviews, each, words, files):
    rows = made_findings(seed, reviews, each, words, files)
    got = {(r["review"], r["id"]): r["duplicate_of"] for r in collector.fold_duplicates(spark.createDataFrame(rows, FINDING)).collect()}
    want = plain_fold(rows)
    assert got == want and sum(m is not None for m in want.values()) > 10


def test_fold_of_nothing(spark):
    assert collector.fold_duplicates(spark.createDataFrame([], FINDING)).collect() == []
    alone = [("r", "a", "High", True, None, None), ("r", "b", "Unheard", None, [], [])]
    assert {(r["id"], r["duplicate_of"]) for r in collector.fold_duplicates(spark.createDataFrame(alone, FINDING)).collect()} == {("a", None), ("b", None)}


# ---- upkeep


def module(rng, names, n):
    picks = rng.sample(names, min(len(names), rng.randrange(4)))
    lines = [f"from pkg import {p}" if rng.random() < 0.5 else f"import pkg.{p}" if rng.random() < 0.5 else f"from . import {p}" for p in picks]
    return "\n".join(lines) + f"\ndef f{n}():\n    return {rng.random()}\n"


def test_store_equals_a_whole_run_and_parses_what_changed(spark):
    rng = random.Random(4)
    names = [f"m{i}" for i in range(60)]
    tree = {f"pkg/{n}.py": module(rng, names, n) for n in names[:50]} | {"pkg/__init__.py": "", "pkg/null.py": None}
    frame = lambda: spark.createDataFrame(list(tree.items()), "path string, text string")
    store = increments.Store(spark, f"{work_folder(spark)}/test-store-{rng.random()}", python_ast.nodes)
    version, change = store.update(frame())
    assert version == 1 and change.parsed.count() == len(tree) and change.gone.count() == 0
    edges = written(python_ast.import_edges(store.rows(1), store.files(1)))
    roots = spark.createDataFrame([("pkg/m0.py",), ("pkg/m1.py",)], "node string")
    seen = written(reachable(edges, roots).select("node"))
    for turn in range(3):
        before = store.files(version).select("path")
        for path in rng.sample(sorted(p for p in tree if "/m" in p and p not in ("pkg/m0.py", "pkg/m1.py")), 4):
            if rng.random() < 0.4:
                del tree[path]
            else:
                tree[path] = module(rng, names, path)
        tree[f"pkg/m{50 + turn}.py"] = module(rng, names, turn)
        version, change = store.update(frame())
        rows = written(store.rows(version))
        whole = python_ast.nodes(frame())
        key = lambda df: sorted(map(str, df.collect()))
        assert key(rows) == key(whole) and change.parsed.count() <= 5
        edges, lost, gained = increments.updated_edges(edges, change, rows, before)
        edges = written(edges)
        want = python_ast.import_edges(whole, frame())
        assert key(edges.select("src", "dst")) == key(want.select("src", "dst"))
        seen = written(increments.updated_reach(seen, edges, written(lost), written(gained), roots, roots))
        assert key(seen) == key(reachable(want, roots).select("node"))
    assert store.update(frame())[1].parsed.count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_reach_after_changes_equals_reach(spark, seed):
    rng = random.Random(seed)
    nodes = range(40)
    old = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(55)}
    lost = set(rng.sample(sorted(old), 8))
    gained = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(6)} - old
    now = (old - lost) | gained
    frame = lambda e: spark.createDataFrame(sorted(e), "src int, dst int")
    ids = lambda n: spark.createDataFrame([(x,) for x in n], "node int")
    old_roots, roots = [0, 1], [1, 2]
    seen = reachable(frame(old), ids(old_roots)).select("node")
    got = increments.updated_reach(seen, frame(now), frame(lost), frame(gained), ids(roots), ids(old_roots))
    rows = [r["node"] for r in got.collect()]
    assert sorted(rows) == sorted(r["node"] for r in reachable(frame(now), ids(roots)).collect())


def test_fold_keeps_little_on_disk(spark):
    """pairs are places in the order and each table's shuffles go with it; they used to hold both long ids and stay until the end."""
    from pyspark.sql import functions as F

    rows = spark.range(24_000).select(
        (F.col("id") % 4_000).cast("string").alias("review"), F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit("High").alias("severity"), F.lit(True).alias("verified"),
        F.array(F.concat(F.lit("t"), F.col("id") % 5), F.concat(F.lit("u"), F.col("id") % 7)).alias("terms"), F.array(F.struct((F.col("id") % 3).cast("string").alias("file"), (F.col("id") % 50).cast("int").alias("low"), (F.col("id") % 50).cast("int").alias("high"))).alias("spans"),
    )

    def shuffled():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(f.length() for f in (found.apply(i) for i in range(found.size())) if f.getName().startswith("shuffle_"))

    before = shuffled()
    folded = collector.fold_duplicates(rows)
    assert shuffled() - before < 100_000
    assert folded.count() == 24_000 and folded.where("duplicate_of is not null").count() > 0
