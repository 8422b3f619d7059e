"""Set similarity and what stands on it: few rows meet, and the pairs are those of brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import joins, review


def brute(rows, least):
    found = set()
    for (ka, a, x), (kb, b, y) in itertools.combinations(sorted(rows), 2):
        x, y = set(x), set(y)
        if ka == kb and x & y and len(x & y) / len(x | y) >= least:
            found.add((ka, a, b))
    return found


@pytest.mark.parametrize("least", [0.5, 0.7, 0.9])
def test_similar_sets_equal_brute_force(spark, least):
    """Sizes from 1 to 130, so that one to five terms must be shared by the prefixes."""
    rng = random.Random(7)
    rows = []
    for i in range(60):
        base = rng.sample([f"w{n}" for n in range(220)], rng.choice([1, 2, 5, 12, 39, 40, 41, 80, 119, 120, 130]))
        for _ in range(rng.choice([1, 2, 3])):
            changed = [w for w in base if rng.random() > rng.choice([0, 0.05, 0.2])] + [f"x{len(rows)}"] * rng.randint(0, 1)
            rows.append((i % 2, len(rows), sorted(changed)))
    df = spark.createDataFrame(rows, "lane int, id long, terms array<string>")
    got = {(r.lane, r.a, r.b) for r in joins.similar_sets(df, "id", "terms", least, ("lane",)).collect()}
    want = brute(rows, least)
    assert got == want and len(want) > 5
    assert {(r.a, r.b) for r in joins.similar_sets(df, "id", "terms", least).collect()} == {(a, b) for _, a, b in brute([(0, i, t) for _, i, t in rows], least)}


def test_hypotheses_with_common_words(spark):
    """words that all statements of a lane share made every two of them meet; 40,000 would be 800 million pairs a word."""
    n = 40_000
    words = F.concat(F.lit("queue worker blocks balance writes "), *[x for w in ("alpha", "beta", "gamma", "delta", "omega", "sigma") for x in (F.lit(f" {w}"), F.col("id"))])
    twice = F.when(F.col("id") % 1000 == 999, F.lit("cache entries stay stale after failed commit forever")).otherwise(words)
    stated = spark.range(n).select(F.lit("a").alias("lane"), F.col("id").alias("seq"), twice.alias("statement"), F.array(F.lit("f")).alias("paths"))
    got = review.hypotheses(stated, spark.createDataFrame([("f",)], "path string")).groupBy("fault").count().collect()
    assert {r.fault: r["count"] for r in got} == {None: n - n // 1000 + 1, "repeated": n // 1000 - 1}


def test_hypotheses_repeat_the_first_of_another_set(spark):
    """A set is compared through its first statement: what comes after a like set's first one is repeated, the first one of all is not."""
    same, like, other = "queue worker blocks balance writes twice", "queue worker blocks balance writes", "cache entries stay stale after commit"
    stated = spark.createDataFrame([("a", 1, same), ("a", 2, like), ("a", 3, same), ("a", 4, other), ("a", 5, like), ("a", 6, other), ("b", 1, like), ("b", 2, other)], "lane string, seq long, statement string").withColumn("paths", F.array(F.lit("f")))
    got = {(r.lane, r.seq): r.fault for r in review.hypotheses(stated, spark.createDataFrame([("f",)], "path string"), least=1).collect()}
    assert {k for k, v in got.items() if v == "repeated"} == {("a", 2), ("a", 3), ("a", 5), ("a", 6)} and set(got.values()) == {None, "repeated"}


def test_title_pairs_leave_no_shuffles(spark, tmp_path):
    """once its tables are written, the shuffles that made them are gone; they used to stay until the end."""
    from quarry.plans.catalogue import QUERIES

    rng = random.Random(3)
    texts = [" ".join(rng.sample([f"common{n}" for n in range(300)], 150)) + f" only{i}" for i in range(1500)]
    spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[5], texts[7] + " more"])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    files = lambda: sum(f.length() for f in iter_of(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_"))
    iter_of = lambda seq: [seq.apply(i) for i in range(seq.size())]
    before = files()
    got = sorted((r.a, r.b) for r in QUERIES["title_jaccard_pairs"](spark, str(tmp_path)).collect())
    assert got == [(5, 1500), (7, 1501)]
    assert files() - before < 100_000
