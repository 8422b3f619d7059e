"""Graph and summary queries over whole tables against brute force: every line and every order counts."""

import datetime
import itertools
import random

from quarry.plans.catalogue import QUERIES


def store(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_graphs_over_all_lines(spark, tmp_path):
    links = [(1, 2), (2, 3), (3, 4), (5, 1), (4, 4), (1, 2)]
    store(spark, tmp_path, "supplier", [(i,) for i in range(1, 8)], "s_suppkey long")
    store(spark, tmp_path, "lineitem", [(a, b - 1, 1.0, 0.0, "N", 2) for a, b in links], "l_suppkey long, l_partkey long, l_quantity double, l_discount double, l_returnflag string, l_linenumber int")
    seen = {1}
    while more := {b for a, b in links if a in seen} - seen:
        seen |= more
    assert {r.node for r in QUERIES["reachable_nodes"](spark, str(tmp_path)).collect()} == seen == {1, 2, 3, 4}
    two = set(links) | {(a, d) for (a, b), (c, d) in itertools.product(links, links) if b == c}
    assert sorted(map(tuple, QUERIES["depth2_reach"](spark, str(tmp_path)).collect())) == sorted(two)


def test_summaries_and_cycles_over_all_orders(spark, tmp_path):
    """Old orders count; a customer without orders stays, with nulls."""
    day = datetime.datetime
    orders = [(10, 1, day(1995, 1, 1), "F"), (11, 1, day(1999, 5, 5), "O"), (12, 2, day(1999, 1, 1), "F"), (13, 2, day(2001, 6, 1), "P"), (14, 2, day(2001, 6, 1), "O")]
    store(spark, tmp_path, "customer", [(1, "a", 1), (2, "b", 2), (3, "c", 3)], "c_custkey long, c_name string, c_nationkey int")
    store(spark, tmp_path, "orders", orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderstatus string")
    store(spark, tmp_path, "supplier", [(1, 1), (2, 2)], "s_suppkey long, s_nationkey int")
    store(spark, tmp_path, "lineitem", [(10, 2)] * 14 + [(12, 1)] * 14, "l_orderkey long, l_suppkey long")
    got = QUERIES["repo_summary"](spark, str(tmp_path)).select("c_custkey", "c_name", "n_children", "o_orderkey", "o_orderstatus").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == [(1, "a", 2, 11, "O"), (2, "b", 3, 14, "O"), (3, "c", 0, None, None)]
    assert [tuple(r) for r in QUERIES["layer_cycles"](spark, str(tmp_path)).collect()] == [(1, 2)]


def test_two_steps_in_bands_and_stripes(spark, monkeypatch):
    """paths are marked by task, not made as rows; nulls end a path, and names of any kind are nodes."""
    from quarry.operators import graphs

    monkeypatch.setattr(graphs, "HELD", 40)
    monkeypatch.setattr(graphs, "PASSING", 15)
    rng = random.Random(5)
    links = [(f"n{rng.randrange(40)}", rng.choice([None, *[f"n{i}" for i in range(60)]])) for _ in range(200)] + [("a", None), (None, "a"), ("b", "a")]
    roots = [*[f"n{i}" for i in range(0, 40, 3)], "a", "b", None, "b"]
    want = {(a, b) for a, b in links if a in roots and a} | {(a, d) for (a, b), (c, d) in itertools.product(links, links) if a in roots and a and b is not None and b == c}
    found = graphs.within_two(spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([(r,) for r in roots], "node string"))
    got = list(map(tuple, found.collect()))
    assert len(got) == len(set(got)) and set(got) == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # of edges and roots
