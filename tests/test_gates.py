"""Each gate of missing controls open and shut."""

import pytest

from quarry.operators import gates

OPEN = {
    "pii": ("email phone address dob ssn", {}), "scoring": ("def rank_items(x):\n    pass", {"models": 1}), "stateful": ("import redis", {}), "llm": ("x", {"models": 2}),
    "uploads": ("x", {"uploads": 1}), "jobs": ("x", {"model_calls": 1}), "env": ("os.getenv('A')", {}),
}
SHUT = {"pii": ("email phone address dob", {}), "scoring": ("def rank_items(x):\n    pass", {"uploads": 1}), "stateful": ("import os", {}), "llm": (None, {"models": 0}), "uploads": ("upload", {}), "jobs": ("x", {"models": 1}), "env": ("getEnv", {})}


def frames(spark, text, facts):
    return spark.createDataFrame([(text,), ("plain",)], "text string"), spark.createDataFrame(list(facts.items()), "fact string, n long")


@pytest.mark.parametrize("gate", sorted(OPEN))
def test_gate(spark, gate):
    rules = gates.conditions(spark)
    for given, want in ((OPEN[gate], True), (SHUT[gate], False)):
        texts, facts = frames(spark, *given)
        assert (gate in {r["gate"] for r in gates.open_gates(rules, texts, facts).collect()}) == want


def test_missing_controls(spark):
    rules = gates.conditions(spark)
    controls = spark.createDataFrame([("env", "sec", "vault"), ("env", "ops", "dotenv"), ("llm", "llm", "guard"), ("uploads", "in", "scanner")], "gate string, lane string, evidence string")
    code, facts = frames(spark, "os.environ['A']", {"uploads": 1})
    infra = spark.createDataFrame([("uses a scanner",), (None,)], "text string")
    got = lambda *more: sorted(r["lane"] for r in gates.missing_controls(controls, rules, code, facts, *more).collect())
    assert got() == ["in", "ops", "sec"] and got(infra) == ["ops", "sec"]
    assert gates.missing_controls(controls, rules, code.limit(0), facts.limit(0)).collect() == []
