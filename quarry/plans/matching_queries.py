"""Queries over operators that match texts and paths by equality joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import containment, review, routes
from quarry.plans.catalogue import query
from quarry.sources.tables import table


@query("""SELECT DISTINCT d.doc_id, b.needle FROM documents AS d JOIN (SELECT DISTINCT substr(text, 20, 60) AS needle FROM benchmark UNION SELECT DISTINCT source FROM documents UNION SELECT 'in') AS b
    ON contains(d.text, b.needle) WHERE length(b.needle) > 0""")
def needles_in_documents(spark, d):
    """Documents that hold a piece of a benchmark passage, the name of a source or a short word."""
    docs = table(spark, d, "documents")
    needles = table(spark, d, "benchmark").select(F.substring("text", 20, 60).alias("needle")).union(docs.select("source").distinct()).union(spark.range(1).select(F.lit("in")))
    return containment.containing(docs, "doc_id", "text", needles, "needle")


_MADE = """r AS (SELECT DISTINCT '/' || replace(lower(p_type), ' ', '/') || CASE WHEN p_size % 3 = 0 THEN '/{id}' WHEN p_size % 3 = 1 THEN '/{id}/parts' ELSE '' END AS path FROM part),
    c AS (SELECT DISTINCT '/' || replace(lower(p_type), ' ', '/') || CASE WHEN p_size % 4 = 0 THEN '/' || p_partkey WHEN p_size % 4 = 1 THEN '/{}/parts' WHEN p_size % 4 = 2 THEN '//' ELSE '' END AS path FROM part WHERE p_partkey % 5 < 2)"""


def _made(spark, d):
    part = table(spark, d, "part")
    stem = F.concat(F.lit("/"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("/")))
    kind = lambda n: F.col("p_size") % n
    served = part.select(F.concat(stem, F.when(kind(3) == 0, "/{id}").when(kind(3) == 1, "/{id}/parts").otherwise("")).alias("path")).distinct()
    called = part.where("p_partkey % 5 < 2").select(F.concat(stem, F.when(kind(4) == 0, F.concat(F.lit("/"), "p_partkey")).when(kind(4) == 1, "/{}/parts").when(kind(4) == 2, "//").otherwise("")).alias("path")).distinct()
    return served, called


@query(rf"""WITH {_MADE}, k AS (SELECT '^' || regexp_replace(regexp_replace(path, '/+$', ''), '[{{][}}]', '[^/]+') || '/?$' AS pat FROM c)
    SELECT path FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE regexp_matches(replace(r.path, '{{id}}', 'x'), k.pat))""")
def uncalled_routes(spark, d):
    """Routes that no call reaches."""
    return review.routes_without_client(*_made(spark, d))


@query(rf"""WITH {_MADE}, k AS (SELECT '^' || regexp_replace(regexp_replace(path, '/+$', ''), '[{{]id[}}]', '[^/]+') || '/?$' AS pat FROM r WHERE NOT starts_with(path, '/promo') UNION ALL SELECT '^/promo/burnished(/.*)?$'),
    f AS (SELECT DISTINCT '/' || split_part(path, '/', 2) AS path FROM r WHERE NOT starts_with(path, '/promo'))
    SELECT path FROM c WHERE path NOT IN (SELECT path FROM f) AND NOT EXISTS (SELECT 1 FROM k WHERE regexp_matches(c.path, k.pat))""")
def unserved_calls(spark, d):
    """Calls that neither a route nor a mount serves."""
    served, called = _made(spark, d)
    mounts = spark.range(1).select(F.lit("/promo/burnished/").alias("path"))
    return routes.unmatched_calls(called, served.where(~F.startswith("path", F.lit("/promo"))), mounts)


_GATES = [("addressed", 1, "@[a-z]+[.]", None, 5), ("licensed", 1, "[Ll]icensed under", None, 1), ("licensed", 1, None, "toxic", 1), ("either", 1, "no such words anywhere", None, 1), ("either", 2, None, "labels", 10), ("never", 1, "no such words anywhere", None, 1), ("never", 1, None, "labels", 1)]
_GUARDS = [("addressed", "masking", "mask_email"), ("addressed", "dots", "[.]"), ("licensed", "notice file", "NOTICE file"), ("either", "ledger", "ledger_of_labels"), ("never", "closed", "also absent")]


@query(f"""WITH n AS (SELECT 'addressed' AS gate, 1 AS alternative, sum(len(regexp_extract_all(text, '@[a-z]+[.]'))) >= 5 AS met FROM documents UNION ALL
    SELECT 'licensed', 1, sum(len(regexp_extract_all(text, '[Ll]icensed under'))) >= 1 AND (SELECT sum(toxic) FROM labels) >= 1 FROM documents UNION ALL
    SELECT 'either', 2, (SELECT count(*) FROM labels) >= 10),
    g AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _GUARDS)}) AS t(gate, control, evidence))
    SELECT gate, control, evidence FROM g WHERE gate IN (SELECT gate FROM n WHERE met) AND NOT EXISTS (SELECT 1 FROM documents WHERE regexp_matches(text, evidence))""")
def gated_controls(spark, d):
    """Controls without evidence in the documents whose gate is open."""
    from quarry.operators import gates

    labels = table(spark, d, "labels")
    facts = labels.agg(F.sum("toxic").cast("long").alias("n")).select(F.lit("toxic").alias("fact"), "n").union(labels.agg(F.count("*").alias("n")).select(F.lit("labels").alias("fact"), "n"))
    controls = spark.createDataFrame(_GUARDS, "gate string, control string, evidence string")
    return gates.missing_controls(controls, gates.conditions(spark, _GATES), table(spark, d, "documents").select("text"), facts).select("gate", "control", "evidence")
