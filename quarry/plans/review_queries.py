"""Named queries over the review operators: the test tables play findings, leads, routes and files; each has its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import predicates as P
from quarry.functions import scalars as S
from quarry.operators import review as R
from quarry.operators import windows
from quarry.plans.catalogue import query, quoted
from quarry.sources.tables import document_files, lines, table

FOLDERS = ["src", "src/tests", "app/migrations", "web/src", "scripts", "src/e2e", ".github/workflows", "ci/jenkins"]
NAMES = ["main.py", "test_api.py", "setup.py", "App.tsx", "conftest.py", "deploy.yml", "Jenkinsfile", "view.spec.ts", "package.json", ".gitlab-ci.yml", "job_test.py"]
KEYS = ["API_TOKEN", "DB_HOST", "SECRET_KEY", "TIMEOUT_SECONDS", "SIGNING_KEY", "TOKEN_TTL"]
DEFAULTS = ["''", "'abcdef'", "<expression>", "'https://example.org/a/long/address/that/goes/on/and/on/for/more/than/eighty/characters/in/all'", None]
CLAIMS = ["the job lock stays set", "a flag in the database", "the cache is cold"]
NOTES = ["finally releases it", "released in except, and a ttl expires it", "not checked, out of time", "the checklist does not mention it", "verified by reading the handler"]
EXPOSURES = ["live", "conditional", "latent", "dead", "theoretical", "unknown"]
VENDORS = [(r"^(mail|post)", "mail"), (r"^src[0-4]$", "low"), (r"^src[5-9]$", "middle"), (r"^src1", "high")]
RULES = [("src/tests/*", False), ("*.py", True), ("web/*", True), ("*/jenkins/*", False), ("*", True)]


def pick(index: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def duck_pick(index: str, values: list) -> str:
    return f"([{', '.join('NULL' if v is None else quoted(v) for v in values)}])[{index} % {len(values)} + 1]"


_FILE = f"({duck_pick('p_partkey', FOLDERS)} || '/' || {duck_pick('p_size', NAMES)})"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumn("path", F.concat(pick(F.col("p_partkey"), FOLDERS), F.lit("/"), pick(F.col("p_size"), NAMES)))


def _has(parts: str, names: list[str]) -> str:
    return f"list_has_any({parts}, [{', '.join(map(quoted, names))}])"


@query(f"""WITH f AS (SELECT p_partkey, p_size, {_FILE} AS path FROM part), g AS (SELECT *, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS name FROM f),
    h AS (SELECT *, parts[:-2] AS folders FROM g)
    SELECT p_partkey, path, {_has('folders', P.TEST_FOLDERS)} OR regexp_matches(name, {quoted(P.TEST_NAME)}) AS mapped_test,
        {_has('folders', [*P.TEST_FOLDERS, '__tests__', 'e2e'])} OR regexp_matches(name, '^test_|_tests?\\.py$|^(conftest|tests?)\\.py$|\\.(test|spec)\\.[jt]sx?$') AS signal_test,
        {_has('parts', P.TOOL_FOLDERS)} OR name IN ({', '.join(map(quoted, P.TOOL_NAMES))}) AS tooling,
        {_has('folders', ['tests', 'test'])} OR regexp_matches(name, {quoted(P.TEST_NAME)}) OR p_partkey % 7 = 0 OR ({_has('folders', ['scripts'])} AND p_partkey % 3 = 0) AS script_or_test,
        regexp_matches(path, {quoted(P.CLIENT_FILE)}) AS client, lower(name) IN ({', '.join(map(quoted, P.PIPELINE_NAMES))}) OR regexp_matches(lower(path), {quoted(P.PIPELINE_PATH)}) AS pipeline FROM h""")
def path_predicates(spark: SparkSession, d: str) -> DataFrame:
    """What a file's path says of it."""
    p = F.col("path")
    return _paths(spark, d).select(
        "p_partkey", "path", P.mapped_test_path(p).alias("mapped_test"), S.test_path(p).alias("signal_test"), P.tooling_path(p).alias("tooling"),
        P.script_or_test(p, F.col("p_partkey") % 7 == 0, F.col("p_partkey") % 3 == 0).alias("script_or_test"), P.client_file(p).alias("client"), P.pipeline_file(p).alias("pipeline"),
    )


@query(f"""WITH e AS (SELECT p_partkey, {duck_pick('p_partkey', KEYS)} AS k, {duck_pick('p_size', DEFAULTS)} AS v, p_partkey % 11 = 0 AS required FROM part)
    SELECT p_partkey, k AS name, CASE WHEN required THEN 'required (raises if missing)' WHEN v IS NULL THEN 'no default (None/undefined)'
        WHEN regexp_matches(k, {quoted(S.SECRET_WORD)}) AND NOT regexp_matches(k, {quoted(S.NOT_SECRET)}) AND v <> '<expression>' THEN CASE WHEN v IN ('''''', '""') THEN 'empty-string default' ELSE 'HARD-CODED DEFAULT (' || (length(v) - 2) || ' chars)' END
        ELSE substring(v, 1, 80) END AS shown FROM e""")
def shown_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Defaults of environment variables as reports show them."""
    rows = table(spark, d, "part").select("p_partkey", pick(F.col("p_partkey"), KEYS).alias("name"), pick(F.col("p_size"), DEFAULTS).alias("v"), (F.col("p_partkey") % 11 == 0).alias("required"))
    return rows.select("p_partkey", "name", P.shown_default(F.col("name"), F.col("v"), F.col("required")).alias("shown"))


@query(f"""WITH t AS (SELECT p_partkey, {duck_pick('p_partkey', CLAIMS)} AS c, {duck_pick('p_size', NOTES)} AS n FROM part)
    SELECT p_partkey, regexp_matches(c, {quoted(P.PERSISTED)}) AND regexp_matches(n, {quoted(P.CLEANUP)}) AND NOT regexp_matches(n, {quoted(P.RECOVERY)}) AS cleanup_only,
        regexp_matches(n, {quoted(P.NON_REASON)}) AS no_reason, regexp_matches(n, {quoted(P.SCOPE_REASON)}) AS scope_reason FROM t""")
def reason_predicates(spark: SparkSession, d: str) -> DataFrame:
    """reasons that are none."""
    rows = table(spark, d, "part").select("p_partkey", pick(F.col("p_partkey"), CLAIMS).alias("c"), pick(F.col("p_size"), NOTES).alias("n"))
    return rows.select("p_partkey", P.cleanup_only(F.col("c"), F.col("n")).alias("cleanup_only"), P.no_reason(F.col("n")).alias("no_reason"), P.scope_reason(F.col("n")).alias("scope_reason"))


@query(f"""SELECT p_partkey, CASE {duck_pick('p_size', EXPOSURES)} {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in P.EXPOSURES.items())} ELSE {duck_pick('p_size', EXPOSURES)} END AS exposure,
    CASE WHEN p_brand = 'Brand#13' AND p_name <> '' THEN string_split(lower(p_name), ' ')[1] ELSE p_type END AS group_key FROM part""")
def exposure_and_group(spark: SparkSession, d: str) -> DataFrame:
    """Labels of exposures; triage groups of advisories."""
    tool = F.when(F.col("p_brand") == "Brand#13", "pip_audit").otherwise("other")
    return table(spark, d, "part").select("p_partkey", P.exposure_label(pick(F.col("p_size"), EXPOSURES)).alias("exposure"), P.advisory_group(tool, F.col("p_type"), F.col("p_name")).alias("group_key"))


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN replace(url, 'http', 'ftp') WHEN 1 THEN regexp_replace(url, '://', '://user:pw@') WHEN 2 THEN regexp_replace(url, '://[^/]*', '://192.168.1.' || (page_id % 200))
        WHEN 3 THEN regexp_replace(url, '://[^/]*', '://-bad_host') ELSE url END AS url FROM pages), h AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host FROM u)
    SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'scheme' WHEN regexp_matches(url, '^https?://[^/]*@') THEN 'credentials' WHEN NOT regexp_matches(host, '^[a-z0-9]([a-z0-9.-]*[a-z0-9])?$') THEN 'host'
        WHEN regexp_matches(host, '^(localhost|.*\.local|.*\.internal|127\..*|10\..*|192\.168\..*|169\.254\..*|0\.0\.0\.0|172\.(1[6-9]|2[0-9]|3[01])\..*)$') THEN 'internal' END AS fault,
        regexp_matches(lower(substring(md5(url), 1, 8) || '-' || substring(md5(url), 9, 4) || '-4000-8000-' || substring(md5(url), 13, CASE WHEN page_id % 2 = 0 THEN 12 ELSE 11 END)), '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') AS is_uuid FROM h""")
def address_checks(spark: SparkSession, d: str) -> DataFrame:
    """addresses and ids that are refused."""
    n, url = F.col("page_id"), F.col("url")
    changed = F.when(n % 6 == 0, F.replace(url, F.lit("http"), F.lit("ftp"))).when(n % 6 == 1, F.regexp_replace(url, "://", "://user:pw@")).when(n % 6 == 2, F.regexp_replace(url, F.lit("://[^/]*"), F.concat(F.lit("://192.168.1."), (n % 200).cast("string")))).when(n % 6 == 3, F.regexp_replace(url, "://[^/]*", "://-bad_host")).otherwise(url)
    h = F.md5("url")
    made = F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4000-8000-"), F.when(n % 2 == 0, F.substring(h, 13, 12)).otherwise(F.substring(h, 13, 11)))
    return table(spark, d, "pages").select("page_id", changed.alias("url")).select("page_id", P.url_fault(F.col("url")).alias("fault"), P.uuid_like(made).alias("is_uuid"))


@query("""WITH s AS (SELECT event_id, CAST(event_id * 37 % 400000 AS BIGINT) AS s FROM events)
    SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS took,
        CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age FROM s""")
def time_labels(spark: SparkSession, d: str) -> DataFrame:
    """durations and ages in words."""
    s = F.col("event_id") * 37 % 400000
    return table(spark, d, "events").select("event_id", P.duration_label(s).alias("took"), P.age_label(s).alias("age"))


@query("""SELECT o_orderkey, sha256(concat_ws(':', o_orderkey::VARCHAR, o_orderstatus, '3')) AS manifest_key, sha256(concat_ws(':', o_orderkey::VARCHAR, o_orderstatus, '3', o_orderpriority, 'm', '1')) AS review_key, sha256(o_orderpriority) AS config_key FROM orders""")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """the keys under which stages are cached."""
    key = F.col("o_orderkey").cast("string")
    return table(spark, d, "orders").select("o_orderkey", S.cache_key(key, F.col("o_orderstatus"), F.lit("3")).alias("manifest_key"), S.cache_key(key, F.col("o_orderstatus"), F.lit("3"), F.col("o_orderpriority"), F.lit("m"), F.lit("1")).alias("review_key"), F.sha2("o_orderpriority", 256).alias("config_key"))


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def list_view(spark: SparkSession, d: str) -> DataFrame:
    """P20: list views read no heavy columns."""
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query("""SELECT o_orderkey, o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND c_mktsegment = 'FURNITURE' AND contains(lower(c_name), '00') AND o_orderstatus IN ('F', 'P')""")
def ui_filters(spark: SparkSession, d: str) -> DataFrame:
    """Severity, category, free text and status at once."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("c_mktsegment") == "FURNITURE") & F.contains(F.lower("c_name"), F.lit("00")) & F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderpriority", "c_mktsegment")


_ROUTE = r"^https?://[^/]+(/[^?#]*)"
_ROUTES = rf"""r AS (SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, regexp_replace(regexp_extract(url, '{_ROUTE}', 1), '[0-9]+$', '{{id}}') AS path, CASE WHEN contains(url, 'utm') THEN ['CAMPAIGN'] ELSE [] END AS flags FROM pages)"""


def _routes(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", _ROUTE, 1), "[0-9]+$", "{id}")
    flags = F.when(F.contains("url", F.lit("utm")), F.array(F.lit("CAMPAIGN"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "pages").select(F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET").alias("method"), path.alias("path"), flags.alias("flags")).distinct()


@query("""SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, url AS path, len(string_split(url, '/')) AS n FROM pages WHERE page_id % 3 = 0 AND contains(lower(url), 'example') ORDER BY path, method LIMIT 20""")
def endpoint_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of the flagged endpoints of one method; the route map is empty, so the discovered ones serve."""
    found = table(spark, d, "pages").select(F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET").alias("method"), F.col("url").alias("path"), F.array(F.lit("x")).alias("flags")).distinct()
    return R.list_endpoints(found.limit(0), found, "Example", "POST", True, 0, 20).select("method", "path", F.size(F.split("path", "/")).cast("long").alias("n"))


@query("""WITH s AS (SELECT 'part' || p_partkey AS id, p_name || '.' || p_type AS qualname, 'function' AS kind FROM part UNION ALL SELECT 'supplier' || s_suppkey, s_name, 'class' FROM supplier),
    c AS (SELECT 'part' || l_partkey AS id, count(DISTINCT l_suppkey) AS callers FROM lineitem GROUP BY 1) SELECT id, qualname, kind, coalesce(callers, 0) AS callers FROM s LEFT JOIN c USING (id) WHERE contains(lower(qualname), 'er')""")
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by a part of their name, with their callers."""
    functions = table(spark, d, "part").select(F.concat(F.lit("part"), "p_partkey").alias("id"), F.concat_ws(".", "p_name", "p_type").alias("qualname"), F.lit("function").alias("kind"))
    classes = table(spark, d, "supplier").select(F.concat(F.lit("supplier"), "s_suppkey"), "s_name", F.lit("class"))
    calls = table(spark, d, "lineitem").select(F.concat(F.lit("part"), "l_partkey").alias("callee"), F.col("l_suppkey").alias("caller"))
    return R.find_symbols(functions.union(classes), calls, "ER")


_SEV = "(['Critical','High','Medium','Low','Low'])[CAST(substring(o_orderpriority, 1, 1) AS INTEGER)]"


def _findings(spark: SparkSession, d: str) -> DataFrame:
    severity = F.element_at(F.array(*map(F.lit, [*S.SEVERITIES, "Low"])), F.substring("o_orderpriority", 1, 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("category"), severity.alias("severity"), "o_custkey", "o_totalprice")


@query(f"""WITH f AS (SELECT o_orderkey AS id, o_orderstatus AS category, {_SEV} AS severity FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)), g AS (SELECT *, CAST(list_position(['Critical','High'], severity) - 1 AS INTEGER) AS rank FROM f WHERE severity IN ('Critical','High'))
    SELECT id, category, severity, CAST(row_number() OVER (PARTITION BY rank ORDER BY category, id) AS INTEGER) AS place FROM g""")
def graver_findings(spark: SparkSession, d: str) -> DataFrame:
    """P5: findings of a severity or graver that are no duplicates."""
    duplicates = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("id")).distinct()
    return R.findings_at_least(_findings(spark, d), duplicates, "High").select("id", "category", "severity", "place")


@query("""WITH o AS (SELECT o_orderstatus AS lane, count(*) AS findings FROM orders GROUP BY 1), k AS (SELECT DISTINCT CASE c_nationkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'O' WHEN 2 THEN 'P' ELSE 'X' END AS lane, c_custkey AS kpi FROM customer),
    g AS (SELECT lane, count(*) AS kpi_gaps FROM k WHERE (lane, kpi) NOT IN (SELECT (o_orderstatus, o_custkey) FROM orders) GROUP BY 1), u AS (SELECT l_returnflag AS lane, count(*) AS untriaged FROM (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1)
    SELECT lane, coalesce(findings, 0) AS findings, coalesce(kpi_gaps, 0) AS kpi_gaps, coalesce(untriaged, 0) AS untriaged FROM o FULL JOIN g USING (lane) FULL JOIN u USING (lane)""")
def lane_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings, unassessed KPIs and untriaged tool findings of each lane."""
    orders = table(spark, d, "orders")
    kpis = table(spark, d, "customer").select(pick(F.col("c_nationkey"), ["F", "O", "P", "X"]).alias("lane"), F.col("c_custkey").alias("kpi")).distinct()
    static = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("lane"), F.col("l_orderkey").alias("id")).distinct()
    return R.lane_counts(orders.select(F.col("o_orderstatus").alias("lane")), kpis, orders.select(F.col("o_orderstatus").alias("lane"), F.col("o_custkey").alias("kpi")), static, orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))


@query(f"SELECT o_orderkey AS id, {_SEV} AS severity FROM orders WHERE o_orderstatus = 'P' AND {_SEV} IN ('Critical', 'High') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def findings_to_verify(spark: SparkSession, d: str) -> DataFrame:
    """Grave findings of a lane without a verdict."""
    judged = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()
    return _findings(spark, d).where("category = 'P' and severity in ('Critical', 'High')").join(judged, "id", "left_anti").select("id", "severity")


_PLACE = "SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey, l_partkey AS file, CAST(l_orderkey % 1000 AS BIGINT) AS line, l_returnflag AS f, l_quantity AS q, l_extendedprice AS e FROM lineitem"


def _places(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_suppkey", F.col("l_partkey").alias("file"), (F.col("l_orderkey") % 1000).alias("line"), F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("q"))


@query(f"""WITH p AS ({_PLACE}), f AS (SELECT id, file, line, q FROM p WHERE f = 'R') SELECT file, count(*) AS findings, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM p AS l WHERE l.f = 'A' AND l.file = f.file AND f.line BETWEEN l.line - 15 AND l.line + 15)
    OR EXISTS (SELECT 1 FROM p AS l WHERE l.f = 'N' AND l.q = 1 AND l.file = f.file) OR EXISTS (SELECT 1 FROM p AS l WHERE l.f = 'N' AND l.q > 40 AND l.file = f.file AND f.line BETWEEN l.line - 2 AND l.line + 2) OR q = 50 THEN 1 ELSE 0 END) AS BIGINT) AS backed FROM f GROUP BY 1""")
def lead_backed(spark: SparkSession, d: str) -> DataFrame:
    """Findings near a lead, in a leading file, near a tool's hit, or citing one; counted by file."""
    p = _places(spark, d)
    findings = p.where("f = 'R'").select((F.monotonically_increasing_id()).alias("id"), "file", "line", F.when(F.col("q") == 50, F.array(F.col("id"))).otherwise(F.array().cast("array<bigint>")).alias("static_ids"))
    from quarry.shared import written

    got = R.lead_backed(written(findings), p.where("f = 'A'"), p.where("f = 'N' and q = 1").select("file"), p.where("f = 'N' and q > 40"))
    return got.groupBy("file").agg(F.count("*").alias("findings"), F.count_if("backed").alias("backed"))


@query(f"""WITH p AS ({_PLACE}), f AS (SELECT id, file, line, l_suppkey FROM p WHERE f = 'R' AND q < 10) SELECT l_suppkey AS rule, count(*) AS n FROM f WHERE NOT EXISTS (SELECT 1 FROM p AS s WHERE s.f = 'A' AND s.file = f.file AND f.line BETWEEN s.line - 15 AND s.line + s.q + 15)
    AND l_suppkey NOT IN (SELECT l_suppkey FROM p WHERE e > 104900) GROUP BY 1""")
def unrecorded_positives(spark: SparkSession, d: str) -> DataFrame:
    """Tool findings judged real that no finding cites or names, by rule."""
    from quarry.shared import written

    p = _places(spark, d)
    real = written(p.where("f = 'R' and q < 10").select(F.monotonically_increasing_id().alias("id"), "file", "line", F.col("l_suppkey").alias("rule")))
    spans = p.where("f = 'A'").select("file", F.col("line").alias("low"), (F.col("line") + F.col("q").cast("long")).alias("high"))
    named = table(spark, d, "lineitem").where("l_extendedprice > 104900").select(F.col("l_suppkey").alias("rule"))
    return R.unrecorded(real, spans, named).groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 35))")
def all_unreachable(spark: SparkSession, d: str) -> DataFrame:
    """Groups all of whose files are unreachable."""
    dead = table(spark, d, "part").where("p_size < 35").select(F.col("p_partkey").alias("l_partkey"))
    return R.all_within(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey", dead)


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50) THEN 'kept' ELSE 'fallback' END AS part FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount = 0.1 AND l_quantity = 1)""")
def carved_sets(spark: SparkSession, d: str) -> DataFrame:
    """A set without its carve-outs; what another set claims goes to the fallback."""
    line = table(spark, d, "lineitem")
    out = line.where("l_discount = 0.1 and l_quantity = 1").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    claimed = line.where("l_returnflag = 'R' and l_quantity = 50").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("claimed", F.lit(True))
    return table(spark, d, "supplier").select("s_suppkey").join(out, "s_suppkey", "left_anti").join(claimed, "s_suppkey", "left").select(F.col("s_suppkey").alias("id"), F.when(F.col("claimed"), "fallback").otherwise("kept").alias("part"))


@query("""WITH m AS (SELECT l_orderkey AS id, l_suppkey % 5 AS lane, l_returnflag AS verdict, l_shipdate AS reason, l_partkey * 1000 + l_linenumber AS seq FROM lineitem), o AS (SELECT o_orderkey AS id, o_custkey % 5 AS owner FROM orders),
    r AS (SELECT m.*, row_number() OVER (PARTITION BY id ORDER BY seq DESC, verdict DESC) AS n FROM m JOIN o USING (id) WHERE lane = owner) SELECT id, verdict FROM r WHERE n = 1""")
def last_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """C4: the owner's last verdict on each finding."""
    actions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 5).alias("lane"), F.col("l_returnflag").alias("verdict"), F.lit("").alias("reason"), F.struct(F.col("l_partkey") * 1000 + F.col("l_linenumber"), "l_returnflag").alias("seq"))
    return R.last_verdicts(actions, table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("lane")))[0].select("id", "verdict")


@query("""WITH m AS (SELECT l_orderkey AS review, l_partkey AS id, l_linenumber AS pos FROM lineitem), a AS (SELECT review, CASE WHEN id % 10 = 3 THEN id - 3 ELSE id END AS id, pos FROM m), k AS (SELECT review, id, min(pos) AS pos FROM a WHERE id % 4 <> 1 GROUP BY 1, 2)
    SELECT review, list(id ORDER BY pos, id) AS ids FROM k GROUP BY 1""")
def summary_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of a summary, cleaned."""
    mentioned = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("review"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("at"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return R.summary_ids(mentioned, part.where("id % 4 <> 1"), part.where("id % 10 = 3").select("id", (F.col("id") - 3).alias("primary_id")))


@query("""WITH n AS (SELECT s_nationkey AS lane, s_name AS row, row_number() OVER (ORDER BY s_nationkey, s_name) AS number FROM (SELECT DISTINCT s_nationkey, s_name FROM supplier)),
    k AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY number) AS p FROM n WHERE number % 3 <> 0) SELECT lane, number, row FROM k WHERE p <= 12""")
def negatives_to_audit(spark: SparkSession, d: str) -> DataFrame:
    """Dismissals to audit, twelve a lane, numbered over all lanes."""
    dismissed = table(spark, d, "supplier").select(F.col("s_nationkey").alias("lane"), F.col("s_name").alias("row"))
    audited = R._running(dismissed.distinct()).where("number % 3 = 0").select("lane", "number")
    return R.negatives(dismissed, audited)


@query("""WITH a AS (SELECT p_partkey AS seq, p_size % 25 AS lane, split_part(p_name, ' ', 1) AS needle, CASE p_partkey % 4 WHEN 0 THEN 'out of time' WHEN 1 THEN 'safe, read it' WHEN 2 THEN 'no' ELSE 'checked by reading the handler' END AS reason FROM part),
    l AS (SELECT DISTINCT s_nationkey AS lane, p_type AS label, p_name AS row FROM supplier JOIN part ON s_suppkey = p_partkey), m AS (SELECT l.lane, row, reason, row_number() OVER (PARTITION BY l.lane, row ORDER BY seq DESC) AS n FROM l JOIN a ON l.lane = a.lane AND contains(lower(label || ' ' || row), lower(needle)) WHERE length(trim(reason)) >= 10 AND reason <> 'out of time')
    SELECT lane, row, reason FROM m WHERE n = 1""")
def lead_dismissals(spark: SparkSession, d: str) -> DataFrame:
    """C11: leads that are dismissed for a reason."""
    part = table(spark, d, "part")
    actions = part.select(F.col("p_partkey").alias("seq"), (F.col("p_size") % 25).alias("lane"), F.split("p_name", " ")[0].alias("needle"), pick(F.col("p_partkey"), ["out of time", "safe, read it", "no", "checked by reading the handler"]).alias("reason"))
    leads = table(spark, d, "supplier").join(part, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_nationkey").alias("lane"), F.col("p_type").alias("label"), F.col("p_name").alias("row")).distinct()
    return R.dismissals(actions, leads)


_TERMS = f"list_distinct(list_filter(regexp_extract_all(lower(t), '[a-z][a-z0-9_]{{3,}}'), lambda w: NOT list_contains([{', '.join(map(quoted, S.STOP_WORDS))}], w)))"


@query(f"""WITH h AS (SELECT c_nationkey AS lane, c_custkey AS seq, CASE WHEN c_custkey % 11 = 0 THEN 'it might be so' WHEN c_custkey % 13 = 0 THEN 'lock held forever after worker crash leaves queue blocked' ELSE 'request number ' || c_name || ' writes balance twice under retry storm segment' || c_custkey || ' alpha' || c_custkey || ' beta' || c_custkey || ' gamma' || c_custkey END AS t, c_custkey % 60 AS f FROM customer),
    k AS (SELECT *, {_TERMS} AS terms, count(*) OVER (PARTITION BY lane) AS n FROM h)
    SELECT lane, seq, CASE WHEN regexp_matches(t, '(?i)\\b(may|might|maybe|perhaps|possibly|could)\\b') OR len(terms) < 5 THEN 'vague' WHEN f NOT IN (SELECT p_size FROM part) THEN 'unknown file'
        WHEN EXISTS (SELECT 1 FROM k AS o WHERE o.lane = k.lane AND o.seq < k.seq AND len(list_intersect(o.terms, k.terms)) >= 0.7 * (len(o.terms) + len(k.terms) - len(list_intersect(o.terms, k.terms))) - 1e-9 AND len(list_intersect(o.terms, k.terms)) > 0) THEN 'repeated'
        WHEN n < 6 THEN 'too few' END AS fault FROM k""")
def hypothesis_faults(spark: SparkSession, d: str) -> DataFrame:
    """Hypotheses that are not admitted, and why."""
    key = F.col("c_custkey")
    text = F.when(key % 11 == 0, "it might be so").when(key % 13 == 0, "lock held forever after worker crash leaves queue blocked").otherwise(F.concat(F.lit("request number "), "c_name", F.lit(" writes balance twice under retry storm segment"), key, F.lit(" alpha"), key, F.lit(" beta"), key, F.lit(" gamma"), key))
    stated = table(spark, d, "customer").select(F.col("c_nationkey").alias("lane"), key.alias("seq"), text.alias("statement"), F.array((key % 60).cast("string")).alias("paths"))
    return R.hypotheses(stated, table(spark, d, "part").select(F.col("p_size").cast("string").alias("path")))


@query(f"""WITH t AS (SELECT p_partkey AS id, 'see ' || CASE p_partkey % 3 WHEN 0 THEN '/' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN {duck_pick('p_partkey', FOLDERS)} || '/' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN 'gone_' ELSE '' END || {duck_pick('p_size', NAMES)} || ':' || p_size || ' for it' AS text FROM part),
    f AS (SELECT DISTINCT {_FILE} AS path FROM part WHERE p_size < 30), c AS (SELECT id, regexp_replace(unnest(regexp_extract_all(text, '([\\w./\\-]+\\.[A-Za-z0-9]+):\\d+', 1)), '^/+', '') AS p FROM t)
    SELECT DISTINCT id FROM c WHERE EXISTS (SELECT 1 FROM f WHERE path = p OR ends_with(path, '/' || p))""")
def cites_repository(spark: SparkSession, d: str) -> DataFrame:
    """texts that cite a file of the repository."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("see "), F.when(k % 3 == 0, "/").otherwise(""), F.when(k % 2 == 0, F.concat(pick(k, FOLDERS), F.lit("/"))).otherwise(""), F.when(k % 5 == 0, "gone_").otherwise(""), pick(F.col("p_size"), NAMES), F.lit(":"), F.col("p_size"), F.lit(" for it"))
    return R.cites_repository(table(spark, d, "part").select(k.alias("id"), text.alias("text")), _paths(spark, d).where("p_size < 30").select("path").distinct())


@query(rf"""WITH {_ROUTES}, e AS (SELECT DISTINCT path FROM r), c AS (SELECT DISTINCT '^' || regexp_replace(regexp_replace(path, '/+$', ''), '[{{]id[}}]', '[^/]+') || '/?$' AS pat FROM r WHERE method = 'POST')
    SELECT path FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE regexp_matches(replace(e.path, '{{id}}', 'x'), c.pat))""")
def routes_without_client(spark: SparkSession, d: str) -> DataFrame:
    """Routes that no call matches."""
    routes = _routes(spark, d)
    return R.routes_without_client(routes.select("path").distinct(), routes.where("method = 'POST'").select("path").distinct())


@query("""WITH r AS (SELECT DISTINCT '/' || lower(p_type) || '/' || split_part(p_name, ' ', 2) || '/{id}' AS path FROM part), b AS (SELECT path, regexp_replace(path, '/[{]id[}]', '') AS bare FROM r),
    w AS (SELECT p_partkey AS document, 'see http://h/v1/' || lower(p_type) || '/' || split_part(p_name, ' ', 2) || CASE WHEN p_size % 2 = 0 THEN '/7' ELSE '' END || ' or not' AS text FROM part WHERE p_size < 9)
    SELECT path, min(document) AS document FROM b JOIN w ON contains(text, bare || '/') OR contains(text, bare || ' ') GROUP BY 1""")
def documented_routes(spark: SparkSession, d: str) -> DataFrame:
    """The first document that names a route."""
    part = table(spark, d, "part").withColumn("tail", F.concat_ws("/", F.lower("p_type"), F.split("p_name", " ")[1]))
    docs = part.where("p_size < 9").select(F.col("p_partkey").alias("document"), F.concat(F.lit("see http://h/v1/"), "tail", F.when(F.col("p_size") % 2 == 0, "/7").otherwise(""), F.lit(" or not")).alias("text"))
    return R.documented_routes(part.select(F.concat(F.lit("/"), "tail", F.lit("/{id}")).alias("path")).distinct(), docs)


@query("""WITH n AS (SELECT p_partkey AS id, p_name AS name, p_brand AS file, 'Brand#' || (p_size % 5 + 1) || '1' AS hint FROM part WHERE p_size % 2 = 0), q AS (SELECT p_name AS name, p_brand AS place, min(p_partkey) AS line FROM part WHERE p_size % 2 = 1 GROUP BY 1, 2)
    SELECT id, place, tier FROM (SELECT id, place, CASE WHEN place = file THEN 0 WHEN place = hint THEN 1 ELSE 2 END AS tier, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN place = file THEN 0 WHEN place = hint THEN 1 ELSE 2 END, place NULLS FIRST, line) AS r FROM n LEFT JOIN q USING (name)) WHERE r = 1""")
def handler_resolution(spark: SparkSession, d: str) -> DataFrame:
    """What a handler's name means: near, hinted, or first."""
    part = table(spark, d, "part")
    names = part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.concat(F.lit("Brand#"), F.col("p_size") % 5 + 1, F.lit("1")).alias("hint"))
    defined = part.where("p_size % 2 = 1").groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("file")).agg(F.min("p_partkey").alias("line"))
    return R.resolve_handlers(names, defined).select("id", F.col("at").alias("place"), "tier")


_CLASS = "c AS (SELECT DISTINCT l_partkey % 40 AS owner, l_suppkey AS caller, (l_suppkey * 7 + l_linenumber) % (SELECT count(*) FROM supplier) AS callee FROM lineitem)"


@query(f"""WITH RECURSIVE {_CLASS}, t AS (SELECT DISTINCT owner, callee AS name FROM c WHERE callee % 9 = 0 UNION SELECT c.owner, c.caller FROM t JOIN c ON c.owner = t.owner AND c.callee = t.name) SELECT owner, name FROM t""")
def transitive_users(spark: SparkSession, d: str) -> DataFrame:
    """Methods that use an identity through others of their class."""
    n = table(spark, d, "supplier").agg(F.count("*").alias("n"))
    calls = table(spark, d, "lineitem").join(F.broadcast(n)).select((F.col("l_partkey") % 40).alias("owner"), F.col("l_suppkey").alias("caller"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % F.col("n")).alias("callee")).distinct()
    from quarry.shared import written

    calls = written(calls)
    return R.transitive_users(calls, calls.where("callee % 9 = 0").select("owner", F.col("callee").alias("name")))


@query("""WITH RECURSIVE c AS (SELECT DISTINCT l_suppkey AS caller, (l_suppkey * 3 + l_linenumber) % (SELECT count(*) FROM supplier) AS callee FROM lineitem), w AS (SELECT (SELECT min(s_suppkey) FROM supplier) AS name, 0 AS round UNION SELECT caller, round + 1 FROM w JOIN c ON callee = name WHERE round < 30 AND caller % 5 <> 4)
    SELECT name, CAST(min(round) AS INTEGER) AS round FROM w GROUP BY 1""")
def witnessed_reach(spark: SparkSession, d: str) -> DataFrame:
    """Names that reach a seed, nearest first, past no blocked name."""
    from quarry.shared import written

    n = table(spark, d, "supplier").agg(F.count("*").alias("n"))
    calls = written(table(spark, d, "lineitem").join(F.broadcast(n)).select(F.col("l_suppkey").alias("caller"), ((F.col("l_suppkey") * 3 + F.col("l_linenumber")) % F.col("n")).alias("callee")).distinct())
    seeds = table(spark, d, "supplier").agg(F.min("s_suppkey").alias("name")).withColumn("witness", F.lit("w"))
    blocked = table(spark, d, "supplier").where("s_suppkey % 5 = 4").select(F.col("s_suppkey").alias("name"))
    return R.witnessed_reach(calls, seeds, blocked).select("name", "round")


@query("SELECT l_partkey AS file, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS imported_by FROM lineitem GROUP BY 1")
def imported_by(spark: SparkSession, d: str) -> DataFrame:
    """Reverse adjacency."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("file")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("imported_by"))


@query(f"""WITH f AS (SELECT {_FILE} AS path FROM part) SELECT array_to_string(string_split(path, '/')[1:2], '/') AS layer, count(*) AS n FROM f GROUP BY 1""")
def layers(spark: SparkSession, d: str) -> DataFrame:
    """Files by the first two parts of their path."""
    return _paths(spark, d).groupBy(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("layer")).agg(F.count("*").alias("n"))


@query("""SELECT count(DISTINCT l_partkey) AS functions, count(DISTINCT l_suppkey) AS files, count(*) AS calls, count(*) FILTER (l_returnflag = 'R') AS resolved, count(*) FILTER (l_returnflag = 'A') AS ambiguous, count(*) FILTER (l_returnflag = 'N') AS external FROM lineitem""")
def graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    """A3: sizes of the graph and outcomes of its calls."""
    f = F.col("l_returnflag")
    return table(spark, d, "lineitem").agg(F.countDistinct("l_partkey").alias("functions"), F.countDistinct("l_suppkey").alias("files"), F.count("*").alias("calls"), F.count_if(f == "R").alias("resolved"), F.count_if(f == "A").alias("ambiguous"), F.count_if(f == "N").alias("external"))


@query(rf"""WITH {_ROUTES}, s AS (SELECT '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT starts_with(x, '{{'))[1:3], '/') AS prefix, method, flags FROM r)
    SELECT prefix, count(*) AS routes, count(*) FILTER (method = 'GET') AS n_get, count(*) FILTER (method = 'POST') AS n_post, count(*) FILTER (len(flags) > 0) AS n_flagged FROM s GROUP BY 1""")
def api_surface(spark: SparkSession, d: str) -> DataFrame:
    """Routes by the first three fixed segments of their path."""
    fixed = F.filter(F.split("path", "/"), lambda x: (x != "") & ~F.startswith(x, F.lit("{")))
    return _routes(spark, d).groupBy(F.concat(F.lit("/"), F.array_join(F.slice(fixed, 1, 3), "/")).alias("prefix")).agg(F.count("*").alias("routes"), F.count_if(F.col("method") == "GET").alias("n_get"), F.count_if(F.col("method") == "POST").alias("n_post"), F.count_if(F.size("flags") > 0).alias("n_flagged"))


@query(f"""SELECT count(*) AS findings, {', '.join(f"count(*) FILTER ({_SEV} = '{s}') AS n_{s.lower()}" for s in S.SEVERITIES)}, count(DISTINCT o_custkey) AS repositories, count(*) FILTER (o_orderstatus = 'F') AS finished, count(DISTINCT o_orderstatus) AS lanes, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders""")
def review_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The counters of a review."""
    rows = _findings(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate"), "id")
    return rows.agg(F.count("*").alias("findings"), *[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in S.SEVERITIES], F.countDistinct("o_custkey").alias("repositories"), F.count_if(F.col("category") == "F").alias("finished"), F.countDistinct("category").alias("lanes"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("SELECT coalesce(role, 'all') AS agent, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY GROUPING SETS ((role), ())")
def usage_sums(spark: SparkSession, d: str) -> DataFrame:
    """Calls and characters of each agent and in all."""
    return table(spark, d, "conversations").rollup("role").agg(F.count("*").alias("calls"), F.sum(F.length("text")).alias("characters")).select(F.coalesce("role", F.lit("all")).alias("agent"), "calls", "characters")


@query("""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT source, doc_id, count(*) AS n FROM l WHERE regexp_matches(line, '!!') GROUP BY 1, 2) SELECT source, doc_id, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, doc_id) AS INTEGER) AS rank FROM c""")
def print_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a kind by file, most first."""
    hits = lines(document_files(spark, d), carry=("source", "doc_id")).where(F.col("line").rlike("!!")).groupBy("source", "doc_id").agg(F.count("*").alias("n"))
    return windows.numbered(hits, ["source"], [F.desc("n"), F.col("doc_id")], "rank").withColumn("rank", F.col("rank").cast("int"))


@query("""WITH x AS (SELECT source, CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), g AS (SELECT source, count(*) AS modules, CAST(sum(n) AS BIGINT) AS lines FROM x GROUP BY 1)
    SELECT *, CAST(row_number() OVER (ORDER BY lines DESC, source) AS INTEGER) AS rank FROM g""")
def dead_code_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Unreachable modules and their lines by folder, largest first."""
    dead = document_files(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    by_folder = dead.groupBy("source").agg(F.count("*").alias("modules"), F.sum(S.line_count(F.col("text"))).alias("lines"))
    return windows.numbered(by_folder.withColumn("all", F.lit(0)), ["all"], [F.desc("lines"), F.col("source")], "rank").select("source", "modules", "lines", F.col("rank").cast("int").alias("rank"))


@query(r"SELECT source, count(*) AS n FROM documents WHERE lang = 'en' AND regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') GROUP BY 1")
def personal_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with personal data by folder."""
    return document_files(spark, d).where((F.col("language") == "en") & F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")).groupBy("source").agg(F.count("*").alias("n"))


@query(f"""WITH v AS (SELECT doc_id AS file, CASE {' '.join(f"WHEN regexp_matches(source, {quoted(p)}) THEN {quoted(v)}" for p, v in VENDORS)} END AS vendor FROM documents) SELECT vendor, min(file) AS first_file, count(DISTINCT file) AS n_files FROM v WHERE vendor IS NOT NULL GROUP BY 1""")
def processor_usage(spark: SparkSession, d: str) -> DataFrame:
    """Third parties that files use."""
    return R.processors(table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("source").alias("module")), VENDORS)


@query("""WITH e AS (SELECT source AS name, bool_or(contains(text, 'MIT License')) AS a, bool_or(contains(text, '@')) AS b, bool_or(contains(text, 'Apache')) AS c FROM documents GROUP BY 1), s AS (SELECT name, a::INTEGER + b::INTEGER + 2 * c::INTEGER AS score FROM e)
    SELECT name, score, CASE WHEN score >= 4 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS confidence, score >= 4 AS is_primary FROM s WHERE score > 0""")
def framework_scores(spark: SparkSession, d: str) -> DataFrame:
    """Evidence for frameworks, scored."""
    has = lambda t: F.contains("text", F.lit(t))
    return R.framework_scores(table(spark, d, "documents").select(F.col("source").alias("name"), has("MIT License").alias("dependency"), has("@").alias("imported"), has("Apache").alias("pattern")))


@query("""WITH g AS (SELECT l_returnflag AS tool, l_linestatus AS reason, l_suppkey AS rule, count(*) AS n, min(l_orderkey) AS first_id FROM lineitem GROUP BY 1, 2, 3) SELECT tool, reason, rule, n, first_id FROM g ORDER BY n DESC, tool, reason, rule LIMIT 25""")
def dismissed_groups(spark: SparkSession, d: str) -> DataFrame:
    """The 25 largest groups of dismissed findings."""
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("tool"), F.col("l_linestatus").alias("reason"), F.col("l_suppkey").alias("rule")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_id")).orderBy(F.desc("n"), "tool", "reason", "rule").limit(25)


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus = 'F') SELECT {', '.join(f"count(*) FILTER ({_SEV} = '{s}') AS n_{s.lower()}" for s in S.SEVERITIES)}, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS running FROM l WHERE r = 1""")
def dashboard_totals(spark: SparkSession, d: str) -> DataFrame:
    """Severities over the latest finished review of every repository, and how many run."""
    orders = table(spark, d, "orders")
    latest = windows.latest_by(orders.where("o_orderstatus = 'F'"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey"]).select(F.col("o_orderkey").alias("id"))
    sums = _findings(spark, d).join(latest, "id", "left_semi").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in S.SEVERITIES])
    return sums.join(F.broadcast(orders.where("o_orderstatus = 'O'").agg(F.count("*").alias("running"))))  # one row each


@query("SELECT o_orderpriority AS status, count(*) AS n FROM orders GROUP BY 1")
def kpi_tally(spark: SparkSession, d: str) -> DataFrame:
    """KPIs by status."""
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("status")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT doc_id, regexp_extract_all(text, '(?m)^([A-Za-z]+)', 1) AS ws, text FROM documents), u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s), d AS (SELECT doc_id, w, min(i) AS i FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM d),
    l AS (SELECT doc_id, list(w ORDER BY i) AS stages FROM r WHERE n <= 15 GROUP BY 1) SELECT s.doc_id, coalesce(stages, []) AS stages, regexp_matches(text, '(?i)license') AS tested, regexp_matches(text, '!!') AS scanned FROM s LEFT JOIN l ON s.doc_id = l.doc_id""")
def pipeline_facts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct stages in order, fifteen at most, and which checks there are."""
    stages = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit("(?m)^([A-Za-z]+)"), F.lit(1))), 1, 15)
    return table(spark, d, "documents").select("doc_id", stages.alias("stages"), F.col("text").rlike("(?i)license").alias("tested"), F.col("text").rlike("!!").alias("scanned"))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus = 'F') SELECT p.o_orderkey AS id, p.o_custkey AS key, c.o_orderkey AS from_id, c.o_totalprice AS result, CASE WHEN c.o_orderkey IS NULL THEN 'pending' ELSE 'completed' END AS status FROM orders AS p LEFT JOIN c ON p.o_custkey = c.o_custkey AND c.r = 1 WHERE p.o_orderstatus = 'O'""")
def cached_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Polled reviews with the newest finished result of their key."""
    orders = table(spark, d, "orders")
    done = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("result"), F.col("o_orderdate").alias("finished"))
    return R.cached_result(orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key")), done).select("id", "key", "from_id", "result", "status")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 1) UNION ALL SELECT c_custkey + (SELECT max(o_orderkey) + 1 FROM orders), c_custkey, 'new' FROM customer""")
def get_and_create(spark: SparkSession, d: str) -> DataFrame:
    """Rows of given keys, and new rows appended."""
    orders, most = table(spark, d, "orders"), table(spark, d, "orders").agg((F.max("o_orderkey") + 1).alias("next"))
    asked = table(spark, d, "lineitem").where("l_quantity = 1").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    made = table(spark, d, "customer").join(F.broadcast(most)).select((F.col("c_custkey") + F.col("next")).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.lit("new").alias("o_orderstatus"))
    return orders.join(asked, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey", "o_orderstatus").unionByName(made)


@query(f"""SELECT p_partkey, {_FILE} AS path, CASE WHEN regexp_matches({_FILE}, '^src/tests/.*$') THEN false WHEN regexp_matches({_FILE}, '^.*\\.py$') THEN true WHEN regexp_matches({_FILE}, '^web/.*$') THEN true WHEN regexp_matches({_FILE}, '^.*/jenkins/.*$') THEN false ELSE true END AS allowed FROM part""")
def read_permissions(spark: SparkSession, d: str) -> DataFrame:
    """What may be read, by the first rule that fits."""
    return R.allowed(_paths(spark, d).select("p_partkey", "path"), RULES)


@query(r"""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\w{9,}')) AS name FROM benchmark), u AS (SELECT unnest(regexp_extract_all(regexp_replace(text, '(?m)#.*$', '', 'g'), '\w+')) AS name FROM documents), c AS (SELECT name, count(*) AS uses FROM u GROUP BY 1)
    SELECT n.name, coalesce(uses, 0) AS uses FROM n LEFT JOIN c USING (name) WHERE coalesce(uses, 0) <= 1""")
def unwired_controls(spark: SparkSession, d: str) -> DataFrame:
    """Names that are defined but used nowhere."""
    names = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\w{9,}"), F.lit(0))).alias("name")).distinct()
    return R.unwired(names, table(spark, d, "documents"))


@query(r"""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\w{9,}')) AS name FROM benchmark), u AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\w+')) AS name FROM conversations) SELECT name FROM n WHERE name NOT IN (SELECT name FROM u)""")
def tables_without_migration(spark: SparkSession, d: str) -> DataFrame:
    """Names that no migration holds."""
    names = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\w{9,}"), F.lit(0))).alias("name")).distinct()
    return R.without_migration(names, table(spark, d, "conversations"), F.contains("text", F.lit("create_all(")))


@query("""SELECT DISTINCT o_orderkey AS route, c_name AS model, n_name AS field FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE regexp_matches(n_name, '_(1|2)[0-9]?$')""")
def response_fields(spark: SparkSession, d: str) -> DataFrame:
    """Sensitive fields of the models that routes return."""
    fields = table(spark, d, "nation").where(F.col("n_name").rlike("_(1|2)[0-9]?$"))
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(fields, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_orderkey").alias("route"), F.col("c_name").alias("model"), F.col("n_name").alias("field")).distinct()


@query("SELECT DISTINCT a.l_suppkey AS starter, a.l_partkey AS started FROM lineitem AS a WHERE l_returnflag = 'A' AND l_partkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def executor_nesting(spark: SparkSession, d: str) -> DataFrame:
    """Functions started on an executor that start another."""
    line = table(spark, d, "lineitem")
    starters = line.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("started")).distinct()
    return line.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("starter"), F.col("l_partkey").alias("started")).distinct().join(starters, "started", "left_semi")


@query("SELECT l_orderkey AS handler FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag IN ('N', 'A')) AND NOT bool_or(l_linestatus = 'O')")
def static_health(spark: SparkSession, d: str) -> DataFrame:
    """Handlers that await nothing and call only what builds a response."""
    called = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("handler")).agg(F.collect_set("l_returnflag").alias("callees"), F.bool_or(F.col("l_linestatus") == "O").alias("awaits"))
    return called.where((F.size(F.array_except("callees", F.array(F.lit("N"), F.lit("A")))) == 0) & ~F.col("awaits")).select("handler")


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS path FROM pages) SELECT page_id, path, count(*) AS n FROM l WHERE NOT regexp_matches(path, '^/(the|and|login|public)') GROUP BY 1, 2""")
def unguarded_client_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes in client code that nothing guards."""
    found = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1))).alias("path"))
    return found.where(~F.col("path").rlike("^/(the|and|login|public)")).groupBy("page_id", "path").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT DISTINCT source AS folder FROM documents), p AS (SELECT source AS folder, list(DISTINCT lang) AS have FROM documents WHERE n_chars > 3000 GROUP BY 1), m AS (SELECT folder, list_sort(list_filter(['de', 'en', 'es', 'fr', 'it'], lambda x: NOT list_contains(coalesce(have, []), x))) AS missing FROM f LEFT JOIN p USING (folder)) SELECT folder, missing FROM m WHERE len(missing) > 0""")
def ignore_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Build folders whose ignore file lacks entries, or that have none."""
    docs = table(spark, d, "documents")
    have = docs.where("n_chars > 3000").groupBy(F.col("source").alias("folder")).agg(F.collect_set("lang").alias("have"))
    missing = F.array_except(F.array(*map(F.lit, ["de", "en", "es", "fr", "it"])), F.coalesce("have", F.array().cast("array<string>")))
    return docs.select(F.col("source").alias("folder")).distinct().join(have, "folder", "left").select("folder", F.array_sort(missing).alias("missing")).where(F.size("missing") > 0)


@query("""WITH t AS (SELECT item_id, text AS t FROM benchmark), k AS (SELECT item_id, """ + _TERMS + """ AS w FROM t) SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w)) >= 2 AS same_subject, len(list_intersect(a.w, b.w)) >= 0.7 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AND len(a.w) > 0 AND len(b.w) > 0 AS similar FROM k AS a JOIN k AS b ON b.item_id = a.item_id + 1""")
def subject_predicates(spark: SparkSession, d: str) -> DataFrame:
    """F8: whether neighbouring statements talk of the same, or are nearly the same."""
    terms = table(spark, d, "benchmark").select("item_id", S.title_terms(F.col("text"), 4).alias("w"))
    a, b = terms.select(F.col("item_id").alias("a"), F.col("w").alias("wa")), terms.select(F.col("item_id").alias("b"), F.col("w").alias("wb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", (F.size(F.array_intersect("wa", "wb")) >= 2).alias("same_subject"), ((S.jaccard(F.col("wa"), F.col("wb")) >= 0.7) & (F.size("wa") > 0) & (F.size("wb") > 0)).alias("similar"))


@query("""SELECT n_nationkey AS position, '| ' || n_name || ' | ' || replace(r_name || '|x', '|', '\\|') || ' |' AS line FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT -1, '|---|---|' UNION ALL SELECT -2, '| Nation | Region |'""")
def markdown_table(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a Markdown table with escaped cells."""
    from quarry.plans.report import _cell

    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("position"), F.concat(F.lit("| "), "n_name", F.lit(" | "), _cell(F.concat("r_name", F.lit("|x"))), F.lit(" |")).alias("line"))
    return rows.union(spark.createDataFrame([(-1, "|---|---|"), (-2, "| Nation | Region |")], "position int, line string"))
