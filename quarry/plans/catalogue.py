"""The named queries: each applies an engine operator to the test tables; ORACLES holds the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import graphs, joins, store, windows
from quarry.sources.tables import document_files, lines, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Rule patterns of the secret scan, alike in Java and RE2.
SECRET_RULES = [
    ("generic-secret-assignment", "critical", r'(token|secret|password|api_key)\s*=\s*"[^"]{8,}"'),
    ("email-address", "low", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("ipv4-address", "info", r"(^|[^0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}([^0-9.]|$)"),
]
CONTROLS = [("rate limiting", "(?i)rate.?limit"), ("idiot filter", "idiot"), ("license notice", "(?i)licensed under"), ("audit log", "(?i)audit.?log"), ("mit", "MIT License")]
LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
SINCE = "2001-01-01"


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _duck_lines(columns: str = "doc_id, source") -> str:
    return f"SELECT {columns}, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"


@query("""SELECT lang AS language, count(*) AS file_count, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes,
    CAST(sum(CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END) AS BIGINT) AS total_lines
    FROM documents GROUP BY 1""")
def lang_totals(spark: SparkSession, d: str) -> DataFrame:
    """A1, A2: files, bytes and lines by language."""
    return document_files(spark, d).groupBy("language").agg(F.count("*").alias("file_count"), F.sum(F.octet_length("text")).alias("total_bytes"), F.sum(S.line_count(F.col("text"))).alias("total_lines"))


@query("""SELECT source, lang, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r
    FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)) WHERE r <= 3""")
def dir_lang_mix_top3(spark: SparkSession, d: str) -> DataFrame:
    """A4, A5: the three commonest languages of each directory."""
    counted = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return windows.numbered(counted, ["source"], [F.desc("n"), F.col("lang")], "rank").where("rank <= 3").select("source", "lang", "n", "rank")


def _secret_findings(spark: SparkSession, d: str) -> DataFrame:
    found = lines(document_files(spark, d), carry=("path",))
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(rule).alias("category"), F.lit(sev).alias("severity"))) for rule, sev, p in SECRET_RULES]))
    rows = found.select("path", "line_no", "line", F.explode(hits).alias("h")).select(F.lit("scan").alias("tool"), F.col("path").alias("file"), F.col("line_no").alias("line"), "h.severity", "h.category", F.substring("line", 1, 200).alias("message"))
    return rows.withColumn("id", S.finding_id(F.col("tool"), F.col("category"), F.col("file"), F.col("line"), F.col("message")))


_SECRET_SQL = f"""WITH l AS ({_duck_lines("source || '/' || doc_id AS file")}), h AS (
    {' UNION ALL '.join(f"SELECT file, CAST(line_no AS INTEGER) AS line, {quoted(sev)} AS severity, {quoted(rule)} AS category, substring(line, 1, 200) AS message FROM l WHERE regexp_matches(line, {quoted(p)})" for rule, sev, p in SECRET_RULES)})
    SELECT 'scan' AS tool, *, substring(sha256('scan|' || category || '|' || file || '|' || line || '|' || message), 1, 16) AS id FROM h"""


@query(_SECRET_SQL)
def scan_secret_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that match a rule, as normalised findings with content ids."""
    return _secret_findings(spark, d)


@query(f"SELECT split_part(file, '/', 1) AS directory, category, severity, count(*) AS findings, count(DISTINCT file) AS files FROM ({_SECRET_SQL}) GROUP BY 1, 2, 3")
def secret_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings and files by directory, rule and severity."""
    found = _secret_findings(spark, d)
    return found.groupBy(F.element_at(F.split("file", "/"), 1).alias("directory"), "category", "severity").agg(F.count("*").alias("findings"), F.countDistinct("file").alias("files"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return secret_counts(spark, d)


@query(f"""WITH l AS ({_duck_lines("doc_id, source")}), f AS (SELECT source AS file, CAST(line_no AS INTEGER) AS line, line AS message, doc_id FROM l UNION ALL SELECT source, NULL, text, doc_id FROM documents),
    i AS (SELECT *, substring(sha256('scan|text|' || file || '|' || coalesce(CAST(line AS VARCHAR), 'None') || '|' || message), 1, 16) AS id FROM f)
    SELECT id, file, line, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id, line) AS r FROM i) WHERE r = 1""")
def finding_ids(spark: SparkSession, d: str) -> DataFrame:
    """Content ids with and without a line; the first occurrence of each stays."""
    docs = table(spark, d, "documents")
    each = lines(docs, carry=("doc_id", "source")).select(F.col("source").alias("file"), F.col("line_no").alias("line"), F.col("line").alias("message"), "doc_id")
    whole = docs.select(F.col("source").alias("file"), F.lit(None).cast("int").alias("line"), F.col("text").alias("message"), "doc_id")
    found = each.unionByName(whole).select(S.finding_id(F.lit("scan"), F.lit("text"), F.col("file"), F.col("line"), F.col("message")).alias("id"), "file", "line", "doc_id")
    return windows.first_by(found, ["id"], [F.col("doc_id"), F.asc_nulls_last("line")])


@query("SELECT sha256(text) AS content_hash, count(*) AS members, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_text_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of equal content."""
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("members"), F.min("doc_id").alias("first_doc")).where("members > 1")


@query(f"SELECT line, count(*) AS places, count(DISTINCT doc_id) AS files FROM ({_duck_lines('doc_id')}) WHERE length(line) > 20 GROUP BY 1 HAVING count(*) > 1")
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that stand at two places or more."""
    return lines(table(spark, d, "documents"), carry=("doc_id",)).where(F.length("line") > 20).groupBy("line").agg(F.count("*").alias("places"), F.countDistinct("doc_id").alias("files")).where("places > 1")


@query("SELECT event_id, event_type AS tool, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE WHEN value >= 75 THEN 'error' WHEN value >= 25 THEN 'warning' ELSE 'info' END AS severity FROM events")
def normalize_props(spark: SparkSession, d: str) -> DataFrame:
    """N1-N10's shape: a JSON payload read with a declared schema."""
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("tool"), F.from_json("props", "k int").k.alias("k"), F.when(F.col("value") >= 75, "error").when(F.col("value") >= 25, "warning").otherwise("info").alias("severity"))


@query("""SELECT event_type AS tool, count(*) AS total, count(*) FILTER (value >= 90) AS critical, count(*) FILTER (value >= 60 AND value < 90) AS high,
    count(*) FILTER (value >= 30 AND value < 60) AS medium, count(*) FILTER (value < 30) AS low FROM events GROUP BY 1""")
def severity_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Conditional counts per tool."""
    v = F.col("value")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("total"), F.count_if(v >= 90).alias("critical"), F.count_if((v >= 60) & (v < 90)).alias("high"), F.count_if((v >= 30) & (v < 60)).alias("medium"), F.count_if(v < 30).alias("low"))


_TRIAGE = "WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1)"


def _triaged(spark: SparkSession, d: str, how: str) -> DataFrame:
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return table(spark, d, "documents").select("doc_id", "source", "lang").join(labels, "doc_id", how)


@query(f"""{_TRIAGE}, g AS (SELECT source, count(*) AS total, count(*) FILTER (q IS NULL) AS untriaged FROM documents LEFT JOIN l USING (doc_id) GROUP BY 1),
    s AS (SELECT source, lang, count(*) AS n FROM documents LEFT JOIN l USING (doc_id) WHERE q IS NULL GROUP BY 1, 2)
    SELECT source, lang, n, total, untriaged FROM s JOIN g USING (source) WHERE untriaged > 0.6 * total""")
def untriaged_allowance(spark: SparkSession, d: str) -> DataFrame:
    """Untriaged groups of the owners that are above their allowance."""
    rows = _triaged(spark, d, "left")
    owners = rows.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("q").isNull()).alias("untriaged")).where(F.col("untriaged") > 0.6 * F.col("total"))
    return rows.where("q is null").groupBy("source", "lang").agg(F.count("*").alias("n")).join(owners, "source")


@query(f"""{_TRIAGE} SELECT coalesce(source, 'unknown') AS tool, count(*) AS total, count(*) FILTER (q = 0) AS true_positive, count(*) FILTER (q = 1) AS low_value,
    count(*) FILTER (q IS NULL) AS untriaged FROM documents FULL JOIN l USING (doc_id) GROUP BY 1""")
def triage_summary(spark: SparkSession, d: str) -> DataFrame:
    """Verdict histogram per tool, tools of either side."""
    q = F.col("q")
    return _triaged(spark, d, "full").groupBy(F.coalesce("source", F.lit("unknown")).alias("tool")).agg(F.count("*").alias("total"), F.count_if(q == 0).alias("true_positive"), F.count_if(q == 1).alias("low_value"), F.count_if(q.isNull()).alias("untriaged"))


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def latest_per_repo(spark: SparkSession, d: str) -> DataFrame:
    """Newest row of each key."""
    return windows.latest_by(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT c_custkey, c_name, coalesce(n, 0) AS n_children, o_orderkey, o_orderstatus FROM customer LEFT JOIN x ON c_custkey = o_custkey AND r = 1""")
def repo_summary(spark: SparkSession, d: str) -> DataFrame:
    """Every repository with its latest review and review count."""
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return store.summaries(table(spark, d, "customer").select("c_custkey", "c_name"), orders, "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("""SELECT o_orderkey, c_name, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation)
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40""")
def owned_reviews_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of what one owner may see, newest first."""
    owner = table(spark, d, "nation").agg(F.min("n_name").alias("n_name"))
    mine = table(spark, d, "customer").join(table(spark, d, "nation").join(F.broadcast(owner), "n_name", "left_semi"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    rows = table(spark, d, "orders").join(mine.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return store.page(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 20).select("o_orderkey", "c_name", "o_orderstatus")


@query(f"""SELECT o_orderkey, CASE WHEN s THEN 'failed' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN s THEN 'interrupted' END AS error
    FROM (SELECT *, o_orderstatus IN ('O', 'P') AND o_orderdate < TIMESTAMP '{SINCE}' AS s FROM orders)""")
def fail_stale(spark: SparkSession, d: str) -> DataFrame:
    """Conditional bulk update."""
    return store.fail_stale(table(spark, d, "orders"), "o_orderstatus", "o_orderdate", F.lit(SINCE).cast("timestamp_ntz"), ["O", "P"], "interrupted").select("o_orderkey", "o_orderstatus", "error")


@query(f"""WITH s AS (SELECT {', '.join(LINE_KEYS)} FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE_KEYS)}) AS r
    FROM lineitem WHERE l_returnflag <> 'R' AND (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM s))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM (SELECT * FROM s UNION ALL SELECT {', '.join(LINE_KEYS)} FROM n WHERE r = 1)""")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """B1: rows of new keys only, the first of each."""
    rows = table(spark, d, "lineitem").select(*LINE_KEYS)
    return store.insert_ignore(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag <> 'R'"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in LINE_KEYS]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")


@query("SELECT l_partkey, count(*) AS fan_in FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def fan_in_topk(spark: SparkSession, d: str) -> DataFrame:
    """K1: most called."""
    return table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct().groupBy("l_partkey").agg(F.count("*").alias("fan_in")).orderBy(F.desc("fan_in"), "l_partkey").limit(20)


@query("SELECT l_suppkey, count(*) AS fan_out FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def fan_out_topk(spark: SparkSession, d: str) -> DataFrame:
    """K1: calling most."""
    return table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct().groupBy("l_suppkey").agg(F.count("*").alias("fan_out")).orderBy(F.desc("fan_out"), "l_suppkey").limit(20)


@query("""WITH n AS (SELECT p_name || '|' || p_brand AS name, count(*) AS candidates, min(p_partkey) AS only_id FROM part GROUP BY 1),
    c AS (SELECT p_partkey AS call_id, p_name || '|' || p_brand AS name FROM part UNION ALL SELECT p_partkey, 'made up ' || p_name FROM part)
    SELECT call_id, name, coalesce(candidates, 0) AS candidates, CASE WHEN candidates IS NULL THEN 'external' WHEN candidates = 1 THEN 'unique' ELSE 'ambiguous' END AS resolution,
    CASE WHEN candidates = 1 THEN only_id END AS resolved_id FROM c LEFT JOIN n USING (name)""")
def unique_name_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Calls resolved where exactly one definition has the name."""
    parts = table(spark, d, "part").select("p_partkey", "p_name", F.concat_ws("|", "p_name", "p_brand").alias("name"))
    calls = parts.select(F.col("p_partkey").alias("call_id"), "name").union(parts.select("p_partkey", F.concat(F.lit("made up "), "p_name")))
    return joins.resolve_names(calls, parts, "name", "p_partkey").select("call_id", "name", "candidates", "resolution", "resolved_id")


def _citations(spark: SparkSession, d: str) -> DataFrame:
    low = F.col("l_orderkey") % 1000
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", low.alias("low"), (low + F.col("l_quantity").cast("long")).alias("high"))


_CITE = "c AS (SELECT *, l_orderkey % 1000 AS low, l_orderkey % 1000 + CAST(l_quantity AS BIGINT) AS high FROM lineitem)"


@query(f"""WITH {_CITE} SELECT p.l_partkey, count(*) AS pairs, count(DISTINCT s.l_orderkey) AS cited FROM c AS p JOIN c AS s ON p.l_partkey = s.l_partkey AND p.low BETWEEN s.low - 15 AND s.high + 15
    WHERE p.l_returnflag = 'R' AND s.l_returnflag = 'A' GROUP BY 1""")
def range_join_spans(spark: SparkSession, d: str) -> DataFrame:
    """Lead lines within 15 lines of a cited span."""
    cited = _citations(spark, d)
    points = cited.where("l_returnflag = 'R'").select("l_partkey", F.col("low").alias("line"))
    spans = cited.where("l_returnflag = 'A'").select("l_partkey", "low", "high", "l_orderkey")
    return joins.near_spans(points, spans, "l_partkey", "line", "low", "high").groupBy("l_partkey").agg(F.count("*").alias("pairs"), F.countDistinct("l_orderkey").alias("cited"))


@query(f"""WITH {_CITE} SELECT l_partkey, l_orderkey, l_linenumber, low FROM c AS p WHERE l_returnflag = 'R' AND NOT EXISTS
    (SELECT 1 FROM c AS s WHERE s.l_returnflag = 'A' AND s.l_partkey = p.l_partkey AND p.low BETWEEN s.low - 15 AND s.high + 15)""")
def unaddressed_leads(spark: SparkSession, d: str) -> DataFrame:
    """Lead lines that no cited span comes near."""
    cited = _citations(spark, d)
    points = cited.where("l_returnflag = 'R'").select("l_partkey", "l_orderkey", "l_linenumber", "low")
    spans = cited.where("l_returnflag = 'A'").select("l_partkey", F.col("low").alias("start"), "high")
    near = joins.near_spans(points.select("l_partkey", "low").distinct(), spans, "l_partkey", "low", "start", "high").select("l_partkey", "low").distinct()
    return points.join(near, ["l_partkey", "low"], "left_anti").select("l_partkey", "l_orderkey", "l_linenumber", "low")


@query(f"""WITH {_CITE}, i AS (SELECT l_partkey, low, high, row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(LINE_KEYS)}) AS r FROM c),
    g AS (SELECT l_partkey, list({{'r': r, 'low': low, 'high': high}}) AS held FROM i GROUP BY l_partkey), x AS (SELECT l_partkey, held, unnest(held) AS a FROM g),
    y AS (SELECT l_partkey, a, unnest(held) AS b FROM x)
    SELECT l_partkey, a.r AS a, b.r AS b FROM y WHERE a.r < b.r AND a.low - 5 <= b.high AND b.low - 5 <= a.high""")
def interval_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of citations of a file that overlap within five lines."""
    rows = table(spark, d, "lineitem").select(*LINE_KEYS)
    low = F.col("l_orderkey") % 1000
    spans = windows.numbered(rows, ["l_partkey"], [F.col(c) for c in LINE_KEYS], "r").select("l_partkey", F.col("r").cast("long").alias("r"), low.alias("low"), (low + F.col("l_quantity").cast("long")).alias("high"))
    return joins.overlapping_pairs(spans, "l_partkey", "r", "low", "high")


@query(f"""WITH t AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_]{{2,}}'), lambda w: NOT list_contains([{', '.join(map(quoted, S.STOP_WORDS))}], w)))) AS terms FROM documents),
    g AS (SELECT min(doc_id) AS doc_id, terms FROM t WHERE len(terms) > 0 GROUP BY terms)
    SELECT first AS a, doc_id AS b, 1.0 AS similarity FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY terms) AS first FROM t WHERE len(terms) > 0) WHERE doc_id <> first UNION ALL
    SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.terms, b.terms)) / (len(a.terms) + len(b.terms) - len(list_intersect(a.terms, b.terms))), 6) AS similarity
    FROM g AS a JOIN g AS b ON a.doc_id < b.doc_id AND least(len(a.terms), len(b.terms)) >= 0.7 * greatest(len(a.terms), len(b.terms)) - 1e-9
    WHERE len(list_intersect(a.terms, b.terms)) / (len(a.terms) + len(b.terms) - len(list_intersect(a.terms, b.terms))) >= 0.7""")
def title_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of texts with similar words, between the first of each group of equal word sets; and of each text of such a group with that first one."""
    from quarry.shared import drop, written

    terms = table(spark, d, "documents").select("doc_id", S.title_terms(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    terms = written(terms.withColumn("digest", joins.set_digest(F.col("terms"))))
    first = written(joins.distinct_sets(terms, "doc_id", "terms"))
    equal = written(terms.select("doc_id", "digest").join(first.where("members > 1").select("digest", F.col("doc_id").alias("a")), "digest").where("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity")))
    drop(terms)
    return joins.similar_sets(first, "doc_id", "terms", 0.7).withColumn("similarity", F.round("similarity", 6)).unionByName(equal)


def _severity(column: str = "o_orderpriority") -> Column:
    return F.element_at(F.array(*map(F.lit, S.SEVERITIES)), F.least(F.substring(column, 1, 1).cast("int"), F.lit(4)))


@query("""WITH s AS (SELECT o_orderkey, least(CAST(substring(o_orderpriority, 1, 1) AS INTEGER), 4) - 1 AS r, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS c FROM orders)
    SELECT o_orderkey, (['Critical','High','Medium','Low','Low'])[r + 1] AS severity, (['Critical','High','Medium','Low','Low'])[greatest(r, c) + 1] AS capped, c > r AS lowered FROM s""")
def severity_caps(spark: SparkSession, d: str) -> DataFrame:
    """Severities lowered to the ceiling of their exposure."""
    from quarry.operators.collector import cap_severity

    rows = table(spark, d, "orders").select("o_orderkey", _severity().alias("severity"), F.when(F.col("o_orderstatus") == "F", "dead").when(F.col("o_orderstatus") == "P", "latent").otherwise("reachable").alias("exposure"))
    return cap_severity(rows).select("o_orderkey", "severity", "capped", "lowered")


@query("""WITH g AS (SELECT l_suppkey, l_partkey, CAST(2 * count(DISTINCT l_returnflag) + least(count(*), 3) AS BIGINT) AS score FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, l_suppkey, l_partkey) AS n FROM g) SELECT l_suppkey, l_partkey, score FROM r WHERE n <= 3 ORDER BY score DESC, l_suppkey, l_partkey LIMIT 15""")
def capped_hotspots(spark: SparkSession, d: str) -> DataFrame:
    """Best scores, three a file at most."""
    scored = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg((2 * F.countDistinct("l_returnflag") + F.least(F.count("*"), F.lit(3))).cast("long").alias("score"))
    return windows.top_with_cap(scored, "l_suppkey", [F.desc("score"), F.col("l_suppkey"), F.col("l_partkey")], 3, 15)


@query(f"SELECT label FROM (VALUES {', '.join(f'({quoted(a)}, {quoted(b)})' for a, b in CONTROLS)}) AS v(label, p) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE regexp_matches(text, p))")
def absent_controls(spark: SparkSession, d: str) -> DataFrame:
    """Controls without evidence anywhere."""
    rules = spark.createDataFrame(CONTROLS, "label string, pattern string")
    return joins.absent(rules, table(spark, d, "documents"), "pattern", "text").select("label")


_PATH = r"^https?://[^/]+(/[^?#]*)"


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '{_PATH}', 1) AS path FROM pages), c AS (SELECT DISTINCT coalesce(nullif(regexp_replace(path, '/+$', ''), ''), '/') AS path FROM p),
    r AS (SELECT DISTINCT '^' || regexp_replace(regexp_replace(path, '/+$', ''), '/[0-9]+$', '/[^/]+') || '/?$' AS pat FROM p WHERE path LIKE '/en/%')
    SELECT path FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE regexp_matches(c.path, pat))""")
def route_match_anti(spark: SparkSession, d: str) -> DataFrame:
    """Called paths that no route serves (routes: the English pages, ids as parameters)."""
    paths = table(spark, d, "pages").select(F.regexp_extract("url", _PATH, 1).alias("path"))
    routes = paths.where(F.startswith("path", F.lit("/en/"))).select(F.regexp_replace(F.regexp_replace("path", r"/+$", ""), r"/[0-9]+$", "/{id}").alias("route"))
    return joins.match_routes(paths.select(S.client_path(F.col("path")).alias("path")).distinct(), routes, "path", "route")


_EDGES = "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS dst FROM lineitem)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    most = table(spark, d, "supplier").agg(F.max("s_suppkey").alias("most"))
    return table(spark, d, "lineitem").join(F.broadcast(most)).select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % F.col("most") + 1).alias("dst")).distinct()


@query(f"WITH RECURSIVE {_EDGES}, t AS (SELECT src AS node FROM e WHERE src = (SELECT min(src) FROM e) UNION SELECT dst FROM t JOIN e ON node = src) SELECT node FROM t")
def reachable_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Everything reached from the roots."""
    from quarry.shared import written

    edges = written(_edges(spark, d))
    return graphs.reachable(edges, edges.agg(F.min("src").alias("node"))).select("node")


@query(f"WITH {_EDGES}, o AS (SELECT DISTINCT src AS root, dst AS node FROM e) SELECT root, node FROM o UNION SELECT root, dst FROM o JOIN e ON node = src")
def depth2_reach(spark: SparkSession, d: str) -> DataFrame:
    """What is at most two edges away."""
    from quarry.shared import written

    edges = written(_edges(spark, d))
    return graphs.within_two(edges, edges.select(F.col("src").alias("node")))


@query("""WITH f AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY 1, 2 HAVING count(*) >= 14) SELECT a.src AS a, a.dst AS b FROM f AS a JOIN f AS b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst""")
def layer_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of layers that depend on each other."""
    flows = (
        table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).count().where("count >= 14")
    )
    return graphs.mutual_pairs(flows)


@query("""SELECT l_partkey, l_suppkey, count(*) AS reads FROM (SELECT l_partkey, l_suppkey, nullif(l_returnflag, 'N') AS v FROM lineitem) GROUP BY 1, 2
    HAVING count(DISTINCT coalesce(v, '<none>')) > 1 AND count(v) > 0""")
def divergent_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Keys read with different defaults, where no default counts as one."""
    value = F.nullif("l_returnflag", F.lit("N"))
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", value.alias("v"))
    return rows.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("reads"), F.size(F.collect_set(F.coalesce("v", F.lit("<none>")))).alias("values"), F.count("v").alias("some")).where("values > 1 and some > 0").select("l_partkey", "l_suppkey", "reads")


@query("""WITH w AS (SELECT user_id, event_type, date_trunc('week', ts) AS week, list_sort(list(DISTINCT value > 50)) AS flags FROM events GROUP BY 1, 2, 3)
    SELECT user_id, event_type, count(*) AS files FROM w GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT flags) > 1""")
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose flag sets differ between files."""
    sets = table(spark, d, "events").groupBy("user_id", "event_type", F.date_trunc("week", "ts").alias("week")).agg(F.array_sort(F.collect_set(F.col("value") > 50)).alias("flags"))
    return sets.groupBy("user_id", "event_type").agg(F.count("*").alias("files"), F.countDistinct("flags").alias("kinds")).where("files > 1 and kinds > 1").select("user_id", "event_type", "files")


@query("""SELECT user_id, event_type AS stage, event_id, value >= 50 AS finished FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def progress_fold(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each stage of a run."""
    last = windows.latest_by(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])
    return last.select("user_id", F.col("event_type").alias("stage"), "event_id", (F.col("value") >= 50).alias("finished"))


@query("SELECT user_id, count(*) AS events FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-29'")
def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs without news since the cut-off."""
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.max("ts").alias("last")).where(F.col("last") < F.lit("2024-01-29").cast("timestamp_ntz")).select("user_id", "events")


@query("SELECT conv_id, turn, used FROM (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations) WHERE used <= 2000")
def char_budget(spark: SparkSession, d: str) -> DataFrame:
    """Turns that fit a character budget."""
    return windows.within_budget(table(spark, d, "conversations"), ["conv_id"], [F.col("turn")], F.length("text"), 2000).select("conv_id", "turn", "used")


@query("SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations")
def growing_history(spark: SparkSession, d: str) -> DataFrame:
    """What is sent again with every turn."""
    return windows.within_budget(table(spark, d, "conversations"), ["conv_id"], [F.col("turn")], F.length("text"), 1 << 62).select("conv_id", "turn", "used")


@query("""SELECT o_custkey, CAST(floor((r - 1) / 8) AS BIGINT) AS batch, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) GROUP BY 1, 2""")
def batching_8(spark: SparkSession, d: str) -> DataFrame:
    """Work in batches of eight."""
    rows = windows.batches(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 8)
    return rows.groupBy("o_custkey", "batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("""SELECT o_orderpriority, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (o_orderpriority, c_mktsegment)""")
def cube_severity_lane(spark: SparkSession, d: str) -> DataFrame:
    """A32 with totals: severity by lane."""
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).cube("o_orderpriority", "c_mktsegment").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CAST(substring(o_orderpriority, 1, 1) AS VARCHAR) || '.' || row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus, o_orderkey) AS section FROM orders""")
def section_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Section numbers by category and order within it. Ranks are counted in parts of a category, shifted by their sums."""
    from quarry.operators.collector import part_numbers

    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    ranked = part_numbers(rows, ["o_orderpriority"], ["o_orderstatus", "o_orderkey"], F.floor(F.col("o_orderkey") / 4096))
    return ranked.select("o_orderkey", F.concat_ws(".", F.substring("o_orderpriority", 1, 1), F.col("number").cast("string")).alias("section"))


@query("""WITH g AS (SELECT DISTINCT l_returnflag AS section, CAST(l_partkey AS VARCHAR) AS item FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY item) AS n, count(*) OVER (PARTITION BY section) AS total FROM g)
    SELECT section, CAST(n AS INTEGER) AS position, item FROM r WHERE n <= 80 UNION ALL SELECT DISTINCT section, 81, '… ' || (total - 80) || ' more' FROM r WHERE total > 80""")
def inventory_caps(spark: SparkSession, d: str) -> DataFrame:
    """Lists of 80 with a remainder row."""
    items = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("section"), F.col("l_partkey").cast("string").alias("item")).distinct()
    return windows.capped_list(items, ["section"], [F.col("item")], 80, "item")


@query("SELECT path, page_id, n > 1 AS duplicate FROM (SELECT page_id, regexp_extract(url, '" + _PATH + "', 1) AS path, count(*) OVER (PARTITION BY regexp_extract(url, '" + _PATH + "', 1)) AS n FROM pages)")
def duplicate_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints that are declared twice."""
    return windows.duplicates_flag(table(spark, d, "pages").select("page_id", F.regexp_extract("url", _PATH, 1).alias("path")), ["path"])


@query(f"""{_TRIAGE}, f AS ({_SECRET_SQL}) SELECT id, file, line, category, severity, coalesce(CASE q WHEN 0 THEN 'true_positive' WHEN 1 THEN 'low_value' END, 'untriaged') AS triage
    FROM f LEFT JOIN l ON CAST(split_part(file, '/', 2) AS BIGINT) = doc_id WHERE regexp_matches(file, '^src1.*$') AND severity IN ('critical', 'low') ORDER BY file, line, category LIMIT 5 OFFSET 5""")
def query_static_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings by glob and severity with their triage state, second page."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    found = _secret_findings(spark, d).where(F.col("file").rlike(S.glob_pattern("src1*")) & F.col("severity").isin("critical", "low")).withColumn("doc_id", F.element_at(F.split("file", "/"), 2).cast("long"))
    state = F.coalesce(F.when(F.col("q") == 0, "true_positive").when(F.col("q") == 1, "low_value"), F.lit("untriaged"))
    return store.page(found.join(labels, "doc_id", "left").withColumn("triage", state), [F.col("file"), F.col("line"), F.col("category")], 2, 5).select("id", "file", "line", "category", "severity", "triage")


@query(f"""SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM ({_duck_lines('doc_id')}) WHERE regexp_matches(line, '\\bidiot\\b')""")
def find_references(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hold an identifier as a whole word."""
    return lines(table(spark, d, "documents"), carry=("doc_id",)).where(F.col("line").rlike(r"\bidiot\b")).select("doc_id", "line_no")


@query("""WITH l AS (SELECT DISTINCT doc_id FROM labels) SELECT source AS directory, count(*) AS files, count(l.doc_id) AS opened, CAST(round_even(100.0 * count(l.doc_id) / count(*), 0) AS INTEGER) AS percent FROM documents d LEFT JOIN l USING (doc_id) GROUP BY 1""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Opened files by directory, half to even."""
    opened = table(spark, d, "labels").select("doc_id").distinct().withColumn("o", F.lit(1))
    return table(spark, d, "documents").join(opened, "doc_id", "left").groupBy(F.col("source").alias("directory")).agg(F.count("*").alias("files"), F.count("o").alias("opened")).withColumn("percent", S.percent(F.col("opened"), F.col("files")))


@query("""SELECT c_custkey, c_name, CASE WHEN n > 0 THEN 'active' END AS state, c_mktsegment FROM (SELECT c_custkey, c_name, count(o_orderkey) AS n, c_mktsegment FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1, 2, 4)""")
def conflict_guard(spark: SparkSession, d: str) -> DataFrame:
    """Repositories that have an active review."""
    active = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("state", F.lit("active"))
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").join(active, "c_custkey", "left")


@query("""SELECT c_custkey, coalesce(n.bal, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS bal FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) AS n ON o_custkey = c_custkey""")
def partial_update(spark: SparkSession, d: str) -> DataFrame:
    """Non-null changes only."""
    changes = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return store.partial_update(table(spark, d, "customer").select("c_custkey", "c_acctbal"), changes, "c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Children of deleted parents go with them."""
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return store.delete_cascade(orders, orders.where("o_orderstatus = 'F'"), "l_orderkey", {"lines": table(spark, d, "lineitem")})["lines"].select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT lang, count(*) FILTER (source = 'src0') AS src0, count(*) FILTER (source = 'src1') AS src1, count(*) FILTER (source = 'src2') AS src2 FROM documents GROUP BY 1""")
def severity_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Pivot over a declared domain."""
    return table(spark, d, "documents").groupBy("lang").pivot("source", ["src0", "src1", "src2"]).agg(F.count(F.lit(1))).na.fill(0, ["src0", "src1", "src2"])


@query("""SELECT lane, path FROM (SELECT DISTINCT 'secrets' AS lane, doc_id AS path FROM documents WHERE text LIKE '%token = "%' UNION SELECT 'licensing', doc_id FROM documents WHERE text LIKE '%License%'
    UNION SELECT 'language', doc_id FROM documents WHERE lang <> 'en') WHERE path IN (SELECT doc_id FROM labels)""")
def lane_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Union of the files that predicates send to each lane, within those in scope."""
    docs = table(spark, d, "documents")
    lanes = F.array_compact(F.array(F.when(F.contains("text", F.lit('token = "')), F.lit("secrets")), F.when(F.contains("text", F.lit("License")), F.lit("licensing")), F.when(F.col("lang") != "en", F.lit("language"))))
    return docs.select(F.explode(lanes).alias("lane"), F.col("doc_id").alias("path")).distinct().join(table(spark, d, "labels").select(F.col("doc_id").alias("path")), "path", "left_semi").select("lane", "path")
