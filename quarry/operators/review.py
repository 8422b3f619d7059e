"""What a review reads and decides, as relations: lists, coverage of leads, verdicts, folds of last writes, and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.predicates import cited_paths
from quarry.functions.scalars import SEVERITIES, rank_of, title_terms
from quarry.operators.containment import containing
from quarry.operators.joins import matching_paths, near_spans, similar_sets
from quarry.operators.windows import first_by, numbered
from quarry.shared import written


def list_endpoints(routes: DataFrame, discovered: DataFrame, contains: str = "", method: str | None = None, flagged_only: bool = False, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the route map (method, path, flags), or of the discovered endpoints where the map is empty, in path order."""
    rows = discovered if routes.isEmpty() else routes
    wanted = F.contains(F.lower("path"), F.lit(contains.lower())) & (F.lit(True) if method is None else F.col("method") == method) & (F.size("flags") > 0 if flagged_only else F.lit(True))
    return rows.where(wanted).orderBy("path", "method").offset(offset).limit(limit)


def find_symbols(symbols: DataFrame, calls: DataFrame, part: str) -> DataFrame:
    """Symbols (id, qualname, kind) whose qualified name holds the part, whatever its case, with the number of distinct callers."""
    callers = calls.groupBy(F.col("callee").alias("id")).agg(F.countDistinct("caller").alias("callers"))
    return symbols.where(F.contains(F.lower("qualname"), F.lit(part.lower()))).join(callers, "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))


def findings_at_least(findings: DataFrame, duplicates: DataFrame, severity: str) -> DataFrame:
    """Findings that are no duplicates, as grave as ``severity`` or graver, with their position by severity, category and id."""
    rank = rank_of(F.col("severity"), SEVERITIES)
    kept = findings.join(duplicates.select("id"), "id", "left_anti").where(rank <= SEVERITIES.index(severity))
    return numbered(kept.withColumn("rank", rank), ["rank"], [F.col("category"), F.col("id")], "place")


def lane_counts(findings: DataFrame, kpis: DataFrame, assessed: DataFrame, static: DataFrame, triaged: DataFrame) -> DataFrame:
    """(lane, findings, kpi_gaps, untriaged): of every lane that any of them names."""
    own = findings.groupBy("lane").agg(F.count("*").alias("findings"))
    gaps = kpis.join(assessed.select("lane", "kpi").distinct(), ["lane", "kpi"], "left_anti").groupBy("lane").agg(F.count("*").alias("kpi_gaps"))
    left = static.join(triaged.select("id").distinct(), "id", "left_anti").groupBy("lane").agg(F.count("*").alias("untriaged"))
    return own.join(gaps, "lane", "full").join(left, "lane", "full").na.fill(0, ["findings", "kpi_gaps", "untriaged"])


def lead_backed(findings: DataFrame, leads: DataFrame, file_leads: DataFrame, static: DataFrame) -> DataFrame:
    """findings (id, file, line, static_ids) with backed: within 15 lines of a lead, in a file that is a lead as a whole, within two
    lines of a tool's hit, or citing a tool's finding."""
    near = near_spans(findings.select("id", "file", "line"), leads.select("file", F.col("line").alias("low"), F.col("line").alias("high")).distinct(), "file", "line", "low", "high", 15).select("id")
    hit = near_spans(findings.select("id", "file", "line"), static.select("file", F.col("line").alias("low"), F.col("line").alias("high")).distinct(), "file", "line", "low", "high", 2).select("id")
    whole = findings.join(file_leads.select("file").distinct(), "file", "left_semi").select("id")
    cited = findings.where(F.size("static_ids") > 0).select("id")
    backed = near.union(hit).union(whole).union(cited).distinct().withColumn("backed", F.lit(True))
    return findings.join(backed, "id", "left").withColumn("backed", F.coalesce("backed", F.lit(False)))


def unrecorded(positives: DataFrame, spans: DataFrame, named: DataFrame) -> DataFrame:
    """Tool findings judged real (id, file, line, rule) that no finding's citation comes within 15 lines of and whose rule no finding names:
    the two conditions are two anti joins."""
    near = near_spans(positives.select("id", "file", "line"), spans, "file", "line", "low", "high", 15).select("id").distinct()
    return positives.join(near, "id", "left_anti").join(named.select("rule").distinct(), "rule", "left_anti")


def all_within(members: DataFrame, group: str, member: str, dead: DataFrame) -> DataFrame:
    """Groups all of whose members are among the dead ones."""
    marked = members.join(dead.select(member).distinct().withColumn("__dead", F.lit(True)), member, "left")
    return marked.groupBy(group).agg(F.bool_and(F.coalesce("__dead", F.lit(False))).alias("all_dead")).where("all_dead").select(group)


def last_verdicts(actions: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, verdict, reason of each finding's last action by its owner; counts of actions on unknown and on foreign findings).
    actions: seq, lane, id, verdict, reason."""
    met = actions.join(owners.select("id", F.col("lane").alias("owner")), "id", "left")
    own = met.where(F.col("owner") == F.col("lane"))
    last = own.groupBy("id").agg(F.max_by(F.struct("verdict", "reason"), "seq").alias("x")).select("id", "x.verdict", "x.reason")
    return last, met.agg(F.count_if(F.col("owner").isNull()).alias("n_unknown"), F.count_if(F.col("owner") != F.col("lane")).alias("n_foreign"))


def summary_ids(mentioned: DataFrame, known: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(review, ids): ids that a summary mentions, in order; duplicates stand for what they repeat, unknown ones go, each counts once."""
    main = mentioned.join(duplicates.select("id", "primary_id"), "id", "left").withColumn("id", F.coalesce("primary_id", "id")).drop("primary_id")
    kept = first_by(main.join(known.select("id"), "id", "left_semi"), ["review", "id"], [F.col("at")])
    return kept.groupBy("review").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("ids"))


def negatives(dismissed: DataFrame, audited: DataFrame, limit: int = 12) -> DataFrame:
    """(lane, number, row): the first ``limit`` dismissals of each lane that are not audited yet. Numbers run over all lanes in the order of
    (lane, row), so that a reference stays the same; audited: lane, number."""
    every = _running(dismissed.select("lane", "row").distinct())
    return numbered(every.join(audited, ["lane", "number"], "left_anti"), ["lane"], [F.col("number")], "place").where(F.col("place") <= limit).select("lane", "number", "row")


def _running(rows: DataFrame) -> DataFrame:
    """Adds number: the place from 1 over all lanes, by counting each lane and shifting by the lanes before."""
    before = Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("lane").agg(F.count("*").alias("n")).select("lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))  # one row a lane
    return numbered(rows, ["lane"], [F.col("row")], "n").join(F.broadcast(shift), "lane").select("lane", "row", (F.col("n") + F.col("shift")).cast("long").alias("number"))


def dismissals(actions: DataFrame, leads: DataFrame) -> DataFrame:
    """(lane, row, reason): leads that an action (seq, lane, needle, reason) dismisses, the last one's reason. A needle is sought in label and row,
    whatever its case; a reason must say something: ten characters or more, and none of the phrases that give none."""
    from quarry.functions.predicates import no_reason, scope_reason

    valid = actions.where((F.length(F.trim("reason")) >= 10) & ~no_reason(F.col("reason")) & ~scope_reason(F.col("reason")) & (F.trim("needle") != ""))
    wanted = valid.withColumn("needle", F.lower(F.trim("needle")))
    texts = leads.select("lane", "row", F.struct("label", "row").alias("lead"), F.lower(F.concat_ws(" ", "label", "row")).alias("text")).distinct()
    held = containing(texts.select("lane", "lead", "text"), "lead", "text", wanted, "needle", ["lane"])
    met = held.select("lane", F.col("lead.row").alias("row"), "needle").join(wanted, ["lane", "needle"])
    return met.groupBy("lane", "row").agg(F.max_by("reason", "seq").alias("reason"))


def hypotheses(stated: DataFrame, files: DataFrame, least: int = 6, alike: float = 0.7) -> DataFrame:
    """stated (lane, seq, statement, paths) with fault: 'vague' (hedged or under five key words), 'unknown file', 'repeated' (an earlier one of the
    lane shares 70 % of the key words), 'too few' (the lane states fewer than ``least``), else null."""
    words = stated.withColumn("terms", title_terms(F.col("statement"), 4))
    known = F.broadcast(files.select(F.col("path").alias("p")).distinct()) if files.limit(100_001).count() <= 100_000 else files.select(F.col("path").alias("p")).distinct()
    missing = words.select("lane", "seq", F.explode("paths").alias("p")).join(known, "p", "left_anti").select("lane", "seq").distinct().withColumn("lost", F.lit(True))
    # Equal sets of a lane meet once, as a set of its first statement; only unlike sets are compared.
    known_sets = written(words.where(F.size("terms") > 0).groupBy("lane", "terms").agg(F.min("seq").alias("first")).withColumn("set", F.struct("first", F.xxhash64("terms").alias("hash"))))
    pairs = similar_sets(known_sets, "set", "terms", alike, ("lane",)).where("a.first < b.first")
    like = known_sets.join(pairs.select("lane", F.col("b").alias("set"), F.lit(True).alias("like")).distinct(), ["lane", "set"], "left").select("lane", "terms", "first", "like")
    close = words.join(like, ["lane", "terms"]).where((F.col("seq") > F.col("first")) | F.col("like")).select("lane", "seq", "terms").distinct().withColumn("again", F.lit(True))
    many = stated.groupBy("lane").agg(F.count("*").alias("n"))
    hedged = F.col("statement").rlike(r"(?i)\b(may|might|maybe|perhaps|possibly|could)\b")
    fault = F.when(hedged | (F.size("terms") < 5), "vague").when(F.col("lost"), "unknown file").when(F.col("again"), "repeated").when(F.col("n") < least, "too few")
    return words.join(missing, ["lane", "seq"], "left").join(close, ["lane", "seq", "terms"], "left").join(many, "lane").select("lane", "seq", fault.alias("fault"))


def cites_repository(texts: DataFrame, files: DataFrame) -> DataFrame:
    """(id): texts that cite a known file as path.ext:line, by its path or the end of it. Every end of a known path is a key, so the join is an equality."""
    parts = F.split("path", "/")
    ends = files.select("path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("i")).select(F.array_join(F.slice(F.split("path", "/"), F.col("i"), F.size(F.split("path", "/"))), "/").alias("end")).distinct()
    return texts.select("id", F.explode(F.array_distinct(cited_paths(F.col("text")))).alias("end")).join(ends, "end", "left_semi").select("id").distinct()


def routes_without_client(routes: DataFrame, calls: DataFrame) -> DataFrame:
    """Routes that no client call matches, the parameters of a route standing for any value; none if there are no calls at all."""
    some = calls.limit(1).select(F.lit(True).alias("__some"))
    filled = routes.withColumn("__probe", F.regexp_replace("path", r"\{[^}]*\}", "x"))
    called = matching_paths(filled.select(F.col("__probe").alias("path")), calls.select("path", F.lit(False).alias("below")))
    return filled.join(called.withColumnRenamed("path", "__called"), F.col("__probe") == F.col("__called"), "left_anti").join(F.broadcast(some), F.lit(True), "left_semi").drop("__probe")


def documented_routes(routes: DataFrame, documents: DataFrame) -> DataFrame:
    """(path, document): the first document (least path) that names a route: its path without parameters, or an end of it of over six
    characters with a slash. Documents are cut into their path-like runs, of which every end and start is a key."""
    bare = F.regexp_replace(F.regexp_replace("path", r"/?\{[^}]*\}", ""), "/+$", "")
    parts = F.split(F.regexp_replace(bare, "^/+", ""), "/")
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")
    keys = routes.select("path", F.explode(F.array_compact(F.array(F.when(F.length(bare) > 1, bare), F.when((F.length(tail) > 6) & F.contains(tail, F.lit("/")), tail)))).alias("key"))
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_\-/.]*/[A-Za-z0-9_\-/.]*"), F.lit(0)))
    cut = documents.select("document", F.explode(runs).alias("run")).distinct()
    pieces = F.split("run", "/")
    spans = cut.select("document", pieces.alias("ps"), F.explode(F.sequence(F.lit(1), F.size(pieces))).alias("i")).select("document", "ps", "i", F.explode(F.sequence("i", F.size("ps"))).alias("j"))
    named = spans.select("document", F.array_join(F.slice("ps", F.col("i"), F.col("j") - F.col("i") + 1), "/").alias("key")).where("key <> ''")
    both = named.union(named.select("document", F.concat(F.lit("/"), "key"))).distinct()
    return keys.join(both, "key").groupBy("path").agg(F.min("document").alias("document"))


def resolve_handlers(names: DataFrame, definitions: DataFrame) -> DataFrame:
    """names (id, name, file, hint) with the definition each means: one of the same file, else of the module that the hint names, else the first."""
    met = names.join(definitions.select("name", F.col("file").alias("at"), "line"), "name", "left")
    stem = F.regexp_extract("at", r"([^/]*?)(\.[^./]*)?$", 1)
    tier = F.when(F.col("at") == F.col("file"), 0).when(stem == F.col("hint"), 1).otherwise(2)
    return first_by(met.withColumn("tier", tier), ["id"], [F.col("tier"), F.col("at"), F.col("line")])


def transitive_users(calls: DataFrame, seeds: DataFrame, owner: str = "owner") -> DataFrame:
    """(owner, name): methods that use something themselves (seeds) or call a method of their owner that does, to any depth."""
    known = written(seeds.select(owner, "name").distinct())
    frontier = known
    while not frontier.isEmpty():
        step = calls.select(owner, "caller", F.col("callee").alias("name")).join(frontier, [owner, "name"]).select(owner, F.col("caller").alias("name")).distinct()
        frontier = written(step.join(known, [owner, "name"], "left_anti"))
        known = written(known.union(frontier))
    return known


def witnessed_reach(calls: DataFrame, seeds: DataFrame, blocked: DataFrame) -> DataFrame:
    """(name, witness, round): names that reach a seed over calls, with the site that shows it: that of the nearest round, in it the least.
    Blocked names (generic or asynchronous) pass nothing on."""
    known = written(seeds.groupBy("name").agg(F.min("witness").alias("witness")).withColumn("round", F.lit(0)))
    frontier, n = known, 0
    while not frontier.isEmpty():
        n += 1
        step = calls.select(F.col("callee").alias("name"), "caller").join(frontier.select("name", "witness"), "name").select(F.col("caller").alias("name"), "witness")
        fresh = step.join(blocked.select("name"), "name", "left_anti").join(known.select("name"), "name", "left_anti")
        frontier = written(fresh.groupBy("name").agg(F.min("witness").alias("witness")).withColumn("round", F.lit(n)))
        known = written(known.union(frontier))
    return known


def processors(texts: DataFrame, vendors: list[tuple[str, str]]) -> DataFrame:
    """(vendor, first_file, n_files): first file and number of files by vendor; vendors: (pattern, vendor), the first that fits a file's module counts.
    texts: file, module."""
    named = F.lit(None).cast("string")
    for pattern, vendor in reversed(vendors):
        named = F.when(F.col("module").rlike(pattern), vendor).otherwise(named)
    return texts.select("file", named.alias("vendor")).where("vendor is not null").groupBy("vendor").agg(F.min("file").alias("first_file"), F.countDistinct("file").alias("n_files"))


def framework_scores(evidence: DataFrame) -> DataFrame:
    """(name, score, confidence, is_primary) of frameworks with any evidence (booleans dependency, imported, pattern): one point each for the first two, two for the third."""
    score = F.col("dependency").cast("int") + F.col("imported").cast("int") + 2 * F.col("pattern").cast("int")
    found = evidence.groupBy("name").agg(*[F.bool_or(c).alias(c) for c in ("dependency", "imported", "pattern")]).withColumn("score", score).where("score > 0")
    return found.select("name", "score", F.when(F.col("score") >= 4, "high").when(F.col("score") >= 2, "medium").otherwise("low").alias("confidence"), (F.col("score") >= 4).alias("is_primary"))


def allowed(paths: DataFrame, rules: list[tuple[str, bool]], path: str = "path", default: bool = False) -> DataFrame:
    """paths with allowed: what the first rule (glob, allowed) that fits says, else the default."""
    from quarry.functions.scalars import glob_pattern

    verdict = F.lit(default)
    for glob, yes in reversed(rules):
        verdict = F.when(F.col(path).rlike(glob_pattern(glob)), yes).otherwise(verdict)
    return paths.withColumn("allowed", verdict)


def unwired(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Names (of controls) that occur as a word at most once, the definition itself, in all texts without their comments."""
    words = F.regexp_extract_all(F.regexp_replace("text", r"(?m)#.*$", ""), F.lit(r"\w+"), F.lit(0))
    counts = texts.select(F.explode(words).alias("name")).join(names.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.count("*").alias("uses"))
    return names.join(counts, "name", "left").withColumn("uses", F.coalesce("uses", F.lit(0))).where("uses <= 1")


def without_migration(tables: DataFrame, migrations: DataFrame, creates_all: Column | None = None) -> DataFrame:
    """Tables whose name no migration text holds as a word; none where tables are created by the program itself."""
    if creates_all is not None and not migrations.where(creates_all).isEmpty():
        return tables.limit(0)
    words = migrations.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))).alias("name")).distinct()
    return tables.join(words, "name", "left_anti")


def cached_result(polled: DataFrame, completed: DataFrame) -> DataFrame:
    """polled (id, key) with the result of the newest completed row of the same key, if any; its status then is completed."""
    newest = completed.groupBy("key").agg(F.max_by(F.struct(F.col("id").alias("from_id"), "result"), F.struct("finished", "id")).alias("x")).select("key", "x.from_id", "x.result")
    return polled.join(newest, "key", "left").withColumn("status", F.when(F.col("from_id").isNotNull(), "completed").otherwise("pending"))
