"""Route maps from parsed sources: routers, include chains, dependency closures, and risk hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import graphs, joins, python_ast, windows
from quarry.shared import written

# Names that verify a user token, shared keys, identities, paging parameters.
TOKEN_VERIFY = r"jwt\.decode|decode_access_token|decode_token|verify_token|verify_jwt|OAuth2PasswordBearer|HTTPBearer|HTTPAuthorizationCredentials|get_current_user|get_current_active_user|firebase_admin\.auth|verify_id_token"
API_KEY_NAME = r"(?i)api[_-]?key"
IDENTITY = r"(?i)(^|[_-])(user|email|e_?mail|owner|role|tenant|account|org|uid|username|created_by|requester|actor)([_-]|$)"
PAGING = r"(?i)^(limit|offset|page|page_size|per_page|skip|cursor|size|top|take|pagination|paging)$"


def _text(column: str, key: str) -> Column:
    return F.regexp_replace(F.coalesce(F.element_at(column, key), F.lit("")), "^['\"]|['\"]$", "")


def _names(column: str, key: str) -> Column:
    value = _text(column, key)
    return F.when(value.rlike(r"^[A-Za-z_][\w.]*(,[A-Za-z_][\w.]*)*$") & (value != "List"), F.split(value, ",")).otherwise(F.array().cast("array<string>"))


def routers(tree: DataFrame) -> DataFrame:
    kind = F.element_at(F.split("detail", r"\."), -1)
    return tree.where("kind = 'assign_call'").where(kind.isin("FastAPI", "APIRouter")).select(F.concat_ws("::", "path", "name").alias("router"), "path", F.col("name").alias("var"), (kind == "FastAPI").alias("is_app"), _text("keywords", "prefix").alias("prefix"), _names("keywords", "dependencies").alias("deps"))


def include_edges(tree: DataFrame, known: DataFrame) -> DataFrame:
    """(child, parent, prefix, deps): each include resolved to the router of that name in the same file, else in a file that the
    expression's qualifier names, else to the first one."""
    parts = F.split(F.element_at("keywords", "_0"), r"\.")
    made = tree.where("kind = 'call' and name = 'include_router'").select("path", "line", F.element_at(F.split("qualname", r"\."), 1).alias("parent_var"), F.element_at(parts, -1).alias("var"), F.when(F.size(parts) > 1, F.element_at(parts, -2)).alias("hint"), _text("keywords", "prefix").alias("include_prefix"), _names("keywords", "dependencies").alias("include_deps"))
    cands = known.select(F.col("router").alias("child"), F.col("path").alias("child_path"), "var")
    stem = F.regexp_extract("child_path", r"([^/]+)\.py$", 1)
    tier = F.when((F.col("child_path") == F.col("path")) & F.col("hint").isNull(), 0).when(stem == F.col("hint"), 1).when(F.contains("child_path", F.coalesce("hint", F.lit("\0"))), 2).otherwise(3)
    best = windows.first_by(made.join(cands, "var").withColumn("tier", tier), ["path", "line", "var"], [F.col("tier"), F.col("child")])
    return best.join(known.select(F.col("path"), F.col("var").alias("parent_var"), F.col("router").alias("parent")), ["path", "parent_var"]).where("child <> parent").select("child", "parent", "include_prefix", "include_deps")


def prefix_chains(known: DataFrame, includes: DataFrame, depth: int = 6) -> DataFrame:
    """(router, prefix, deps): every combination of prefixes a router is mounted under, up to an app, a router that nobody includes, or the depth."""
    now = written(known.select("router", F.col("router").alias("top"), "prefix", "deps", "is_app", F.lit(False).alias("done")))
    up = includes.join(known.select(F.col("router").alias("parent"), F.col("prefix").alias("up_prefix"), F.col("deps").alias("up_deps"), F.col("is_app").alias("up_app")), "parent")
    for _ in range(depth + 1):
        open_ones = now.where("not done and not is_app").join(up, F.col("top") == F.col("child"), "left")
        moved = open_ones.select("router", F.coalesce("parent", "top").alias("top"), F.when(F.col("parent").isNull(), F.col("prefix")).otherwise(F.concat("up_prefix", "include_prefix", "prefix")).alias("prefix"), F.when(F.col("parent").isNull(), F.col("deps")).otherwise(F.concat("up_deps", "include_deps", "deps")).alias("deps"), F.coalesce("up_app", F.lit(False)).alias("is_app"), F.col("parent").isNull().alias("done"))
        now = written(now.where("done or is_app").unionByName(moved))
        if now.where("not done and not is_app").isEmpty():
            break
    return now.select("router", "prefix", "deps")


def routes(tree: DataFrame) -> DataFrame:
    """method, path, handler, file, line, dependencies, identity_inputs, user_token_verified, shared_key, accepts_upload, paginated, auth, flags."""
    from quarry.operators.detectors import with_dependency_aliases

    tree = with_dependency_aliases(tree)
    known = written(routers(tree))
    chains = prefix_chains(known, include_edges(tree, known))
    var = F.element_at(F.split("qualname", r"\."), 1)
    listed = F.filter(F.split(F.coalesce(F.element_at("keywords", "methods"), F.lit("")), ","), lambda m: m != "")
    methods = F.when(F.col("name").isin("route", "api_route"), F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("GET")))).otherwise(F.array(F.upper("name")))
    raw = tree.where("kind = 'decorator'").where(F.col("name").isin(*python_ast.VERBS, "route", "api_route") & (F.size("literals") > 0)).select("path", "line", F.concat_ws("::", "path", var).alias("router"), F.explode(methods).alias("method"), F.element_at("literals", 1).alias("own"), F.col("owner").alias("fn"), F.col("owner_name").alias("handler"), _names("keywords", "dependencies").alias("own_deps"))
    params = tree.where("kind = 'param'").groupBy(F.col("owner").alias("fn")).agg(
        F.array_distinct(F.flatten(F.collect_list("literals"))).alias("param_deps"), F.bool_or(F.col("detail").rlike(r"UploadFile|\bFile\b") | F.col("qualname").rlike(r"(^|\.)File$")).alias("accepts_upload"), F.bool_or(F.col("name").rlike(PAGING)).alias("paginated"),
        F.array_sort(F.collect_set(F.when(F.col("name").rlike(IDENTITY), F.concat(F.lit("param:"), "name")))).alias("identity"),
    )
    none = F.array().cast("array<string>")
    full = raw.join(chains, "router").join(params, "fn", "left").select("method", F.regexp_replace(F.coalesce(F.nullif(F.concat("prefix", "own"), F.lit("")), F.lit("/")), "/{2,}", "/").alias("path_"), "handler", F.col("path").alias("file"), "line", "fn", F.array_distinct(F.concat("deps", "own_deps", F.coalesce("param_deps", none))).alias("direct"), F.coalesce("identity", none).alias("identity"), F.coalesce("accepts_upload", F.lit(False)).alias("accepts_upload"), F.coalesce("paginated", F.lit(False)).alias("paginated"))
    full = written(full.withColumn("route", F.concat_ws(" ", "method", "path_", "fn")))

    first = windows.first_by(python_ast.functions(tree), ["name"], [F.col("file"), F.col("start_line")]).select("name", "id")
    deps = tree.where("kind = 'param'").select(F.col("owner").alias("id"), F.explode("literals").alias("dst")).join(first, "id").select(F.col("name").alias("src"), "dst")
    start = full.select(F.col("route").alias("src"), F.explode("direct").alias("dst"))
    inside = tree.where("kind = 'call'").groupBy(F.col("owner").alias("id")).agg(F.bool_or(F.col("qualname").rlike(r"jwt\.decode|OAuth2PasswordBearer|HTTPBearer|verify_id_token")).alias("verifies"))
    known_deps = deps.select("src").union(deps.select("dst")).union(start.select("dst")).distinct().withColumnRenamed("src", "node")
    said = tree.where("kind = 'param'").groupBy(F.col("owner").alias("id")).agg(F.array_sort(F.collect_set(F.when(F.col("name").rlike(IDENTITY), F.concat(F.lit("param:"), "name")))).alias("identity"), F.bool_or(F.col("name").rlike(API_KEY_NAME)).alias("keyed"))
    facts = known_deps.join(first.withColumnRenamed("name", "node"), "node", "left").join(inside, "id", "left").join(said, "id", "left").select("node", (F.col("node").rlike(TOKEN_VERIFY) | F.coalesce("verifies", F.lit(False))).alias("verified"), (F.col("node").rlike(API_KEY_NAME) | F.coalesce("keyed", F.lit(False))).alias("shared"), F.coalesce("identity", none).alias("identity"))
    edges = written(start.union(deps).distinct())
    closed = written(graphs.closure_with(edges, start.select(F.col("src").alias("node")), facts)).withColumnRenamed("root", "route")
    reach = graph_names(edges, start)
    in_path = F.transform(F.filter(F.regexp_extract_all("path_", F.lit(r"\{([^}:]+)"), F.lit(1)), lambda p: p.rlike(IDENTITY)), lambda p: F.concat(F.lit("path:"), p))
    out = full.join(closed, "route", "left").join(reach, "route", "left").select(
        "method", F.col("path_").alias("path"), "handler", "file", "line", F.coalesce("names", none).alias("dependencies"), F.array_distinct(F.concat("identity", F.coalesce("identities", none), in_path)).alias("identity_inputs"),
        F.coalesce("any_verified", F.lit(False)).alias("user_token_verified"), F.coalesce("any_shared", F.lit(False)).alias("shared_key"), "accepts_upload", "paginated",
    )
    return out.withColumn("auth", S.route_auth(F.col("dependencies"), F.col("user_token_verified"), F.col("shared_key"))).withColumn("flags", S.route_flags(F.col("path"), F.col("handler"), F.col("dependencies"), F.col("identity_inputs"), F.col("user_token_verified"), F.col("accepts_upload")))


def graph_names(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(route, names): everything a route depends on, directly or not, sorted."""
    pairs = written(start.select(F.col("src").alias("route"), F.col("dst").alias("name")).distinct())
    frontier = pairs
    while True:
        step = frontier.join(edges, F.col("name") == F.col("src")).select("route", F.col("dst").alias("name")).distinct()
        frontier = written(step.join(pairs, ["route", "name"], "left_anti"))
        if frontier.isEmpty():
            break
        pairs = written(pairs.union(frontier))
    return pairs.groupBy("route").agg(F.array_sort(F.collect_set("name")).alias("names"))


def effects(tree: DataFrame) -> DataFrame:
    """(fn, effect): kinds of side effect of a function's own calls; the first rule that fits a call decides."""
    root, last = F.element_at(F.split("qualname", r"\."), 1), F.col("name")
    base = F.lower(F.regexp_replace("qualname", r"\.?[^.]*$", ""))
    rule = (
        F.when(root.isin("subprocess", "pty") | F.col("qualname").isin("os.system", "os.popen") | F.startswith("name", F.lit("create_subprocess")), "subprocess")
        .when(root.isin("requests", "httpx", "aiohttp", "urllib3") | (last.isin("get", "post", "put", "patch", "delete", "request") & base.rlike("(client|http|api|requests)")), "network")
        .when(last.isin("sendmail", "send_message") | base.rlike("smtp") | last.rlike(r"(?i)send_?(e?mail|sms|notification)"), "messaging")
        .when(last.isin("invoke", "ainvoke", "generate", "generate_content") | F.col("qualname").rlike(r"(completions|messages)\.create$"), "model call")
        .when(last.isin("create_task", "ensure_future", "add_task", "delay", "apply_async", "submit", "run_in_executor", "Thread"), "background work")
        .when(last.isin("acquire", "release") | last.rlike("(?i)lock"), "lock")
        .when(((last == "open") & F.exists("literals", lambda m: m.rlike(r"^[rbt+]*[wax][rwaxbt+]*$"))) | (last.isin("write_text", "write_bytes", "unlink", "rename", "replace", "rmtree", "copy", "move", "makedirs", "remove", "dump") & (root.isin("os", "shutil", "json", "pickle") | base.rlike("path") | F.startswith("name", F.lit("write")))), "file write")
        .when(last.isin("add", "commit", "delete", "execute", "insert", "insert_one", "update", "update_one", "save", "create", "bulk_create", "executemany") & base.rlike(r"(session|db|conn|cursor|collection|repo|table|objects|cur)\b"), "db write")
    )
    return tree.where("kind = 'call' and owner is not null").select(F.col("owner").alias("fn"), rule.alias("effect")).where("effect is not null").distinct()


def hotspots(tree: DataFrame, handlers: DataFrame, per_file: int = 3, overall: int = 15) -> DataFrame:
    """Functions that combine two or more kinds of effect within two calls, by score: 2 per kind, 3 for a route handler, up to 3 for
    length, 1 for a broad except. A call resolves by module qualifier, else within its file, else if at most two definitions share the name."""
    fns = python_ast.functions(tree).where(~S.test_path(F.col("file"))).select("id", "name", "file", "start_line", "loc")
    stem = F.regexp_extract("file", r"([^/]+)\.py$", 1)
    defs = fns.select(F.col("id").alias("callee"), "name", F.col("file").alias("def_file"), stem.alias("def_stem")).join(fns.groupBy("name").count(), "name")
    made = tree.where("kind = 'call' and owner is not null").select(F.col("owner").alias("fn"), "name", F.col("path").alias("call_file"), F.regexp_extract("qualname", r"([^.]+)\.[^.]+$", 1).alias("qualifier")).distinct()
    tier = F.when(F.col("def_stem") == F.col("qualifier"), 0).when(F.col("def_file") == F.col("call_file"), 1).when(F.col("count") <= 2, 2)
    cand = made.join(defs, "name").withColumn("tier", tier).where("tier is not null")
    best = cand.groupBy("fn", "name", "qualifier").agg(F.min("tier").alias("best"))
    edges = cand.join(best, ["fn", "name", "qualifier"]).where("tier = best and fn <> callee").select(F.col("fn").alias("src"), F.col("callee").alias("dst")).distinct()
    own = effects(tree)
    near = graphs.within_two(edges, fns.select(F.col("id").alias("node"))).select(F.col("root").alias("fn"), F.col("node"))
    reached = own.union(near.join(own.withColumnRenamed("fn", "node"), "node").select("fn", "effect")).groupBy("fn").agg(F.array_sort(F.collect_set("effect")).alias("kinds")).where(F.size("kinds") >= 2)
    broad = tree.where("kind = 'except' and owner is not null").where(F.col("name").isin("", "Exception", "BaseException")).select(F.col("owner").alias("fn"), F.lit(True).alias("broad")).distinct()
    routed = handlers.select("file", F.col("handler").alias("name"), F.lit(True).alias("handler")).distinct()
    rows = fns.join(reached, F.col("id") == F.col("fn")).join(broad, "fn", "left").join(routed, ["file", "name"], "left").na.fill(False, ["broad", "handler"])
    score = 2 * F.size("kinds") + F.when(F.col("handler"), 3).otherwise(0) + F.least(F.col("loc") / 40, F.lit(3.0)) + F.when(F.col("broad"), 1).otherwise(0)
    scored = rows.select("file", F.col("start_line").alias("line"), "name", "kinds", "handler", "broad", "loc", score.alias("score"))
    return windows.top_with_cap(scored, "file", [F.desc("score"), F.col("file"), F.col("line")], per_file, overall)


def client_calls(files: DataFrame, first_segments: DataFrame) -> DataFrame:
    """(path, file, line): string literals in scripts that look like paths of known first segments; template holes become {}. First per file."""
    line = F.regexp_replace("raw", r"\$\{[^}]*\}", "{}")
    found = files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select("path", "pos", F.explode(F.regexp_extract_all(line, F.lit(r"[`'\"](?:\{\})?(/[A-Za-z0-9_.\-{}/?=&]+)[`'\"]"), F.lit(1))).alias("call"))
    rows = found.select(S.client_path(F.col("call")).alias("call"), F.col("path").alias("file"), (F.col("pos") + 1).alias("line")).withColumn("segment", F.element_at(F.split("call", "/"), 2))
    return windows.first_by(rows.join(first_segments, "segment", "left_semi"), ["call", "file"], [F.col("line")]).select(F.col("call").alias("path"), "file", "line")


def unmatched_calls(calls: DataFrame, route_map: DataFrame, mounts: DataFrame | None = None) -> DataFrame:
    """Calls (path, ...) that neither a route nor a mount (path; anything below it counts) serves; a bare first segment of a route is no call. None if there are no routes."""
    served = route_map.select("path", F.lit(False).alias("below"))
    if mounts is not None:
        served = served.union(mounts.select("path", F.lit(True).alias("below")))
    first = route_map.select(F.concat(F.lit("/"), F.element_at(F.split(F.regexp_replace("path", "^/+|/+$", ""), "/"), 1)).alias("path")).distinct()
    known = joins.matching_paths(calls, served).union(first).distinct()
    some = route_map.limit(1).select(F.lit(True).alias("__some"))
    return calls.join(known, "path", "left_anti").join(F.broadcast(some), F.lit(True), "left_semi")


def blueprint_routes(tree: DataFrame) -> DataFrame:
    """method, path, handler, file, line of Flask-like applications and blueprints; the prefix given when a blueprint is registered overrides its
    own, and a blueprint registered more than once serves under each prefix."""
    last = F.element_at(F.split("detail", r"\."), -1)
    apps = tree.where("kind = 'assign_call'").where(last.isin("Flask", "Quart", "Sanic", "Blueprint")).select("path", F.col("name").alias("var"), _text("keywords", "url_prefix").alias("own_prefix"))
    named = F.element_at(F.split(F.element_at("keywords", "_0"), r"\."), -1)
    registered = tree.where("kind = 'call' and name in ('register_blueprint', 'blueprint')").select(named.alias("var"), F.nullif(_text("keywords", "url_prefix"), F.lit("")).alias("new_prefix")).distinct()
    listed = F.filter(F.split(F.coalesce(F.element_at("keywords", "methods"), F.lit("")), ","), lambda m: m != "")
    methods = F.when(F.col("name") == "route", F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("GET")))).otherwise(F.array(F.upper("name")))
    raw = tree.where("kind = 'decorator'").where(F.col("name").isin(*python_ast.VERBS, "route") & (F.size("literals") > 0)).select("path", "line", F.element_at(F.split("qualname", r"\."), 1).alias("var"), F.explode(methods).alias("method"), F.element_at("literals", 1).alias("own"), F.col("owner_name").alias("handler"))
    full = raw.join(apps, ["path", "var"]).join(registered, "var", "left")
    return full.select("method", S.framework_path(F.concat(F.coalesce("new_prefix", "own_prefix"), "own")).alias("route"), "handler", F.col("path").alias("file"), "line").withColumnRenamed("route", "path").distinct()
