"""Detectors over the tagged rows of Python sources that need more than one row: joins, fixpoints, counts. Each gives (file, line, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import test_path
from quarry.operators import python_ast as P
from quarry.operators import review as R
from quarry.operators.windows import first_by

# Constructors and names of model clients, their methods, and what hands work to other threads.
MODEL_MAKER = r"^(Chat[A-Z]\w*|\w*LLM|OpenAI|AsyncOpenAI|AzureOpenAI|AsyncAzureOpenAI|Anthropic|AsyncAnthropic|\w*Embeddings|SentenceTransformer|CrossEncoder|GenerativeModel|ModelInference|init_chat_model)$"
MODEL_NAME = r"(?i)(^|_)(llms?|chat|model|embedder|embeddings?|encoder|client|agent)(_|\d|$)"
SPECIFIC = ["invoke", "generate", "predict", "batch", "embed_query", "embed_documents"]
AWAITED = ["ainvoke", "agenerate", "apredict", "abatch", "astream", "aembed_query", "aembed_documents", "astream_events"]
# Own lists.
VENDORS = [
    (r"^(openai|langchain_openai)\b", "OpenAI"), (r"^(anthropic|langchain_anthropic)\b", "Anthropic"), (r"^(boto3|botocore)\b", "AWS"), (r"^azure\b", "Azure"), (r"^stripe\b", "Stripe"),
    (r"^twilio\b", "Twilio"), (r"^sentry_sdk\b", "Sentry"), (r"^(smtplib|aiosmtplib)\b", "SMTP server"), (r"^(cohere|langchain_cohere)\b", "Cohere"), (r"^(mistralai|langchain_mistralai)\b", "Mistral"),
]
IDENTITY_FIELD = r"(?i)(^|_)(user|owner|tenant|account|org)(_?id)?$"
FETCHES = r"(?i)^(query|execute|find|find_one|filter|select|fetch\w*|search|get_all|scalars?)$"
RENEWS = ["clear", "cycle_id", "regenerate", "renew", "rotate", "cycle_key", "flush", "invalidate"]
# Names of protective code, of text cleaners and of those that rewrite on purpose, signs that identifiers are made of,
# launch commands, test packages.
CONTROL = (
    r"(?i)(csrf|xsrf|auth\w*_middleware|\w*_auth_middleware|authenticat\w*|authoriz\w*|login_required|"
    r"require_\w*(auth|login|role|admin|permission)|rate_?limit\w*|throttl\w*|security_headers?\w*|"
    r"verify_(token|signature|webhook|api_key)\w*|check_(permission|access|owner)\w*|sanitiz\w*|escape_html)"
)
CLEANER = r"(?i)(clean|normali[sz]e|sanitiz|preprocess|prepare_?text|scrub|tidy|correct)"
ON_PURPOSE = r"(?i)file_?name|path|slug|key|url|header|sql"
IDENTIFIER_SIGN = r"^(\\?[_.@+\-:/#]|\[[_.@+\-:/#\\]+\]|\\d.*|\d{4}.*|.*\\d\{4\}.*)$"
SERVER = r"\b(?:uvicorn|gunicorn|hypercorn|daphne|granian)\b[^\n]*?\b([A-Za-z_][\w.]*):([A-Za-z_]\w*)"
SCRIPT = r"\bpython[0-9.]*\s+(?:-\w\s+)*([\w./-]+\.py)\b"
MODULE = r"\bpython[0-9.]*\s+-m\s+([A-Za-z_][\w.]*)"
TEST_PACKAGE = r"(?i)^(pytest|pytest-[\w-]+|unittest2|nose2?|hypothesis|jest|vitest|mocha|playwright|@playwright/test|cypress|@testing-library/[\w-]+)$"


def _last(column: str | Column) -> Column:
    return F.element_at(F.split(column, r"\."), -1)


def model_names(tree: DataFrame) -> DataFrame:
    """(name): what modules bind to a model or embedding client."""
    return tree.where("kind = 'module_name'").where(_last("detail").rlike(MODEL_MAKER)).select("name").distinct()


def model_calls(tree: DataFrame) -> DataFrame:
    """(file, line, fn, fn_name, in_async, method, how): calls of models, ``how`` sync or async. A generic method (create, encode, stream) counts only on a known
    model object or a client's completions."""
    receiver = F.regexp_extract("qualname", r"([^.]+)\.[^.]+$", 1)
    known = model_names(tree).select(F.col("name").alias("receiver"), F.lit(True).alias("is_model"))
    asyncs = tree.where("kind = 'function' and is_async").select(F.col("id").alias("owner"), F.lit(True).alias("in_async"))
    rows = tree.where("kind = 'call' and owner is not null").withColumn("receiver", receiver).where("receiver <> ''").join(known, "receiver", "left").join(asyncs, "owner", "left").na.fill(False, ["is_model", "in_async"])
    named = F.col("receiver").rlike(MODEL_NAME)
    sync = (F.col("is_model") & F.col("name").isin(*SPECIFIC, "encode", "create", "stream", "run", "complete", "chat")) | (F.col("name").isin(SPECIFIC) & named) | (F.col("qualname").rlike(r"\.(completions|messages)\.create$")) | ((F.col("name") == "encode") & F.col("receiver").rlike("(?i)(model|embedder|encoder|embedding)"))
    how = F.when(F.col("name").isin(AWAITED) & (named | F.col("is_model")), "async").when(sync & ~F.col("awaited"), "sync")
    return rows.withColumn("how", how).where("how is not null").select(F.col("path").alias("file"), "line", F.col("owner").alias("fn"), F.col("owner_name").alias("fn_name"), "in_async", F.col("name").alias("method"), "how")


def blocking_in_async(tree: DataFrame) -> DataFrame:
    """(file, line, name, witness): model calls without await in an async function, and calls there of a plain function that reaches one; witness is the nearest such call."""
    sync = model_calls(tree).where("how = 'sync'")
    direct = sync.where("in_async").select("file", "line", F.col("method").alias("name"), F.concat_ws(":", "file", "line").alias("witness"))
    edges = tree.where("kind = 'call' and owner is not null and not awaited").select(F.col("owner_name").alias("caller"), F.col("name").alias("callee")).distinct()
    asyncs = tree.where("kind = 'function' and is_async").select("name").distinct()
    reach = R.witnessed_reach(edges, sync.where("not in_async").select(F.col("fn_name").alias("name"), F.concat_ws(":", "file", "line").alias("witness")), asyncs)
    plain = tree.where("kind = 'function' and not is_async").select("name").distinct()
    called = tree.where("kind = 'call' and not awaited").join(tree.where("kind = 'function' and is_async").select(F.col("id").alias("owner")), "owner", "left_semi")
    through = called.join(reach.join(plain, "name", "left_semi").select("name", "witness"), "name").select(F.col("path").alias("file"), "line", "name", "witness")
    return direct.union(through).distinct()


def executor_nesting(tree: DataFrame) -> DataFrame:
    """(file, line, job): functions started on an executor that start another one there."""
    starts = tree.where("kind = 'call' and name in ('submit', 'run_in_executor')").select("owner", "path", "line", F.array_compact(F.array(_last(F.element_at("keywords", "_0")), _last(F.element_at("keywords", "_1")))).alias("jobs"))
    jobs = starts.select(F.explode("jobs").alias("name")).distinct()
    starters = starts.select(F.col("owner").alias("id")).distinct()
    return P.functions(tree).join(jobs, "name", "left_semi").join(starters, "id", "left_semi").select("file", F.col("start_line").alias("line"), F.col("name").alias("job"))


def single_worker_pools(tree: DataFrame) -> DataFrame:
    return tree.where("kind in ('call', 'assign_call')").where((F.coalesce("name", F.lit("")).rlike("PoolExecutor$") | F.coalesce("detail", F.lit("")).rlike("PoolExecutor$")) & ((F.element_at("keywords", "max_workers") == "1") | (F.element_at("keywords", "_0") == "1"))).select(F.col("path").alias("file"), "line").distinct()


def query_credentials(tree: DataFrame) -> DataFrame:
    """(file, line, name): credentials that travel in an address: parameters of handlers by name, and reads of query parameters."""
    secret = r"(?i)^(access_?token|token|api_?key|password|secret)$"
    handlers = tree.where("kind = 'decorator'").where(F.col("name").isin(*P.VERBS, "route")).select("owner").distinct()
    params = tree.where("kind = 'param'").where(F.col("name").rlike(secret) & ~F.coalesce("qualname", F.lit("")).rlike("(Header|Cookie|Body|Form|Depends|Security)$")).join(handlers, "owner", "left_semi").select(F.col("path").alias("file"), "line", "name")
    reads = tree.where("kind = 'call'").where(F.col("qualname").rlike(r"(query_params|args|GET)\.get$") & F.exists("literals", lambda s: s.rlike(secret))).select(F.col("path").alias("file"), "line", F.element_at("literals", 1).alias("name"))
    return params.union(reads)


def session_fixation(tree: DataFrame) -> DataFrame:
    """(file, line, key): the first write of an identity into a session by a function that never renews it."""
    writes = tree.where("kind = 'item_write'").where(F.lower("name").rlike("session") & F.col("detail").rlike(r"(?i)^_?(user|uid|account|email|login|username)(_?id)?$"))
    renewed = tree.where("kind = 'call'").where(F.col("name").isin(RENEWS)).select("owner").distinct()
    return first_by(writes.join(renewed, "owner", "left_anti"), ["owner"], [F.col("line")]).select(F.col("path").alias("file"), "line", F.col("detail").alias("key"))


def lossy_cleaning(tree: DataFrame) -> DataFrame:
    """(file, line, sign): cleaners of text that rewrite signs of which addresses, names and dates are made; cleaners of paths and the like do so on purpose."""
    calls = tree.where("kind = 'call'").where(F.col("owner_name").rlike(CLEANER) & ~F.col("owner_name").rlike(ON_PURPOSE))
    sub = F.col("qualname").isin("re.sub", "re.subn", "regex.sub") | (F.col("name") == "replace")
    return calls.where(sub & F.element_at("literals", 1).rlike(IDENTIFIER_SIGN)).select(F.col("path").alias("file"), "line", F.element_at("literals", 1).alias("sign"))


def unwired_controls(tree: DataFrame, files: DataFrame) -> DataFrame:
    """(file, line, name): top-level functions and classes that protect, by their name, and that no code outside tests names but where they are defined."""
    made = tree.where("kind in ('function', 'class') and parent = path").where(F.col("name").rlike(CONTROL) & ~test_path(F.col("path"))).select("name", F.col("path").alias("file"), "line")
    code = files.where("language = 'Python'").where(~test_path(F.col("path"))).select("text")
    return R.unwired(made, code).select("file", "line", "name")


def with_dependency_aliases(tree: DataFrame) -> DataFrame:
    """The rows, where a parameter annotated by a module-level alias of Depends(f) bears f, as if it were written out. Of several aliases of one
    name all count."""
    aliases = tree.where("kind = 'module_name' and size(literals) > 0").groupBy(F.col("name").alias("alias")).agg(F.array_distinct(F.flatten(F.collect_list("literals"))).alias("targets"))
    params = tree.where("kind = 'param'").join(aliases, F.col("detail") == F.col("alias"), "left")
    filled = params.withColumn("literals", F.array_union(F.coalesce("literals", F.array().cast("array<string>")), F.coalesce("targets", F.array().cast("array<string>")))).select(*tree.columns)
    return tree.where("kind <> 'param'").unionByName(filled)


def identity_unused(tree: DataFrame) -> DataFrame:
    """(file, line, class, method): methods that fetch something in a class that holds an identity, and use that identity neither themselves nor through
    other methods of the class."""
    methods = tree.where("kind = 'function'").select("id", "name", "line", F.col("path").alias("file"), F.col("parent").alias("owner"))
    touched = tree.where("kind = 'self_attr'").select(F.col("owner").alias("id"), F.col("name").alias("attr"), "detail")
    own = touched.join(methods.select("id", F.col("name").alias("method"), F.col("owner").alias("cls")), "id")
    held = own.where(F.col("detail") == "write").where(F.col("attr").rlike(IDENTITY_FIELD)).select("cls", "attr").distinct()
    uses = own.where("detail = 'read' and method <> '__init__'").join(held, ["cls", "attr"], "left_semi").select(F.col("cls").alias("owner"), F.col("method").alias("name"))
    inner = tree.where("kind = 'call'").where(F.col("qualname").rlike(r"^self\.\w+$")).select(F.col("owner").alias("id"), F.col("name").alias("callee")).join(methods.select("id", F.col("name").alias("caller"), "owner"), "id").select("owner", "caller", "callee")
    using = R.transitive_users(inner, uses)
    fetching = tree.where("kind = 'call'").where(F.col("name").rlike(FETCHES)).select(F.col("owner").alias("id")).distinct()
    return methods.join(fetching, "id", "left_semi").join(held.select(F.col("cls").alias("owner")).distinct(), "owner", "left_semi").join(using, ["owner", "name"], "left_anti").where("name <> '__init__'").select("file", "line", F.regexp_extract("owner", r"::(.*)$", 1).alias("class"), F.col("name").alias("method"))


def launched(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(file, how): Python files that a launch command names: server (module:attribute), or else script (a path, or a module with -m). Every end of a path is a key."""
    said = texts.select(F.explode(F.concat(
        F.transform(F.regexp_extract_all("text", F.lit(SERVER), F.lit(1)), lambda m: F.struct(F.lit(0).alias("tier"), F.concat(F.replace(m, F.lit("."), F.lit("/")), F.lit(".py")).alias("end"))),
        F.transform(F.regexp_extract_all("text", F.lit(SCRIPT), F.lit(1)), lambda m: F.struct(F.lit(1).alias("tier"), F.regexp_replace(m, r"^[./]+", "").alias("end"))),
        F.flatten(F.transform(F.regexp_extract_all("text", F.lit(MODULE), F.lit(1)), lambda m: F.array(*[F.struct(F.lit(1).alias("tier"), F.concat(F.replace(m, F.lit("."), F.lit("/")), F.lit(x)).alias("end")) for x in (".py", "/__main__.py")]))),
    )).alias("x")).select("x.tier", "x.end").distinct()
    parts = F.split("path", "/")
    ends = files.where(F.endswith("path", F.lit(".py"))).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 1000), "/"))).alias("end"))
    return ends.join(said, "end").groupBy(F.col("path").alias("file")).agg(F.min("tier").alias("tier")).select("file", F.when(F.col("tier") == 0, "server").otherwise("script").alias("how"))


def runtime_loaded(tree: DataFrame, files: DataFrame) -> DataFrame:
    """(file): modules that a program loads by name: a dotted string of a call names them, a worker's decorator stands in them, or they are management commands."""
    python = files.where(F.endswith("path", F.lit(".py"))).where(~test_path(F.col("path"))).select("path")
    dotted = F.split(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/")
    named = python.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(dotted)), lambda i: F.array_join(F.slice(dotted, i, 1000), "."))).alias("module"))
    strings = tree.where(~test_path(F.col("path"))).where("kind in ('call', 'decorator')").select(F.explode("literals").alias("s")).where(F.col("s").rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)+(:\w+)?$")).select(F.regexp_replace("s", ":.*$", "").alias("module")).distinct()
    by_name = named.join(strings, "module", "left_semi").select("path")
    workers = tree.where("kind = 'function'").where(F.exists("decorators", lambda d: d.rlike(r"(^|\.)(shared_task|task|actor|periodic_task|on_message|subscriber)$"))).select("path")
    commands = python.where(F.contains(F.concat(F.lit("/"), "path"), F.lit("/management/commands/")))
    return by_name.union(workers).union(commands).distinct().select(F.col("path").alias("file"))


def call_routes(tree: DataFrame) -> DataFrame:
    """method, path, handler, file, line of frameworks that register routes by calls: add_get('/x', h), web.get('/x', h), Route('/x', h, methods=[...]), path('x/', view)."""
    listed = F.filter(F.split(F.coalesce(F.element_at("keywords", "methods"), F.lit("")), ","), lambda m: m != "")
    verb = F.upper(F.regexp_extract("name", r"^(?:add_)?(get|post|put|patch|delete|head|options)$", 1))
    known = tree.where("kind = 'call' and size(literals) > 0")
    web = known.where((F.col("qualname").rlike(r"(^|\.)router\.add_\w+$|^(aiohttp\.)?web\.\w+$")) & (verb != "")).withColumn("methods", F.array(verb)).withColumn("h", F.element_at("keywords", "_1")).withColumn("p", F.element_at("literals", 1))
    added = known.where("name = 'add_route' and size(literals) > 1 and map_contains_key(keywords, '_2')").withColumn("methods", F.array(F.upper(F.element_at("literals", 1)))).withColumn("h", F.element_at("keywords", "_2")).withColumn("p", F.element_at("literals", 2))
    star = known.where("name = 'Route'").withColumn("methods", F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("GET")))).withColumn("h", F.coalesce(F.element_at("keywords", "_1"), F.element_at("keywords", "endpoint"))).withColumn("p", F.element_at("literals", 1))
    django = known.where("name in ('path', 're_path') and map_contains_key(keywords, '_1')").where(~F.element_at("keywords", "_1").rlike(r"(^|\.)include$")).withColumn("methods", F.array(F.lit("ANY"))).withColumn("h", F.regexp_replace(F.element_at("keywords", "_1"), r"\.as_view$", "")).withColumn("p", F.element_at("literals", 1))
    from quarry.functions.scalars import framework_path

    found = web.unionByName(added).unionByName(star).unionByName(django)
    rows = found.select(F.explode("methods").alias("method"), framework_path(F.col("p")).alias("path_"), _last("h").alias("handler"), F.col("path").alias("file"), "line")
    return first_by(rows, ["method", "path_", "file", "handler"], [F.col("line")]).withColumnRenamed("path_", "path")


def application_auth(tree: DataFrame) -> DataFrame:
    """(file, line, name): functions that run before every request (by decorator) and refuse some."""
    hooks = tree.where("kind = 'function'").where(F.exists("decorators", lambda d: d.rlike(r"(^|\.)(before_request|before_app_request|middleware|on_request)$"))).select("id", F.col("path").alias("file"), "line", "name")
    refuses = tree.where("kind = 'call'").where((F.col("name").isin("abort", "HTTPException", "HTTPUnauthorized", "HTTPForbidden", "HttpResponseForbidden", "PermissionDenied", "Unauthorized", "JSONResponse", "Response")) & (F.col("name").rlike("(?i)forbidden|unauthorized|denied") | F.exists(F.map_values("keywords"), lambda v: v.isin("401", "403")))).select(F.col("owner").alias("id")).distinct()
    return hooks.join(refuses, "id", "left_semi").select("file", "line", "name")


def vendors(tree: DataFrame, known: list[tuple[str, str]] = VENDORS) -> DataFrame:
    """(vendor, first_file, n_files): third parties that live code imports."""
    return R.processors(tree.where("kind = 'import'").where(~test_path(F.col("path"))).select(F.col("path").alias("file"), F.regexp_replace("name", r"^\.+", "").alias("module")), known)


def testing_inventory(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(kind, name): test files, those of them that call routes, test packages and pipelines."""
    from quarry.functions.predicates import pipeline_file

    tests = files.where("language in ('Python', 'TypeScript', 'JavaScript')").where(test_path(F.col("path")))
    calls = tests.where(F.col("text").rlike(r"TestClient|AsyncClient|test_client\(|supertest|\bclient\.(get|post|put|patch|delete)\("))
    packages = dependencies.where(F.lower("package").rlike(TEST_PACKAGE)).select(F.lower("package").alias("name")).distinct()
    one = lambda kind, df: df.select(F.lit(kind).alias("kind"), "name")
    path = lambda df: df.select(F.col("path").alias("name"))
    return one("test file", path(tests)).union(one("route test", path(calls))).union(one("test package", packages)).union(one("pipeline", path(files.where(pipeline_file(F.col("path"))))))
