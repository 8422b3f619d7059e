"""Scalar functions on columns. Python-only notions (line of a match, banker's rounding, null-inclusive hashing) are spelled out here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered vocabularies, gravest or lowest first.
SEVERITIES = ["Critical", "High", "Medium", "Low"]
CONFIDENCES = ["low", "medium", "high"]


def rank_of(value: Column, order: list[str]) -> Column:
    """Position in an ordered vocabulary, from 0 for the gravest; unknown values come last."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(order))).cast("int")


def finding_id(tool: Column, category: Column, file: Column, line: Column, message: Column) -> Column:
    """16 hex digits of a finding's content; a missing line counts as the word None."""
    return F.substring(F.sha2(F.concat_ws("|", tool, category, file, F.coalesce(line.cast("string"), F.lit("None")), message), 256), 1, 16)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def title_terms(title: Column, least: int = 3) -> Column:
    """Distinct lower-case words of a letter and more letters, digits or _, ``least`` long or longer, without stop words."""
    words = F.regexp_extract_all(F.lower(title), F.lit(rf"[a-z][a-z0-9_]{{{least - 1},}}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))))


# Title words that say nothing about a defect, and terms that name one.
STOP_WORDS = """with from into that this missing lack lacks using used without the and for via not all any are absence absent leads lead
    allows allowed can issue issues potential possible multiple across due its has have been
    api endpoint endpoints route routes application app code service services file files data insecure unsafe vulnerability vulnerable""".split()
ANCHOR_TERMS = """cors csrf xss jwt ssrf xxe idor csp hsts otp sqli injection traversal deserialization clickjacking openapi swagger
    mktemp pickle yaml iframe sandbox""".split()
# What a function's name may add to its core.
NAME_MODIFIERS = """async sync all new old legacy v1 v2 v3 impl internal helper fitz pymupdf pdfplumber pypdf fast simple uploaded upload
    external tmp temp wrapper base default the a func fn local orig original alt 2 3""".split()


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two distinct arrays; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) - both == 0, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def path_pattern(path: Column, prefix: bool = False) -> Column:
    """Regular expression of a route path: a segment ``{x}`` or ``{}`` stands for any one segment; a trailing slash is optional, or
    with ``prefix`` anything below. Other characters are literal."""

    def segment(x: Column) -> Column:
        return F.when(x.rlike(r"^\{[^}]*\}$"), F.lit("[^/]+")).otherwise(F.regexp_replace(x, r"([\\.^$|?*+()\[\]{}])", r"\\$1"))

    body = F.array_join(F.transform(F.split(F.regexp_replace(path, r"/+$", ""), "/"), segment), "/")
    return F.concat(F.lit("^"), body, F.lit("(?:/.*)?$" if prefix else "/?$"))


def client_path(path: Column) -> Column:
    """A called path without query, fragment, a trailing ``{}`` that is not a segment, and trailing slash; ``/`` if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"(?<!/)\{\}$", "")
    return F.coalesce(F.nullif(F.regexp_replace(bare, r"/+$", ""), F.lit("")), F.lit("/"))


def framework_path(path: Column) -> Column:
    """``<int:id>``, ``<id>`` and ``{id:pattern}`` become ``{id}``; one leading slash, no doubled ones; a trailing one stays."""
    named = F.regexp_replace(F.regexp_replace(path, r"<(?:[^:<>]+:)?([^<>]+)>", r"{$1}"), r"\{([^}:]+):[^}]*\}", r"{$1}")
    return F.regexp_replace(F.concat(F.lit("/"), named), r"/{2,}", "/")


def package_name(name: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit("-")), r"\[.*$", "")


def core_tokens(name: Column, modifiers: list[str]) -> Column:
    """Sorted set of a name's parts between underscores, lower case, without the modifiers."""
    parts = F.filter(F.split(F.lower(name), "_"), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.array_except(parts, F.array(*map(F.lit, modifiers)))))


def repo_relative(path: Column, root: str) -> Column:
    """Below the root: what follows it; else unchanged."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)


def evidence_label(file: Column, start: Column, end: Column) -> Column:
    """file:start, and -end only if it differs."""
    return F.concat(file, F.lit(":"), start.cast("string"), F.when(end.isNotNull() & (end != start), F.concat(F.lit("-"), end.cast("string"))).otherwise(""))


def line_count(text: Column) -> Column:
    """0 for an empty text; a last line without newline counts."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).otherwise(breaks + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("int")


def percent(part: Column, whole: Column) -> Column:
    """Rounded half to even; 0 of nothing."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0)).otherwise(F.bround(100.0 * part / whole, 0)).cast("int")


def looks_binary(text: Column) -> Column:
    """Over 5 % control or replacement characters in the first 4000."""
    sample = F.substring(text, 1, 4000)
    odd = F.length(sample) - F.length(F.regexp_replace(sample, "[\\x00-\\x08\\x0E-\\x1F�]", ""))
    return (F.length(sample) > 0) & (odd * 20 > F.length(sample))


def capped(text: Column, limit: int) -> Column:
    """The first ``limit`` characters and a note of how many are left out."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("\n… "), (F.length(text) - limit).cast("string"), F.lit(" more characters")))


def agent_role(name: Column) -> Column:
    """struct<role, category, kpis> of ``role:category`` or ``role:category-kpis``."""
    return F.struct(F.regexp_extract(name, r"^([^:]*)", 1).alias("role"), F.regexp_extract(name, r"^[^:]*:(.*?)(?:-kpis)?$", 1).alias("category"), F.endswith(name, F.lit("-kpis")).alias("kpis"))


def glob_pattern(glob: str) -> str:
    """Java regular expression of a shell glob in which * crosses slashes."""
    out = ""
    for ch in glob:
        out += {"*": ".*", "?": "."}.get(ch, ch if ch in "[]" or ch.isalnum() or ch in "_/" else "\\" + ch)
    return f"^{out.replace('[!', '[^')}$"


# Patterns and values that decide the flags of environment entries and routes.
SECRET_WORD = r"(?i)(secret|password|passwd|pwd|token|api[_-]?key|apikey|private[_-]?key|credential|signing)"
NOT_SECRET = r"(?i)(_(minutes|seconds|hours|days|ttl|expire|expires|expiry|lifetime|url|uri|endpoint|host|algorithm|alg|header|name|path|file|type|length|len|size|count|limit|enabled|id))$"
CLIENT_PREFIX = r"^(VITE_|NEXT_PUBLIC_|REACT_APP_|EXPO_PUBLIC_|NUXT_PUBLIC_)"
PLACEHOLDER = r"(?i)^(<.*>|your[-_].*|x{3,}|\*{3,}|example.*|placeholder|todo|tbd|replace[-_]?me|\.\.\.|\$\{.*\})$"
LOCAL_URL = r"(?i)(localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\])"
PRIVATE_IP = r"\b(10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+)\b"
DEV_HOST = r"(?i)https?://[^/\s]*(dev|staging|stage|test|qa|sandbox)[^/\s]*"
WEAK_VALUES = "secret password changeme change-me admin test default 1234 12345 123456 qwerty letmein key token dev devsecret".split()
AUTH_ENTRY = r"(?i)(^|[/_-])(login|logout|signin|sign-in|signup|sign-up|register|otp|password|passwd|token|refresh|forgot|reset|oauth|callback|verify)([/_-]|$)"
LISTING = r"(?i)(^|_)(list|search|all|index|directory|history)(_|$)|s$"


def secret_name(key: Column) -> Column:
    return key.rlike(SECRET_WORD) & ~key.rlike(NOT_SECRET)


def env_flags(key: Column, value: Column) -> Column:
    """Flags of an environment entry, in a fixed order. Empty and placeholder values bear no further flags but exposure."""
    v = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "^['\"]+|['\"]+$", "")
    empty, placeholder, secret = v == "", v.rlike(PLACEHOLDER), secret_name(key)
    live = ~empty & ~placeholder
    weak = F.lower(v).isin(WEAK_VALUES)
    flags = [
        ("secret-named key exposed to the browser bundle", secret & key.rlike(CLIENT_PREFIX)), ("empty", empty), ("placeholder", ~empty & placeholder),
        ("points at localhost/loopback", live & v.rlike(LOCAL_URL)), ("contains a private IP address", live & v.rlike(PRIVATE_IP)), ("points at a dev/staging/test host", live & v.rlike(DEV_HOST)),
        ("weak/well-known secret value", live & secret & weak), ("short secret (< 16 chars)", live & secret & ~weak & (F.length(v) < 16)),
    ]
    return F.array_compact(F.array(*[F.when(yes, F.lit(name)) for name, yes in flags]))


def route_auth(dependencies: Column, user_token: Column, shared_key: Column) -> Column:
    return F.when(user_token, "user token").when(shared_key, "shared API key only").when(F.size(dependencies) == 0, "NONE").otherwise("deps without user verification")


def route_flags(path: Column, handler: Column, dependencies: Column, identity: Column, user_token: Column, upload: Column) -> Column:
    entry = path.rlike(AUTH_ENTRY) | handler.rlike(AUTH_ENTRY)
    who = F.when(entry, "AUTH ENTRY POINT").when((F.size(identity) > 0) & ~user_token, "CLIENT-ASSERTED IDENTITY")
    return F.array_compact(F.array(who, F.when(upload, F.lit("FILE UPLOAD")), F.when(F.size(dependencies) == 0, F.lit("NO AUTH DEPENDENCY"))))


def unpaginated_listing(method: Column, path: Column, handler: Column, paginated: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(path, r"/+$", ""), "/"), -1)
    return (method == "GET") & ~paginated & (last != "") & ~F.startswith(last, F.lit("{")) & (handler.rlike(LISTING) | last.rlike(LISTING))


def test_path(path: Column) -> Column:
    """Test code by folder or name, for Python and scripts."""
    name = F.element_at(F.split(path, "/"), -1)
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    in_tests = F.arrays_overlap(folders, F.array(*map(F.lit, ["tests", "test", "testing", "__tests__", "e2e"])))
    return in_tests | name.rlike(r"^test_|_tests?\.py$|^(conftest|tests?)\.py$|\.(test|spec)\.[jt]sx?$")
