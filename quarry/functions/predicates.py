"""Predicates and labels over paths, texts, addresses and times, on columns. Patterns read alike in Java and RE2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders and names of tests, tooling, client code and pipelines.
TEST_FOLDERS = ["tests", "test", "testing"]
TOOL_FOLDERS = ["migrations", "alembic", "versions"]
TOOL_NAMES = ["setup.py", "manage.py", "noxfile.py"]
TEST_NAME = r"^test_|_test\.py$|^conftest\.py$"
CLIENT_FILE = r"(?i)\.(tsx?|jsx?|vue|svelte|mjs|cjs)$|(^|/)(vite|webpack|next|nuxt|tailwind|postcss|babel)\.config\.|(^|/)(package(-lock)?\.json|yarn\.lock|pnpm-lock\.yaml|tsconfig[^/]*\.json)$"
PIPELINE_NAMES = [".gitlab-ci.yml", "azure-pipelines.yml", "bitbucket-pipelines.yml", ".drone.yml", "cloudbuild.yaml", "cloudbuild.yml"]
PIPELINE_PATH = r"(^|/)jenkinsfile[^/]*$|(^|/)jenkins/|(^|/)\.github/workflows/|^\.circleci/"
# Texts that do not count as a reason.
PERSISTED = r"(?i)\block(ed)?\b|\bflag\b|in[_ -]?progress|background work|\bjob\b|\blease\b|semaphore"
CLEANUP = r"(?i)\bfinally\b|\bexcept\b|context manager|\bwith\b block|cleaned up|clears? the|releases?"
RECOVERY = r"(?i)stale|\bttl\b|expir|startup|on start|heartbeat|\bowner|\blease\b|timeout|not persisted|in[- ]memory only|reset (on|at|when)|reaper|watchdog|advisory lock|transaction[- ]scoped|rolled back"
NON_REASON = (
    r"(?i)\b(budget|out of time|no time|time ran|ran out|partially|not (fully )?(investigated|checked|traced|reviewed)|did not (check|trace|review)|covered (by|in|under) (finding|another)|"
    r"see finding|already (recorded|reported|covered)|will (check|review) later|skipp?ed)\b"
)
SCOPE_REASON = r"(?i)(brief|checklist|baseline|prompt|instructions?|review scope|lead list)s?\b[^.]{0,40}\b(does not|doesn't|do not|never) (list|include|mention|require|cover)"
# How far a defect is reachable, in words.
EXPOSURES = {
    "live": "live — reachable through the running system today",
    "conditional": "reachable, but only under specific conditions",
    "latent": "latent — present in the code, not reachable from any entry point today (one import/route away)",
    "dead": "dead — unused code nothing calls or plans to call",
    "theoretical": "theoretical — needs a future change to the architecture before it can happen",
}
CITATION = r"([\w./\-]+\.[A-Za-z0-9]+):\d+"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def _among(parts: Column, names: list[str]) -> Column:
    return F.arrays_overlap(parts, F.array(*map(F.lit, names)))


def mapped_test_path(path: Column) -> Column:
    """The narrower test of the route maps; ``scalars.test_path`` is that of the signals."""
    return _among(folders(path), TEST_FOLDERS) | base_name(path).rlike(TEST_NAME)


def tooling_path(path: Column) -> Column:
    return _among(F.split(path, "/"), TOOL_FOLDERS) | base_name(path).isin(TOOL_NAMES)


def script_or_test(path: Column, is_script: Column, unreachable: Column) -> Column:
    """Tests, listed scripts, and files below a scripts folder that nothing reaches."""
    return _among(folders(path), ["tests", "test"]) | base_name(path).rlike(TEST_NAME) | is_script | (_among(folders(path), ["scripts"]) & unreachable)


def client_file(path: Column) -> Column:
    return path.rlike(CLIENT_FILE)


def pipeline_file(path: Column) -> Column:
    return F.lower(base_name(path)).isin(PIPELINE_NAMES) | F.lower(path).rlike(PIPELINE_PATH)


def shown_default(key: Column, default: Column, required: Column) -> Column:
    """What a report shows of a variable's default: never a secret itself. Quotes count towards the stored length. The phrases are fixed values."""
    from quarry.functions.scalars import secret_name

    masked = F.when(default.isin("''", '""'), "empty-string default").otherwise(F.concat(F.lit("HARD-CODED DEFAULT ("), (F.length(default) - 2).cast("string"), F.lit(" chars)")))
    return (
        F.when(required, "required (raises if missing)").when(default.isNull(), "no default (None/undefined)")
        .when(secret_name(key) & (default != "<expression>"), masked).otherwise(F.substring(default, 1, 80))
    )


def cleanup_only(claim: Column, note: Column) -> Column:
    """State that outlives the process, called safe by clean-up code alone."""
    return claim.rlike(PERSISTED) & note.rlike(CLEANUP) & ~note.rlike(RECOVERY)


def no_reason(text: Column) -> Column:
    return text.rlike(NON_REASON)


def scope_reason(text: Column) -> Column:
    return text.rlike(SCOPE_REASON)


def exposure_label(exposure: Column) -> Column:
    """In words; unknown ones as they are."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in EXPOSURES.items() for x in pair]), exposure), exposure)


def advisory_group(tool: Column, category: Column, message: Column) -> Column:
    """Advisories of dependencies by package, the message's first word; all others by rule."""
    return F.when((tool == "pip_audit") & (message != ""), F.lower(F.split(message, " ")[0])).otherwise(category)


def cited_paths(text: Column) -> Column:
    """Paths that a text cites as path.ext:line, without leading slashes."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(1)), lambda p: F.regexp_replace(p, "^/+", ""))


def url_fault(url: Column) -> Column:
    """Why an address is refused: its scheme, credentials in it, a host that is no name or number, or one inside the network; null if it is fine."""
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    inside = host.rlike(r"^(localhost|.*\.local|.*\.internal|127\..*|10\..*|192\.168\..*|169\.254\..*|0\.0\.0\.0|172\.(1[6-9]|2[0-9]|3[01])\..*)$")
    return F.when(~url.rlike(r"^https?://"), "scheme").when(url.rlike(r"^https?://[^/]*@"), "credentials").when(~host.rlike(r"^[a-z0-9]([a-z0-9.-]*[a-z0-9])?$"), "host").when(inside, "internal")


def uuid_like(text: Column) -> Column:
    return F.lower(text).rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def duration_label(seconds: Column) -> Column:
    """45s, 3m 20s, 2h 5m."""
    s = seconds.cast("long")
    text = lambda x: F.floor(x).cast("string")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(text(s / 60), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(text(s / 3600), F.lit("h "), text(s % 3600 / 60), F.lit("m")))


def age_label(seconds: Column) -> Column:
    """just now, then whole minutes, hours and days ago."""
    s = seconds.cast("long")
    ago = lambda size, unit: F.concat(F.floor(s / size).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, "just now").when(s < 3600, ago(60, "m")).when(s < 86400, ago(3600, "h")).otherwise(ago(86400, "d"))
