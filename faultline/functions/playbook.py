"""Known failure modes: keywords, titles and suggested actions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: the playbook, in matching order ----

PLAYBOOK = (
    {
        "keywords": ("out of memory", "oom kill", "killed process", "vmem", "heap space", "memory limit"),
        "title": "Memory exhaustion",
        "solutions": (
            "Restart the affected service to recover, then review its memory limits.",
            "Cap the query or job that consumed the memory — the cited lines name it.",
            "Capture a heap profile to find the cause before simply raising limits.",
        ),
    },
    {
        "keywords": ("connection refused", "connection reset", "unreachable", "no route to host", "econnrefused", "econnreset"),
        "title": "Dependency unreachable",
        "solutions": (
            "Check whether the named dependency (host/port in the cited lines) is up and accepting connections.",
            "Verify network path and DNS between the caller and the dependency.",
            "Fail over to a replica or restart the dependency if it is down.",
        ),
    },
    {
        "keywords": ("retry attempt", "retries exhausted", "retries exceeded", "retrying"),
        "title": "Repeated retries against a failing dependency",
        "solutions": (
            "Find and fix the dependency the retries are aimed at (see the surrounding error lines).",
            "Cap retries with exponential backoff so callers fail fast instead of piling up.",
        ),
    },
    {
        "keywords": ("syntax error at or near", "errors.syntaxerror"),
        "title": "Invalid SQL generated by the pipeline",
        "solutions": (
            "Fix the malformed statement at the cited lines — the logged SQL shows the exact position.",
            "Validate rendered SQL against the database in staging, or with a dry run, before execution.",
            "Re-run the failed task once the statement is corrected so downstream work can be scheduled.",
        ),
    },
    {
        "keywords": ("permission denied", "insufficientprivilege", "forbidden", "unauthorized", "403"),
        "title": "Access denied — credentials or grants",
        "solutions": (
            "Confirm the service account still holds the grants named in the cited lines.",
            "Check whether a credential rotation completed on every consumer, not just some.",
            "Re-run the failed job once access is restored; no data change is needed.",
        ),
    },
    {
        "keywords": ("no module named", "modulenotfounderror", "importerror"),
        "title": "Missing dependency in the deployed image",
        "solutions": (
            "Rebuild and redeploy the image with the missing package pinned in the lock file.",
            "Roll back to the previous image so the job can run while the rebuild happens.",
            "Add an import smoke test to the build so a missing dependency fails at build time.",
        ),
    },
    {
        "keywords": ("checksum mismatch", "validation failed", "verification failed", "manifest"),
        "title": "Data validation failure",
        "solutions": (
            "Compare the failing artefacts against their manifest before releasing anything downstream.",
            "Re-fetch or regenerate the affected files, then re-run the verification step.",
            "Hold downstream delivery until the mismatch is explained — do not override the check.",
        ),
    },
    {
        "keywords": ("does not exist", "undefinedcolumn", "undefinedtable", "schema drift", "no such column"),
        "title": "Database schema mismatch",
        "solutions": (
            "Compare the deployed schema against the expected migration state for the objects named in the cited lines.",
            "Re-run or roll back the migration that left the schema inconsistent, then re-run the failed jobs.",
            "Add a post-migration schema assertion so a partial apply fails loudly instead of silently.",
        ),
    },
    {
        "keywords": ("no space left", "disk full", "disk space", "device full", "% full"),
        "title": "Disk space exhaustion",
        "solutions": (
            "Free space on the affected volume immediately (rotate or ship logs, expire old WAL/archives).",
            "Fix whatever stopped reclaiming space — the cited lines name the process that filled it.",
            "Alert on disk usage well below 100% so this is caught before writes fail.",
        ),
    },
    {
        "keywords": ("pool", "hikari", "connection slots"),
        "title": "Database connection pool exhaustion",
        "solutions": (
            "Increase the database connection pool size (or lower per-request hold time) and restart the affected service.",
            "Check the database server for slow queries or locks that are holding connections open.",
            "Add a circuit breaker / timeout so dependent services fail fast instead of queueing.",
        ),
    },
    {
        "keywords": ("timeout", "timed out"),
        "title": "Downstream timeouts",
        "solutions": (
            "Identify the slow dependency and confirm it is healthy before restarting callers.",
            "Raise or tune the client timeout only after the root bottleneck is fixed.",
        ),
    },
    {
        "keywords": ("deployment", "rollout", "deployed", "new release", "deploy started"),
        "title": "Faulty deployment",
        "solutions": (
            "Roll back to the previous release immediately.",
            "Reproduce the failing request locally against the new build before re-deploying.",
            "Add the failing case to the pre-deploy smoke test suite.",
        ),
    },
    {
        "keywords": ("nullpointer", "traceback", "stack trace", " 500 ", " 502 ", " 503 ", " 504 "),
        "title": "Application errors (HTTP 5xx)",
        "solutions": (
            "Inspect the stack trace at the cited lines and fix the failing code path.",
            "Roll back if the errors began right after a deployment.",
        ),
    },
)

# Names a symptom, so it does not count as a known cause.
GENERIC_TITLE = "Application errors (HTTP 5xx)"

DEFAULT_SOLUTIONS = (
    "Investigate the cited log lines with the owning team.",
    "Check recent changes (deploys, config, infrastructure) around the first occurrence time.",
)

# ---- end of fixed values ----


def playbook_rank(text: Column) -> Column:
    """Number (from 1) of the first playbook entry with a keyword in ``text``, or null."""
    low = F.lower(text)
    tests = []
    for number, item in enumerate(PLAYBOOK, start=1):
        hits = [low.contains(keyword) for keyword in item["keywords"]]
        tests.append(F.when(reduce(or_, hits), number))
    return F.coalesce(*tests)


def playbook_title(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(item["title"]) for item in PLAYBOOK]), rank - 1)


def playbook_solutions(rank: Column) -> Column:
    """Actions of the entry; two general ones without an entry."""
    def texts(items: tuple[str, ...]) -> Column:
        return F.array(*map(F.lit, items))

    listed = F.array(*[texts(item["solutions"][:3]) for item in PLAYBOOK])
    return F.coalesce(F.get(listed, rank - 1), texts(DEFAULT_SOLUTIONS))
