"""Log corpora derived from the driver tables, for Spark and for DuckDB.

Both engines get the same expressions; only time formats and JSON access
differ.  Every row of a table becomes lines, so the corpora grow with it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import spread

SPARK = {
    "k": "cast(get_json_object(props, '$.k') as bigint)",
    "day": "date_format(ts, 'yyyy-MM-dd')",
    "clock": "date_format(ts, 'HH:mm:ss')",
    "millis": "date_format(ts, 'SSS')",
    "clf": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')",
    "syslog": "date_format(ts, 'MMM dd HH:mm:ss')",
}
DUCKDB = {
    "k": "cast(json_extract_string(props, '$.k') as bigint)",
    "day": "strftime(ts, '%Y-%m-%d')",
    "clock": "strftime(ts, '%H:%M:%S')",
    "millis": "strftime(ts, '%g')",
    "clf": "strftime(ts, '%d/%b/%Y:%H:%M:%S')",
    "syslog": "strftime(ts, '%b %d %H:%M:%S')",
}
# Positions an event may take in its log: line numbers have gaps, as they do
# where blank lines were dropped.
SLOTS = 8


def _case(selector: str, options: list[str]) -> str:
    """The option whose place is ``selector`` modulo the number of options."""
    arms = " ".join(f"when {i} then {o}" for i, o in enumerate(options))
    return f"(case ({selector}) % {len(options)} {arms} end)"


Q = "chr(39)"

_ERRORS = [
    "'Connection pool exhausted: 50/50 in use, waited 30' || k || 'ms'",
    "'Connection to postgres://db-prod:5432/main refused (ECONNREFUSED)'",
    "'Retry attempt ' || k || '/99 after 2000ms'",
    "'syntax error at or near \"col' || k || '\"'",
    "'permission denied for relation accounts_' || k",
    f"'No module named ' || {Q} || 'pyarrow' || {Q}",
    "'checksum mismatch for part 0x1F' || k || 'ab'",
    "'column t' || k || '.amount does not exist'",
    "'No space left on device /var/lib/data' || k",
    "'request timed out after 30001ms txn=' || event_id",
    "'rollout of build ' || k || '.2.1 unhealthy'",
    "'NullPointerException at Handler.java:' || k",
    "'Out of memory: Killed process ' || event_id",
    "'unexpected state \"' || event_type || k || '\" in reconciler'",
    "'book state divergent seq=' || event_id",
    "'ledger imbalance for account ' || event_id || ' shard ' || k",
]
_NOTES = [
    "'Heartbeat: ' || k || ' running'",
    "'duration: 12' || k || ' ms statement: SELECT 1'",
    "'cache eviction rate ' || k || ' high'",
    "'retrying upload part ' || k",
    "'ok, grade E for effort ' || event_id",
    "'disk usage 8' || (k % 10) || '% full'",
    "'WARN threshold ' || k || ' near CRITICAL threshold'",
]
_SERVICES = [
    "'payments-service'", "'auth-service'", "'checkout'", "'inventory.worker'", "'search-api'",
    "'ledger'", "'report_builder'", "'error'", "'node' || (k % 20)",
]


def event_line_selects(d: dict[str, str]) -> list[list[str]]:
    """Nested select lists over ``events``; the last yields the lines ``l0, l1, ...``."""
    iso = "(day || 'T' || clock || '.' || millis || 'Z')"
    comma = "(day || ' ' || clock || ',' || millis)"
    error = "event_type = 'error'"
    level = (
        f"(case when {error} and k % 16 = 12 then 'FATAL' when {error} then 'ERROR' "
        "when event_type = 'purchase' and k % 3 = 0 then 'WARN' "
        "when event_type = 'click' and k % 2 = 0 then 'DEBUG' "
        "when event_type = 'signup' then 'NOTICE' else 'INFO' end)"
    )
    inner = ["'user-' || user_id as log_id", "event_id", "event_type"]
    inner += [f"{d[name]} as {name}" for name in ("k", "day", "clock", "millis", "clf", "syslog")]
    named = [
        "*",
        f"{level} as level",
        f"case when {error} then {_case('k', _ERRORS)} else {_case('k', _NOTES)} end as msg",
        f"{_case('k', _SERVICES)} as svc",
    ]
    status = "(case when event_type = 'error' then 500 + k % 5 when event_type = 'click' then 400 + k % 5 else 200 end)"
    trace = f"case when {error} and event_id % 10 = 8 then "
    formats = [
            f"{iso} || ' ' || level || ' [' || svc || '] ' || msg",
            f"{comma} || ' ' || level || ' app.' || svc || ' - ' || msg",
            "'10.0.0.' || k || ' - - [' || clf || ' +0000] \"GET /api/v1/' || event_type || '/' || event_id || ' HTTP/1.1\" ' || "
            + status + " || ' 51' || k",
            "syslog || ' db-01 postgres[' || (9000 + k) || ']: ' || msg",
            f"'<' || {iso} || '> [SEQ:' || event_id || '] FEED-GW lvl=' || substr(level, 1, 1) || ' code=0x1F' || k || ' msg=\"' || msg || '\"'",
            "day || '|' || clock || '.' || millis || '|SETTLE|SEV=' || substr(level, 1, 1) || '|component=' || svc || '|' || msg",
            f"'{{\"ts\":\"' || {iso} || '\",\"level\":\"' || lower(level) || '\",\"msg\":\"' || event_type || ' ' || k || '\"}}'",
            "clock || ' gateway: upstream status=' || " + status + " || ' route=/x/' || k",
            f"{iso} || ' [' || level || '] pipeline.' || svc || ' - Task ' || case when {error} then 'failed with exception' else 'started' end",
            f"{comma} || ' INFO airflow.task - ' || case when {error} and k % 2 = 0 then 'Marking task as FAILED' "
            "when k % 3 = 0 then 'Task exited with return code ' || (k % 4) else 'Marking task as SUCCESS' end || ' dag=d' || k",
    ]
    rest = [
        f"{trace}'Traceback (most recent call last):' "
        f"when event_id % 10 = 1 and {error} then '   detail: shard ' || k end",
        f"{trace}'  File \"/opt/app/write.py\", line ' || k || ', in <module>' end",
        f"{trace}chr(9) || 'import pyarrow.parquet as pq' end",
        f"{trace}'ModuleNotFoundError: No module named pkg' || (k % 7) end",
        "case when event_id % 17 = 0 then '   ' end",
        "case when event_id % 23 = 0 then 'Caused by: upstream reset' end",
    ]
    early, late = [
        "case event_id % 10 " + " ".join(f"when {i} then {formats[i]}" for i in half) + " end"
        for half in (range(5), range(5, 10))
    ]
    lines = [f"case when early is not null then early else {late} end", *rest]
    return [inner, named, ["*", f"{early} as early"], ["log_id", "event_id", *[f"{x} as l{i}" for i, x in enumerate(lines)]]]


LINES_PER_EVENT = 7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(log_id, pos, line_number, raw)``: one log per user, in time order."""
    rendered = _table(spark, sf_dir, "events")
    for select in event_line_selects(SPARK):
        rendered = rendered.selectExpr(*select)
    return (
        rendered.select(
            "log_id",
            "event_id",
            F.posexplode(F.array(*[f"l{i}" for i in range(LINES_PER_EVENT)])).alias("i", "raw"),
        )
        .where("trim(raw) != ''")
        .select(
            "log_id",
            (F.col("event_id") * SLOTS + F.col("i")).alias("pos"),
            (F.col("event_id") * SLOTS + F.col("i") + 1).alias("line_number"),
            "raw",
        )
    )


def event_lines_cte() -> str:
    table = "events"
    for i, select in enumerate(event_line_selects(DUCKDB)):
        table = f"(select {', '.join(select)} from {table}) as r{i}"
    parts = " union all ".join(
        f"select log_id, event_id * {SLOTS} + {i} as pos, event_id * {SLOTS} + {i} + 1 as line_number, "
        f"l{i} as raw from rendered where trim(l{i}) <> ''"
        for i in range(LINES_PER_EVENT)
    )
    return f"rendered as materialized (select * from {table}), event_lines as ({parts})"


def search_pattern_selects(d: dict[str, str]) -> list[str]:
    """Patterns that each user asks of the own log, some broken, and patterns of all logs."""
    kinds = [
        "'retry attempt ' || (k % 10)",
        "'status=5[0-9]' || (k % 10)",
        "'(unclosed ' || event_type",
        "'permission|timed out'",
        "'[0-9]{5}ms'",
        "event_type || '/' || event_id",
        "'checksum MISMATCH for part 0x[0-9a-f]+'",
    ]
    own = f"select log_id, {_case('event_id', kinds)} as pattern from (select 'user-' || user_id as log_id, event_id, event_type, {d['k']} as k from events) e"
    everyone = "select cast(null as {text}) as log_id, 'rollout of build ' || n_nationkey || '[.]2|^' || n_name as pattern from nation"
    return [own, everyone]


def search_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(log_id, pattern)``; a null log asks all logs."""
    for name in ("events", "nation"):
        _table(spark, sf_dir, name).createOrReplaceTempView(name)
    own, everyone = search_pattern_selects(SPARK)
    return spark.sql(own).unionByName(spark.sql(everyone.format(text="string")))


def search_patterns_cte() -> str:
    own, everyone = search_pattern_selects(DUCKDB)
    return f"asked as materialized ({own} union {everyone.format(text='varchar')})"


# One tail per document, so whole texts carry markers, blanks and odd line ends.
_NL = "chr(10)"
_TAILS = [
    "''",
    f"{_NL} || 'INFO Marking task as SUCCESS' || {_NL}",
    f"{_NL} || 'ERROR Marking task as FAILED' || {_NL}",
    f"{_NL} || 'marking task as failed' || {_NL} || 'Task exited with return code 0'",
    f"{_NL} || 'Task exited with return code 0' || {_NL} || 'Task failed with exception'",
    f"{_NL} || 'relation ' || chr(34) || 'dim_' || doc_id || chr(34) || ' does not exist' || {_NL} || 'Task failed with exception'",
    f"chr(13) || {_NL} || chr(13) || {_NL} || 'psycopg2.errors.SyntaxError: near SELECT' || chr(13) || {_NL} || '  '",
    f"{_NL} || 'connection to server at db' || doc_id || ' failed' || {_NL} || {_NL} || 'done'",
    f"{_NL} || 'FATAL: out of memory' || {_NL} || 'Task exited with return code 137'",
    f"{_NL} || 'operation timed out; unauthorized' || {_NL} || 'Marking task as SUCCESS'",
    f"{_NL} || 'ImportError: no pkg' || {_NL} || 'Task exited with return code 1'",
    f"{_NL} || 'process ended, exit code 3'",
    f"{_NL} || 'relation ' || chr(34) || 'dim_' || {_NL} || {_NL} || doc_id || chr(34) || ' does not exist' || {_NL} || 'Task failed with exception'",
    f"{_NL} || 'connection to server at db' || chr(11) || chr(13) || doc_id || ' failed' || {_NL}",
    f"{_NL} || 'connection to server at db' || {_NL} || ' failed; relation ' || chr(34) || 'a' || {_NL} || chr(34) || 'b' || chr(34) || ' does not exist'",
]
DOC_LOG_COLUMNS = [
    "'doc-' || doc_id as log_id", "doc_id", f"text || {_case('doc_id', _TAILS)} as text"
]


def doc_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(log_id, doc_id, text)``: every document as one whole log text."""
    return _table(spark, sf_dir, "documents").selectExpr(*DOC_LOG_COLUMNS)


DOC_LOGS_CTE = f"doc_logs as materialized (select {', '.join(DOC_LOG_COLUMNS)} from documents)"
DOC_LINES_CTE = (
    DOC_LOGS_CTE + ", doc_lines as materialized (select log_id, doc_id, cast(i - 1 as bigint) as pos, "
    "cast(i as bigint) as line_number, parts[i] as raw from (select log_id, doc_id, parts, "
    "unnest(range(1, len(parts) + 1)) as i from (select log_id, doc_id, "
    "regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') as parts "
    "from doc_logs) a) b where regexp_replace(parts[i], "
    "'[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g') <> '')"
)


# ------------------------------------------------------- small-value corpora

SPELLINGS = [
    "'warn'", "' Warning '", "'ERR'", "'fatal'", "'Crit'", "'PANIC'", "'emerg'", "'ALERT'",
    "'trace'", "'notice'", "'fail'", "'SEVERE'", "'debug'", "'Info'", "'error'", "'CRITICAL'",
    "''", "cast(null as varchar(9))", "'bogus'", "'5'", "chr(9) || 'error' || chr(10)", "'err or'", "'  '",
]
LEVEL_SPELLINGS = ["event_id", f"{_case('event_id', SPELLINGS)} as spelling"]


def level_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr(*LEVEL_SPELLINGS)


_UPLOADS = ["text", "''", "' ' || chr(10) || chr(9)", "{wide}", "'. ' || text"]
UPLOADS = ["'up-' || doc_id as doc_id", _case("doc_id", _UPLOADS) + " as doc"]


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Spark's chr() knows single bytes only
    wide = "'\\u3000' || '\\u2028'"
    return _table(spark, sf_dir, "documents").selectExpr(*[c.format(wide=wide) for c in UPLOADS])


UPLOADS_SQL = f"select {', '.join(UPLOADS)} from documents".format(wide="chr(12288) || chr(8232)")


def mixed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and object documents of every known and unknown shape."""
    shapes = [
        ("text", "@text"),
        ("text", '{"filename":"a-@.log","status":"FAIL"}'),
        ("object", '{"filename":"a-@.log","status":"FAIL"}'),
        ("object", '{"unexpected":"shape @"}'),
        ("text", '{"unexpected":"shape @"}'),
        ("text", ' \n {"entries":[],"status":"x"} '),
        ("text", '{"entries":{"a":1},"other":@}'),
        ("object", "[1,2,@]"),
        ("text", "{broken @text"),
        ("object", "{broken"),
        ("text", '{"entries":"x","filename":null}'),
        ("object", '{"entries":["a line",{"msg":"m @"}]}'),
        ("text", '{"status":"PASS"} and more'),
    ]
    docs = _table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % len(shapes)
    doc = F.coalesce(*[F.when(kind == i, F.lit(shape)) for i, (_, shape) in enumerate(shapes)])
    doc = F.replace(F.replace(doc, F.lit("@text"), "text"), F.lit("@"), F.col("doc_id").cast("string"))
    origin = F.coalesce(*[F.when(kind == i, F.lit(o)) for i, (o, _) in enumerate(shapes)])
    return docs.select("doc_id", origin.alias("origin"), doc.alias("doc"))


def verdict_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = [
        '{"filename":"doc-@.log","status":"@s"}',
        '{"filename":"doc-@.log","status":"@s","category":"X","extra":[1,{"status":"no"}]}',
        '{"filename":"doc-@.log"}',
        '{"status":"@s"}',
        '{"filename":null,"status":null}',
        '{"status":true,"filename":@}',
    ]
    labels = _table(spark, sf_dir, "labels")
    kind = F.col("doc_id") % len(shapes)
    doc = F.coalesce(*[F.when(kind == i, F.lit(shape)) for i, shape in enumerate(shapes)])
    status = F.when(F.col("quality") == 1, "pass").otherwise("Fail")
    doc = F.replace(F.replace(doc, F.lit("@s"), status), F.lit("@"), F.col("doc_id").cast("string"))
    return labels.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("log_id"), doc.alias("doc"))


def expected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that are often wrong; toxic ones name logs that do not exist."""
    passed = F.col("quality") == 1
    return _table(spark, sf_dir, "labels").select(
        F.concat(
            F.when(F.col("toxic") == 1, "gone-").otherwise("doc-"), F.col("doc_id").cast("string")
        ).alias("log_id"),
        F.when(passed, "PASS").otherwise("FAIL").alias("status"),
        F.when(passed, "PASS")
        .when(F.col("doc_id") % 2 == 0, "UNKNOWN")
        .otherwise("TIMEOUT")
        .alias("category"),
    )


def structured_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per conversation turn, with three list items each.

    The first is an object that uses other field names each time, the second a
    plain line, the third something odd.
    """
    turns = _table(spark, sf_dir, "conversations")
    role, body, turn = F.col("role"), F.col("text"), F.col("turn")

    def obj(fixed: str, **named) -> "F.Column":
        inside = F.to_json(F.struct(*[c.alias(n) for n, c in named.items()]))
        return F.concat(F.lit("{" + fixed), F.substring(inside, 2, F.length(inside)))

    first = [
        obj('"time":"2024-01-01T00:00:00Z","level":" warn ",', source=role, message=body, raw=body, line_number=turn),
        obj('"timestamp":"","status":"FAIL","lineno":"7",', file=role, description=body),
        obj('"ts":1700000000,"severity":"","msg":"","line_no":0,', service=role, raw_line=body),
        obj('"datetime":null,"date":"d","loglevel":null,"level":"notice","n":7.9,', component=role, text=body, original=body),
        obj('"raw":5,"time":1.0,"source":true,', body=body),
        obj('"raw":"","message":0,"index":"x7",', origin=role),
    ]
    third = ["5", "null", '{"line_number":"x7","message":"m"}', "[1]", '{"level":"fatal","text":"t","index":true}']
    kind, odd = turn % len(first), F.col("conv_id") % len(third)
    return turns.select(
        F.concat_ws("-", F.lit("conv"), F.col("conv_id").cast("string"), turn.cast("string")).alias("log_id"),
        F.concat(
            F.lit('{"filename":"conv-'),
            F.col("conv_id").cast("string"),
            F.when(F.col("conv_id") % 4 == 0, '.json","log_source":"","entries":[').otherwise('.json","entries":['),
            F.coalesce(*[F.when(kind == i, item) for i, item in enumerate(first)]),
            F.concat(F.lit(',"2024-01-01T00:00:0'), (turn % 10).cast("string"), F.lit("Z ERROR ["), role, F.lit('] turn failed",')),
            F.coalesce(*[F.when(odd == i, F.lit(item)) for i, item in enumerate(third)]),
            F.lit("]}"),
        ).alias("doc"),
    )


def intake_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that may be delivered: whole texts, blank files, structured lists, verdicts, and pages that are no JSON."""
    texts = doc_logs(spark, sf_dir).select("log_id", F.concat("log_id", F.lit(".txt")).alias("log_source"), F.lit("text").alias("origin"), F.col("text").alias("doc"))
    blank = uploads(spark, sf_dir).select(
        F.col("doc_id").alias("log_id"), F.concat("doc_id", F.lit(".up")).alias("log_source"), F.lit("text").alias("origin"), "doc"
    )

    def objects(docs: DataFrame, prefix: str) -> DataFrame:
        return docs.select(
            F.concat(F.lit(prefix), "log_id").alias("log_id"), F.lit(None).cast("string").alias("log_source"), F.lit("object").alias("origin"), "doc"
        )

    pages = _table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), "page_id").alias("log_id"), F.col("html").alias("doc"))
    return (
        texts.unionByName(blank)
        .unionByName(objects(structured_docs(spark, sf_dir), ""))
        .unionByName(objects(verdict_docs(spark, sf_dir), "verdict-"))
        .unionByName(objects(pages, ""))
    )


# ------------------------------------------------------- candidate reports


def _incident(title: str, severity: str, confidence, cites: list, **more) -> dict:
    return {
        "title": title,
        "severity": severity,
        "confidence": confidence,
        "human_explanation": f"About {title}.",
        "possible_solutions": ["Look at doc @.", "Try again."],
        "evidence": [{"line_number": n, "why_relevant": f"cites {n}"} for n in cites],
        "affected_sources": [],
    } | more


def _report(status: str | None, *incidents: dict) -> str:
    report = {"overall_status": status} if status else {}
    return json.dumps(report | ({"incidents": incidents} if incidents else {}))


CANDIDATES = [
    [_report("degraded", _incident("Pool @", "high", 0.95, [1, 999999]))],
    [f"Here it is:\n```json\n{_report('critical', _incident('Fenced', 'critical', 1, [2, 1]))}\n```\nbye {{x}}"],
    [f"Result: {_report('degraded', _incident('Prose', 'medium', 0.25, [1]))} end."],
    ["no report at all", _report("degraded", _incident("Second", "low", 0.6, [2]))],
    [
        _report("degraded", _incident("Sure", "low", 1.2, [1])),
        _report("degraded", _incident("Idle", "low", 0.2, [1], possible_solutions=[])),
    ],
    [
        _report(
            "critical",
            _incident("A", "low", 0.5, [1]),
            _incident("B", "critical", 0.4, [1]),
            _incident("C", "critical", 0.9, [2]),
            _incident("D", "high", 0.9, [3]),
        )
    ],
    [_report("healthy")],
    [_report(None, _incident("Lost", "high", 0.8, [999999]))],
    [_report("degraded", _incident("Lax", "high", "0.5", ["2", 1.0]))],
    [
        _report("degraded", _incident("Bad", "urgent", 0.5, [1])),
        _report("degraded", _incident("Half", "low", 0.5, [14.5])),
        _report("degraded", _incident("Late", "low", 0.5, [1])),
    ],
    [
        _report("degraded", _incident("Many", "low", 0.5, [1], possible_solutions=list("abcd"))),
        _report("degraded", _incident("Bare", "low", 0.5, [], affected_sources=["db", "api"], first_seen="t1", last_seen=None)),
    ],
    [],
    ['{"a":1} {"b":2}', _report("fine", _incident("Odd", "low", 0.5, [1]))],
]


def candidate_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(log_id, attempt, content)``: reports about the document logs."""
    docs = _table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % len(CANDIDATES)
    attempts = F.coalesce(
        *[
            F.when(kind == i, F.array(*map(F.lit, contents)).cast("array<string>"))
            for i, contents in enumerate(CANDIDATES)
        ]
    )
    number = F.col("doc_id").cast("string")
    return docs.select(
        F.concat(F.lit("doc-"), number).alias("log_id"),
        number.alias("number"),
        F.posexplode(attempts).alias("attempt", "content"),
    ).select(
        "log_id",
        (F.col("attempt") + 1).cast("bigint").alias("attempt"),
        F.replace("content", F.lit("@"), "number").alias("content"),
    )
