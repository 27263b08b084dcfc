"""DuckDB SQL with the expected result of each registered query.

Written from the operators' meaning, not from their Spark plans: windows run
over whole logs, JSON results are computed from the table columns directly, and
regular expressions are spelled for RE2 (no look-around).
"""

from __future__ import annotations

from catalog import corpora as C

# ------------------------------------------------------------ RE2 fragments

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
S_IN = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
S = f"[{S_IN}]"
D = r"\p{Nd}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{S}+', ''), '{S}+$', '')"


ISO = rf"{D}{{4}}-{D}{{2}}-{D}{{2}}[T ]{D}{{2}}:{D}{{2}}:{D}{{2}}(?:[.,]{D}+)?(?:Z|[+-]{D}{{2}}:?{D}{{2}})?"
CLF = rf"{D}{{2}}/[A-Z][a-z]{{2}}/{D}{{4}}:{D}{{2}}:{D}{{2}}:{D}{{2}}(?: [+-]{D}{{4}})?"
SYSLOG = rf"[A-Z][a-z]{{2}} [ {D}]{D} {D}{{2}}:{D}{{2}}:{D}{{2}}"
# group 1 stands for what look-around would leave out
CLOCK = rf"(?:^|{NW})({D}{{2}}:{D}{{2}}:{D}{{2}}(?:[.,]{D}+)?)(?:$|{NW})"
TIME = (
    f"coalesce(nullif(regexp_extract(raw, {q(ISO)}, 0), ''), nullif(regexp_extract(raw, {q(CLF)}, 0), ''), "
    f"nullif(regexp_extract(raw, {q(SYSLOG)}, 0), ''), nullif(regexp_extract(raw, {q(CLOCK)}, 1), ''))"
)

SHORT = rf"(?i)(?:^|{NW})(?:lvl|level|sev|severity){S}*[=:]{S}*([EWIDFCTN])(?:$|{NW})"
SHORT_LEVEL = (
    f"(case upper(regexp_extract(raw, {q(SHORT)}, 1)) when 'F' then 'CRITICAL' when 'C' then 'CRITICAL' "
    "when 'E' then 'ERROR' when 'W' then 'WARNING' when 'N' then 'INFO' when 'I' then 'INFO' "
    "when 'D' then 'DEBUG' when 'T' then 'DEBUG' end)"
)
WORDS = "CRITICAL|CRIT|PANIC|EMERG|ALERT|FATAL|SEVERE|ERROR|ERR|WARNING|WARN|NOTICE|INFO|DEBUG|TRACE"
TOKEN = rf"(?i)(?:^|[{S_IN}\[\(:])(?:level[=:]{S}*)?({WORDS})(?:[{S_IN}\]\):=,]|$)"


def normal(x: str) -> str:
    return (
        f"(case when {x} in ('WARN', 'WARNING') then 'WARNING' when {x} in ('ERR', 'FAIL', 'SEVERE', 'ERROR') then 'ERROR' "
        f"when {x} in ('FATAL', 'CRIT', 'PANIC', 'EMERG', 'ALERT', 'CRITICAL') then 'CRITICAL' "
        f"when {x} in ('TRACE', 'DEBUG') then 'DEBUG' else 'INFO' end)"
    )


TOKEN_TEXT = f"upper(regexp_extract(raw, {q(TOKEN)}, 1))"
TOKEN_LEVEL = f"(case when {TOKEN_TEXT} <> '' then {normal(TOKEN_TEXT)} end)"
SEVERE = "(?i)out of memory|killed process|no space left on device|kernel panic|segmentation fault|segfault|read-only file system|i/o error"
IS_ERROR = (
    f"(regexp_matches(raw, {q(f'(?:' + chr(34) + f'{S}*|status[=: ])5{D}{{2}}(?:$|{NW})')}) "
    f"or regexp_matches(raw, {q(f'{W}(?:Exception|Error)(?:$|{NW})')}) "
    f"or contains(raw, 'Traceback (most recent call last)') or regexp_matches(raw, {q(SEVERE)}))"
)
IS_WARNING = f"regexp_matches(raw, {q(f'(?:' + chr(34) + f'{S}*|status[=: ])4{D}{{2}}(?:$|{NW})')})"
LEVEL = (
    f"coalesce({SHORT_LEVEL}, {TOKEN_LEVEL}, case when {IS_ERROR} then 'ERROR' end, "
    f"case when {IS_WARNING} then 'WARNING' end, 'INFO')"
)
STOP = (
    "('', 'error', 'warn', 'warning', 'info', 'debug', 'critical', 'fatal', 'trace', 'notice', 'statement', "
    "'duration', 'detail', 'hint', 'context', 'query', 'log', 'state', 'level', 'msg', 'message', 'line', 'task', "
    "'tasks', 'queued', 'running', 'exception', 'caused', 'reason', 'status', 'result', 'note', 'stack', 'file', "
    "'at', 'in', 'the')"
)
NAME = rf"[a-zA-Z][\p{{L}}\p{{N}}_.\-]{{1,40}}"
SOURCE_RES = [
    ("raw", rf"(?i)(?:^|{NW})(?:service|svc|app|component|logger)[=:]{S}*([\p{{L}}\p{{N}}_.\-]+)"),
    ("raw", rf"\[({NAME})\]"),
    ("raw", rf"(?:ERROR|WARN(?:ING)?|INFO|DEBUG|CRITICAL|FATAL){S}+({NAME}){S}+-{S}"),
    ("raw", rf"\]{S}+({NAME}){S}+-{S}"),
    ("left(raw, 70)", rf"(?:^|{S})([a-z][\p{{L}}\p{{N}}_\-]{{2,30}})(?:\[{D}+\])?:{S}"),
]
SOURCE = (
    "(case "
    + " ".join(
        f"when lower(regexp_extract({x}, {q(p)}, 1)) not in {STOP} then regexp_extract({x}, {q(p)}, 1)"
        for x, p in SOURCE_RES
    )
    + " end)"
)
LEADING = rf"(?i)^(?:CRITICAL|FATAL|SEVERE|ERROR|ERR|WARNING|WARN|NOTICE|INFO|DEBUG|TRACE)\]?{S}*[-:]?{S}+"
MESSAGE = strip(
    "regexp_replace(case when time is not null and position(time in raw) <= 8 "
    f"then ltrim(substring(raw, position(time in raw) + length(time)), ' -:[]') else raw end, {q(LEADING)}, '')"
)
CONT = (
    rf"(?i)^{S}+[^{S_IN}]|^Traceback \(most recent call last\)|^Caused by:|"
    rf"^{W}[\p{{L}}\p{{N}}_.]*(?:Error|Exception)(?:$|{NW})"
)


def signature(x: str) -> str:
    return (
        strip(f'''regexp_replace(regexp_replace(regexp_replace({x}, '0x[0-9a-fA-F]+', '<hex>', 'g'), '{D}+(?:[.]{D}+)*', '<n>', 'g'), '"[^"]*"', '"<str>"', 'g')''')
    )


def excerpt(x: str) -> str:
    return f"(case when length({x}) > 300 then left({x}, 300) || '…' else {x} end)"


ERR = "level in ('ERROR', 'CRITICAL')"
LOUD = "level in ('ERROR', 'CRITICAL', 'WARNING')"

# ------------------------------------------------------------- shared steps

EVENT_LINES = C.event_lines_cte()
BOTH = (
    f"{EVENT_LINES}, {C.DOC_LINES_CTE}, lines as materialized (select log_id, pos, line_number, raw from event_lines "
    "union all select log_id, pos, line_number, raw from doc_lines)"
)


def entries_cte(lines: str) -> str:
    return (
        f"timed as materialized (select log_id, pos, line_number, raw, {TIME} as time from {lines}), "
        f"parsed as materialized (select *, {SOURCE} as source, {LEVEL} as level0, {MESSAGE} as message from timed), "
        f"marked as (select *, level0 = 'INFO' and regexp_matches(raw, {q(CONT)}) as cont from parsed), "
        "carried as (select *, last_value(case when not cont then level0 end ignore nulls) over "
        "(partition by log_id order by pos rows between unbounded preceding and current row) as above from marked), "
        "entries as materialized (select log_id, pos, line_number, raw, time, source, "
        "case when cont and above in ('ERROR', 'CRITICAL') then above else level0 end as level, message from carried)"
    )


EVENTS = f"{EVENT_LINES}, {entries_cte('event_lines')}"
DOCS = f"{C.DOC_LINES_CTE}, {entries_cte('doc_lines')}"
ALL = f"{BOTH}, {entries_cte('lines')}"

GROUPS = (
    f"signed as (select *, {signature('message')} as sig, {excerpt('message')} as short from entries where {LOUD}), "
    "groups as materialized (select log_id, level, sig as message_signature, count(*) as count, "
    "coalesce(list_sort(list(distinct source) filter (source <> '')), []) as sources, "
    "(list(time order by pos) filter (time is not null))[1] as first_seen, "
    "(list(time order by pos desc) filter (time <> ''))[1] as last_seen, "
    "(list(short order by pos))[1] as sample_message, list_slice(list(line_number order by pos), 1, 5) as samples, "
    "min(pos) as first_pos from signed group by log_id, level, sig)"
)
TOTALS = (
    f"totals as (select log_id, count(*) as total_lines, count(*) filter ({ERR}) as error_lines, "
    "count(*) filter (level = 'WARNING') as warning_lines from entries group by log_id)"
)
RANKED = (
    f"{EVENTS}, {GROUPS}, {TOTALS}, ordered as (select *, row_number() over (partition by log_id order by "
    f"case when {ERR} then 0 else 1 end, count desc, first_pos) as rank, count(*) over (partition by log_id) as n from groups), "
    "ranked as materialized (select o.*, t.total_lines, t.error_lines, t.warning_lines from ordered o join totals t using (log_id))"
)
FLAT_GROUP = (
    "log_id, level, message_signature, count, array_to_string(sources, ', ') as sources, first_seen, last_seen, "
    "sample_message, array_to_string(samples::varchar[], ',') as sample_line_numbers"
)

PLAYBOOK = [
    ("Memory exhaustion", ["out of memory", "oom kill", "killed process", "vmem", "heap space", "memory limit"]),
    ("Dependency unreachable", ["connection refused", "connection reset", "unreachable", "no route to host", "econnrefused", "econnreset"]),
    ("Repeated retries against a failing dependency", ["retry attempt", "retries exhausted", "retries exceeded", "retrying"]),
    ("Invalid SQL generated by the pipeline", ["syntax error at or near", "errors.syntaxerror"]),
    ("Access denied — credentials or grants", ["permission denied", "insufficientprivilege", "forbidden", "unauthorized", "403"]),
    ("Missing dependency in the deployed image", ["no module named", "modulenotfounderror", "importerror"]),
    ("Data validation failure", ["checksum mismatch", "validation failed", "verification failed", "manifest"]),
    ("Database schema mismatch", ["does not exist", "undefinedcolumn", "undefinedtable", "schema drift", "no such column"]),
    ("Disk space exhaustion", ["no space left", "disk full", "disk space", "device full", "% full"]),
    ("Database connection pool exhaustion", ["pool", "hikari", "connection slots"]),
    ("Downstream timeouts", ["timeout", "timed out"]),
    ("Faulty deployment", ["deployment", "rollout", "deployed", "new release", "deploy started"]),
    ("Application errors (HTTP 5xx)", ["nullpointer", "traceback", "stack trace", " 500 ", " 502 ", " 503 ", " 504 "]),
]


def _solutions_case() -> str:
    from faultline.functions.playbook import DEFAULT_SOLUTIONS, PLAYBOOK as BOOK

    # the actions are plain reference data, looked up by title
    arms = " ".join(f"when {q(b['title'])} then {q(chr(10).join(b['solutions']))}" for b in BOOK)
    return f"(case playbook_title {arms} else {q(chr(10).join(DEFAULT_SOLUTIONS))} end)"


TITLE_CASE = (
    "(case "
    + " ".join(
        "when " + " or ".join(f"contains(low, {q(k)})" for k in words) + f" then {q(title)}"
        for title, words in PLAYBOOK
    )
    + " end)"
)
MATCHED = (
    f"{RANKED}, lowered as (select *, coalesce(nullif(sample_message, ''), message_signature) as sample, "
    "lower(message_signature || ' ' || coalesce(nullif(sample_message, ''), message_signature)) as low from ranked), "
    f"matched as (select *, {TITLE_CASE} as playbook_title from lowered)"
)
CAUSES = (
    f"{MATCHED}, flagged as (select *, coalesce(playbook_title <> 'Application errors (HTTP 5xx)', false) as known from matched), "
    "causes as (select *, row_number() over (partition by log_id order by case when known then 0 else 1 end, "
    f"case when {ERR} then 0 else 1 end, count desc, rank) as cause_rank from flagged)"
)
TITLED = (
    f"{CAUSES}, titled as materialized (select *, coalesce(playbook_title, 'Repeated ' || lower(level) || 's: ' || sample) as title "
    "from causes where level <> 'WARNING' or count >= 3)"
)
MERGED = (
    f"{TITLED}, led as (select *, row_number() over (partition by log_id, title order by cause_rank) as place from titled), "
    "sourced as (select log_id, title, list_sort(list(distinct s)) as sources from (select log_id, title, unnest(sources) as s from titled) u group by 1, 2), "
    "folded as (select log_id, title, min(cause_rank) as best, cast(sum(count) as bigint) as count, "
    "min(nullif(first_seen, '')) as first_seen, max(nullif(last_seen, '')) as last_seen, "
    "flatten(list(case when place = 1 then samples else list_slice(samples, 1, 2) end order by place)) as lines, "
    "bool_or(level = 'CRITICAL') as any_critical from led group by log_id, title), "
    "placed as (select *, row_number() over (partition by log_id order by best) as incident_rank from folded), "
    "merged as materialized (select p.log_id, p.title, p.incident_rank, p.count, p.first_seen, p.last_seen, p.lines, p.any_critical, "
    "l.level as leader_level, l.count as leader_count, l.sample, l.known, l.playbook_title, l.total_lines, l.error_lines, "
    "coalesce(s.sources, []) as sources from placed p join led l on l.log_id = p.log_id and l.title = p.title and l.place = 1 "
    "left join sourced s on s.log_id = p.log_id and s.title = p.title)"
)
SEVERITY = (
    "(case when any_critical then 'critical' when leader_level = 'WARNING' then case when leader_count >= 3 then 'medium' else 'low' end "
    "when error_lines::double / total_lines >= 0.25 then 'critical' "
    "when error_lines::double / total_lines >= 0.08 or error_lines >= 20 then 'high' "
    "when error_lines::double / total_lines >= 0.025 or error_lines >= 5 then 'medium' else 'low' end)"
)
CONFIDENCE = (
    "cast(case when known then case when leader_count >= 3 then 0.95 else 0.9 end "
    "else case when leader_count >= 3 then 0.75 else 0.7 end end as double)"
)
TEXT = (
    "'The logs show ' || count || ' occurrence(s) of this problem affecting ' || "
    "coalesce(nullif(array_to_string(sources, ', '), ''), 'the logs') || "
    "case when first_seen <> '' then ' between ' || first_seen || ' and ' || last_seen else '' end || "
    "'. The recurring message looks like: \"' || sample || '\". This pattern usually means the service could not do its "
    "normal work and requests started failing. The cited lines below are the concrete evidence.'"
)
REASON = "Occurrence of the failing pattern this incident is based on."
CITED = (
    f"{MERGED}, numbered as (select log_id, incident_rank, n, min(i) as i from (select log_id, incident_rank, unnest(lines) as n, "
    "generate_subscripts(lines, 1) as i from merged) u group by 1, 2, 3), "
    "cited as (select log_id, incident_rank, n, row_number() over (partition by log_id, incident_rank order by i) - 1 as place from numbered), "
    "evidence as materialized (select * from cited where place < 4)"
)
STATUS = (
    f"{CITED}, judged as materialized (select *, {SEVERITY} as severity, {CONFIDENCE} as confidence, {TEXT} as explanation from merged), "
    "status as materialized (select t.log_id, t.total_lines, t.error_lines, t.warning_lines, case when exists (select 1 from judged j where j.log_id = t.log_id "
    "and j.severity = 'critical') then 'critical' when t.error_lines > 0 then 'degraded' else 'healthy' end as overall_status from totals t)"
)
LOGS = (
    "logs as materialized (select distinct 'user-' || user_id as log_id, cast(null as varchar) as status from events union all "
    "select distinct 'empty-' || event_type, case event_type when 'error' then 'FAIL' when 'view' then 'PASS' when 'click' then 'UNKNOWN' end from events)"
)
NONE = "cast(null as varchar)"
VERDICT_TEXT = (
    "'The upstream classifier marked ''' || {source} || ''' as ' || {status} || ', but no per-line log entries were provided, so the root cause "
    "cannot be determined from this input alone. Re-submit the raw log file (or the parser''s per-entry JSON) to get a full analysis with evidence.'"
)
VERDICT_STEPS = (
    "'Re-run the analysis with the raw log file so the agent can inspect individual lines.' || chr(10) || "
    "'Upgrade the parser call to return per-entry JSON (time, file, status, description).'"
)


def verdict_rows(source: str, status: str) -> str:
    """Columns after the line counts of a report built from a verdict alone."""
    has = f"{status} <> 'PASS'"

    def when(value: str) -> str:
        return f"case when {has} then {value} end"

    empty = when("''")
    return (
        f"cast({when('0')} as bigint) as place, {when(q('Classifier flagged this log as ') + ' || ' + status)} as title, "
        f"case when {status} = 'FAIL' then 'medium' when {has} then 'low' end as severity, cast({when('0.3')} as double) as confidence, "
        f"{when(VERDICT_TEXT.format(source=source, status=status))} as human_explanation, {when(VERDICT_STEPS)} as possible_solutions, "
        f"{empty} as affected_sources, {NONE} as first_seen, {NONE} as last_seen, {empty} as evidence_lines, {empty} as evidence_text, "
        f"{empty} as evidence_times, {empty} as evidence_sources, {empty} as evidence_reasons"
    )


def verdict_status(status: str) -> str:
    return f"case {status} when 'PASS' then 'healthy' when 'FAIL' then 'degraded' else 'inconclusive' end"


def fixed_incident(text: str, steps: str) -> str:
    return (
        "cast(0 as bigint) as place, 'Analysis could not be completed' as title, 'low' as severity, cast(0 as double) as confidence, "
        f"{text} as human_explanation, {steps} as possible_solutions, '' as affected_sources, {NONE} as first_seen, {NONE} as last_seen, "
        "'' as evidence_lines, '' as evidence_text, '' as evidence_times, '' as evidence_sources, '' as evidence_reasons"
    )


NO_ENTRIES = ("'The input contained no log entries, so there is nothing to analyze.'", "'Check that the log file is not empty and was uploaded correctly.'")
MALFORMED = (
    "'The analysis engine produced a malformed report twice, so no conclusion is available for this run.'",
    "'Re-run the analysis.' || chr(10) || 'If this repeats, check the model deployment configuration.'",
)
UNREACHED = (
    "'The analysis engine (LLM) could not be reached, so the log was not investigated. Technical detail: no report was delivered'",
    "'Check the report writer''s configuration and network access.' || chr(10) || 'Run the built-in analysis, which needs no report.'",
)
RANK = "case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end"
ZERO = "cast(0 as bigint) as total_lines, cast(0 as bigint) as error_lines, cast(0 as bigint) as warning_lines"


def evidence_lists(rows: str, keys: str, order: str) -> str:
    def text(column: str, name: str) -> str:
        return f"string_agg(coalesce({column}::varchar, '-'), chr(10) order by {order}) as {name}"

    return (
        f"(select {keys}, {text('line_number', 'evidence_lines')}, {text('raw', 'evidence_text')}, {text('time', 'evidence_times')}, "
        f"{text('source', 'evidence_sources')}, {text('why', 'evidence_reasons')} from {rows} group by {keys})"
    )


ANALYSIS = (
    f"{STATUS}, {LOGS}, facts as (select v.log_id, v.incident_rank, v.place, e.line_number, e.raw, e.time, e.source, {q(REASON)} as why "
    "from evidence v join entries e on e.log_id = v.log_id and e.line_number = v.n), "
    f"proofs as {evidence_lists('facts', 'log_id, incident_rank', 'place')}, "
    f"sorted as materialized (select *, row_number() over (partition by log_id order by {RANK}, confidence desc, incident_rank) - 1 as spot from judged), "
    "listed as (select s.log_id, s.spot, s.title, s.severity, s.confidence, s.explanation, "
    f"{_solutions_case()} as solutions, array_to_string(s.sources, ', ') as sources, s.first_seen, s.last_seen, "
    "p.* exclude (log_id, incident_rank) from sorted s join proofs p on p.log_id = s.log_id and p.incident_rank = s.incident_rank), "
    "report as materialized ("
    "select t.log_id, t.log_id || '.log' as log_source, t.overall_status, t.total_lines, t.error_lines, t.warning_lines, l.spot as place, l.title, l.severity, "
    "l.confidence, l.explanation as human_explanation, l.solutions as possible_solutions, l.sources as affected_sources, l.first_seen, l.last_seen, "
    "coalesce(l.evidence_lines, case when l.title is not null then '' end) as evidence_lines, l.evidence_text, l.evidence_times, l.evidence_sources, l.evidence_reasons "
    "from status t left join listed l on l.log_id = t.log_id "
    f"union all select log_id, log_id || '.log', {verdict_status('status')}, {ZERO}, {verdict_rows('log_id || ' + q('.log'), 'status')} from logs where log_id like 'empty-%' and status is not null "
    f"union all select log_id, log_id || '.log', 'inconclusive', {ZERO}, {fixed_incident(*NO_ENTRIES)} from logs where log_id like 'empty-%' and status is null)"
)


def brief(sql: str) -> str:
    """The same with the sizes of a short report."""
    whole_to_short = {
        signature("message"): f"left({signature('message')}, 160)",
        " from ordered o join totals t using (log_id))": " from ordered o join totals t using (log_id) where rank <= 10)",
        "|| sample) as title ": "|| left(sample, 60)) as title ",
        "like: \"' || sample || ": "like: \"' || left(sample, 120) || ",
        " and s.title = p.title)": " and s.title = p.title where incident_rank <= 3)",
    }
    for whole, short in whole_to_short.items():
        assert whole in sql
        sql = sql.replace(whole, short)
    return sql


CARD = (
    "{key}r.log_source as file_name, coalesce(upper(left(r.severity, 1)) || substring(r.severity, 2), 'Low') as severity, "
    "case when r.title is not null then r.title || case when c.n > 1 then ' (+' || (c.n - 1) || ' related finding' || case when c.n > 2 then 's' else '' end || ')' else '' end "
    "when r.overall_status = 'healthy' then 'No issues found — this log looks healthy.' else 'Analysis inconclusive — not enough evidence to name a root cause.' end as summary, "
    "case when r.title is not null then r.human_explanation when r.overall_status = 'healthy' then 'Scanned ' || r.total_lines || ' lines: ' || r.error_lines || ' errors and ' || r.warning_lines || ' warnings, nothing actionable.' "
    "else 'The analysis engine could not reach a conclusion for this log.' end as root_cause, "
    "coalesce(r.possible_solutions, '') as recommendations, r.confidence, "
    "replace(r.evidence_lines, chr(10), ',') as evidence_lines, r.affected_sources, r.total_lines, r.error_lines, r.warning_lines, "
    "case when r.title is not null then coalesce((select string_agg(o.title || '|' || upper(left(o.severity, 1)) || substring(o.severity, 2) || '|' || o.human_explanation, chr(10) order by o.place) "
    "from report o where o.log_id = r.log_id and o.place > 0), '') end as other_incidents "
    "from report r join (select log_id, count(title) as n from report group by 1) c using (log_id) "
)
# ------------------------------------------------- classification in DuckDB

PASS_RE = "Marking task as SUCCESS|Task exited with return code 0"
FAIL_RE = r"Marking task as FAILED|Task failed with exception|Task exited with return code [1-9]\p{Nd}*"
CATEGORY_RES = [
    ("SQL_SCHEMA_ERROR", 'relation "[^"]+" does not exist|column [a-z0-9_.]+ does not exist|UndefinedTable|UndefinedColumn'),
    ("SQL_SYNTAX_ERROR", r"syntax error at or near|psycopg2\.errors\.SyntaxError"),
    ("SQL_TYPE_MISMATCH", r"operator does not exist:|cannot be matched|is of type [a-z]+ but expression is of type [a-z]+|psycopg2\.errors\.UndefinedFunction"),
    ("DB_RESOURCE_EXHAUSTION", "high VMem usage|out of memory|OOM|memory limit"),
    ("DB_CONNECTION_ERROR", r"connection to server [^\n]* failed|remaining connection slots are reserved|could not connect|connection reset|broken pipe|OperationalError"),
    ("PERMISSION_ERROR", "permission denied|InsufficientPrivilege|forbidden|unauthorized"),
    ("MODULE_IMPORT_ERROR", "No module named|ImportError|ModuleNotFoundError"),
    ("TIMEOUT", "timed out|timeout|execution timeout|deadline exceeded"),
    ("RETURN_CODE_FAILURE", r"Task exited with return code [1-9]\p{Nd}*|exit code [1-9]\p{Nd}*"),
]


def position(x: str, pattern: str) -> str:
    return (
        f"cast(case when regexp_matches({x}, {q('(?i)' + pattern)}) then "
        f"length(regexp_extract({x}, {q('(?is)^(.*)(?:' + pattern + ')')}, 1)) else -1 end as bigint)"
    )


def category(x: str) -> str:
    arms = " ".join(f"when regexp_matches({x}, {q('(?i)' + p)}) then {q(n)}" for n, p in CATEGORY_RES)
    return f"(case {arms} end)"


SCANNED = (
    f"{C.DOC_LOGS_CTE}, scanned as materialized (select log_id, {position('text', PASS_RE)} as pass_pos, {position('text', FAIL_RE)} as fail_pos, "
    f"{category('text')} as cat from doc_logs)"
)
VERDICTS = (
    f"{SCANNED}, verdicts as (select log_id, case when pass_pos > fail_pos then 'PASS' else 'FAIL' end as status, "
    "case when pass_pos > fail_pos then 'PASS' else coalesce(cat, case when fail_pos >= 0 then 'FAILURE_GENERIC' else 'UNKNOWN' end) end as category from scanned)"
)
AUDIT = (
    f"{VERDICTS}, expected as (select case when toxic = 1 then 'gone-' else 'doc-' end || doc_id as log_id, "
    "case when quality = 1 then 'PASS' else 'FAIL' end as status, case when quality = 1 then 'PASS' when doc_id % 2 = 0 then 'UNKNOWN' else 'TIMEOUT' end as category from labels), "
    "audit as (select e.log_id, e.status, e.category, v.status as actual_status, v.category as actual_category, "
    "e.status is not distinct from v.status and e.category is not distinct from v.category as ok from expected e left join verdicts v using (log_id))"
)

# ------------------------------------------------------- candidate reports

# One row per attempt: variant, attempt, found, first title, problem, status, incident count.
ATTEMPTS = """attempts(v, attempt, found, first_title, problem, overall_status, incident_count) as (values
 (0, 1, true, 'Pool @', null, 'degraded', 1), (1, 1, true, 'Fenced', null, 'critical', 1), (2, 1, true, 'Prose', null, 'degraded', 1),
 (3, 1, false, null, 'no JSON object found', null, 0), (3, 2, true, 'Second', null, 'degraded', 1),
 (4, 1, true, 'Sure', 'confidence', null, 0), (4, 2, true, 'Idle', 'possible_solutions', null, 0),
 (5, 1, true, 'A', null, 'critical', 4), (6, 1, true, null, null, 'healthy', 0), (7, 1, true, 'Lost', null, 'inconclusive', 1),
 (8, 1, true, 'Lax', null, 'degraded', 1), (9, 1, true, 'Bad', 'severity', null, 0), (9, 2, true, 'Half', 'evidence', null, 0),
 (9, 3, true, 'Late', null, 'degraded', 1), (10, 1, true, 'Many', 'possible_solutions', null, 0), (10, 2, true, 'Bare', null, 'degraded', 1),
 (12, 1, false, null, 'no JSON object found', null, 0), (12, 2, true, 'Odd', 'overall_status', null, 0))"""
# Accepted incidents: variant, place as written, title, severity, confidence, cited lines, sources, first seen.
ACCEPTED = """accepted(v, incident_pos, title, severity, confidence, cites, sources, first_seen) as (values
 (0, 1, 'Pool @', 'high', 0.95::double, [1, 999999], '', null), (1, 1, 'Fenced', 'critical', 1, [2, 1], '', null),
 (2, 1, 'Prose', 'medium', 0.25, [1], '', null), (3, 1, 'Second', 'low', 0.6, [2], '', null),
 (5, 1, 'A', 'low', 0.5, [1], '', null), (5, 2, 'B', 'critical', 0.4, [1], '', null), (5, 3, 'C', 'critical', 0.9, [2], '', null),
 (5, 4, 'D', 'high', 0.9, [3], '', null), (7, 1, 'Lost', 'high', 0.8, [999999], '', null), (8, 1, 'Lax', 'high', 0.5, [2, 1], '', null),
 (9, 1, 'Late', 'low', 0.5, [1], '', null), (10, 1, 'Bare', 'low', 0.5, [], 'db, api', 't1'))"""
NOTE = " (Note: the cited log lines could not be verified against the input, so treat this finding with caution.)"
CHECKED = (
    f"{DOCS}, {ATTEMPTS}, {ACCEPTED}, docs as (select 'doc-' || doc_id as log_id, doc_id, doc_id % 13 as v from documents), "
    "incidents as materialized (select d.log_id, d.doc_id, a.incident_pos::bigint as incident_pos, replace(a.title, '@', d.doc_id::varchar) as title, a.severity, a.confidence, a.cites, a.sources, a.first_seen "
    "from docs d join accepted a using (v)), "
    "cited as (select log_id, incident_pos, unnest(cites) as n, generate_subscripts(cites, 1) as i from incidents), "
    "facts as materialized (select c.log_id, c.incident_pos, c.i, e.line_number, e.raw, e.time, e.source, 'cites ' || "
    "case when c.log_id in (select log_id from docs where v = 8) and c.n = 1 then '1.0' else c.n::varchar end as why "
    "from cited c join entries e on e.log_id = c.log_id and e.line_number = c.n), "
    f"proofs as {evidence_lists('facts', 'log_id, incident_pos', 'i')}, "
    "proven as materialized (select i.*, len(i.cites)::bigint as cited_count, coalesce(p.evidence_lines, '') as evidence_lines, coalesce(p.evidence_text, '') as evidence_text, "
    "coalesce(p.evidence_times, '') as evidence_times, coalesce(p.evidence_sources, '') as evidence_sources, coalesce(p.evidence_reasons, '') as evidence_reasons, "
    "len(i.cites) > 0 and p.log_id is null as lost from incidents i left join proofs p on p.log_id = i.log_id and p.incident_pos = i.incident_pos), "
    "judged as materialized (select * exclude (confidence), case when lost then least(confidence, 0.3) else confidence end as confidence, "
    f"'About ' || title || '.' || case when lost then {q(NOTE)} else '' end as human_explanation from proven), "
    f"sorted as (select *, row_number() over (partition by log_id order by {RANK}, confidence desc, incident_pos) - 1 as place from judged), {TOTALS}"
)
PICKED_STATUS = "case when v = 1 or v = 5 then 'critical' when v = 6 then 'healthy' when v = 7 then 'inconclusive' else 'degraded' end"

# -------------------------------------------------------- structured items

TURNS = (
    "turns as (select 'conv-' || conv_id || '-' || turn as log_id, conv_id, turn, role, text, turn % 6 as v, conv_id % 5 as odd from conversations)"
)
FIRST_ITEM = f"""first_item as (select log_id, 0::bigint as pos,
 case v when 0 then turn when 1 then 7 when 3 then 7 when 5 then null else 1 end as number,
 case v when 4 then text when 5 then '' else text end as raw0,
 case v when 0 then '2024-01-01T00:00:00Z' when 1 then '' when 2 then '1700000000' when 3 then 'd' when 4 then '1.0' end as time,
 case v when 4 then 'True' else role end as source,
 case v when 0 then 'WARNING' when 1 then 'ERROR' else 'INFO' end as level,
 case v when 5 then '' else text end as message,
 case v when 4 then 'raw is not a string' when 5 then 'line number is not an integer' end as problem from turns)"""
STRUCTURED = f"""{TURNS}, {FIRST_ITEM}, objects as (
 select log_id, pos, case when problem like 'line%' then null when coalesce(number, 0) = 0 then 1 else number end::bigint as line_number,
  case when problem like 'raw%' then '5' else raw0 end as raw, time, source, level, message, problem from first_item
 union all select log_id, 2, null, 'm', null, null, 'INFO', 'm', 'line number is not an integer' from turns where odd = 2
 union all select log_id, 2, 1, 't', null, null, 'CRITICAL', 't', null from turns where odd = 4),
 plain as (select log_id, '2024-01-01T00:00:0' || (turn % 10) || 'Z ERROR [' || role || '] turn failed' as raw, role, turn from turns)"""

# Blank is what holds nothing but white space; structured turns and verdicts as above, pages are no JSON.
_BLANK = f"regexp_replace(doc, '{S}', '', 'g') = ''"
_LABEL_SOURCE = "case doc_id % 6 when 3 then 'classifier' when 4 then 'None' when 5 then doc_id::varchar else 'doc-' || doc_id || '.log' end"
_LABEL_STATUS = "case doc_id % 6 when 2 then 'UNKNOWN' when 4 then 'NONE' when 5 then 'TRUE' else case when quality = 1 then 'PASS' else 'FAIL' end end"
INTAKE_LINES = C.DOC_LINES_CTE.replace(
    "from documents)",
    f"from documents union all select doc_id, null, doc from ({C.UPLOADS_SQL}) u)",
    1,
)
STRUCTURED_ROWS = (
    "select log_id, pos, line_number, raw, time, source, level, message, problem from objects "
    "union all select log_id, 1, 2, raw, left(raw, 20), role, 'ERROR', '[' || role || '] turn failed', null from plain "
    "union all select log_id, 2, 3, case odd when 0 then '5' when 3 then '[1]' end, null, null, null, null, "
    "case odd when 0 then 'item is bigint' when 1 then 'item is void' else 'item is array' end from turns where odd in (0, 1, 3)"
)
INTAKE = (
    f"{INTAKE_LINES}, {entries_cte('doc_lines')}, {STRUCTURED}, rows_of_lists as materialized ({STRUCTURED_ROWS}), "
    f"taken as materialized (select log_id, log_id || case when doc_id is null then '.up' else '.txt' end as log_source, 'raw' as kind, {NONE} as status from (select *, text as doc from doc_logs) d where not {_BLANK} "
    f"union all select log_id, 'conv-' || conv_id || '.json', 'structured', {NONE} from turns "
    f"union all select 'verdict-doc-' || doc_id, {_LABEL_SOURCE}, 'verdict', {_LABEL_STATUS} from labels), "
    "lined as materialized (select log_id, pos, line_number, raw, time, source, level, message, 'raw' as kind from entries "
    "union all select log_id, pos, line_number, raw, time, source, level, message, 'structured' from rows_of_lists where problem is null), "
    f"refused as materialized (select log_id, cast(null as bigint) as pos, 'reject' as kind, 'uploaded file is empty' as problem, doc as content from (select *, text as doc from doc_logs) d where {_BLANK} "
    "union all select 'page-' || page_id, null, 'reject', case when html is null or trim(html) = '' then 'uploaded file is empty' else 'not a JSON object' end, html from pages "
    "union all select log_id, pos, 'item', problem, raw from rows_of_lists where problem is not null)"
)

# ------------------------------------------------------------------ oracles


def _with(ctes: str, select: str) -> str:
    return f"with {ctes} {select}"


def _line(value: str, name: str) -> str:
    return _with(BOTH, f"select log_id, line_number, {value} as {name} from lines")


SEARCH = (
    "hits as (select log_id, {tag}pos, line_number, level, time, source, " + excerpt("raw") + " as raw from entries{where}), "
    "found as (select * exclude (pos), row_number() over (partition by log_id{by} order by pos) as rank, count(*) over (partition by log_id{by}) as total_matches from hits)"
)


def _batch(base: str, patterns: list[tuple[str, str]]) -> str:
    arms = " union all ".join(
        f"select {q(shown)} as pattern, * from entries where regexp_matches(raw, {q('(?i)' + used)})"
        for shown, used in patterns
    )
    return _with(
        f"{base}, tagged as ({arms}), hits as (select log_id, pattern, pos, line_number, level, time, source, {excerpt('raw')} as raw from tagged), "
        "found as (select * exclude (pos), row_number() over (partition by log_id, pattern order by pos) as rank, count(*) over (partition by log_id, pattern) as total_matches from hits)",
        "select * from found",
    )


FIRST_ERROR = f"firsts as (select log_id, (list(line_number order by pos))[1] as center from entries where {ERR} group by log_id)"

ORACLES: dict[str, str] = {
    "read_log_lines": _with(
        EVENT_LINES,
        "select log_id, row_number() over (partition by log_id order by pos) - 1 as pos, row_number() over (partition by log_id order by pos) as line_number, raw from event_lines",
    ),
    "read_raw_logs": _with(
        EVENT_LINES,
        "select log_id, 'raw' as kind, cast(null as varchar) as classifier_status, string_agg(raw, chr(10) order by pos) || chr(10) as text from event_lines group by log_id",
    ),
    "split_lines": _with(C.DOC_LINES_CTE, "select log_id, line_number, raw from doc_lines"),
    "read_structured_entries": _with(
        STRUCTURED,
        "select log_id, pos, line_number, raw, time, source, level, message, problem from objects "
        "union all select log_id, 1, 2, raw, left(raw, 20), role, 'ERROR', '[' || role || '] turn failed', null from plain "
        "union all select log_id, 2, 3, case odd when 0 then '5' when 3 then '[1]' end, null, null, null, null, "
        "case odd when 0 then 'item is bigint' when 1 then 'item is void' else 'item is array' end from turns where odd in (0, 1, 3)",
    ),
    "coalesce_aliases": _with(STRUCTURED, "select * from objects"),
    "structured_logs": _with(
        TURNS,
        "select log_id, 'conv-' || conv_id || '.json' as log_source, 'structured' as kind, cast(null as varchar) as classifier_status from turns",
    ),
    "read_verdicts": "select 'doc-' || doc_id as log_id, case doc_id % 6 when 3 then 'classifier' when 4 then 'None' when 5 then doc_id::varchar else 'doc-' || doc_id || '.log' end as log_source, "
    "'verdict' as kind, case doc_id % 6 when 2 then 'UNKNOWN' when 4 then 'NONE' when 5 then 'TRUE' else case when quality = 1 then 'PASS' else 'FAIL' end end as classifier_status from labels",
    "route_inputs": "select doc_id, case when doc_id % 13 in (2, 3, 7, 9, 11) then 'object' else 'text' end as origin, "
    "case when doc_id % 13 in (1, 2, 10) then 'verdict' when doc_id % 13 in (5, 11) then 'structured' when doc_id % 13 in (3, 7, 9) then 'reject' else 'raw' end as kind, "
    "case doc_id % 13 when 3 then 'unrecognized JSON shape' when 7 then 'not a JSON object' when 9 then 'not a JSON object' end as problem from documents",
    "intake_logs": _with(INTAKE, "select log_id, log_source, kind, status as classifier_status from taken"),
    "intake_entries": _with(INTAKE, "select log_id, line_number, raw, time, source, level, message, kind from lined"),
    "quarantine": _with(INTAKE, "select log_id, pos, kind, problem, content from refused"),
    "conservation": _with(
        f"{INTAKE}, came as (select kind, count(*) as arrived from taken group by 1 union all select 'reject', count(*) from refused where pos is null "
        "union all select 'item', 3 * count(*) from turns)",
        "select kind, arrived::bigint as arrived, (case kind when 'reject' then 0 when 'item' then (select count(*) from lined where kind = 'structured') else arrived end)::bigint as reported, "
        "(case kind when 'reject' then arrived when 'item' then (select count(*) from refused where pos is not null) else 0 end)::bigint as quarantined, true as balanced from came",
    ),
    "intake_report": _with(
        f"{INTAKE}, counts as (select log_id, count(*) as total_lines, count(*) filter ({ERR}) as error_lines, count(*) filter (level = 'WARNING') as warning_lines from lined group by 1), "
        f"named as (select *, coalesce({TITLE_CASE}, 'Repeated ' || lower(level) || 's: ' || sample) as title from (select *, coalesce(nullif(short, ''), sig) as sample, "
        "lower(sig || ' ' || coalesce(nullif(short, ''), sig)) as low from (select log_id, level, sig, count(*) as count, (list(short order by pos))[1] as short from "
        f"(select log_id, level, pos, {signature('message')} as sig, {excerpt('message')} as short from lined where {LOUD}) s group by 1, 2, 3) g where level <> 'WARNING' or count >= 3) h), "
        "titles as (select log_id, count(distinct title) as n from named group by 1)",
        "select t.log_id, t.log_source, coalesce(total_lines, 0) as total_lines, coalesce(error_lines, 0) as error_lines, coalesce(warning_lines, 0) as warning_lines, "
        "(case when total_lines > 0 then coalesce(n, 0) when t.status = 'PASS' then 0 else 1 end)::bigint as incidents from taken t left join counts using (log_id) left join titles using (log_id)",
    ),
    "quarantine_empty": f"select doc_id, case when regexp_replace(doc, '{S}', '', 'g') = '' then 'uploaded file is empty' end as problem from ({C.UPLOADS_SQL}) u",
    "extract_time": _line(TIME, "time"),
    "extract_short_level": _line(SHORT_LEVEL, "level"),
    "extract_level_token": _line(TOKEN_LEVEL, "level"),
    "infer_error": _with(BOTH, f"select log_id, line_number, raw from lines where {IS_ERROR}"),
    "infer_warning": _with(BOTH, f"select log_id, line_number, raw from lines where {IS_WARNING}"),
    "default_info": _line(LEVEL, "level"),
    "normalize_level": f"select event_id, spelling, {normal('upper(' + strip('spelling') + ')')} as level from (select {", ".join(C.LEVEL_SPELLINGS)} from events) s",
    "extract_source": _line(SOURCE, "source"),
    "clean_message": _with(ALL, "select log_id, line_number, message from parsed"),
    "parse_lines": _with(ALL, "select log_id, line_number, raw, time, source, level0 as level, message from parsed"),
    "message_signature": _with(ALL, f"select log_id, line_number, {signature('message')} as signature from parsed"),
    "trim_excerpt": _line(excerpt("raw"), "excerpt"),
    "inherit_trace_level": _with(ALL, "select log_id, line_number, level from entries"),
    "filter_errors_warnings": _with(EVENTS, f"select * from entries where {LOUD}"),
    "search_logs": _with(
        f"{EVENTS}, " + SEARCH.format(tag="'error|warn|fail' as pattern, ", where=" where regexp_matches(raw, '(?i)error|warn|fail')", by=""),
        "select * from found where rank <= 5",
    ),
    "search_logs_batch": _batch(
        EVENTS,
        [
            ("pool|timed out", "pool|timed out"),
            (r"\bTask\b.*failed", r"\bTask\b.*failed"),
            ("econnrefused", "econnrefused"),
            (r"status=5\d\d", r"status=5\d\d"),
            ("nothing matches this", "nothing matches this"),
        ],
    ),
    "search_documents": _batch(
        DOCS,
        [
            (r"\b(?:die|des|été)\b", rf"(?:^|{NW})(?:die|des|été)(?:$|{NW})"),
            (r"TASK|exit code \d", r"TASK|exit code \p{Nd}"),
        ],
    ),
    "search_pattern_table": _with(
        f"{EVENTS}, {C.search_patterns_cte()}, pairs as (select e.*, a.pattern from entries e join asked a on a.log_id = e.log_id "
        "where a.pattern not like '(unclosed%' and regexp_matches(e.raw, '(?i)' || a.pattern) union select e.*, a.pattern from entries e join asked a on a.log_id is null and regexp_matches(e.raw, '(?i)' || a.pattern)), "
        f"hits as (select log_id, pattern, pos, line_number, level, time, source, {excerpt('raw')} as raw from pairs), "
        "found as (select * exclude (pos), row_number() over (partition by log_id, pattern order by pos) as rank, count(*) over (partition by log_id, pattern) as total_matches from hits)",
        "select * from found",
    ),
    "invalid_pattern_report": _with(
        C.search_patterns_cte(),
        "select log_id, pattern, 'invalid regex: missing ), unterminated subpattern at position 0' as error from asked where pattern like '(unclosed%'",
    ),
    "context_window": _with(
        f"{EVENTS}, {FIRST_ERROR}",
        f"select f.log_id, f.center, e.line_number, e.level, e.time, e.source, {excerpt('e.raw')} as raw, cast(null as varchar) as note "
        "from firsts f join entries e on e.log_id = f.log_id and e.line_number between f.center - 15 and f.center + 15 "
        "union all select log_id, -100, null, null, null, null, null, 'line -100 not found in input' from firsts",
    ),
    "first_samples": _with(
        f"{EVENTS}, {GROUPS}, spread as (select log_id, level, message_signature, unnest(samples) as line_number, generate_subscripts(samples, 1) as rank from groups)",
        "select log_id, level, message_signature, line_number, rank::bigint as rank from spread",
    ),
    "log_stats": _with(
        f"{EVENTS}, {TOTALS}, {LOGS}",
        "select l.log_id, coalesce(total_lines, 0) as total_lines, coalesce(error_lines, 0) as error_lines, coalesce(warning_lines, 0) as warning_lines from logs l left join totals t using (log_id)",
    ),
    "log_overview": _with(
        f"{EVENTS}, {TOTALS}, ends as (select log_id, min(line_number) as first_line, max(line_number) as last_line from entries group by 1)",
        "select * from totals join ends using (log_id)",
    ),
    "error_groups": _with(f"{EVENTS}, {GROUPS}", f"select {FLAT_GROUP}, first_pos from groups"),
    "error_group_report": _with(
        RANKED,
        f"select {FLAT_GROUP}, rank, total_lines, error_lines, warning_lines, 0::bigint as groups_truncated from ranked",
    ),
    "playbook_match": _with(MATCHED, f"select log_id, rank, sample, playbook_title, {_solutions_case()} as solutions from matched"),
    "known_cause_rank": _with(CAUSES, "select log_id, rank, known, cause_rank from causes"),
    "drop_noise_warnings": _with(RANKED, "select log_id, rank, level, count from ranked where level <> 'WARNING' or count >= 3"),
    "fallback_title": _with(TITLED, "select log_id, rank, cause_rank, title from titled"),
    "merge_incidents": _with(
        f"{CITED}, listed as (select log_id, incident_rank, string_agg(n::varchar, ',' order by place) as line_numbers from evidence group by 1, 2)",
        "select log_id, incident_rank, title, leader_level, leader_count, count, array_to_string(sources, ', ') as sources, first_seen, last_seen, "
        "line_numbers, any_critical from merged join listed using (log_id, incident_rank)",
    ),
    "incident_severity": _with(MERGED, f"select log_id, incident_rank, {SEVERITY} as severity from merged"),
    "incident_confidence": _with(MERGED, f"select log_id, incident_rank, {CONFIDENCE} as confidence from merged"),
    "incident_text": _with(MERGED, f"select log_id, incident_rank, {TEXT} as human_explanation from merged"),
    "incident_evidence": _with(CITED, f"select log_id, incident_rank, place, n as line_number, {q(REASON)} as why_relevant from evidence"),
    "overall_status": _with(STATUS, "select log_id, total_lines, error_lines, warning_lines, overall_status from status"),
    "incident_report": _with(ANALYSIS, "select * from report"),
    "brief_report": _with(brief(ANALYSIS), "select * from report"),
    "write_results": _with(ANALYSIS, "select * from report"),
    "summary_line": _with(
        ANALYSIS,
        "select log_id, upper(any_value(overall_status)) || ' — ' || count(title) || ' incident(s), ' || any_value(error_lines) || ' errors / ' || "
        "any_value(warning_lines) || ' warnings in ' || any_value(total_lines) || ' lines' as summary from report group by log_id",
    ),
    "report_cards": _with(ANALYSIS, "select " + CARD.format(key="r.log_id, ") + "where r.place is null or r.place = 0"),
    "cards_with_fallback": _with(
        f"{ANALYSIS}, cards as (select "
        + CARD.format(key="r.log_id, ")
        + "where (r.place is null or r.place = 0) and (r.log_id like 'user-%' or r.title <> 'Analysis could not be completed' or r.title is null))",
        "select l.log_id, l.status as parser_status, l.log_id like 'user-%' as analysed, c.* exclude (log_id) from logs l left join cards c using (log_id)",
    ),
    "fallback_count": _with(LOGS, "select count(*) as files, count(*) filter (log_id like 'empty-%') as failed from logs"),
    "verify_evidence": _with(
        CHECKED,
        "select log_id, incident_pos, cited_count, evidence_lines, evidence_text, evidence_times, evidence_sources, evidence_reasons from proven",
    ),
    "penalize_unverified": _with(CHECKED, "select log_id, incident_pos, confidence, human_explanation from judged"),
    "extract_report_json": _with(
        f"{ATTEMPTS}, docs as (select doc_id, doc_id % 13 as v from documents)",
        "select 'doc-' || doc_id as log_id, attempt::bigint as attempt, found, replace(first_title, '@', doc_id::varchar) as first_title from docs join attempts using (v)",
    ),
    "validate_report": _with(
        f"{ATTEMPTS}, docs as (select doc_id, doc_id % 13 as v from documents)",
        "select 'doc-' || doc_id as log_id, attempt::bigint as attempt, problem, overall_status, incident_count::bigint as incident_count from docs join attempts using (v)",
    ),
    "pick_attempt": _with(
        f"{ATTEMPTS}, docs as (select doc_id, doc_id % 13 as v from documents)",
        "select 'doc-' || doc_id as log_id, (min(attempt) filter (problem is null))::bigint as attempt, "
        "(array_agg(overall_status order by attempt) filter (problem is null))[1] as overall_status from docs join attempts using (v) group by doc_id",
    ),
    "assemble_result": _with(
        CHECKED,
        f"select d.log_id, d.log_id || '.txt' as log_source, {PICKED_STATUS} as overall_status, total_lines, error_lines, warning_lines, s.place, s.title, s.severity, s.confidence, s.human_explanation, "
        "case when s.title is null then null else 'Look at doc ' || d.doc_id || '.' || chr(10) || 'Try again.' end as possible_solutions, s.sources as affected_sources, s.first_seen, cast(null as varchar) as last_seen, "
        "s.evidence_lines, s.evidence_text, s.evidence_times, s.evidence_sources, s.evidence_reasons "
        "from docs d join totals using (log_id) left join sorted s on s.log_id = d.log_id where d.v not in (4, 11, 12) "
        f"union all select log_id, log_id || '.txt', 'inconclusive', total_lines, error_lines, warning_lines, {fixed_incident(*MALFORMED)} from docs join totals using (log_id) where v in (4, 12) "
        f"union all select log_id, log_id || '.txt', 'inconclusive', total_lines, error_lines, warning_lines, {fixed_incident(*UNREACHED)} from docs join totals using (log_id) where v = 11",
    ),
    "last_marker": _with(SCANNED, "select log_id, pass_pos, fail_pos from scanned"),
    "first_category": _with(SCANNED, "select log_id, coalesce(cat, case when fail_pos >= 0 then 'FAILURE_GENERIC' else 'UNKNOWN' end) as category from scanned"),
    "classify_log": _with(VERDICTS, "select * from verdicts"),
    # a document without any line has no row
    "classify_document_lines": _with(VERDICTS, f"select v.* from verdicts v join doc_logs d using (log_id) where regexp_replace(d.text, '{S}', '', 'g') <> ''"),
    "audit_classification": _with(AUDIT, "select * from audit"),
    "audit_failures": _with(AUDIT, "select count(*) as logs, count(*) filter (not ok) as failures from audit"),
    "triage_class": _with(
        f"{EVENTS}, {GROUPS}, {LOGS}, shape as (select log_id, count(*) filter ({ERR}) as e, count(*) filter (level = 'WARNING') as w, "
        f"(list(message_signature order by first_pos) filter ({ERR}))[1] as g from groups group by 1)",
        "select l.log_id, coalesce(e, 0) as error_groups, coalesce(w, 0) as warning_groups, g as earliest_error_group, "
        "case when e > 1 then 'several_groups' when e = 1 then 'one_group' when w > 0 then 'warnings_only' else 'none' end as triage from logs l left join shape s using (log_id)",
    ),
    "error_onset": _with(
        f"{EVENTS}, errors as (select *, coalesce(nullif(source, ''), '(unattributed)') as src from entries where {ERR}), "
        "firsts as (select log_id, src, time, line_number, row_number() over (partition by log_id, src order by pos) as n, pos = min(pos) over (partition by log_id) as prime from errors)",
        "select log_id, src as source, time as first_error_time, line_number as first_error_line, prime as prime_suspect from firsts where n = 1",
    ),
    "pre_onset_context": _with(
        f"{EVENTS}, {FIRST_ERROR}",
        f"select f.log_id, f.center, e.line_number, e.level, e.time, e.source, {excerpt('e.raw')} as raw "
        "from firsts f join entries e on e.log_id = f.log_id and e.line_number between f.center - 15 and f.center",
    ),
}

_MONTH = "(position(left(time, 3) in 'JanFebMarAprMayJunJulAugSepOctNovDec') + 2) // 3"


def _near(candidates: list[str]) -> str:
    listed = ", ".join(f"{{'off': abs(epoch_us({c}) - epoch_us(anchor)), 't': {c}}}" for c in candidates)
    return f"list_min(list_filter([{listed}], lambda c: c.t is not null)).t"


def _on_day(shift: str) -> str:
    return f"try_cast(strftime(anchor + interval '{shift}', '%Y-%m-%d ') || replace(time, ',', '.') as timestamp)"


def _in_year(shift: int) -> str:
    return f"try_cast((year(anchor) + {shift}) || '-' || lpad(({_MONTH})::varchar, 2, '0') || '-' || lpad(trim(substring(time, 5, 2)), 2, '0') || substring(time, 7) as timestamp)"


# Web server times of the corpora carry +0000 only.
EVENT_TIME = (
    f"{EVENTS}, dated as (select *, case when regexp_matches(time, '^\\d{{4}}-') then try_cast(rtrim(replace(replace(time, ',', '.'), 'T', ' '), 'Z') as timestamp) "
    "when regexp_matches(time, '^\\d{2}/') then try_strptime(left(time, 20), '%d/%b/%Y:%H:%M:%S') end as own from entries), "
    "anchored as (select *, coalesce(last_value(own ignore nulls) over (partition by log_id order by pos rows between unbounded preceding and current row), "
    "first_value(own ignore nulls) over (partition by log_id order by pos rows between current row and unbounded following)) as anchor from dated), "
    "happened as materialized (select log_id, line_number, source, level, coalesce(own, case when regexp_matches(time, '^[A-Z]') then "
    f"{_near([_in_year(i) for i in (-1, 0, 1)])} when regexp_matches(time, '^\\d{{2}}:') then {_near([_on_day(d) for d in ('-1 day', '0 day', '1 day')])} end) as happened_at from anchored)"
)
ORACLES["event_time"] = _with(EVENT_TIME, "select log_id, line_number, source, level, epoch_us(happened_at) as micros from happened")
ORACLES["activity"] = _with(
    EVENT_TIME,
    "select epoch_us(date_trunc('hour', happened_at)) as start, epoch_us(date_trunc('hour', happened_at)) + 3600000000 as end, source, level, count(*) as lines from happened "
    "where happened_at is not null group by date_trunc('hour', happened_at), source, level",
)

_SOURCES = (
    f"{EVENTS}, sourced as (select *, coalesce(nullif(source, ''), '(unattributed)') as src from entries), "
    f"activity as (select log_id, src as source, count(*) as total, count(*) filter ({ERR}) as errors, count(*) filter (level = 'WARNING') as warnings, "
    "(list(time order by pos) filter (time <> ''))[1] as first_seen, (list(time order by pos desc) filter (time <> ''))[1] as last_seen, min(pos) as first_pos, "
    f"cast(format('{{:.3f}}', count(*) filter ({ERR})::double / count(*)) as double) as error_rate from sourced group by log_id, src)"
)
ORACLES["source_stats"] = _with(_SOURCES, "select * exclude (first_pos) from activity")
ORACLES["source_report"] = _with(
    f"{_SOURCES}, placed as (select *, row_number() over (partition by log_id order by errors desc, total desc, first_pos) as rank, count(*) over (partition by log_id) as n from activity)",
    "select * exclude (first_pos, n), 0::bigint as sources_truncated from placed",
)
_LABELLED = (
    "labelled as (select 'doc-' || doc_id as log_id, doc_id, case doc_id % 6 when 3 then 'classifier' when 4 then 'None' when 5 then doc_id::varchar else 'doc-' || doc_id || '.log' end as log_source, "
    "case doc_id % 6 when 2 then 'UNKNOWN' when 4 then 'NONE' when 5 then 'TRUE' else case when quality = 1 then 'PASS' else 'FAIL' end end as status from labels)"
)
ORACLES["verdict_only_report"] = _with(
    _LABELLED,
    f"select log_id, log_source, {verdict_status('status')} as overall_status, {ZERO}, {verdict_rows('log_source', 'status')} from labelled",
)
ORACLES["inconclusive_report"] = _with(
    _LABELLED,
    " union all ".join(
        f"select log_id, log_source, 'inconclusive' as overall_status, {ZERO}, {fixed_incident(*reason)} from labelled where doc_id % 3 = {i}"
        for i, reason in enumerate((NO_ENTRIES, MALFORMED, UNREACHED))
    ),
)
_LAST_LINE = (
    f"{EVENT_LINES}, scored as (select log_id, pos, raw, {position('raw', PASS_RE)} as p, {position('raw', FAIL_RE)} as f from event_lines), "
    "ends as (select log_id, (list(p > f order by pos desc) filter (p >= 0 or f >= 0))[1] as passed, bool_or(f >= 0) as failed, "
    + ", ".join(f"bool_or(regexp_matches(raw, {q('(?i)' + p)})) as c{i}" for i, (_, p) in enumerate(CATEGORY_RES))
    + " from scored group by log_id)"
)
ORACLES["classify_lines"] = _with(
    _LAST_LINE,
    "select log_id, case when passed then 'PASS' else 'FAIL' end as status, case when passed then 'PASS' "
    + " ".join(f"when c{i} then {q(n)}" for i, (n, _) in enumerate(CATEGORY_RES))
    + " when failed then 'FAILURE_GENERIC' else 'UNKNOWN' end as category from ends",
)
