"""Reports, ranking, search and sources on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import classify, lookup, reports, search
from faultline.operators.groups import error_group_report, error_groups
from faultline.operators.incidents import build_incidents
from faultline.operators.ranking import head_with_totals, numbered
from faultline.schemas import BRIEF
from faultline.operators.stats import source_stats
from faultline.plans.reporting import analyze_logs, check_reports, text_entries
from faultline.sources import raw_logs, sinks

LOG = "log_id string, log_source string, kind string, classifier_status string, text string"


def make_logs(spark, *rows):
    return spark.createDataFrame([(i, f"{i}.log", "raw", s, t) for i, s, t in rows], LOG)


def analyze(spark, *rows):
    logs = make_logs(spark, *rows)
    results = analyze_logs(logs.drop("text"), text_entries(logs)).collect()
    return {r.log_id: r for r in results}


def test_builtin_analysis(spark):
    pool = "INFO ok\n" * 5 + "".join(
        f"2026-01-01T00:00:0{i}Z ERROR [db] Connection pool exhausted after {i}ms\n" for i in range(4)
    ) + "ERROR Task failed with exception\n" * 6
    found = analyze(
        spark,
        ("pool", None, pool),
        ("quiet", None, "INFO a\nWARN once\n"),
        ("passed", "PASS", ""),
        ("failed", "FAIL", ""),
        ("empty", None, ""),
    )
    top, second = found["pool"].incidents
    assert found["pool"].overall_status == "critical"
    assert top.title == "Database connection pool exhaustion" and top.confidence == 0.95
    assert [e.line_number for e in top.evidence] == [6, 7, 8, 9]
    assert top.evidence[0].raw_text.endswith("after 0ms") and top.affected_sources == ["db"]
    assert second.title == "Repeated errors: Task failed with exception" and second.confidence == 0.75
    assert found["quiet"].overall_status == "healthy" and found["quiet"].incidents == []
    assert found["quiet"].stats.warning_lines == 1
    assert found["passed"].overall_status == "healthy"
    assert found["failed"].overall_status == "degraded"
    assert found["failed"].incidents[0].confidence == 0.3
    assert found["empty"].overall_status == "inconclusive"


def test_groups_over_many_chunks_match_plain_counting(spark):
    rng = random.Random(3)
    step = 50_000  # lines far apart, so that a log spans many chunks
    rows = [
        ("big", i * step, i * step, rng.choice(["ERROR", "WARNING", "INFO"]), rng.choice("abcdefghijklmn"),
         rng.choice(["s1", "s2", "", None]), rng.choice([None, "", f"t{i:04d}"]))
        for i in range(500)
    ]
    entries = spark.createDataFrame(
        rows, "log_id string, pos bigint, line_number bigint, level string, message string, source string, time string"
    ).withColumn("raw", F.col("message"))
    want = {}
    for _, pos, _, level, message, source, time in rows:
        if level == "INFO":
            continue
        g = want.setdefault((level, message), [0, set(), [], time, time])
        g[0] += 1
        g[1] |= {source} - {"", None}
        g[2] = (g[2] + [pos])[:5]
        g[3] = time if g[3] is None else g[3]
        g[4] = time or g[4]
    got = {
        (r.level, r.message_signature): [r["count"], set(r.sources), r.sample_line_numbers, r.first_seen, r.last_seen]
        for r in error_groups(entries).collect()
    }
    assert got == want
    whole = error_group_report(entries).orderBy("rank").collect()
    report = error_group_report(entries, BRIEF).orderBy("rank").collect()
    assert len(whole) == len(want) and whole[0].groups_truncated == 0
    assert len(report) == 10 and report[0].groups_truncated == len(want) - 10
    assert [r[:3] for r in whole[:10]] == [r[:3] for r in report]
    assert report[0].total_lines == 500
    assert [r.level for r in report] == sorted((r.level for r in report))


@pytest.mark.parametrize("sizes", [[], [3], [7, 50]])
def test_ranking_does_not_depend_on_buckets(spark, sizes):
    rows = [("hot" if i % 3 else f"k{i % 9}", (i * 37) % 301, i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, at bigint, weight bigint")
    buckets = [F.expr(f"at div {s}") for s in sizes]
    got = head_with_totals(df, ["key"], [F.col("at")], 4, {"sum": F.col("weight"), "n": F.lit(1)}, buckets)
    want = set()
    for key in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == key)
        total = sum(w for _, w in mine)
        want |= {(key, at, w, i + 1, total, len(mine)) for i, (at, w) in enumerate(mine[:4])}
    assert set(map(tuple, got.collect())) == want


def test_numbering_spans_tasks(spark):
    rows = [("hot" if i % 4 else f"k{i % 12}", (i * 37) % 401) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, at bigint").repartition(7)
    got = numbered(df, ["key"], [F.col("at").desc()]).collect()
    for key in {r[0] for r in rows}:
        mine = sorted((at for k, at in rows if k == key), reverse=True)
        assert sorted((r.rank, r.at) for r in got if r.key == key) == list(enumerate(mine, 1))


def test_incidents_see_every_group(spark):
    """Forty unknown error groups, then one critical group and one known warning that a cut at ten would hide."""
    groups = [("a", "ERROR", f"broken {c}", 50 - i, ["s"], "t1", "t2", f"broken {c}", [i * 10, i * 10 + 1], i * 10)
              for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN")]
    groups += [("a", "CRITICAL", "gone", 1, [], None, None, "gone", [900], 900)]
    groups += [("a", "WARNING", "pool low", 3, ["db"], "t0", "t9", "pool low", [901, 902, 903], 901)]
    groups += [("a", "WARNING", f"HikariPool {i}", 4, [f"n{i}"], "", None, f"HikariPool {i}", [5, 5, 910 + i], 910 + i) for i in range(3)]
    groups = [(*g, [(n, f"raw {n}", "t", "s") for n in g[8]]) for g in groups]
    names = "log_id string, level string, message_signature string, count bigint, sources array<string>, first_seen string, last_seen string, sample_message string, sample_line_numbers array<bigint>, first_pos bigint, samples array<struct<line_number:bigint,raw:string,time:string,source:string>>"
    totals = spark.createDataFrame([("a", 100_000, 1200, 15)], "log_id string, total_lines bigint, error_lines bigint, warning_lines bigint")
    table = spark.createDataFrame(groups, names).repartition(4)
    found = build_incidents(table, totals).orderBy("incident_pos").collect()
    assert len(found) == 42 and [r.incident_pos for r in found] == list(range(1, 43))
    pool = found[0]
    assert pool.title == "Database connection pool exhaustion" and pool.affected_sources == ["db", "n0", "n1", "n2"]
    # the groups of four lead the one of three; repeated line numbers count once
    assert [(e.line_number, e.raw_text) for e in pool.evidence] == [(n, f"raw {n}") for n in (5, 910, 901, 902)]
    assert (pool.first_seen, pool.last_seen) == ("t0", "t9") and "15 occurrence(s)" in pool.human_explanation
    assert [r.title for r in found if r.severity == "critical"] == ["Repeated criticals: gone"]
    brief = build_incidents(table, totals, BRIEF).collect()
    assert sorted(r.title for r in brief) == sorted(r.title for r in found[:3])


def test_rates_round_on_the_binary_value(spark):
    pairs = [(e, t) for t in (16, 48, 80, 400, 2000, 7) for e in range(t + 1) if e % 7 == 1 or t < 100]
    rows = [
        (f"{e}/{t}", "x", i, "ERROR" if i < e else "INFO", None) for e, t in pairs if t < 100 for i in range(t)
    ]
    entries = spark.createDataFrame(rows, "log_id string, source string, pos bigint, level string, time string")
    got = {r.log_id: r.error_rate for r in source_stats(entries).collect()}
    assert got == {f"{e}/{t}": round(e / t, 3) for e, t in pairs if t < 100}


def test_search_and_context(spark):
    entries = text_entries(make_logs(spark, ("a", None, "\n".join(f"line {i} Größe" for i in range(1, 41)))))
    rows = search.search_logs(entries, r"LINE \d+ größe\b").orderBy("rank").collect()
    assert [(r.rank, r.line_number, r.total_matches) for r in rows] == [(i, i, 40) for i in range(1, 41)]
    first = search.search_logs(entries, "line", 3).orderBy("rank").collect()
    assert [(r.rank, r.line_number, r.total_matches) for r in first] == [(i, i, 40) for i in (1, 2, 3)]
    centers = spark.createDataFrame([("a", 2), ("a", 900), ("a", 2)], "log_id string, center bigint")
    around = search.context_window(entries, centers, 0).collect()
    assert sorted(r.line_number for r in around if r.center == 2) == [1, 2, 3]
    assert [r.note for r in around if r.center == 900] == ["line 900 not found in input"]


def incident(**changes):
    base = {
        "title": "T", "severity": "high", "confidence": 0.9, "human_explanation": "E",
        "possible_solutions": ["S"], "evidence": [{"line_number": 1, "why_relevant": "w"}],
    }
    return {k: v for k, v in (base | changes).items() if v is not ...}


def evidence(**changes):
    return incident(evidence=[{"line_number": 1, "why_relevant": "w"} | changes])


@pytest.fixture(scope="module")
def problems(spark):
    cases = {
        "plain": incident(), "text confidence": incident(confidence=" 1e-1 "), "flag": incident(confidence=True),
        "no evidence": incident(evidence=...), "whole float": evidence(line_number=2.0), "digits": evidence(line_number=" 7 "),
        "null first_seen": incident(first_seen=None), "null source": evidence(source=None),
        "bad: severity": incident(severity="urgent"), "bad: confidence": incident(confidence=1.01),
        "bad: confidence nan": incident(confidence="nan"), "bad: title": incident(title=5), "bad: title null": incident(title=None),
        "bad: possible_solutions": incident(possible_solutions=[]), "bad: possible_solutions 4": incident(possible_solutions=list("abcd")),
        "bad: possible_solutions type": incident(possible_solutions=["a", 1]), "bad: evidence": evidence(line_number=1.5),
        "bad: evidence null": incident(evidence=None), "bad: evidence why": evidence(why_relevant=...) ,
        "bad: evidence raw": evidence(raw_text=None), "bad: first_seen": incident(first_seen=3),
        "bad: affected_sources": incident(affected_sources="db"), "bad: human_explanation": incident(human_explanation=...),
    }
    cases["bad: evidence why"]["evidence"][0].pop("why_relevant")
    rows = [(name, 1, json.dumps({"overall_status": "degraded", "incidents": [case]})) for name, case in cases.items()]
    for name, value in {"empty object": {}, "empty text": "", "bad: incidents text": "x", "bad: incidents null": None, "bad: incidents object": {"a": 1}}.items():
        rows.append((name, 1, json.dumps({"overall_status": "degraded", "incidents": value})))
    df = spark.createDataFrame(rows, "log_id string, attempt bigint, content string")
    checked = reports.validate_report(reports.extract_report_json(df)).collect()
    return {r.log_id: r.problem for r in checked}


def test_report_rules(problems):
    assert problems["empty object"] is None and problems["empty text"] is None
    for name, problem in problems.items():
        if name.startswith("bad: "):
            assert problem == name.split()[1], name
        else:
            assert problem is None, name


def test_fabricated_citations_are_dropped(spark):
    logs = make_logs(spark, ("a", None, "INFO fine\nERROR real\n"), ("b", None, "ERROR x\n"))
    content = json.dumps({"overall_status": "degraded", "incidents": [incident(evidence=[{"line_number": 999, "why_relevant": "w"}])]})
    candidates = spark.createDataFrame(
        [("a", 1, "not json"), ("a", 2, content)], "log_id string, attempt bigint, content string"
    )
    found = {r.log_id: r for r in check_reports(logs.drop("text"), text_entries(logs), candidates).collect()}
    got = found["a"].incidents[0]
    assert got.evidence == [] and got.confidence == 0.3 and "could not be verified" in got.human_explanation
    assert found["a"].stats.error_lines == 1
    assert "could not be reached" in found["b"].incidents[0].human_explanation


def test_citations_are_looked_up_without_moving_entries(spark, monkeypatch):
    logs = make_logs(spark, ("a", None, "".join(f"ERROR x{i}\n" for i in range(50))), ("b", None, "INFO y\nINFO z\n"))
    entries = text_entries(logs)
    rows = [("a", 1, [(n, f"w{n}") for n in (1, 50, 51, 7)]), ("b", 1, [(2, "w")]), ("c", 1, [(1, "w")]), ("b", 2, [])]
    cited = spark.createDataFrame(rows, "log_id string, incident_pos bigint, evidence array<struct<line_number:bigint,why_relevant:string>>")
    want = {("a", 1): (4, [(1, "ERROR x0"), (50, "ERROR x49"), (7, "ERROR x6")]), ("b", 1): (1, [(2, "INFO z")]), ("c", 1): (1, []), ("b", 2): (0, [])}
    for room in (lookup.BROADCAST_BYTES, 60):
        monkeypatch.setattr(reports, "only_wanted", lambda *args, room=room: lookup.only_wanted(*args, broadcast_bytes=room))
        found = reports.verify_evidence(cited, entries)
        assert {(r.log_id, r.incident_pos): (r.cited_count, [(e.line_number, e.raw_text) for e in r.evidence]) for r in found.collect()} == want
    wanted = cited.selectExpr("log_id", "explode(evidence.line_number) line_number")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lookup.only_wanted(entries, wanted, ["log_id", "line_number"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and not any("raw" in line for line in shuffles)


def test_structured_evidence_is_the_last_entry_of_its_line(spark):
    logs = make_logs(spark, ("s", None, "")).drop("text").withColumn("kind", F.lit("structured"))
    rows = [("s", i, 1, f"ERROR pool {i}", None, "db", "ERROR", f"pool {i}") for i in range(4)]
    entries = spark.createDataFrame(rows, "log_id string, pos bigint, line_number bigint, raw string, time string, source string, level string, message string")
    (report,) = analyze_logs(logs, entries).collect()
    assert [(e.line_number, e.raw_text) for e in report.incidents[0].evidence] == [(1, "ERROR pool 3")]


def test_classification_of_texts_and_lines(spark):
    texts = {
        "later pass": ("Marking task as FAILED\nmarking task as success", "PASS", "PASS"),
        "later fail": ("Task exited with return code 0 Task exited with return code 12", "FAIL", "RETURN_CODE_FAILURE"),
        "earlier category": ("timeout\npermission denied\n", "FAIL", "PERMISSION_ERROR"),
        "schema": ('relation "x y" does not exist', "FAIL", "SQL_SCHEMA_ERROR"),
        "room": ("the ROOM is full", "FAIL", "DB_RESOURCE_EXHAUSTION"),
        "generic": ("Task failed with exception", "FAIL", "FAILURE_GENERIC"),
        "unknown": ("hello wörld", "FAIL", "UNKNOWN"),
    }
    logs = make_logs(spark, *[(name, None, t) for name, (t, _, _) in texts.items()]).select("log_id", "text")
    want = {name: (s, c) for name, (_, s, c) in texts.items()}
    for verdicts in (classify.classify_log(logs), classify.classify_lines(raw_logs.split_lines(logs))):
        assert {r.log_id: (r.status, r.category) for r in verdicts.collect()} == want


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_reports_come_back_as_they_were_written(spark, tmp_path, fmt):
    logs = make_logs(spark, ("a", "FAIL", ""), ("b", None, "INFO é\nERROR pool exhausted\n"), ("c", None, ""), ("d", "PASS", ""))
    results = analyze_logs(logs.drop("text"), text_entries(logs))
    path = str(tmp_path / "out")
    sinks.write_results(results, path, fmt, "r")
    back = sinks.read_results(spark, path, fmt)
    assert back.where("problem IS NOT NULL").count() == 0
    key = lambda r: r.log_id
    assert sorted(back.select(*results.columns).collect(), key=key) == sorted(results.collect(), key=key)
    with pytest.raises(Exception, match="stats|INVALID|CAST"):
        sinks.write_results(results.withColumn("stats", F.lit("many")), path, fmt, "r")


def test_damaged_reports_are_seen(spark, tmp_path):
    logs = make_logs(spark, ("b", None, "ERROR pool exhausted\n"))
    sinks.write_results(analyze_logs(logs.drop("text"), text_entries(logs)), str(tmp_path / "out"), "json", "r")
    (file,) = (tmp_path / "out" / "run_id=r").glob("part-*.json")
    good = json.loads(file.read_text())
    changes = {
        None: {}, "overall_status": {"overall_status": "fine"}, "incidents": {"incidents": None}, "stats": {"stats": {"total_lines": 1}},
        "severity": {"incidents": [good["incidents"][0] | {"severity": "urgent"}]}, "confidence": {"incidents": [good["incidents"][0] | {"confidence": 1.5}]},
        "possible_solutions": {"incidents": [good["incidents"][0] | {"possible_solutions": []}]},
        "evidence": {"incidents": [good["incidents"][0] | {"evidence": [{"line_number": 1}]}]},
    }
    folder = tmp_path / "damaged" / "run_id=r"
    folder.mkdir(parents=True)
    (folder / "part-0.json").write_text("\n".join([*(json.dumps(good | {"log_id": str(k)} | c) for k, c in changes.items()), "no json"]) + "\n")
    found = {r.log_id: r.problem for r in sinks.read_results(spark, str(tmp_path / "damaged")).collect()}
    assert found == {str(k): k for k in changes} | {None: "analysis_id"}


@pytest.mark.parametrize("chunk_lines", [1, 3, 1000])
def test_patterns_across_lines_are_seen(spark, chunk_lines):
    rng = random.Random(6)
    parts = ['relation "', 'Relation "a', '"', '" does not exist', 'b" DOES not exist', '"" ', "connection to server ", "CONNECTION to server x", " failed", "Task failed with exception", "x", " "]
    breaks = ["\n", "\r\n", "\r", "\x0b", "\u2028", "\n\n", "\r\r\n", "", " "]
    texts = ["y" + "".join(rng.choice(parts) + rng.choice(breaks) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    logs = spark.createDataFrame(list(enumerate(texts)), "log_id string, text string")
    want = {r.log_id: (r.status, r.category) for r in classify.classify_log(logs).collect()}
    got = {r.log_id: (r.status, r.category) for r in classify.classify_lines(raw_logs.split_lines(logs, segments=True), chunk_lines).collect()}
    assert got == want
    plain = raw_logs.split_lines(logs)
    assert raw_logs.split_lines(logs, segments=True).drop("segment").exceptAll(plain).count() == 0 == plain.exceptAll(raw_logs.split_lines(logs, segments=True).drop("segment")).count()


def test_large_files_are_numbered_across_splits(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    texts = {}
    for name, n in (("one.log", 300), ("two.log", 7), ("three.log", 1000)):
        body = "".join(f"{name} line {i}" + ("\r\n" if i % 3 else "\n") + ("\n" if i % 5 == 0 else "") for i in range(n))
        texts[name] = body.replace("line 4", "line\x0b4")
        (logs / name).write_text(texts[name], newline="", encoding="utf-8")
    (logs / "bad.log").write_bytes(b"ERROR caf\xe9 down\n")
    texts["bad.log"] = "ERROR caf� down\n"
    want = {
        (name, i + 1, line) for name, body in texts.items() for i, line in enumerate(body.splitlines()) if line.strip()
    }
    name = F.element_at(F.split("log_id", "/"), -1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for room in (raw_logs.BROADCAST_BYTES, 400):  # one group of files, or several
            lines = raw_logs.read_log_lines(spark, str(logs), room)
            plan = lines._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan.replace("BroadcastExchange", "") and plan.count("FileScan text") == (1 if room > 400 else 8)
            got = [tuple(r) for r in lines.select(name, "line_number", "raw").collect()]
            assert len(got) == len(want) and set(got) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    whole = raw_logs.split_lines(raw_logs.read_raw_logs(spark, str(logs)))
    ids = {r.log_id for r in lines.select("log_id").distinct().collect()}
    assert ids == {r.log_id for r in raw_logs.file_logs(spark, str(logs)).collect()}
    assert ids == {r.log_id for r in raw_logs.read_raw_logs(spark, str(logs)).collect()}
    assert set(map(tuple, whole.select(name, "line_number", "raw").collect())) == want


def test_results_are_written_by_day(spark, tmp_path):
    logs = make_logs(spark, ("a", "FAIL", ""))
    results = analyze_logs(logs.drop("text"), text_entries(logs))
    sinks.write_results(results, str(tmp_path / "out"))
    row = spark.read.json(str(tmp_path / "out")).first()
    assert row.overall_status == "degraded" and len(row.analysis_id) == 36
    assert row.generated_at.startswith(str(row.run_id))


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_a_repeated_run_leaves_the_same_rows(spark, tmp_path, fmt):
    logs = make_logs(spark, ("a", "FAIL", ""), ("b", None, "ERROR x\n"))
    results = analyze_logs(logs.drop("text"), text_entries(logs))
    path = str(tmp_path / "out")

    def ids():
        rows = spark.read.format(fmt).load(path).select("run_id", "log_id", "analysis_id").collect()
        return sorted(map(tuple, rows))

    sinks.write_results(results, path, fmt, "run-1")
    first = ids()
    sinks.write_results(results, path, fmt, "run-1")
    assert ids() == first and len(first) == 2
    sinks.write_results(results.where("log_id = 'a'"), path, fmt, "run-2")
    assert [r for r in ids() if r[0] == "run-1"] == first and len(ids()) == 3
    assert len({r[2] for r in ids()}) == 3
