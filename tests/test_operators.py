"""Ingest, censuses, logs, runs, verdicts, scans, store and streams."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from factloom.functions import compile_args, csource, jsonops, paths
from factloom.operators import census, compile_db, ingest, logs, perfscan, runs, verdict
from factloom.plans.model import View, promote
from factloom.sources import scans
from factloom.sources.store import Store, StoreError, export_lines
from factloom.streaming import feeds
from test_graph import EDGE, FACT, edge, fact, view


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in cols.items()))
    return df.select(expr).collect()[0][0]


# --- functions -----------------------------------------------------------------------------------


def test_paths(spark):
    src = spark.createDataFrame([(x,) for x in ("a/b.c:12", "a/b.c:0", "a:b", "", None, ":5", "x.c")], "s string")
    got = src.select(paths.source_file(F.col("s")), paths.source_bucket(F.col("s")), paths.source_path(F.col("s"))).collect()
    assert [tuple(r) for r in got][:3] == [("a/b.c", "a/b.c", "a/b.c"), ("a/b.c:0", "a/b.c", "a/b.c"), ("a:b", "a", "a:b")]
    assert got[3][0] == got[4][0] == "<unknown-source>" and got[5][0] == ":5" and got[6][0] == "x.c"
    for g, yes, no in (("src/**/*.c", ["src/a.c", "src/x/y/a.c"], ["src/a.h", "lib/src/a.c"]), ("**", ["a", "a/b"], []), ("a?/[bc].h", ["ax/b.h"], ["a/b.h", "ax/d.h"]), ("*.c", ["a.c"], ["x/a.c"])):
        import re

        assert all(re.match(paths.glob_regex(g), p) for p in yes) and not any(re.match(paths.glob_regex(g), p) for p in no)
    assert one(spark, paths.truncated_text(F.col("s"), 3), s="abcdef") == "abc...[TRUNCATED]"
    assert one(spark, paths.line_at(F.col("s"), F.lit(4)), s="a\nb\nc") == 3


def test_json_operations(spark):
    doc = {"z": "x" * 200, "a": [1] * 12, "user": {"Password": "p", "n": [{"api-key": 1}]}}
    df = spark.createDataFrame([(json.dumps(doc),), ("nonsense",), (None,)], "p string")
    p = df.select(jsonops.bounded_payload(F.col("p"), 2, 128)).collect()[0][0]
    assert json.loads(p["preview"]) == {"a": [1] * 8, "user": {"Password": "p", "n": [{"api-key": 1}]}} and p["truncated"]
    red = [r[0] for r in df.select(jsonops.redacted(F.col("p"))).collect()]
    assert json.loads(red[0])["user"] == {"Password": "[REDACTED]", "n": [{"api-key": "[REDACTED]"}]} and red[1] is None and red[2] is None
    assert jsonops.shorten({"a": {"b": {"c": 1}}}, depth=2) == {"a": {"b": "[TRUNCATED]"}}
    assert jsonops.shorten(list(range(60)))[-1] == "[TRUNCATED]" and "_truncated" in jsonops.shorten({str(k): k for k in range(60)})
    assert jsonops.is_subset({"a": {"b": 1}}, {"a": {"b": 1, "c": 2}}) and not jsonops.is_subset({"a": 1}, {"a": True})
    assert df.select(jsonops.counts_of(F.col("p"), ["a", "z"])).collect()[1][0] == {}
    assert jsonops.json_path("a.0.b") == "$.a[0].b"
    for bad in ("", "a..b", "a.*"):
        with pytest.raises(ValueError):
            jsonops.json_path(bad)


SOURCE = """
/* strlen( in a comment */
int f(char *s, char **v) {
    for (size_t i = 0; i < strlen(s); i++) {
        v[i] = malloc(3);
        while (x) { memset(v, 0, 1); }
        v = realloc(v, i + 1);
    }
    free(v); puts("malloc(");
}
"""


def test_c_scan(spark):
    found = {(f["rule_id"][7:], f["line"], f["symbol"], f["severity"], f["confidence"]) for f in csource.scan(SOURCE)}
    assert found == {("STRLEN_IN_LOOP", 4, None, "medium", "high"), ("ALLOC_IN_LOOP", 5, "malloc", "high", "high"), ("NESTED_LOOP", 6, None, "medium", "medium"), ("BULK_MEMORY_IN_LOOP", 6, "memset", "medium", "medium"), ("REALLOC_GROW_ONE", 7, "realloc", "high", "high")}
    assert all(f["function"] == "f" for f in csource.scan(SOURCE))
    assert csource.blanked("a/*x\ny*/b//z\nd") == "a   \n   b   \nd" and csource.blanked('f("q\\"(", c)').split() == ["f(", ",", "c)"]
    files = spark.createDataFrame([("a.c", SOURCE), ("b.c", None), ("c.c", "")], "path string, text string")
    ranked = perfscan.rank_findings(perfscan.scan_sources(files)).orderBy("id").collect()
    assert [r["id"] for r in ranked] == [f"PERF{k:04d}" for k in range(1, 6)] and ranked[0]["severity"] == "high"
    assert rows(perfscan.count_findings(perfscan.scan_sources(files), "severity")) == [("high", 2), ("medium", 3)]
    spans = spark.createDataFrame([("f", 0, 9), ("f", 1, 5), ("f", 2, 5), ("f", 2, 3), ("g", 1, 2)], "k string, start long, end long")
    assert rows(perfscan.containment_depth(spans, ["k"]), "k", "start", "end", "depth") == [("f", 0, 9, 0), ("f", 1, 5, 1), ("f", 2, 3, 2), ("f", 2, 5, 2), ("g", 1, 2, 0)]
    named = spans.withColumn("name", F.concat("k", F.col("start").cast("string"), F.col("end").cast("string")))
    points = spark.createDataFrame([("f", 4), ("f", 8), ("g", 7)], "k string, pos long")
    assert rows(perfscan.innermost(points, named, "k", 3), "k", "pos", "name") == [("f", 4, "f25"), ("f", 8, "f09"), ("g", 7, None)]
    text = "#ifdef A\nx\n#else\ny\n#endif\nz\n"
    assert csource.guards(text) == {2: ("defined(A)", "then", 1), 4: ("else", "else", 3)}
    assert csource.declared_tests("TEST(S, N) {}\n// TEST(X, Y)\nINSTANTIATE_TEST_SUITE_P(P, S, v);") == [("TEST", "S", "N", 1), ("INSTANTIATE_TEST_SUITE_P", "P/S", "*", 3)]
    assert csource.compact_condition(" a \n b ") == "a b" and csource.compact_condition("x" * 600).endswith("...")
    assert csource.fit_condition("branch", "é" * 2000, "then", "a:1").endswith("...") and csource.fit_condition("b", "a", "t", "s") == "a"


# --- ingest --------------------------------------------------------------------------------------


def test_merges(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, None), (None, 1, "q")], "k string, t int, v string")
    assert rows(ingest.latest_per_key(df, ["k"], ["t"])) == [("a", 2, "z"), ("b", 1, None), (None, 1, "q")]
    assert rows(ingest.duplicate_ids(df, "k")) == [("a", 3)]
    merged = ingest.merge_lines(df, "k", F.col("v"))
    assert rows(merged, "k", "n_delivered", "n_lines")[0] == ("a", 3, 3)
    with pytest.raises(ingest.MergeConflict):
        ingest.require_no_conflict(merged)
    spool = spark.createDataFrame([("a", '{"x":1}', 1), ("a", '{"y":2,"x":1}', 1), ("a", "{}", 2), ("b", '{"x":1}', 1), ("b", '{"x":2}', 1), ("c", "{}", 3)], "k string, p string, s int")
    assert rows(ingest.merge_spool(spool, "k", "p", "s"), "k", "payload", "seq", "conflict") == [("a", '{"x":1,"y":2}', 1, False), ("b", '{"x":1}', 1, True), ("c", "{}", 3, False)]


def test_merge_after_build(spark):
    prior = view(spark, [fact("p1", source="a.c:1"), fact("p2", source="b.c:1"), fact("p3", source="b.c:2")], [edge("p1", "p2"), edge("p2", "p3", rid="same")])
    new = view(spark, [fact("n1", source="a.c:5"), fact("p3", source="c.c:1")], [edge("n1", "p2"), edge("n1", "p3", rid="same")])
    out = ingest.merge_after_build(prior, new)
    assert rows(out.facts, "object_id", "source_path") == [("n1", "a.c"), ("p2", "b.c"), ("p3", "c.c")]
    assert rows(out.relatives, "relative_id", "from_fact_id") == [("rel:n1:p2", "n1"), ("same", "p2")]


def test_call_resolution(spark):
    fns = [("m", "main", "a.c", "external"), ("h1", "help", "a.c", "internal"), ("h2", "help", "b.c", "internal"), ("u", "util", "b.c", "external"), ("d1", "dup", "a.c", "external"), ("d2", "dup", "b.c", "external"), ("s", "stat", "b.c", "internal")]
    calls = [("1", "m", "help", None), ("2", "m", "util", "b.c"), ("3", "m", "dup", None), ("4", "m", "stat", None), ("5", "m", "nowhere", None), ("6", "m", "nowhere", "x.c"), ("7", "ghost", "util", None), ("8", "m", "dup", "b.c"), ("9", "m", "help", "b.c")]
    out = ingest.resolve_calls(spark.createDataFrame(calls, "call_id string, caller_id string, callee_name string, referenced_source string"), spark.createDataFrame(fns, "object_id string, object_name string, canonical_source string, linkage string"))
    assert rows(out, "call_id", "outcome", "target_id", "strategy") == [
        ("1", "resolved", "h1", "unique_name"), ("2", "resolved", "u", "exact_source"), ("3", "ambiguous", None, None), ("4", "internal_unresolved", None, None), ("5", "external_unresolved", None, None),
        ("6", "internal_unresolved", None, None), ("7", "missing_caller", None, None), ("8", "resolved", "d2", "exact_source"), ("9", "internal_unresolved", None, None)]
    assert ("resolved", 3, 1) in rows(ingest.resolution_stats(out))


# --- censuses, compile databases -----------------------------------------------------------------


def test_census(spark):
    cols = "path string, size long, mtime_ns long, sha256 string"
    old = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "y"), ("t", 1, 1, "z"), (None, 1, 1, "n")], cols)
    new = spark.createDataFrame([("a", 2, 2, "xx"), ("new", 1, 1, "w"), ("t", 1, 9, "z"), ("t", 1, 9, "z")], cols)
    assert rows(census.census_diff(old, new)) == [("a", "changed"), ("b", "deleted"), ("new", "new")]
    inv = spark.createDataFrame([("h", "x.h", "header", "1", 5, 5, ["a", "b"]), ("a", "a.c", "c_source", "1", 5, 5, []), ("b", "b.c", "c_source", "1", 5, 5, []), ("o", "o.h", "header", "1", 5, 5, [])], "source_id string, rel_path string, source_kind string, sha256 string, size_bytes long, mtime_ns long, included_by array<string>")
    now = spark.createDataFrame([("x.h", 5, 6, "2"), ("a.c", 5, 6, "2"), ("b.c", 5, 6, "1"), ("o.h", 4, 5, "2")], "rel_path string, size_now long, mtime_now long, sha_now string")
    changed = census.changed_sources(inv, now)
    assert rows(changed, "source_id") == [("a",), ("h",), ("o",)]
    assert rows(census.dirty_sources(changed, inv)) == [("a", "a.c", "content_changed", 0), ("b", "b.c", "included_header_changed", 2), ("o", "o.h", "content_changed", 1)]
    files = spark.createDataFrame([("s/a.c", '#include "b.h"\n# include "../no.h"\n#include <x.h>'), ("s/b.h", '#include "inc/c.h"'), ("inc/c.h", '#include "b.h"\n')], "path string, text string")
    pairs = census.include_pairs(files)
    assert rows(pairs) == [("s/a.c", "s/b.h"), ("s/b.h", "inc/c.h")]
    assert rows(census.include_closure(pairs, files.where("path = 's/a.c'"))) == [("inc/c.h", 2), ("s/a.c", 0), ("s/b.h", 1)]
    assert rows(census.invert_includes(pairs), "path", "included_by") == [("inc/c.h", ["s/b.h"]), ("s/a.c", []), ("s/b.h", ["s/a.c"])]
    assert rows(census.under_budget(spark.createDataFrame([(f"f{k}", 10) for k in range(9)], "path string, size long"), 5, 35), "path") == [("f0",), ("f1",), ("f2",)]
    assert rows(census.frozen_violations(old.where("path is not null"), new), "path", "current") == [("a", "xx"), ("b", "")]
    assert rows(census.c_files(spark.createDataFrame([("a.c",), ("b.py",), ("test/c.c",), ("build/d.c",)], "path string"))) == [("a.c",)]
    assert census.content_digest(files.select("path", F.col("text").alias("sha256"))).first()["n_files"] == 3


def test_merge_spool_query_takes_the_first_delivery(spark, monkeypatch):
    from datetime import datetime

    from factloom.plans import catalog

    lines = [("a", '{"x":1,"y":2}', datetime(2024, 1, 2)), ("a", '{"x":1}', datetime(2024, 1, 1)), ("b", '{"x":1}', datetime(2024, 1, 1)), ("b", '{"y":2,"x":1}', datetime(2024, 1, 1)), ("c", "{}", None), (None, "{}", datetime(2024, 1, 1))]
    monkeypatch.setattr(catalog, "table", lambda *_: spark.createDataFrame(lines, "object_id string, payload string, ingested_at timestamp_ntz"))
    assert rows(catalog.merge_spool(spark, ""), "object_id", "payload", "seq", "conflict") == [("a", '{"x":1}', datetime(2024, 1, 1), False), ("b", '{"x":1,"y":2}', datetime(2024, 1, 1), False), ("c", "{}", None, False)]


def test_include_chains_of_any_length(spark):
    links = [(f"h{k}", f"h{k + 1}") for k in range(67)] + [("h67", "h5")]
    out = census.include_closure(spark.createDataFrame(links, "src string, dst string").coalesce(1), spark.createDataFrame([("h0",), (None,)], "path string"))
    assert {r["path"]: r["hop"] for r in out.collect()} == {f"h{k}": k for k in range(68)} and out.count() == 68


def test_compile_db(spark, tmp_path):
    (tmp_path / "args.rsp").write_text("-Iinc -DX")
    rec = [(["cc", "-c", "a.c", "-o", "a.o"], str(tmp_path), "a.c", "a.o", False, 1), (["cc", "@args.rsp", "-c", "a.c"], str(tmp_path), "a.c", "a.o", False, 2), (["cc"], str(tmp_path), "b.c", "", True, 3), (None, "/", "c.c", "", False, 4)]
    df = spark.createDataFrame(rec, "argv array<string>, cwd string, src string, out string, miss boolean, pos int")
    got = compile_db.compile_db(compile_db.entries(df)).collect()
    assert len(got) == 1 and got[0]["file"] == f"{tmp_path}/a.c" and got[0]["arguments"] == ["cc", f"-I{tmp_path}/inc", "-DX", "-c", f"{tmp_path}/a.c"]
    assert compile_args.classify(["cc", "-c", "a.c", "-oa.o"]) == {"srcs": ["a.c"], "out": "a.o", "compile": True}
    assert compile_args.classify(["cc", "-E", "a.c"])["compile"] is False and compile_args.classify(["cc", "a.c", "b.c", "-o", "x"])["out"] == ""
    assert compile_args.clean_flags(["cc", "-Iinc", "-std=c11", "-o", "x", "-O2", "-D", "Y"]) == (["-Iinc", "-std=c11", "-D", "Y"], 3)
    assert compile_args.strip_launcher(["/x/wrap", "cc", "--root", "r", "--", "gcc", "a.c"], "wrap") == ["gcc", "a.c"]
    existing = spark.createDataFrame([(["/x/wrap", "cc", "--", "gcc", "a.c"], "/d", "a.c", None), (["gcc"], "/d", "z.c", None)], "arguments array<string>, directory string, file string, output string")
    assert rows(compile_db.recover(existing, spark.createDataFrame([("a.c",)], "file string"), "wrap"), "file", "arguments") == [("a.c", ["gcc", "a.c"])]
    inv = spark.createDataFrame([(["cc", "a.c", "b.c", "-o", "x"], "/d", False, None, "t")], "argv array<string>, cwd string, miss boolean, reason string, ts string")
    assert rows(compile_db.journal_rows(inv), "src", "out") == [("a.c", ""), ("b.c", "")]


# --- logs, runs, verdicts ------------------------------------------------------------------------


def event(**kw):
    return json.dumps({"schema_version": 2, "event_name": "store.read", "channel": "facts", "timestamp": "2024-01-01T00:00:00.000001Z", "status": "ok", **kw})


def test_logs(spark, tmp_path):
    lines = [event(duration_ms=2, counts={"n": 3}), "", "{broken", "[]", event(status="error"), event(status="error", error_code="E1", timestamp="2024-01-02T00:00:00.000000Z", counts={"n": 4, "m": 1}), event(event_name="bad"), json.dumps({"x": "y" * 70000}), event(error_code="E2", timestamp="2024-01-02T00:00:00.000000Z", status="warning")]
    (tmp_path / "facts.jsonl").write_text("\n".join(lines) + "\n")
    events, issues = scans.event_log(spark, str(tmp_path))
    assert rows(issues, "pos", "issue") == [(3, "malformed_json"), (4, "invalid_schema"), (5, "invalid_schema"), (7, "invalid_schema"), (8, "oversized_line")]
    s = logs.summarize(events, ["file", "pos"])
    assert s["total_events"] == 3 and s["status"] == {"ok": 1, "error": 1, "warning": 1} and s["latest_error_code"] == "E2" and s["counts"] == {"n": 7, "m": 1} and s["duration_ms_total"] == 2.0
    late, _ = scans.event_log(spark, str(tmp_path), "facts", since="2024-01-02T00:00:00.000000Z")
    assert late.count() == 2
    with pytest.raises(ValueError):
        logs.in_window(F.col("x"), "b", "a")
    stream = feeds.stream_log_summary(feeds.log_stream(spark, str(tmp_path)))
    assert rows(feeds.drain(stream, "logtest", "complete"), "status", "n") == [("error", 1), ("ok", 1), ("warning", 1)]


XML = '<testsuites><testsuite name="S"><testcase classname="S" name="a" time="0.0125" status="run"/><testcase classname="S" name="a" time="x"><failure message="boom &gt; 1">t</failure></testcase><testcase classname="S" name="d" status="notrun"/><testcase name="k"><skipped/></testcase></testsuite></testsuites>'


def test_runs(spark, tmp_path):
    (tmp_path / "r1.xml").write_text(XML)
    (tmp_path / "r2.xml").write_text("<testsuites></testsuites>")
    tests = scans.gtest_xml(spark, str(tmp_path / "*.xml"))
    got = [tuple(r) for r in runs.occurrences(tests).orderBy("pos").select("suite", "name", "status", "elapsed_ms", "message", "occurrence").collect()]
    assert got == [("S", "a", "passed", 12, "", 1), ("S", "a", "failed", 0, "boom > 1", 2), ("S", "d", "skipped", 0, "", 1), ("", "k", "skipped", 0, "", 1)]
    both = spark.createDataFrame([("r1",), ("r2",)], "run_id string")
    tally = runs.run_tallies(tests, both)
    assert rows(tally, "run_id", "passed", "failed", "skipped", "overall", "failure", "first_failure") == [("r1", 1, 1, 2, "failed", None, "S.a"), ("r2", 0, 0, 0, "errored", "no_tests_ran", None)]
    assert runs.test_results(tests).first()["results"] == {"S.a": "failed", "S.d": "skipped", "k": "skipped"}
    evidence = tally.join(runs.test_results(tests), "run_id", "left").selectExpr("*", "cast(null as boolean) facts_published", "cast(null as int) boot_exit_code", "3 listed_tests")
    ok = lambda e: {r["run_id"]: r["ok"] for r in verdict.with_verdict(evidence, verdict.run_clauses(e)).collect()}
    assert ok({"overall": "failed", "test": {"name": "S.a", "result": "failed"}}) == {"r1": True, "r2": False}
    assert ok({"facts": {"published": False}}) == {"r1": True, "r2": True} and ok({"boot": {"exited_zero": True}}) == {"r1": False, "r2": False}
    assert ok({"boot": {"listed_tests_min": 3}, "max_failed": 0}) == {"r1": False, "r2": True}
    with pytest.raises(ValueError):
        verdict.run_clauses({"unknown": 1})
    assert scans.listed_tests(spark.createDataFrame([("S.",), ("  a",), ("  b",)], "value string")).first()[0] == 2
    types = promote(spark.createDataFrame([fact("t1", "S_a_Test", "type"), fact("t2", "x", "type", test_suite="Q", test_name="q"), fact("t3", "S_a_Test", "function")], FACT))
    built = runs.test_candidates(types)
    assert rows(built, "suite", "name", "fact_id") == [("Q", "q", "t2"), ("S", "a", "t1")]
    declared = spark.createDataFrame([("S", "a", "t/a.cc", 1), ("S", "z", "t/z.cc", 1), ("V", "v", "extra/v.cc", 1)], "suite string, name string, file string, line int")
    assert tuple(runs.coverage(declared, built).select("declared", "built", "ratio").first()) == (2, 1, 0.5)
    assert rows(runs.union_tests(declared, built), "suite", "name", "is_built") == [("Q", "q", True), ("S", "a", True), ("S", "z", False), ("V", "v", False)]
    turns = spark.createDataFrame([("assistant", [("tool_use", "submit")]), ("assistant", None), ("user", [("tool_use", "submit")])], "type string, content array<struct<type:string,name:string>>")
    assert runs.tool_turns(turns, "submit").count() == 1
    old = spark.createDataFrame([("a", "s", "c", True), ("b", "s", "c", True)], "target_id string, spec_digest string, sources_digest string, proven boolean")
    new = spark.createDataFrame([("a", "s", "c"), ("b", "s", "d"), ("n", "s", "c")], "target_id string, spec_digest string, sources_digest string")
    assert rows(runs.keep_proven(old, new), "target_id", "proven") == [("a", True), ("b", False), ("n", False)]


def test_gtest_xml_in_splits(spark, tmp_path):
    """One large report is read by many tasks, cut between cases wherever the splits fall."""
    cases = [f'<testcase classname="S" name="n{k}" time="{k / 1000}"' + ("/>", f'>\n<failure message="m &lt; {k}">at</failure></testcase>', ' status="run"><skipped message="why"/></testcase>')[k % 3] for k in range(200)]
    want = [("big", k, "S", f"n{k}", ("passed", "failed", "skipped")[k % 3], k, ("", f"m < {k}", "why")[k % 3]) for k in range(200)]
    (tmp_path / "big.xml").write_text(" \n<testsuites><testsuite name='>'>" + "\n".join(cases) + "</testsuite></testsuites>")
    torn = ['<testcase name="a"><failure><![CDATA[<testcase name="in"/>]]></failure></testcase>', "<testcase name='b >'/>", "<testcases/>", '<testcase name="c"/>', '<testcase name="cut"><fail']
    (tmp_path / "torn.xml").write_text("<testsuites>" + "".join(torn))
    want += [("torn", 0, "", "a", "failed", 0, '<testcase name="in"/>'), ("torn", 1, "", "b >", "passed", 0, ""), ("torn", 2, "", "c", "passed", 0, "")]
    (tmp_path / "bad.xml").write_text('<testcase name="a"/><testcase name="b & c"/><testcase name="d"/>')
    settings = {"spark.sql.files.minPartitionNum": "8", "spark.sql.files.openCostInBytes": "1"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert scans.gtest_xml(spark, str(tmp_path / "big.xml")).rdd.getNumPartitions() > 1
        tests = scans.gtest_xml(spark, str(tmp_path / "*.xml"))
        got = rows(tests, "run_id", "pos", "suite", "name", "status", "elapsed_ms", "message")
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert got == sorted(want, key=repr)


def test_report_and_rounds(spark):
    events = spark.createDataFrame([(1, "m1", "r1", "T1", None), (2, "m1", "", "T2", None), (3, "m2", "r2", "", "T3"), (4, "m1", "r9", "T", None)], "event_pos int, match_id string, run_id string, task string, task_id string")
    table = spark.createDataFrame([("r1", "t", "failed", "done"), ("r2", "t", "passed", "done")], "run_id string, task_id string, overall string, state string")
    assert rows(runs.report(events, table), "task_id", "run_id") == [("T1", "r1"), ("T3", "r2")]
    assert rows(runs.runs_of_match(events, table, "m1"), "run_id") == [("r1",)]
    tasks = spark.createDataFrame([(1, "pass"), (1, "fail"), (2, "open"), (3, "pass"), (4, None)], "round int, status string")
    assert rows(verdict.round_verdicts(tasks, ["round"]), "round", "outcome") == [(1, "failure"), (2, "incomplete"), (3, "success"), (4, "incomplete")]


@pytest.mark.parametrize(
    "path,op,value,ok",
    [("a.b", "eq", 1, True), ("a.b", "eq", "1", False), ("a.b", "eq", 1.0, True), ("a.b", "ne", 2, True), ("a.b", "ne", "x", False), ("l.1", "eq", "y", True), ("l.9", "exists", None, False), ("n", "exists", None, True), ("n", "eq", None, True), ("t", "eq", True, True), ("t", "eq", 1, False), ("a.b", "ge", 1, True), ("a.b", "le", 0, False), ("s", "ge", 1, False), ("zz", "ne", 1, False), ("a", "eq", 1, False)],
)
def test_path_clauses(spark, path, op, value, ok):
    doc = '{"a":{"b":1},"l":["x","y"],"n":null,"t":true,"s":"5"}'
    assert one(spark, verdict.path_clause(F.col("p"), path, op, value), p=doc) is ok


# --- store, streams ------------------------------------------------------------------------------


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.current() is None and store.manifest()["fact_count"] == 0
    facts, edges = spark.createDataFrame([fact("a"), fact("b", kind="type")], FACT), spark.createDataFrame([edge("a", "b")], EDGE)
    first = store.publish(facts, edges)
    again = store.publish(facts.orderBy(F.desc("object_id")), edges)
    assert first["snapshot_id"] == again["snapshot_id"] and again["reused"] and not first["reused"]
    assert store.manifest()["relation_kinds"] == {"direct_call": 1} and not [f for f in (tmp_path / "store" / "snapshots").iterdir() if f.name.startswith(".current-")]
    assert rows(store.table("counters").where("what = 'fact_kind'"), "value", "n") == [("function", 1), ("type", 1)]
    store.verify()
    near = store.view().edges_at("to_fact_id").where("to_fact_id = 'b'")
    assert near.count() == 1 and "EqualTo(to_fact_id,b)" in near._jdf.queryExecution().toString() and "relatives_by_to" in near.inputFiles()[0]
    assert rows(store.view().facts, "object_id") == [("a",), ("b",)] and store.view().facts.where("name_cf = 'a'").count() == 1
    with pytest.raises(StoreError, match="duplicate_object_id"):
        store.publish(facts.union(facts), edges)
    with pytest.raises(StoreError, match="endpoint_missing"):
        store.publish(facts.limit(1), edges)
    assert len(store.snapshots()) == 1
    none = lambda c: spark.createDataFrame([], f"{c} string")
    patches = {"fact_upserts": facts.limit(0), "fact_tombstones": spark.createDataFrame([("a",)], "object_id string"), "relative_upserts": edges.limit(0), "relative_tombstones": none("relative_id"), "source_tombstones": none("source_id")}
    over = store.publish_overlay(patches, 1)
    assert store.overlay()["overlay_id"] == over["overlay_id"] == store.publish_overlay(patches)["overlay_id"]
    assert store.overlay(ttl=5, now=over["created_at"] + 60) is None and store.overlay_tables(over["overlay_id"])["fact_tombstones"].count() == 1
    store.publish(facts.limit(1), edges.limit(0))
    assert store.overlay() is None
    store.drop_overlay()
    export_lines(facts.withColumn("fact_kind", F.lit("function")), "object_id", "fact_kind", str(tmp_path / "lines"))
    assert scans.require_sound(scans.stored_lines(spark, str(tmp_path / "lines"))).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"object_id":"a","payload":"{}","payload_sha256":"0"}\n')
    with pytest.raises(scans.CorruptSnapshot):
        scans.require_sound(scans.stored_lines(spark, str(tmp_path / "bad.jsonl")))


def test_tree_digest(spark):
    import hashlib

    from factloom.functions.digest import tree_digest

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def brute(lines, fan):
        level = sorted(sha(f"{sha(x)}:{lines.count(x)}") for x in set(lines))
        digits = 0
        while len(level) > fan * 16**digits and digits < 9:
            digits += 1
        if len(set(lines)) <= fan:
            digits = 0
        while digits > 0:
            parts = {}
            for d in level:
                parts.setdefault(d[:digits], []).append(d)
            level = sorted(p + sha("".join(sorted(ds))) for p, ds in parts.items())
            digits -= 3
        return sha("".join(level))

    many = [(g, f"line {k % 700}") for g, n in (("a", 900), ("b", 3), (None, 40)) for k in range(n)]
    df = spark.createDataFrame([*many, ("c", None)], "g string, line string")
    for fan in (4, 4096):
        got = {r["g"]: (r["digest"], r["n"]) for r in tree_digest(df.repartition(5), ["g"], fan).collect()}
        assert got == {g: (brute([x for k, x in many if k == g], fan), n) for g, n in (("a", 900), ("b", 3), (None, 40))}
    assert tree_digest(df.where("false"), []).first()["digest"] == sha("")
    assert tree_digest(df, []).first()["digest"] == tree_digest(df.orderBy("line"), []).first()["digest"]


def test_file_scans(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.c").write_text("int a;")
    (tmp_path / "src/b.h").write_text("int b;")
    tree = scans.file_tree(spark, str(tmp_path), ["src/*.c"])
    assert rows(scans.census(tree), "path", "size") == [("src/a.c", 6)] and rows(scans.source_texts(tree)) == [("src/a.c", "int a;")]
    (tmp_path / "j.jsonl").write_text('{"argv":["cc"],"cwd":"/","src":"a.c"}\nnope\n[1]\n')
    assert rows(scans.compile_journal(spark, str(tmp_path / "j.jsonl")), "src", "pos") == [("a.c", 1)]
    (tmp_path / "m.jsonl").write_text('{"event":"e","match_id":"m1","run_id":"r"}\nnope\n{"event":"e","match_id":"m2"}\n')
    assert rows(scans.match_journal(spark, str(tmp_path / "m.jsonl"), "m1"), "run_id") == [("r",)]
    (tmp_path / "o.json").write_text('{"a":1}')
    assert scans.json_object(spark, str(tmp_path / "o.json")) == {"a": 1} and scans.json_object(spark, str(tmp_path / "none.json")) is None
    assert rows(scans.catalog(spark.createDataFrame([("n", "a"), ("n", "b"), ("o", "c")], "name string, file string")), "file", "conflict") == [("a", True), ("b", True), ("c", False)]


def test_streams_equal_their_batch_twins(spark, tmp_path):
    day = 86_400_000_000
    seen = [("p", "x", 1), ("p", "x", 2), ("p", "y", 3), ("q", "z", 1), ("p", "x", 4), (None, "x", 1), ("end", "e", 9)]
    df = spark.createDataFrame([(p, s, n * day) for p, s, n in seen], "path string, sha256 string, seq long")
    for part in ([4, 6], [2, 5], [0, 1, 3], [6]):  # the latest come first: a day of grace is not enough for them, ten are
        df.where(F.col("seq").isin([seen[k][2] * day for k in part]) & F.coalesce(F.col("path").isin([seen[k][0] for k in part if seen[k][0]]), F.lit(True))).coalesce(1).write.mode("append").parquet(str(tmp_path / "obs"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "obs"))
    got = feeds.drain(feeds.stream_changes(stream.union(stream.where("false")), "3 days"), "changes")
    want = rows(feeds.batch_changes(df.where(f"seq <= {6 * day}")))
    assert rows(got.distinct()) == want == [("p", "x", "y", 4 * day), ("p", "y", "x", 3 * day)]
    recs = spark.createDataFrame([("s", "exec", "stopped", 2), ("s", "result", "running", 1), ("t", "notify", "x", 1)], "session string, kind string, name string, seq long")
    recs.write.parquet(str(tmp_path / "recs"))
    states = feeds.drain(feeds.stream_session_states(spark.readStream.schema(recs.schema).parquet(str(tmp_path / "recs"))), "sessions", "update")
    assert rows(states, "session", "state") == [("s", "stopped"), ("t", "created")]


def test_upsert_sink(spark, tmp_path):
    at = str(tmp_path / "sink")
    sink = feeds.upsert_sink(spark, at, ["k"], ["seq"], compact_every=2)
    want = {}
    for batch in range(7):
        part = [(f"k{(batch * 3 + j) % 5}", batch * 10 + j) for j in range(4)]
        for again in range(2):  # a batch that runs again changes nothing
            sink(spark.createDataFrame(part, "k string, seq long"), batch)
        want |= dict(part)
        assert dict(rows(feeds.read_upserts(spark, at, ["k"], ["seq"]))) == want
    assert (tmp_path / "sink/current").read_text() == "5" and len(list((tmp_path / "sink/delta").iterdir())) <= 4
    once = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "k string, r int")
    assert feeds.once_per(once, ["k", "r"]).count() == 2


def test_debugger_lines():
    from factloom.functions import mi

    r = mi.parse('12^done,stack=[frame={level="0",func="main",line="3"}],value="a\\nb"')
    assert (r["token"], r["kind"], r["class"]) == (12, "result", "done")
    assert json.loads(r["results"]) == {"stack": [{"frame": {"level": "0", "func": "main", "line": "3"}}], "value": "a\nb"}
    assert mi.parse('~"hello\\n"')["text"] == "hello\n" and mi.parse('~"hello"')["kind"] == "console" and mi.quote('a"b\\c') == '"a\\"b\\\\c"'
    assert mi.parse("(gdb)") is None and mi.parse("") is None and mi.parse(None) is None and mi.parse("7")["token"] == 7
    assert json.loads(mi.parse('*stopped,x="1",x={},x=[],bad')["results"]) == {"x": ["1", {}, []]}


def test_work_items_and_states(spark):
    from factloom.operators import perfscan

    def work(text):
        if text == "bad":
            raise KeyError("k")
        return [{"n": len(text), "extra": 1}]

    files = spark.createDataFrame([("a", "xy"), ("b", "bad"), ("c", None)], "path string, text string")
    out = {r["path"]: (r["error"], [x["n"] for x in r["rows"]]) for r in ingest.map_files(files, work, "n int").collect()}
    assert out == {"a": (None, [2]), "b": ("KeyError: 'k'", []), "c": (None, [])}
    assert perfscan.explain_rule("C.PERF.NESTED_LOOP")["advice"]
    with pytest.raises(ValueError, match="unknown rule"):
        perfscan.explain_rule("X")
    log = [("a", 1, "insert", None, "w1"), ("a", 2, "finish_if_running", "failed", None), ("a", 3, "finish", "completed", None), ("b", 1, "insert", None, "w2"), ("c", 1, "insert", None, "w1"), ("d", 5, "finish", "completed", None), ("e", 1, "insert", None, None)]
    rows_in = spark.createDataFrame([(i, n, a, s, "r", w) for i, n, a, s, w in log], "run_id string, seq int, action string, state string, result string, worker string")
    got = {r["run_id"]: (r["state"], r["result"]) for r in runs.run_states(rows_in, spark.createDataFrame([("w1",)], "worker string")).collect()}
    assert got == {"a": ("completed", "r"), "b": ("failed", "worker_lost"), "c": ("running", None), "d": ("unknown", None), "e": ("running", None)}


@pytest.mark.parametrize("parts", [1, 8])
def test_containment(spark, parts):
    """Against all pairs; with 8 partitions, groups fill several, and one span is repeated often."""
    import random

    from factloom.operators import perfscan

    rng = random.Random(parts)
    spans = [(rng.choice(["a", "a", "a", "b", None]), s, s + rng.randrange(30)) for s in (rng.randrange(40) for _ in range(150))] + [("a", 5, 60)] * 40 + [("c", 1, 2), ("c", None, 3)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame([(*x, "clash") for x in spans], "g string, start int, end int, n string")
        got = rows(perfscan.containment_depth(df, ["g"]), "g", "start", "end", "depth")
        assert perfscan.containment_depth(df.limit(0), ["g"]).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    known = [x for x in spans if x[1] is not None]
    want = [(g, s, e, 0 if s is None else sum(h == g and t < s and e <= f for h, t, f in known)) for g, s, e in spans]
    assert got == sorted(want, key=repr)


def test_incremental_refresh(spark, tmp_path):
    from factloom.streaming import incremental

    def extract(text):
        if "bad" in text:
            raise ValueError("no")
        return [{"object_id": i, "object_name": i, "object_source": f"{text.split('=')[0]}:1", "object_profile": "p", "payload": "{}"} for i in text.split("=")[1].split(",")]

    store = Store(spark, str(tmp_path / "s"))
    facts = [fact("a1", source="a.c:1"), fact("a2", source="a.c:2"), fact("b1", source="b.c:1")]
    store.publish(spark.createDataFrame(facts, FACT), spark.createDataFrame([edge("a1", "b1"), edge("a2", "b1")], EDGE))
    texts = {"a.c": "a.c=a2,a3", "b.c": "bad"}
    r = incremental.Refresher(store, lambda dirty: dirty.withColumn("text", F.udf(lambda p: texts.get(p))("path")), extract)
    seen = lambda *x: spark.createDataFrame(list(x), "path string, sha256 string, seq long")
    r.prime(seen(("a.c", "1", 1), ("b.c", "1", 1)))
    assert r.refresh(seen(("a.c", "1", 2), (None, "x", 2), ("b.c", None, 2))).dirty == 0
    status = r.refresh(seen(("a.c", "2", 3), ("b.c", "2", 3)), 2)
    assert (status.state, status.dirty, status.failed, status.failures) == ("ok", 2, 1, [("b.c", "ValueError: no")])
    assert rows(r.view().facts, "object_id") == [("a2",), ("a3",), ("b1",)] and rows(r.view().relatives, "from_fact_id") == [("a2",)]
    texts["b.c"] = "b.c=b1,b2"
    assert r.refresh(seen(("b.c", "3", 4)), 3).dirty == 1
    assert rows(r.view().facts, "object_id") == [("a2",), ("a3",), ("b1",), ("b2",)]
    broken = incremental.Refresher(store, lambda dirty: dirty.select("nothing"), extract)
    assert broken.refresh(seen(("a.c", "9", 9)), 4).state == "error" and incremental.state_of(spark, str(tmp_path / "s"))["error"]
    assert rows(broken.view().facts, "object_id") == [("a2",), ("a3",), ("b1",), ("b2",)]


def test_staging_left_behind_is_removed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.reap_staging(10) == 0
    (tmp_path / "s/staging-old").mkdir(parents=True)
    (tmp_path / "s/snapshots").mkdir()
    assert store.reap_staging(3600) == 0 and store.reap_staging(10, now=4e9) == 1 and (tmp_path / "s/snapshots").exists()


def test_small_operators(spark):
    import datetime as dt

    from factloom.operators import detail, search
    from factloom.plans.query_lang import QueryError

    recipes = spark.createDataFrame([("Unit", "runs", ["a.T"]), ("x", None, None), ("y", "N", ["UNITs"])], "id string, notes string, tests array<string>")
    assert rows(search.recipe_search(recipes, "UNIT"), "id") == [("Unit",), ("y",)]
    calls = spark.createDataFrame([("1", "m", "u", None), ("2", "m", "u", None)], "call_id string, caller_id string, callee_name string, referenced_source string")
    fns = spark.createDataFrame([("m", "main", "a.c", "external"), ("t", "u", "b.c", "external")], "object_id string, object_name string, canonical_source string, linkage string")
    edges = ingest.resolved_edges(ingest.resolve_calls(calls, fns), calls, "default")
    assert rows(edges, "from_fact_id", "to_fact_id") == [("m", "t")] and edges.first()["relative_id"].startswith("rel:direct_call:")
    rel = spark.createDataFrame([edge("a", "b", source="s1"), edge("b", "c", evidence="x.c:4"), edge("c", "d")], EDGE)
    dirty = spark.createDataFrame([("s1", "q.c"), ("s2", "x.c")], "source_id string, rel_path string")
    assert rows(census.edges_of_dirty(rel, dirty), "relative_id") == [("rel:a:b",), ("rel:b:c",)]
    v = view(spark, [fact("a"), fact("b")], [edge("a", "b")])
    assert [c["fact"]["object_id"] for c in detail.briefing(v, ["a", "b"], 9000)] == ["a", "b"]
    for refs, most in ((["a", "zz"], 9000), (["a"] * 9, 9000), (["a"], 10)):
        with pytest.raises(QueryError):
            detail.briefing(v, refs, most)
    memo = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "digest string, stored_at int")
    assert rows(logs.newest(memo, "stored_at", 2), "digest") == [("b",), ("c",)] and rows(logs.newest(memo, "stored_at", 2, "a"), "digest") == [("a",), ("c",)]
    inv = spark.createDataFrame([("1", "a"), ("2", "b")], "source_id string, rel_path string")
    assert rows(ingest.merge_inventory(inv, spark.createDataFrame([("3", "a"), ("2", "z")], inv.schema))) == [("2", "z"), ("3", "a")]
    ev = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, m), k) for h, m, k in ((0, 1, "a"), (0, 59, "a"), (1, 0, "b"))], "ts timestamp, k string")
    assert [r["n"] for r in feeds.windowed_counts(ev, "ts", "k").orderBy("start").collect()] == [2, 1]
    assert feeds.once_per(ev, ["k"]).count() == 2
    assert rows(ev.select(perfscan.normalized(F.col("k"), ["a"], "medium"))) == [("a",), ("a",), ("medium",)]
    assert one(spark, paths.snippet(F.col("s"), F.lit(2)), s="x\n  y  \n") == "y" and one(spark, paths.source_line(F.col("s")), s="a/b:7") == 7 and one(spark, paths.source_line(F.col("s")), s="/a:7") is None
    evidence = spark.createDataFrame([(3, True, None, 9), (0, None, None, None)], "result_count int, complete boolean, reachable boolean, total_results int")
    ok = verdict.with_verdict(evidence, verdict.fact_clauses({"min_results": 1, "complete": True, "total_at_least": 9}))
    assert rows(ok, "result_count", "ok") == [(0, False), (3, True)]
    ends = spark.createDataFrame([(True, "x", 1, True), (None, "x", 0, False), (None, None, 0, None), (None, None, None, False), (None, None, None, None)], "v boolean, f string, e int, i boolean")
    assert [r[0] for r in ends.select(verdict.passes(F.col("v"), F.col("f"), F.col("e"), F.col("i"))).collect()] == [True, False, True, True, False]
