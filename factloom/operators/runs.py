"""Test runs: tallies, occurrences, discovery, coverage, guidance, reports.

Tests are rows (run_id, pos, suite, name, status). An empty run has no row of
its own here; `run_tallies` takes the runs to report, so that it is seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Paths that are not the project's own.
VENDORED = ["extra/", "third_party/", "third-party/", "thirdparty/", "vendor/", "external/", "deps/", "contrib/", "node_modules/"]


def test_name(suite: Column, name: Column) -> Column:
    """`Suite.Name`, or the name alone."""
    return F.concat_ws(".", F.nullif(suite, F.lit("")), name)


def run_tallies(tests: DataFrame, runs: DataFrame) -> DataFrame:
    """Passed, failed, skipped, overall, failure and first failed test per run of `runs`(run_id)."""
    n = lambda s: F.count_if(F.col("status") == s)
    first = F.min(F.when(F.col("status") == "failed", F.struct("pos", test_name(F.col("suite"), F.col("name")).alias("test"))))
    tally = tests.groupBy("run_id").agg(n("passed").alias("passed"), n("failed").alias("failed"), n("skipped").alias("skipped"), first["test"].alias("first_failure"))
    out = runs.select("run_id").distinct().join(tally, "run_id", "left").na.fill(0, ["passed", "failed", "skipped"])
    none = F.col("passed") + F.col("failed") + F.col("skipped") == 0
    return out.withColumn("overall", F.when(none, "errored").when(F.col("failed") > 0, "failed").otherwise("passed")).withColumn("failure", F.when(none, "no_tests_ran"))


def occurrences(tests: DataFrame) -> DataFrame:
    """Adds `occurrence`, the nth time a test appears in its run."""
    return tests.withColumn("occurrence", F.row_number().over(Window.partitionBy("run_id", "suite", "name").orderBy("pos")))


def elapsed_ms(seconds: Column) -> Column:
    """Milliseconds of a text of seconds, half to even; 0 for what is no number."""
    return F.coalesce(F.bround(F.try_multiply(seconds.try_cast("double"), F.lit(1000.0))), F.lit(0.0)).cast("bigint")


def test_results(tests: DataFrame) -> DataFrame:
    """(run_id, results): a map of test name to its last status (at one place the largest)."""
    last = tests.groupBy("run_id", test_name(F.col("suite"), F.col("name")).alias("test")).agg(F.max(F.struct("pos", "status"))["status"].alias("status"))
    return last.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("test", "status"))).alias("results"))


def body_name(name: Column) -> Column:
    """struct(suite, name) of a `Suite_Name_Test` body, else null."""
    return F.when(name.rlike(r"^[^_]+_.+_Test$"), F.struct(F.regexp_extract(name, r"^([^_]+)_(.+)_Test$", 1).alias("suite"), F.regexp_extract(name, r"^([^_]+)_(.+)_Test$", 2).alias("name")))


def test_candidates(facts: DataFrame) -> DataFrame:
    """(suite, name, file, fact_id): tests seen in facts of kind type, the smallest id of each."""
    text = lambda k: F.nullif(F.get_json_object("payload", f"$.{k}"), F.lit(""))
    given = text("test_suite").isNotNull() & text("test_name").isNotNull()
    named = F.when(given, F.struct(text("test_suite").alias("suite"), text("test_name").alias("name"))).otherwise(body_name(F.col("object_name")))
    found = facts.where("kind = 'type'").select(named.alias("t"), F.col("source_path").alias("file"), F.col("object_id").alias("fact_id")).where("t is not null")
    return found.groupBy("t.suite", "t.name").agg(F.min(F.struct("fact_id", "file")).alias("x")).select("suite", "name", "x.file", "x.fact_id")


def union_tests(declared: DataFrame, built: DataFrame) -> DataFrame:
    """Declared (suite, name, file, line) and built (suite, name, file, fact_id) tests; declared data win, built ones give the fact."""
    d = declared.groupBy("suite", "name").agg(F.min(F.struct("file", "line")).alias("d"))
    b = built.groupBy("suite", "name").agg(F.min(F.struct("fact_id", "file")).alias("b"))
    return d.join(b, ["suite", "name"], "full").select("suite", "name", F.coalesce("d.file", "b.file").alias("file"), "d.line", "b.fact_id", F.col("d").isNotNull().alias("is_declared"), F.col("b").isNotNull().alias("is_built"))


def in_project(file: Column) -> Column:
    return ~file.rlike("^(" + "|".join(v.replace(".", r"\.") for v in VENDORED) + ")")


def coverage(declared: DataFrame, built: DataFrame) -> DataFrame:
    """One row: declared and built test files of the project, their ratio, and the numbers of tests."""
    keys = built.select("suite", "name", F.lit(True).alias("hit")).distinct()
    rows = declared.where(in_project(F.col("file"))).join(keys, ["suite", "name"], "left")
    out = rows.agg(F.countDistinct("file").alias("declared"), F.countDistinct(F.when(F.col("hit"), F.col("file"))).alias("built"), F.count(F.lit(1)).alias("declared_tests"), F.count("hit").alias("built_tests"))
    return out.withColumn("ratio", F.when(F.col("declared") > 0, F.bround(F.col("built") / F.col("declared"), 4)).otherwise(F.lit(0.0)))


def guidance(tests: DataFrame, known: DataFrame, most: int = 4) -> DataFrame:
    """Per run the first failed tests that are known (suite, name, file, fact_id), at most `most`."""
    failed = tests.where("status = 'failed'").join(known.dropDuplicates(["suite", "name"]), ["suite", "name"])
    return failed.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("pos", "suite", "name"))).where(F.col("place") <= most)


def report(events: DataFrame, runs: DataFrame) -> DataFrame:
    """(event_pos, task_id, run_id, overall, state): journal events with the run they name; the task comes from the event, else from the run."""
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    named = events.where(filled("run_id").isNotNull())
    last = runs.select("run_id", F.col("task_id").alias("run_task"), "overall", "state")
    return named.join(last, "run_id").select("event_pos", F.coalesce(filled("task"), filled("task_id"), F.col("run_task")).alias("task_id"), "run_id", "overall", "state")


def runs_of_match(events: DataFrame, runs: DataFrame, match_id: str) -> DataFrame:
    """Runs that the events of one match name."""
    return runs.join(events.where(F.col("match_id") == match_id).select("run_id"), "run_id", "left_semi")


def task_list(matches: DataFrame) -> DataFrame:
    """Tasks of match documents (match_id, history, current): one row per task with round and step."""
    past = matches.select("match_id", F.explode("history").alias("r")).select("match_id", F.col("r.round").alias("round"), F.col("r.step").alias("step"), F.explode("r.tasks").alias("task"), F.lit(False).alias("is_current"))
    now = matches.select("match_id", F.col("current.round").alias("round"), F.col("current.step").alias("step"), F.explode("current.tasks").alias("task"), F.lit(True).alias("is_current"))
    return past.unionByName(now).select("match_id", "round", "step", "is_current", "task.*")


def timing_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Median, least and largest wall time of the successful runs (exit_code 0)."""
    good = F.when(F.col("exit_code") == 0, F.col("wall_seconds"))
    return runs.groupBy(*keys).agg(F.median(good).alias("median_s"), F.min(good).alias("min_s"), F.max(good).alias("max_s"), F.count(good).alias("n_ok"), F.count(F.lit(1)).alias("n_runs"))


def tool_turns(turns: DataFrame, tool: str) -> DataFrame:
    """Assistant lines of transcripts (type, message.content[]) with a use of a tool."""
    return turns.where((F.col("type") == "assistant") & F.coalesce(F.exists("content", lambda b: (b["type"] == "tool_use") & (b["name"] == tool)), F.lit(False)))


def keep_proven(old: DataFrame, new: DataFrame) -> DataFrame:
    """Target rows (target_id, spec_digest, sources_digest): `proven` stays only if it was and both digests are unchanged."""
    o = old.select("target_id", F.col("spec_digest").alias("s0"), F.col("sources_digest").alias("c0"), F.col("proven").alias("p0"))
    same = F.col("s0").eqNullSafe(F.col("spec_digest")) & F.col("c0").eqNullSafe(F.col("sources_digest"))
    return new.join(o, "target_id", "left").withColumn("proven", F.coalesce(F.col("p0") & same, F.lit(False))).drop("s0", "c0", "p0")


def run_states(log: DataFrame, alive: DataFrame) -> DataFrame:
    """(run_id, state, result) of runs, from a log of rows (run_id, seq, action, state, result, worker).

    Actions: `insert` starts a run; `finish` sets its state whatever it was;
    `finish_if_running` only if nothing has finished it. A run that still is
    running but whose worker is not in `alive`(worker) has failed: worker_lost.
    A run without insert is unknown. One row per run is kept; its log may be in any order.
    """
    of = lambda a: F.col("action") == a
    row = F.struct("seq", "state", "result")
    per = log.groupBy("run_id").agg(
        F.max(F.when(of("finish"), row)).alias("last"), F.min(F.when(of("finish_if_running"), row)).alias("first"), F.max(F.when(of("insert"), F.struct("seq", "worker"))).alias("began")
    )
    known = alive.select("worker").distinct().withColumn("_alive", F.lit(True))
    ended = F.coalesce("last", "first")
    out = per.withColumn("worker", F.col("began.worker")).join(known, "worker", "left")
    lost = F.col("worker").isNotNull() & F.col("_alive").isNull()
    state = F.when(F.col("began").isNull(), "unknown").when(ended.isNotNull(), ended["state"]).when(lost, "failed").otherwise("running")
    result = F.when(F.col("began").isNull(), None).when(ended.isNotNull(), ended["result"]).when(lost, "worker_lost")
    return out.select("run_id", state.alias("state"), result.alias("result"))
