"""Queries over the file formats, sources, runs and streams, with their SQL. Files are written from the test tables first and then read as any other."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import compile_args, mi
from factloom.functions.fold import ascii_lower
from factloom.functions.jsonops import shortened
from factloom.functions.paths import compacted, matches_any
from factloom.operators import compile_db, graph, ingest, logs, perfscan, runs, search, verdict
from factloom.plans.catalog import TALLY, TESTS, VIEW, _busiest, _busiest_sql, _graph, _tallies, _tests, query
from factloom.plans.query_lang import parse
from factloom.scratch import scratch_root
from factloom.session import table
from factloom.sources import scans
from factloom.streaming import feeds

# --- event logs ----------------------------------------------------------------------------------

_EVENTS = """ev as (select event_id, 'run.' || event_type as event_name, 'c' || (event_id % 3) as channel, case when event_type = 'error' then 'error' when event_id % 7 = 0 then 'warning' else 'ok' end as status,
case when event_type = 'error' then 'E' || user_id end as error_code, value as duration_ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as "timestamp" from events where event_type is not null and ts is not null)"""


def _at(spark: SparkSession, d: str, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{abs(hash(d)):x}"


def _log_folder(spark: SparkSession, d: str) -> str:
    """The event table as logs of three channels, every fiftieth event followed by a line that is no JSON and one that is no event."""
    at, e = _at(spark, d, "logs"), table(spark, d, "events").where("event_type is not null and ts is not null")
    bad = F.col("event_type") == "error"
    events = e.select(
        F.lit(2).alias("schema_version"), F.concat(F.lit("run."), "event_type").alias("event_name"), logs.iso_micros(F.col("ts")).alias("timestamp"), F.when(bad, "error").when(F.col("event_id") % 7 == 0, "warning").otherwise("ok").alias("status"),
        F.col("value").alias("duration_ms"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("channel"), F.col("event_id").cast("string").alias("subject_id"), F.when(bad, F.concat(F.lit("E"), F.col("user_id").cast("string"))).alias("error_code"),
        F.from_json("props", "map<string,bigint>").alias("counts"), F.lit('{"api_key": "x", "n": 1}').alias("payload"),
    )
    logs.append_events(events, at, "payload", mode="overwrite")
    noise = e.where("event_id % 50 = 0").select(F.explode(F.array(F.lit("no json"), F.lit("{}"), F.lit("  "))).alias("value"))
    noise.write.mode("append").text(f"{at}/c0.jsonl")
    return at


@query(f"with {_EVENTS} select event_id::varchar as subject_id, event_name, channel, status, error_code, duration_ms, \"timestamp\", '{{\"api_key\":\"[REDACTED]\",\"n\":1}}' as payload from ev")
def event_log_scan(spark: SparkSession, d: str) -> DataFrame:
    """Events written to logs, secrets hidden, and scanned again."""
    events, _ = scans.event_log(spark, _log_folder(spark, d))
    return events.select("subject_id", "event_name", "channel", "status", "error_code", "duration_ms", "timestamp", "payload")


@query(f"with {_EVENTS} select event_id::varchar as subject_id, status from ev where channel = 'c1' and \"timestamp\" between '2024-01-05T00:00:00.000000Z' and '2024-01-15T00:00:00.000000Z'")
def event_log_channel(spark: SparkSession, d: str) -> DataFrame:
    """One channel of the logs in a window of time."""
    events, _ = scans.event_log(spark, _log_folder(spark, d), "c1", "2024-01-05T00:00:00.000000Z", "2024-01-15T00:00:00.000000Z")
    return events.select("subject_id", "status")


@query("select unnest(['malformed_json', 'invalid_schema']) as issue, (select count(*) from events where event_id % 50 = 0 and event_type is not null and ts is not null) as n")
def event_log_problems(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are no events, by what is wrong with them; blank lines are nothing."""
    _, problems = scans.event_log(spark, _log_folder(spark, d))
    return problems.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_EVENTS} select status, count(*) as n from ev group by 1")
def log_summary_by_status(spark: SparkSession, d: str) -> DataFrame:
    events, _ = scans.event_log(spark, _log_folder(spark, d))
    return logs.count_by(events, "status")


@query(f"with {_EVENTS} select event_id::varchar as subject_id, error_code from ev where error_code is not null order by \"timestamp\" desc, event_id desc limit 25")
def newest_errors(spark: SparkSession, d: str) -> DataFrame:
    """The 25 newest errors: what a bounded memory of events keeps."""
    events, _ = scans.event_log(spark, _log_folder(spark, d))
    rows = events.where("error_code is not null").withColumn("key", F.struct("timestamp", F.col("subject_id").cast("bigint")))
    return logs.newest(rows, "key", 25).select("subject_id", "error_code")


@query("""select o_orderkey::varchar as digest from (select o_orderkey, o_orderdate, row_number() over (order by o_orderdate desc, o_orderkey desc) as n, o_orderkey = (select min(o_orderkey) from orders) as own from orders) where own
union select o_orderkey::varchar from (select o_orderkey from orders where o_orderkey <> (select min(o_orderkey) from orders) order by o_orderdate desc, o_orderkey desc limit 31)""")
def memo_eviction(spark: SparkSession, d: str) -> DataFrame:
    """Of all remembered results the 32 newest, and among them the one just written, however old."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("digest"), F.struct("o_orderdate", "o_orderkey").alias("key"), "o_orderkey")
    just = str(o.agg(F.min("o_orderkey")).first()[0])
    return logs.newest(o, "key", 32, except_for=just).select("digest")


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as at, round(epoch_us(ts) / 1000.0 - epoch_us(timestamp '2024-01-01') / 1000.0, 3) as ms from events where ts is not null")
def event_times(spark: SparkSession, d: str) -> DataFrame:
    """Times as text, and milliseconds since the beginning of 2024."""
    e = table(spark, d, "events").where("ts is not null")
    return e.select("event_id", logs.iso_micros(F.col("ts")).alias("at"), F.round(logs.millis_between(F.lit("2024-01-01").cast("timestamp"), F.col("ts")), 3).alias("ms"))


@query(f"""with {VIEW}, a as (select {_busiest_sql('field', 'field_read', 'to_fact_id')} as id)
select k as name, 'queries' as channel, case when n > l then 'too_broad' else 'ok' end as status, n::bigint as total, least(n, l)::bigint as returned from
(select unnest(['query.readers', 'query.few']) as k, unnest([50, 2]) as l, (select count(distinct from_fact_id) from r, a where to_fact_id = id and relation_kind = 'field_read' and from_fact_id in (select object_id from f)) as n)""")
def query_events(spark: SparkSession, d: str) -> DataFrame:
    """Events that tell of answered queries, appended to their log and scanned."""
    v, at = _graph(spark, d), _at(spark, d, "query-log")
    anchor, told = _busiest(v, "field", "field_read", "to_fact_id"), []
    for name, limit in (("query.readers", 50), ("query.few", 2)):
        told.append(logs.query_event(name, graph.relation_search(v, f"readers:{anchor}", limit), limit, 1.0, "2024-01-01T00:00:00.000000Z"))
    schema = "schema_version int, event_name string, timestamp string, status string, duration_ms double, channel string, summary string, counts map<string,bigint>"
    logs.append_events(spark.createDataFrame(told, schema), at, mode="overwrite")
    events, _ = scans.event_log(spark, at, "queries")
    return events.select(F.col("event_name").alias("name"), "channel", F.col("summary").alias("status"), F.col("counts")["total"].alias("total"), F.col("counts")["returned"].alias("returned"))


# --- streams -------------------------------------------------------------------------------------


@query(f"with {_EVENTS} select channel, event_name, status, count(*) as n, round(sum(duration_ms), 2) as duration_ms from ev group by all")
def stream_log_summary(spark: SparkSession, d: str) -> DataFrame:
    """The logs read as a stream of lines, parsed and summed up, drained."""
    lines = feeds.log_stream(spark, f"{_log_folder(spark, d)}/*.jsonl")
    return feeds.drain(feeds.stream_log_summary(lines).withColumn("duration_ms", F.round("duration_ms", 2)), "log_files", "complete")


_OBSERVED = "o as (select object_id as path, payload_sha256 as sha256, epoch_us(delivered_at) as seq from fact_snapshots where object_id is not null and payload_sha256 is not null and delivered_at is not null), top as (select max(seq) // 1000 * 1000 as top from o)"


@query(f"""with {_OBSERVED}, p as (select *, lag(sha256) over (partition by path order by seq, sha256) as previous from o) select path, sha256, previous, seq from p, top where previous <> sha256 and seq <= top - 86400000000""")
def stream_change_feed(spark: SparkSession, d: str) -> DataFrame:
    """Changes of digests per fact by the stateful stream, all deliveries in any order, up to a day before the last."""
    at = _at(spark, d, "observed")
    o = table(spark, d, "fact_snapshots").select(F.col("object_id").alias("path"), F.col("payload_sha256").alias("sha256"), F.unix_micros(F.col("delivered_at").cast("timestamp")).alias("seq"))
    o.write.mode("overwrite").parquet(at)
    return feeds.drain(feeds.stream_changes(spark.readStream.schema(o.schema).parquet(at), "1 day"), "changes")


@query("select user_id, ts::date as day from events where ts is not null and user_id is not null group by all")
def stream_once_per(spark: SparkSession, d: str) -> DataFrame:
    """One refresh per user and day, however many events ask for it, from a stream whose state is bounded by a watermark."""
    schema = table(spark, d, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").where("ts is not null and user_id is not null")
    rows = e.select("user_id", F.col("ts").cast("date").alias("day"), F.col("ts").cast("timestamp").alias("ts"))
    return feeds.drain(feeds.once_per(rows, ["user_id", "day"], "ts", "400 days").select("user_id", "day"), "once")


_SESSION = """cmd as (select user_id, event_id, case event_type when 'error' then '^error,msg="x"' when 'click' then '*running,thread-id="all"' when 'purchase' then '*stopped,reason="bp"' when 'view' then '^running' else '=note' end as line from events where user_id is not null),
st as (select *, case event_type_line when '^error' then 'error' when '*running' then 'running' when '^running' then 'running' when '*stopped' then 'stopped' end as s from (select *, split_part(line, ',', 1) as event_type_line from cmd))"""


@query(f"with {_SESSION} select user_id::varchar as session, coalesce(arg_max(s, event_id) filter (s is not null), 'created') as state from st group by 1")
def stream_session_states(spark: SparkSession, d: str) -> DataFrame:
    """Debugger lines parsed into records and folded into the state of each session by a stateful stream, drained."""
    schema = table(spark, d, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").where("user_id is not null")
    line = F.when(F.col("event_type") == "error", '^error,msg="x"').when(F.col("event_type") == "click", '*running,thread-id="all"').when(F.col("event_type") == "purchase", '*stopped,reason="bp"').when(F.col("event_type") == "view", "^running").otherwise("=note")
    recs = e.select(F.col("user_id").cast("string").alias("session"), mi.records(line).alias("r"), F.col("event_id").cast("bigint").alias("seq")).select("session", "r.kind", F.col("r.class").alias("name"), "seq")
    told = feeds.drain(feeds.stream_session_states(recs), "sessions", "update")
    return ingest.latest_per_key(told, ["session"], ["seq"]).select("session", "state")


@query("""with l as (select event_id, user_id, '12^done,stack=[frame={level="' || (event_id % 9) || '",func="f' || user_id || '"}],value="a\\nb"' as line from events) select event_id, 12 as token, 'result' as kind, 'done' as class, 'f' || user_id as func, (event_id % 9)::varchar as level, 'a' || chr(10) || 'b' as value from l""")
def debugger_records(spark: SparkSession, d: str) -> DataFrame:
    """Debugger lines as nested records."""
    e = table(spark, d, "events")
    line = F.concat(F.lit('12^done,stack=[frame={level="'), (F.col("event_id") % 9).cast("string"), F.lit('",func="f'), F.col("user_id").cast("string"), F.lit('"}],value="a\\nb"'))
    r = e.select("event_id", mi.records(line).alias("r"))
    at = lambda p: F.get_json_object("r.results", p)
    return r.select("event_id", F.col("r.token").cast("int").alias("token"), "r.kind", "r.class", at("$.stack[0].frame.func").alias("func"), at("$.stack[0].frame.level").alias("level"), at("$.value").alias("value"))


# --- test results, transcripts, journals ---------------------------------------------------------


@query("with x as (select 's' || (l_suppkey % 7) as suite, 't' || (l_partkey % 5) as name, case l_returnflag when 'R' then 'failed' when 'A' then 'passed' else 'skipped' end as status, l_quantity::int as q from lineitem) select suite, name, status, q::bigint as elapsed_ms, case when status = 'failed' then 'a < b: ' || q when status = 'skipped' then 'why' else '' end as message, count(*) as n from x group by all")
def gtest_xml_scan(spark: SparkSession, d: str) -> DataFrame:
    """Test cases of XML reports, with times, failures and skips."""
    at = _at(spark, d, "gtest")
    t = table(spark, d, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "passed").otherwise("skipped")
    q = F.col("l_quantity").cast("int")
    head = F.concat(F.lit('<testcase classname="s'), (F.col("l_suppkey") % 7).cast("string"), F.lit('" name="t'), (F.col("l_partkey") % 5).cast("string"), F.lit('" time="'), (q / 1000).cast("string"), F.lit('"'))
    body = F.when(status == "failed", F.concat(F.lit('><failure message="a &lt; b: '), q.cast("string"), F.lit('">at x.cc</failure></testcase>'))).when(status == "skipped", F.lit(' status="run"><skipped message="why"/></testcase>')).otherwise(F.lit(' status="run" />'))
    t.select(F.concat(head, body).alias("value")).repartition(16).write.mode("overwrite").text(at)
    out = scans.gtest_xml(spark, at)
    return out.groupBy("suite", "name", "status", "elapsed_ms", "message").agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as n_listed from part")
def gtest_list_scan(spark: SparkSession, d: str) -> DataFrame:
    """Cases of a test listing."""
    at = _at(spark, d, "list")
    p = table(spark, d, "part")
    p.select(F.explode(F.array(F.concat("p_brand", F.lit(".")), F.concat(F.lit("  "), "p_name"))).alias("value")).write.mode("overwrite").text(at)
    return scans.listed_tests(scans.text_lines(spark, at))


@query("select case when event_id % 2 = 0 then 'search' else 'detail' end as tool, count(*) as n from events where event_type = 'purchase' and event_id % 2 = 0 group by 1")
def assistant_tool_turns(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns of transcripts that use a tool."""
    at, e = _at(spark, d, "transcript"), table(spark, d, "events")
    tool = F.when(F.col("event_id") % 2 == 0, "search").otherwise("detail")
    use = F.struct(F.when(F.col("event_type") == "purchase", "tool_use").otherwise("text").alias("type"), tool.alias("name"))
    kind = F.when(F.col("event_type") == "click", "user").otherwise("assistant")
    e.select(F.to_json(F.struct(kind.alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), F.lit("").alias("name")), use).alias("content")).alias("message"))).alias("value")).write.mode("overwrite").text(at)
    turns = runs.tool_turns(scans.transcripts(spark, at), "search")
    return turns.select(F.explode("content").alias("b")).where("b.type = 'tool_use'").groupBy(F.col("b.name").alias("tool")).agg(F.count(F.lit(1)).alias("n"))


@query("select 'm' || (user_id % 5) as match_id, 'r' || user_id as run_id, event_type as event, count(*) as n from events where user_id % 5 = 3 group by all")
def match_journal_scan(spark: SparkSession, d: str) -> DataFrame:
    """The events of one match from a journal; malformed lines are skipped."""
    at, e = _at(spark, d, "journal"), table(spark, d, "events")
    row = F.to_json(F.struct(F.col("event_type").alias("event"), F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("match_id"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), F.lit("s").alias("seat")))
    e.select(F.explode(F.array(row, F.lit("{cut"))).alias("value")).write.mode("overwrite").text(at)
    return scans.match_journal(spark, at, "m3").groupBy("match_id", "run_id", "event").agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey as run_id, c_mktsegment as overall from customer where c_custkey in (select user_id from events where user_id % 5 = 3)")
def runs_of_match(spark: SparkSession, d: str) -> DataFrame:
    """Runs that the events of one match name."""
    e = table(spark, d, "events").select(F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("match_id"), F.col("user_id").alias("run_id"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("overall"))
    return runs.runs_of_match(e, c, "m3")


# --- compiler invocations ------------------------------------------------------------------------

_COMPILES = """inv as (select p_partkey as k, 'src/p' || (p_partkey % 500) || '.c' as src, case when p_partkey % 3 = 0 then 'a.o' else 'b.o' end as o, p_partkey % 11 = 0 as miss from part),
cdb as (select '/w/' || src as file, '/w/' || o as output, max(k) as k from inv where not miss and k % 13 > 0 group by all)"""


def _compiles(spark: SparkSession, d: str) -> DataFrame:
    """Invocations of a compiler: one per part, some that missed, some that only preprocess."""
    k = F.col("p_partkey")
    src, o = F.concat(F.lit("src/p"), (k % 500).cast("string"), F.lit(".c")), F.when(k % 3 == 0, "a.o").otherwise("b.o")
    argv = F.concat(F.array(F.lit("cc"), F.when(k % 13 == 0, "-E").otherwise("-c"), F.lit("-Iinc"), F.concat(F.lit("-DK="), k.cast("string"))), F.array(src, F.lit("-o"), o))
    return table(spark, d, "part").select(argv.alias("argv"), F.lit("/w").alias("cwd"), (k % 11 == 0).alias("miss"), F.lit("").alias("reason"), k.cast("string").alias("ts"))


def _journal(spark: SparkSession, d: str) -> DataFrame:
    at = _at(spark, d, "compiles")
    rows = compile_db.journal_rows(_compiles(spark, d)).withColumn("_k", F.col("ts").cast("bigint"))
    rows.repartition(1).sortWithinPartitions("_k").drop("_k").select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(at)  # a journal is one file, in order
    return scans.compile_journal(spark, at)


@query("select p_partkey::varchar as ts, 'src/p' || (p_partkey % 500) || '.c' as src, case when p_partkey % 3 = 0 then 'a.o' else 'b.o' end as out, p_partkey % 11 = 0 as miss from part where p_partkey % 13 > 0")
def compile_journal_scan(spark: SparkSession, d: str) -> DataFrame:
    """Compiler invocations classified, written to a journal and scanned; those that only preprocess are none."""
    return _journal(spark, d).select("ts", "src", "out", "miss")


@query(f"with {_COMPILES} select file, output, '/w' as directory, 'cc -c -I/w/inc -DK=' || k || ' ' || file || ' -o ' || output as command from cdb")
def compile_database(spark: SparkSession, d: str) -> DataFrame:
    """The last entry of each source and output, with absolute paths."""
    return compile_db.compile_db(compile_db.entries(_journal(spark, d))).select("file", "output", "directory", F.array_join("arguments", " ").alias("command"))


@query(f"with {_COMPILES} select file, output, 'cc -c -I/w/inc -DK=' || k || ' ' || file || ' -o ' || output as command from cdb where file like '%7.c'")
def compile_commands_recovered(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a compile database file that wrap the compiler in a launcher, for the wanted files, without the launcher."""
    at = _at(spark, d, "cdb")
    db = compile_db.compile_db(compile_db.entries(_journal(spark, d)))
    wrapped = db.withColumn("arguments", F.concat(F.array(F.lit("/opt/bin/wrap"), F.lit("cc"), F.lit("--")), "arguments"))
    one = wrapped.agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("arguments", "directory", "file", "output"))), ","), F.lit("]")).alias("value"))  # the file is one JSON array
    one.write.mode("overwrite").text(at)
    found = compile_db.recover(scans.compile_commands(spark, at), db.select("file").where("file like '%7.c'"), "wrap")
    return found.select("file", "output", F.array_join("arguments", " ").alias("command"))


@query("select p_partkey, '-Iinc -DK=' || p_partkey || ' -std=c11 -x c' as kept, 3 + case when p_partkey % 2 = 0 then 2 else 0 end as dropped from part")
def clean_compile_flags(spark: SparkSession, d: str) -> DataFrame:
    """The flags of command lines that change how a source parses."""
    @F.pandas_udf("kept string, dropped int")
    def clean(argv: pd.Series) -> pd.DataFrame:
        out = [compile_args.clean_flags(list(a)) for a in argv]
        return pd.DataFrame({"kept": [" ".join(k) for k, _ in out], "dropped": [n for _, n in out]})

    argv = F.split(F.concat(F.lit("cc -c -Iinc -DK="), F.col("p_partkey").cast("string"), F.lit(" -O2 -std=c11"), F.when(F.col("p_partkey") % 2 == 0, " -o x.o").otherwise(""), F.lit(" -x c a.c")), " ")
    return table(spark, d, "part").select("p_partkey", clean(argv).alias("c")).select("p_partkey", "c.kept", "c.dropped")


# --- runs and expectations -----------------------------------------------------------------------


@query(f"with {TESTS}, {TALLY} select run_id, first_failure from n where first_failure is not null")
def first_failure(spark: SparkSession, d: str) -> DataFrame:
    return _tallies(spark, d).where("first_failure is not null").select("run_id", "first_failure")


@query(f"with {TESTS}, {TALLY} select run_id, 'errored' as overall, 'no_tests_ran' as failure from runs where run_id not in (select run_id from t)")
def no_tests_guard(spark: SparkSession, d: str) -> DataFrame:
    """Runs without any test, which count as errored."""
    return _tallies(spark, d).where("failure is not null").select("run_id", "overall", "failure")


@query(f"with {TESTS} select run_id, suite || '.' || name as test, arg_max(status, (pos, status)) as status from t group by all")
def test_results(spark: SparkSession, d: str) -> DataFrame:
    """The last status of every test of a run, from a map per run."""
    return runs.test_results(_tests(spark, d)).select("run_id", F.explode("results").alias("test", "status"))


@query(f"with {TESTS}, {TALLY}, m as (select run_id, arg_max(status, (pos, status)) as s from t where suite = 's1' and name = 't2' group by 1) select run_id, coalesce(s = 'passed', false) and coalesce(failed, 0) <= 3 as ok from runs left join n using (run_id) left join m using (run_id)")
def test_clause_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Runs of which one named test must have passed; a run without it fails."""
    evidence = _tallies(spark, d).join(runs.test_results(_tests(spark, d)), "run_id", "left")
    return verdict.with_verdict(evidence, verdict.run_clauses({"test": {"name": "s1.t2", "result": "passed"}, "max_failed": 3})).select("run_id", "ok")


@query("""select o_orderkey, coalesce(o_custkey % 50 >= 5, false) as min_ok, coalesce(o_custkey % 50 <= 40, false) as max_ok, case when o_orderkey % 3 = 0 then o_orderkey % 2 = 0 when o_orderkey % 3 = 1 then not (o_orderkey % 5 = 0) else false end as complete_ok,
o_orderkey % 7 = 0 as reachable_ok from orders""")
def fact_clause_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of queries against an expectation of four clauses; what is missing is false."""
    k = F.col("o_orderkey")
    evidence = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 50).alias("result_count"), verdict.fact_evidence(F.when(k % 3 == 0, k % 2 == 0), F.when(k % 3 == 1, k % 5 == 0)).alias("complete"), F.when(k % 7 == 0, True).alias("reachable"), F.lit(None).cast("int").alias("total_results")
    )
    c = verdict.fact_clauses({"min_results": 5, "max_results": 40, "complete": True, "reachable": True})
    return evidence.select("o_orderkey", c["min_results"].alias("min_ok"), c["max_results"].alias("max_ok"), c["complete"].alias("complete_ok"), c["reachable"].alias("reachable_ok"))


@query("select o_orderkey, case when o_orderkey % 4 = 0 then o_orderkey % 8 = 0 when o_orderkey % 4 = 1 then case when o_orderkey % 3 = 0 then false else o_custkey % 3 = 0 end when o_orderkey % 4 = 2 then o_custkey % 3 = 0 else o_custkey % 2 = 0 end as passed from orders")
def pass_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Whether a step passed: by its verdict, its failure, its exit code or its error flag, in this order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    said = F.when(k % 4 == 0, k % 8 == 0)
    failure = F.when((k % 4 == 1) & (k % 3 == 0), "broken")
    return table(spark, d, "orders").select("o_orderkey", verdict.passes(said, failure, F.when(k % 4 != 3, c % 3), c % 2 != 0).alias("passed"))


@query("select l_orderkey as run_id, case when count(*) filter (l_linenumber = 1) = 0 then 'unknown' when count(*) filter (l_returnflag = 'R') > 0 then 'done' || max(l_linenumber) filter (l_returnflag = 'R') when count(*) filter (l_returnflag = 'A' and l_linenumber > 1) > 0 then 'done' || min(l_linenumber) filter (l_returnflag = 'A' and l_linenumber > 1) when any_value(l_orderkey) % 2 = 0 then 'failed' else 'running' end as state from lineitem group by 1")
def run_states(spark: SparkSession, d: str) -> DataFrame:
    """The state of every run from a log of inserts and endings; runs whose worker is gone have failed."""
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    item = table(spark, d, "lineitem")
    actions = F.array_compact(F.array(F.when(n == 1, F.lit("insert")), F.when(flag == "R", F.lit("finish")).when((flag == "A") & (n > 1), F.lit("finish_if_running"))))
    log = item.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_orderkey").alias("k"), n.alias("line"), F.explode_outer(actions).alias("action"), F.concat(F.lit("done"), n.cast("string")).alias("state"), F.lit("r").alias("result"), F.when(n == 1, F.concat(F.lit("w"), (F.col("l_orderkey") % 10).cast("string"))).alias("worker")
    ).withColumn("seq", F.col("line"))
    alive = spark.createDataFrame([(f"w{k}",) for k in range(1, 10, 2)], "worker string")
    return runs.run_states(log, alive).select("run_id", "state")


@query("with o as (select c_custkey as id, c_name as spec, c_mktsegment as src, c_custkey % 3 > 0 as proven from customer) select id as target_id, proven and id % 5 > 0 and id % 7 > 0 as proven from o")
def kept_proofs(spark: SparkSession, d: str) -> DataFrame:
    """Targets keep their proof unless their specification or sources changed."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("target_id"), F.col("c_name").alias("spec_digest"), F.col("c_mktsegment").alias("sources_digest"), (F.col("c_custkey") % 3 > 0).alias("proven"))
    new = old.select("target_id", F.when(F.col("target_id") % 5 == 0, "x").otherwise(F.col("spec_digest")).alias("spec_digest"), F.when(F.col("target_id") % 7 == 0, "y").otherwise(F.col("sources_digest")).alias("sources_digest"))
    return runs.keep_proven(old, new).select("target_id", "proven")


@query("select 'S' || (p_partkey % 40) as suite, replace(p_name, ' ', '_') as name, 't/' || min((p_partkey, p_partkey))[1] || '.cc' as file, 'fact:' || lpad(min(p_partkey)::varchar, 9, '0') as fact_id from part where p_partkey % 3 > 0 group by 1, 2")
def test_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Tests seen in facts, by the name of their body or by their payload; the smallest id of each."""
    k, name = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit("_"))
    suite = F.concat(F.lit("S"), (k % 40).cast("string"))
    body = F.when(k % 3 == 1, F.concat(suite, F.lit("_"), name, F.lit("_Test"))).when(k % 3 == 2, F.lit("other")).otherwise(F.lit("NoTestAtAll"))
    payload = F.when(k % 3 == 2, F.to_json(F.struct(suite.alias("test_suite"), name.alias("test_name")))).otherwise("{}")
    facts = table(spark, d, "part").select(F.concat(F.lit("fact:"), F.lpad(k.cast("string"), 9, "0")).alias("object_id"), body.alias("object_name"), payload.alias("payload"), F.lit("type").alias("kind"), F.concat(F.lit("t/"), k.cast("string"), F.lit(".cc")).alias("source_path"))
    return runs.test_candidates(facts)


# --- sources -------------------------------------------------------------------------------------

#: Bodies of generated functions, and what the scan must find in them: (rule, severity, confidence, line, symbol). Worked out by hand.
_BODIES = [
    ("for (i = 0; i < strlen(s); i++)\n{\n x += s[i];\n}", [("C.PERF.STRLEN_IN_LOOP", "medium", "high", 3, None)]),
    ("while (n--) {\n p = malloc(n);\n free(p);\n}", [("C.PERF.ALLOC_IN_LOOP", "high", "high", 4, "malloc"), ("C.PERF.ALLOC_IN_LOOP", "high", "high", 5, "free")]),
    ("while (n) {\n p = realloc(p, n + 1);\n}", [("C.PERF.REALLOC_GROW_ONE", "high", "high", 4, "realloc")]),
    ("for (;n;) {\n memcpy(a, b, n);\n}", []),
    ("for (i = 0; i < n; i++) {\n for (j = 0; j < n; j++) {\n  memset(a, 0, n);\n }\n}", [("C.PERF.NESTED_LOOP", "medium", "medium", 4, None), ("C.PERF.BULK_MEMORY_IN_LOOP", "medium", "medium", 5, "memset")]),
    ("while (n) {\n printf(\"strlen(x)\");\n // malloc(1)\n}", [("C.PERF.IO_IN_LOOP", "medium", "medium", 4, "printf")]),
    ("while (n) {\n y = sqrt(y);\n}", [("C.PERF.EXPENSIVE_MATH_IN_LOOP", "low", "medium", 4, "sqrt")]),
    ("malloc(1);\n/* while (1) { free(p); } */\nprintf(\"\");", []),
]
_BODIES[3] = (_BODIES[3][0], [("C.PERF.BULK_MEMORY_IN_LOOP", "medium", "medium", 4, "memcpy")])
_EXPECTED = "exp(kind, rule_id, severity, confidence, line, symbol) as (values " + ", ".join(f"({k}, '{r}', '{s}', '{c}', {n}, {'null' if y is None else repr(y)})" for k, (_, found) in enumerate(_BODIES) for r, s, c, n, y in found) + ")"
_FOUND = f"with {_EXPECTED}, p as (select p_partkey, 'src/p' || lpad(p_partkey::varchar, 7, '0') || '.c' as path, p_partkey % 8 as kind from part), found as (select path, rule_id, severity, confidence, line, symbol, 'f' || p_partkey as function from p join exp using (kind))"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """A source file per part, with one of the bodies."""
    k = F.col("p_partkey")
    body = F.element_at(F.array(*(F.lit(b) for b, _ in _BODIES)), (k % len(_BODIES) + 1).cast("int"))
    return table(spark, d, "part").select(F.concat(F.lit("src/p"), F.lpad(k.cast("string"), 7, "0"), F.lit(".c")).alias("path"), F.concat(F.lit("static int f"), k.cast("string"), F.lit("(char *s, int n)\n{\n"), body, F.lit("\n}\n")).alias("text"))


@query(_FOUND + " select path, rule_id, severity, confidence, line, symbol, function from found")
def source_findings(spark: SparkSession, d: str) -> DataFrame:
    """Performance findings of generated sources, every rule among them."""
    return perfscan.scan_sources(_sources(spark, d)).select("path", "rule_id", "severity", "confidence", "line", "symbol", "function")


@query(_FOUND + """ select path, rule_id, severity, confidence, line, symbol, 'PERF' || lpad((row_number() over (order by (severity = 'high') desc, (confidence = 'high') desc, path, line, rule_id, symbol))::varchar, 4, '0') as id
from found where severity <> 'low' qualify row_number() over (order by (severity = 'high') desc, (confidence = 'high') desc, path, line, rule_id, symbol) <= 50""")
def findings_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The 50 worst of them, numbered."""
    return perfscan.rank_findings(perfscan.scan_sources(_sources(spark, d))).select("path", "rule_id", "severity", "confidence", "line", "symbol", "id")


@query(_FOUND + " select rule_id, count(*) as n from found group by 1")
def finding_counts(spark: SparkSession, d: str) -> DataFrame:
    return perfscan.count_findings(perfscan.scan_sources(_sources(spark, d)), "rule_id")


@query(_FOUND + " select path, case when p_partkey % 10 = 0 then 'ValueError: bad source' end as error, (case when p_partkey % 10 = 0 then 0 else (select count(*) from exp where exp.kind = p.kind) end)::int as n_rows from p")
def work_items(spark: SparkSession, d: str) -> DataFrame:
    """Files as work items: each ends with rows or with its error, and stops no other."""
    from factloom.functions import csource

    def work(text: str) -> list[dict]:
        if text.split("(")[0].endswith("0"):
            raise ValueError("bad source")
        return csource.scan(text)

    return ingest.map_files(_sources(spark, d), work, perfscan.FINDINGS.partition(", ")[2]).select("path", "error", F.size("rows").alias("n_rows"))


_GUARDED = "#ifdef A\nTEST(S%, One)\n#  if  X > 1\nint a;\n#elif Y\nint b;\n#else\nint c;\n#endif\n// TEST(S%, Not)\n#endif\nTEST_F(S%, Two)\nINSTANTIATE_TEST_SUITE_P(Pre, S%, x);\n"


def _guarded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.replace(F.lit(_GUARDED), F.lit("%"), F.col("p_partkey").cast("string")).alias("text"))


@query("with g(line, condition, branch, condition_line) as (values (2, 'defined(A)', 'then', 1), (4, 'X > 1', 'then', 3), (6, 'Y', 'elif', 5), (8, 'else', 'else', 7), (10, 'defined(A)', 'then', 1)) select 'p' || p_partkey as path, g.* from part, g")
def guard_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines under compile guards with the innermost condition."""
    return perfscan.guard_lines(_guarded(spark, d))


@query("with g(macro, pre, name, line) as (values ('TEST', 'S', 'One', 2), ('TEST_F', 'S', 'Two', 12)) select 'p' || p_partkey as path, macro, pre || p_partkey as suite, name, line from part, g union all select 'p' || p_partkey, 'INSTANTIATE_TEST_SUITE_P', 'Pre/S' || p_partkey, '*', 13 from part")
def declared_tests(spark: SparkSession, d: str) -> DataFrame:
    """Test macros of sources, outside of comments."""
    return perfscan.declared_tests(_guarded(spark, d))


@query("""with s as (select o_custkey as k, 'o' || o_orderkey as name, o_orderkey as s, o_orderkey + floor(o_totalprice / 20)::bigint + 1 as e from orders), p as (select distinct o_custkey as k, o_orderkey * 3 // 2 as pos from orders)
select p.k, p.pos, arg_max(s.name, (s.s, s.name)) as name from p left join s on s.k = p.k and s.s <= p.pos and p.pos < s.e group by all""")
def innermost_spans(spark: SparkSession, d: str) -> DataFrame:
    """The innermost span around each point: a range join by cells."""
    o = table(spark, d, "orders")
    spans = o.select(F.col("o_custkey").alias("k"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.floor(F.col("o_totalprice") / 20).cast("bigint") + 1).alias("end"))
    points = o.select(F.col("o_custkey").alias("k"), F.expr("o_orderkey * 3 div 2").alias("pos")).distinct()
    return perfscan.innermost(points, spans, "k")


@query("select p_partkey, case when p_container in ('low', 'medium', 'high') then p_container else 'medium' end as severity from (select p_partkey, case p_partkey % 5 when 0 then 'low' when 1 then 'medium' when 2 then 'high' when 3 then 'HIGH' end as p_container from part)")
def severities(spark: SparkSession, d: str) -> DataFrame:
    """Severities of a closed set, else the default."""
    k = F.col("p_partkey") % 5
    said = F.when(k == 0, "low").when(k == 1, "medium").when(k == 2, "high").when(k == 3, "HIGH")
    return table(spark, d, "part").select("p_partkey", perfscan.normalized(said, ["low", "medium", "high"], "medium").alias("severity"))


@query("""with t as (select p_partkey, trim(regexp_replace(' ' || repeat(p_name || chr(9) || chr(10) || p_brand || '  ', 3), '\\s+', ' ', 'g')) as t from part) select p_partkey, case when length(t) <= 60 then t else rtrim(substring(t, 1, 57)) || '...' end as condition from t""")
def compact_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Condition texts on one line, cut with an ellipsis."""
    text = F.concat(F.lit(" "), F.repeat(F.concat("p_name", F.lit("\t\n"), "p_brand", F.lit("  ")), 3))
    return table(spark, d, "part").select("p_partkey", compacted(text, 60).alias("condition"))


@query("""select rel_path as path, regexp_matches(rel_path, '^(.*/)?[^/]*_[^/]*\\.c$') or regexp_matches(rel_path, '^[a-m][^/]*/[^/]*\\.h$') as hit from (select distinct rel_path from source_inventory where rel_path is not null)""")
def glob_matches(spark: SparkSession, d: str) -> DataFrame:
    """Paths that match one of two anchored globs."""
    paths = table(spark, d, "source_inventory").where("rel_path is not null").select(F.col("rel_path").alias("path")).distinct()
    return paths.select("path", matches_any(F.col("path"), ["**/*_*.c", "[a-m]*/*.h"]).alias("hit"))


@query("select 'src' as folder, sum(octet_length(encode(replace(text, chr(10), ' '))) + 1)::bigint as n_bytes, true as hashed from documents where rel_path is not null and text is not null and not contains(text, chr(13))")
def file_census(spark: SparkSession, d: str) -> DataFrame:
    """Size and digest of the files of a tree that match a glob; a folder that doesn't is left out."""
    at = _at(spark, d, "tree")
    docs = table(spark, d, "documents").where("rel_path is not null and text is not null and not contains(text, '\r')").select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    docs.write.mode("overwrite").text(f"{at}/src")
    docs.write.mode("overwrite").text(f"{at}/other")
    files = scans.census(scans.file_tree(spark, at, ["src/part-*.txt"]))
    return files.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.sum("size").alias("n_bytes"), F.bool_and(F.length("sha256") == 64).alias("hashed"))


@query("select c_custkey, translate(c_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from customer")
def ascii_lowered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", ascii_lower("c_name").alias("low"))


@query("""select c_custkey, case when length(c_name) <= 12 then '{"a":"' || c_name || '"' else '{"a":"' || substring(c_name, 1, 12) || '...[TRUNCATED]"' end || ',"b":{"c":"[TRUNCATED]"}}' as doc from customer""")
def shortened_values(spark: SparkSession, d: str) -> DataFrame:
    """Documents bounded by depth and length of texts."""
    doc = F.to_json(F.struct(F.col("c_name").alias("a"), F.struct(F.struct(F.lit(1).alias("x")).alias("c")).alias("b")))
    return table(spark, d, "customer").select("c_custkey", shortened(doc, string=12, depth=2).alias("doc"))


@query("select c_name as name, c_custkey::varchar as file, c_name in (select c_name from customer group by 1 having count(*) > 1) as conflict from customer where c_custkey % 4 > 0 union all select c_name, 'x' || c_custkey, true from customer where c_custkey % 4 = 0 union all select c_name, c_custkey::varchar, true from customer where c_custkey % 4 = 0")
def catalog_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Named documents, and whether a name is used more than once."""
    c = table(spark, d, "customer")
    books = c.select(F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("file"))
    return scans.catalog(books.unionByName(c.where("c_custkey % 4 = 0").select(F.col("c_name").alias("name"), F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("file"))))


@query("select p_partkey::varchar as id from part where contains(lower(p_name), 'ring') or contains(lower(p_type), 'ring')")
def recipe_search(spark: SparkSession, d: str) -> DataFrame:
    """Recipes whose id, notes or tests hold a text."""
    books = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("notes"), F.array(F.lit("T"), "p_type").alias("tests"))
    return search.recipe_search(books, "RING").select("id")


_PARSED = [
    ("readers:x", "readers", "field", "incoming", "relation", 1, False), ("callers:main depth:2 file:src/", "callers", "function", "incoming", "relation_transitive", 2, False), ("callees:main depth:9", "callees", "function", "outgoing", "relation_transitive", 9, True),
    ("reachable:a->b", "reachable", "function", "outgoing", "relation_reachable", 8, False), ("reachable:a->b depth:3", "reachable", "function", "outgoing", "relation_reachable", 3, False), ("dispatches_via:Exec", "dispatches_via", "field", "outgoing", "relation", 1, False),
    ("writers:x depth:2", "writers", "field", "incoming", "relation", 2, True), ("plain words", None, None, None, None, None, None),
]


def _sql_value(x) -> str:
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'"


@query("select * from (values " + ", ".join("(" + ", ".join(map(_sql_value, r)) + ")" for r in _PARSED) + ") as t(query, predicate, anchor_kind, direction, mode, depth, refine)")
def parsed_queries(spark: SparkSession, d: str) -> DataFrame:
    """How queries of the language are understood; plain words are none of its own."""
    rows = []
    for text, *_ in _PARSED:
        q = parse(text)
        rows.append((text, *((q.predicate, q.anchor_kind, q.direction, q.mode, q.depth, q.complaint is not None) if q else (None,) * 6)))
    return spark.createDataFrame(rows, "query string, predicate string, anchor_kind string, direction string, mode string, depth int, refine boolean")
