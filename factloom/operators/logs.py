"""Event logs: line scan with classified problems, and summaries.

A line is a problem if it is too long, no JSON, or no valid event; blank lines
are nothing. Summaries count only events. Empty logs have empty summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.jsonops import redacted, shortened

# Fixed values of the log format.
MAX_LINE = 64 * 1024
SCHEMAS = [1, 2]
STATUSES = ["ok", "error", "warning"]
CHANNEL = r"^[a-z][a-z0-9_-]{0,62}$"
EVENT_NAME = r"^[a-z][a-z0-9_-]*(?:\.[a-z][a-z0-9_-]*)+$"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"
EVENT_SCHEMA = "schema_version int, event_name string, timestamp string, status string, duration_ms double, channel string, correlation_id string, subject_id string, summary string, counts map<string,bigint>, error_code string, payload string"


def valid_event(e: Column) -> Column:
    """Whether a parsed event obeys the rules of the log."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    status = F.coalesce(e["status"], F.lit("ok"))
    return (
        ok(F.coalesce(e["schema_version"], F.lit(1)).isin(SCHEMAS)) & ok(e["event_name"].rlike(EVENT_NAME)) & ok(e["channel"].rlike(CHANNEL)) & status.isin(STATUSES)
        & ((status != "error") | ok(e["error_code"] != "")) & ok(e["timestamp"].rlike(TIMESTAMP)) & F.try_to_timestamp(F.substring(e["timestamp"], 1, 26), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).isNotNull()
    )


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Adds `event` (null for a problem) and `issue` (null for an event); blank lines go. Works on streams as well."""
    text = F.col(line)
    event = F.from_json(text, EVENT_SCHEMA)
    is_json = F.try_parse_json(text).isNotNull()
    out = lines.where(F.trim(text) != "").withColumn("event", event)
    issue = F.when(F.octet_length(text) + 1 > MAX_LINE, "oversized_line").when(~is_json, "malformed_json").when(F.col("event").isNull() | ~valid_event(F.col("event")), "invalid_schema")
    out = out.withColumn("issue", issue)
    filled = F.struct(
        *(F.coalesce(F.col(f"event.{c}"), d).alias(c) if (d := {"status": F.lit("ok"), "schema_version": F.lit(1)}.get(c)) is not None else F.col(f"event.{c}").alias(c) for c in [x.split()[0] for x in EVENT_SCHEMA.split(", ")])
    )
    return out.withColumn("event", F.when(F.col("issue").isNull(), filled))


def in_window(ts: Column, since: str | None, until: str | None) -> Column:
    """since <= ts <= until, as texts; a bound may be missing."""
    if since is not None and until is not None and since > until:
        raise ValueError("since must not be after until")
    ok = F.lit(True)
    if since is not None:
        ok = ok & (ts >= since)
    return ok if until is None else ok & (ts <= until)


def count_by(events: DataFrame, column: str) -> DataFrame:
    """Events per value of a column, nulls and empty texts left out."""
    return events.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def summary_totals(events: DataFrame, order: list[str]) -> DataFrame:
    """One row: number of events, sum of durations, latest time, code of the latest error (ties: the last in `order`)."""
    failed = F.when(F.coalesce(F.col("error_code") != "", F.lit(False)), F.struct("timestamp", *order, "error_code"))
    return events.agg(
        F.count(F.lit(1)).alias("total_events"), F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("duration_ms_total"), F.max("timestamp").alias("latest_event_at"), F.max(failed)["error_code"].alias("latest_error_code")
    )


def sum_counts(events: DataFrame) -> DataFrame:
    """Sum of each key of the `counts` maps."""
    return events.select(F.explode("counts").alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def summarize(events: DataFrame, order: list[str]) -> dict:
    """All of the summary as plain values. One pass for the four groupings: the event is counted under each of its marks."""
    marks = F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in ("channel", "event_name", "status", "error_code")))
    out: dict = {c: {} for c in ("channel", "event_name", "status", "error_code")}
    for r in events.select(F.explode(marks).alias("x")).select("x.*").where("value is not null and value <> ''").groupBy("what", "value").count().collect():
        out[r["what"]][r["value"]] = r["count"]
    return out | summary_totals(events, order).first().asDict() | {"counts": {r["key"]: r["total"] for r in sum_counts(events).collect()}}


def newest(df: DataFrame, key: str, keep: int, except_for: str | None = None) -> DataFrame:
    """The `keep` newest rows by `key` (a top-k), and always the one just written."""
    top = df.orderBy(F.desc(key)).limit(keep)
    if except_for is None:
        return top
    return df.where(F.col("digest") == except_for).unionByName(df.where(F.col("digest") != except_for).orderBy(F.desc(key)).limit(max(0, keep - 1)))


# --- writing -------------------------------------------------------------------------------------


def iso_micros(ts: Column) -> Column:
    """UTC time as text with microseconds and a Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def millis_between(start: Column, end: Column) -> Column:
    """Milliseconds from one time to another."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(start)) / F.lit(1000.0)


def event_lines(events: DataFrame, payload: str | None = None) -> DataFrame:
    """(channel, value): JSON lines of events; secrets of the payload are hidden and long ones cut, and a line that still is too long goes without payload."""
    columns = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
    rows = events if payload is None else events.withColumn(payload, shortened(redacted(F.col(payload))))
    line = lambda cols: F.to_json(F.struct(*(F.col(c) for c in cols if c in rows.columns)))
    whole = line(columns)
    return rows.select("channel", F.when(F.octet_length(whole) + 1 > MAX_LINE, line([c for c in columns if c != payload])).otherwise(whole).alias("value"))


def append_events(events: DataFrame, folder: str, payload: str | None = None, mode: str = "append") -> None:
    """Appends events to the logs of a folder, one log per channel."""
    lines = event_lines(events, payload)
    for r in lines.select("channel").distinct().collect():  # a log is a file of the folder; there are few channels
        lines.where(F.col("channel") == r[0]).select("value").write.mode(mode).text(f"{folder}/{r[0]}.jsonl")


def query_event(name: str, result, limit: int, duration_ms: float, timestamp: str) -> dict:
    """The event that tells of an answered query: counts and flags, no texts of the query."""
    status = "ok" if result.status in ("ok", "too_broad") else "warning"
    counts = {"total": result.total, "returned": len(result.rows), "limit": limit, "visited": result.visited, "edges": result.edges, "complete": int(result.complete)}
    return {"schema_version": 2, "event_name": name, "timestamp": timestamp, "status": status, "duration_ms": float(duration_ms), "channel": "queries", "summary": result.status, "counts": counts}
