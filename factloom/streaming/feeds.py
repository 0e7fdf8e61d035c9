"""Structured Streaming twins: log summaries, change feed, state folds.

All run with `trigger(availableNow=True)` or continuously; each has a batch
twin whose result it must equal once the input is drained.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators.ingest import latest_per_key
from factloom.operators.logs import parse_lines
from factloom.scratch import scratch_root
from factloom.sources.store import Store


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a folder of JSON-lines logs as they arrive; problems keep a null event and their issue."""
    return parse_lines(spark.readStream.format("text").load(folder))


def stream_log_summary(lines: DataFrame) -> DataFrame:
    """Running counts per channel, name and status with sums of durations. Complete mode."""
    e = lines.where("issue is null").select("event.*")
    return e.groupBy("channel", "event_name", "status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("duration_ms"))


def windowed_counts(events: DataFrame, ts: str, key: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per tumbling window and key; later than `late` are dropped (an addition: the logs themselves have no windows)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


CHANGES = "path string, sha256 string, previous string, seq bigint"


def _changes(key, batches, state: GroupState):
    """Tells each change of a path's digest, in order of time: what came before the watermark is settled, the rest waits."""
    last, seqs, shas = state.get if state.exists else (None, [], [])
    waiting = list(zip(seqs, shas))
    if not state.hasTimedOut:
        for df in batches:
            waiting += list(zip(df["seq"].tolist(), df["sha256"].tolist()))
    waiting.sort()
    settled, out = state.getCurrentWatermarkMs() * 1000, []
    while waiting and waiting[0][0] <= settled:
        n, sha = waiting.pop(0)
        if last is not None and sha != last:
            out.append((key[0], sha, last, n))
        last = sha
    state.update((last, [n for n, _ in waiting], [s for _, s in waiting]))
    if waiting:
        state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["path", "sha256", "previous", "seq"])


def stream_changes(observed: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Changes of digests in a feed of observations (path, sha256, seq in microseconds), in any order of arrival.

    An observation waits until the watermark, the latest seq less `late`, has
    passed it, so order of arrival does not matter; what comes later than that
    is dropped. State is a path's last digest and what waits. A path's first
    digest is no change.
    """
    at = observed.where("path is not null and sha256 is not null and seq is not null").withColumn("at", F.timestamp_micros("seq")).withWatermark("at", late)
    return at.groupBy("path").applyInPandasWithState(_changes, CHANGES, "last string, seqs array<bigint>, shas array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def batch_changes(observed: DataFrame) -> DataFrame:
    """The batch twin of `stream_changes`: what it gives once the watermark has passed all observations."""
    from pyspark.sql.window import Window

    prev = F.lag("sha256").over(Window.partitionBy("path").orderBy("seq"))
    return observed.where("path is not null and sha256 is not null").withColumn("previous", prev).where("previous is not null and previous <> sha256").select("path", "sha256", "previous", "seq")


def _fold(key, batches, state: GroupState):
    """The state of a session after its records, in order of seq."""
    now, seq = state.get if state.exists else ("created", -1)
    rows = pd.concat(list(batches)).sort_values("seq")
    for kind, name, n in zip(rows["kind"], rows["name"], rows["seq"]):
        if n > seq:
            now, seq = next_state(now, kind, name), int(n)
    state.update((now, seq))
    yield pd.DataFrame([(key[0], now, seq)], columns=["session", "state", "seq"])


def next_state(state: str, kind: str, name: str) -> str:
    """How a debugger record moves a session: results and execution records count, notices don't."""
    if kind == "result":
        return {"running": "running", "error": "error", "exit": "exited"}.get(name, state)
    if kind == "exec":
        return {"running": "running", "stopped": "stopped", "exited": "exited"}.get(name, state)
    return state


def stream_session_states(records: DataFrame) -> DataFrame:
    """(session, state, seq) after each batch of records (session, kind, name, seq). Update mode."""
    return records.where("session is not null").groupBy("session").applyInPandasWithState(_fold, "session string, state string, seq bigint", "state string, seq bigint", "update", GroupStateTimeout.NoTimeout)


def once_per(df: DataFrame, keys: list[str], ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first row of each key, such as a refresh per match and round.

    In a stream name its time `ts`: a key is then forgotten when it has not been
    seen for `late`, which bounds the state.
    """
    return df.dropDuplicates(keys) if ts is None else df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def upsert_sink(spark: SparkSession, path: str, keys: list[str], order: list[str], compact_every: int = 16):
    """A `foreachBatch` body that keeps the latest row per key; `read_upserts` reads the table.

    A micro-batch writes its own latest rows only. Every `compact_every` batches
    they are put together with those before, a pointer is moved to the new
    table in one step, and what it replaces is removed at the next time. A batch
    that runs again rewrites its own folder.
    """
    store = Store(spark, path)

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_per_key(batch, keys, order).write.mode("overwrite").parquet(f"{path}/delta/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            latest_per_key(read_upserts(spark, path, keys, order), keys, order).write.mode("overwrite").parquet(f"{path}/base/to={batch_id}")
            store._write(str(batch_id), "current")
            for name in store.names("base"):
                if int(name.split("=")[1]) < batch_id - compact_every:
                    store._fs.delete(store._path("base", name), True)
            for name in store.names("delta"):
                if int(name.split("=")[1]) <= batch_id - compact_every:
                    store._fs.delete(store._path("delta", name), True)

    return write


def read_upserts(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row per key of a table that `upsert_sink` keeps."""
    store = Store(spark, path)
    to = int(store._read("current") or -1)
    parts = [f"{path}/delta/{n}" for n in store.names("delta") if int(n.split("=")[1]) > to] + ([f"{path}/base/to={to}"] if to >= 0 else [])
    return latest_per_key(spark.read.parquet(*parts), keys, order)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now into Parquet; each batch of a complete stream replaces the one before."""
    spark = stream.sparkSession
    at = f"{scratch_root(spark)}/stream-{name}-{uuid.uuid4().hex}"
    keep = "overwrite" if mode == "complete" else "append"
    # An append is made to the batch's own folder, so that a batch that runs again adds nothing.
    into = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/rows" if keep == "overwrite" else f"{at}/rows/{n}")
    stream.writeStream.foreachBatch(into).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    empty = spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{at}/rows") if Store(spark, at)._exists("rows") else empty
