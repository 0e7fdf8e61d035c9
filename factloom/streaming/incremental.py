"""Keeping a published store up to date with its sources, file by file.

A feed of observed digests (path, sha256, seq) drives it. Each micro-batch is
compared with the digests of the state; only sources whose digest changed are
extracted again, and what they give is published as an overlay over the store's
snapshot. A source that can't be extracted keeps its old facts and is told with
its error; if the refresh as a whole fails, the base view stays as it was and
the state says why. Sources no longer observed keep their facts.

Null paths and digests are left out. A batch that runs again gives the same
overlay, since the overlay's id follows from its content.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.ingest import latest_per_key, map_files
from factloom.operators.overlay import Overlay, apply_overlay
from factloom.plans.model import FACT_COLUMNS, View, promote
from factloom.scratch import stage
from factloom.sources.store import Store, StoreError

#: The fields that an extractor gives for each fact.
FIELDS = ", ".join(f"{c} string" for c in FACT_COLUMNS)
PARTS = ["fact_upserts", "fact_tombstones", "relative_upserts", "relative_tombstones", "source_tombstones"]


@dataclass
class Status:
    """How the last refresh went; the same is written to the store."""

    state: str = "idle"  # idle, ok, error
    snapshot_id: str | None = None
    overlay_id: str | None = None
    dirty: int = 0
    failed: int = 0
    error: str | None = None
    seconds: float = 0.0
    failures: list = field(default_factory=list)  # (path, error) of at most so many files as are told
    TOLD = 20


class Refresher:
    """Refreshes one store; `read(paths)` gives (path, text) of sources, `extract(text)` the facts of one as dicts."""

    def __init__(self, store: Store, read: Callable[[DataFrame], DataFrame], extract: Callable[[str], list[dict]]):
        self.store, self.read, self.extract = store, read, extract
        self.status, self._query = Status(), None

    # digests

    def known(self) -> DataFrame:
        """(path, sha256, seq): the last digest of each source."""
        spark = self.store.spark
        names = [n for n in self.store.names("digests") if self.store._exists("digests", n, "_SUCCESS")]
        if not names:
            return spark.createDataFrame([], "path string, sha256 string, seq bigint")
        return spark.read.parquet(f"{self.store.root}/digests/{max(names)}")

    def prime(self, observed: DataFrame) -> None:
        """Takes digests as they are, without extracting: what is known when a watch begins."""
        self._remember(observed, 0)

    def _remember(self, observed: DataFrame, batch_id: int) -> None:
        both = self.known().unionByName(observed.select("path", "sha256", "seq").dropna(subset=["path", "sha256"]))
        latest_per_key(both, ["path"], ["seq", "sha256"]).write.mode("overwrite").parquet(f"{self.store.root}/digests/{batch_id:012}")
        for old in self.store.names("digests")[:-2]:
            self.store._fs.delete(self.store._path("digests", old), True)

    # one refresh

    def dirty(self, observed: DataFrame) -> DataFrame:
        """(path): observed sources whose latest digest is new or differs from the known one."""
        now = latest_per_key(observed.select("path", "sha256", "seq").dropna(subset=["path", "sha256"]), ["path"], ["seq", "sha256"])
        was = self.known().select("path", F.col("sha256").alias("was"), F.col("seq").alias("was_seq"))
        return now.join(was, "path", "left").where(F.col("was").isNull() | ((F.col("seq") >= F.col("was_seq")) & (F.col("was") != F.col("sha256")))).select("path")

    def refresh(self, observed: DataFrame, batch_id: int = 1) -> Status:
        """Extracts what changed and publishes it; never raises for a source or a failed publication, but tells of it."""
        began, base = time.time(), self.store.current()
        try:
            self.status = self._refresh(observed, base)
            self._remember(observed, batch_id)
        except Exception as e:  # noqa: BLE001  the base view stays; the state tells why
            code = e.code if isinstance(e, StoreError) else type(e).__name__
            self.status = Status("error", base, error=f"{code}: {e}"[:500])
        self.status.seconds = round(time.time() - began, 3)
        self.store._write(json.dumps({k: v for k, v in vars(self.status).items()}, sort_keys=True), "incremental.json")
        return self.status

    def _refresh(self, observed: DataFrame, base: str | None) -> Status:
        dirty = stage(self.dirty(observed), "dirty")
        n = dirty.count()
        active = self.store.overlay()
        if n == 0:
            return Status("ok", base, active and active["overlay_id"])
        items = stage(map_files(self.read(dirty), self.extract, FIELDS), "extracted")
        failed = items.where("error is not null")
        told = [(r["path"], r["error"]) for r in failed.select("path", "error").orderBy("path").limit(Status.TOLD).collect()]
        done = items.where("error is null")
        fresh = promote(done.select(F.explode("rows").alias("x")).select("x.*").dropDuplicates(["object_id"]))
        facts = self.store.table("facts", base)
        gone = facts.join(done.select(F.col("path").alias("source_path")), "source_path", "left_semi").join(fresh.select("object_id"), "object_id", "left_anti").select("object_id")
        over = {p: t for p, t in zip(PARTS, (fresh.select(*facts.columns), gone, self.store.view(base).relatives.limit(0), gone.select(F.col("object_id").alias("relative_id")).limit(0), gone.select(F.col("object_id").alias("source_id")).limit(0)))}
        if active:  # what an earlier refresh found out about other sources goes on
            kept = self.store.overlay_tables(active["overlay_id"])
            other = kept["fact_upserts"].join(done.select(F.col("path").alias("source_path")), "source_path", "left_anti")
            over["fact_upserts"] = stage(over["fact_upserts"].unionByName(other.join(fresh.select("object_id"), "object_id", "left_anti").select(*facts.columns)), "upserts")
            over["fact_tombstones"] = stage(over["fact_tombstones"].unionByName(kept["fact_tombstones"]).distinct().join(over["fact_upserts"].select("object_id"), "object_id", "left_anti"), "tombstones")
        m = self.store.publish_overlay(over, n)
        return Status("ok", base, m["overlay_id"], n, failed.count(), None, 0.0, told)

    def view(self) -> View:
        """What a reader sees now: the snapshot under its active overlay, or the snapshot alone if the overlay stands over another."""
        base, m = self.store.view(), self.store.overlay()
        if m is None:
            return base
        return apply_overlay(base, Overlay(**self.store.overlay_tables(m["overlay_id"])))

    # the watch

    def start(self, feed: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Follows a stream of observations; by default all that is there now, then ends."""
        query = feed.writeStream.foreachBatch(lambda batch, n: self.refresh(batch.persist(), n + 1) and None)
        self._query = query.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        return self._query

    def stop(self) -> Status:
        """Ends the watch after the batch at hand."""
        if self._query is not None and self._query.isActive:
            self._query.stop()
        self._query = None
        return self.status


def progress(query: StreamingQuery) -> list[dict]:
    """(batch, rows, milliseconds) of what a stream has told of its batches so far, at most as many as the engine keeps."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "ms": p["durationMs"].get("triggerExecution", 0)} for p in query.recentProgress]


def state_of(spark: SparkSession, root: str) -> dict:
    """The written status of a store's last refresh; idle if there was none."""
    text = Store(spark, root)._read("incremental.json")
    return json.loads(text) if text else vars(Status())
