"""Published snapshots: Parquet tables, a manifest, and a pointer to the current one.

A snapshot's id follows from its content: equal content is published once. Row
digests are hashed as a tree, so no ordered pass over the lines is needed; ids
are therefore our own. The driver alone moves the pointer, by one rename.
Relatives are kept twice, sorted by either end, in place of two indexes: reads
of a fact's edges push its id down to the row groups of the copy for that end.
Counters by kind, profile and source are a table of the snapshot; the manifest
holds totals, and counters of the relation kinds, of which there are few.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.canonical import canonical_json
from factloom.functions.digest import tree_digest
from factloom.functions.paths import source_bucket
from factloom.operators.ingest import duplicate_ids
from factloom.plans.model import FACT_COLUMNS, RELATIVE_COLUMNS, View, promote

SCHEMA_VERSION = 1
KEYS = {"facts": "object_id", "relatives": "relative_id", "source_inventory": "source_id"}
#: What each copy is sorted by.
SORTED = {"facts": ["object_id"], "relatives": ["from_fact_id", "relation_kind", "relative_id"], "relatives_by_to": ["to_fact_id", "relation_kind", "relative_id"], "source_inventory": ["source_id"]}
#: The columns that a table's digest covers, where it has derived ones.
OWN = {"facts": FACT_COLUMNS}


class StoreError(ValueError):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}")
        self.code = code


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order and layout; repeated rows count."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    return tree_digest(df.select(row.alias("line")), []).first()["digest"]


def counters(facts: DataFrame, relatives: DataFrame) -> DataFrame:
    """(what, value, n, n_conditional): facts by kind, profile and source, relatives by kind."""
    kind = F.coalesce(F.nullif(F.get_json_object("payload", "$.fact_kind"), F.lit("")), F.lit("fact"))
    marks = F.array(*(F.struct(F.lit(n).alias("what"), c.alias("value")) for n, c in (("fact_kind", kind), ("profile", F.col("object_profile")), ("source", source_bucket(F.col("object_source"))))))
    of_facts = facts.select(F.explode(marks).alias("x")).groupBy("x.what", "x.value").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("bigint").alias("n_conditional"))
    of_relatives = relatives.groupBy(F.lit("relation_kind").alias("what"), F.col("relation_kind").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count("condition").alias("n_conditional"))
    return of_facts.unionByName(of_relatives)


def totals_of(facts: DataFrame, relatives: DataFrame) -> dict:
    """What a manifest holds of `counters`: totals, and relatives by kind (of a closed set)."""
    rows = relatives.groupBy("relation_kind").agg(F.count(F.lit(1)).alias("n"), F.count("condition").alias("c")).collect()
    out = facts.agg(F.count(F.lit(1)).alias("fact_count"), F.count("object_caller").alias("with_caller"), F.count("object_callee").alias("with_callee")).first().asDict()
    return out | {"relation_kinds": {r["relation_kind"]: r["n"] for r in rows}, "relative_count": sum(r["n"] for r in rows), "conditional_relative_count": sum(r["c"] for r in rows)}


def orphan_edges(facts: DataFrame, relatives: DataFrame) -> DataFrame:
    """(relative_id, end): ends of relatives that are no fact."""
    ends = relatives.select("relative_id", F.explode(F.array("from_fact_id", "to_fact_id")).alias("object_id"))
    return ends.join(facts.select("object_id"), "object_id", "left_anti").select("relative_id", F.col("object_id").alias("end"))


def compression_ratio(raw: int, stored: int) -> float:
    return round(raw / stored, 2) if stored else 1.0


class Store:
    """A folder of snapshots on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    # files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(self.root, *parts))

    def _exists(self, *parts: str) -> bool:
        return self._fs.exists(self._path(*parts))

    def _write(self, text: str, *parts: str) -> None:
        """Written beside, then renamed over the old file in one step: readers see the old or the new one, after a crash too."""
        jvm = self.spark._jvm
        tmp = self._path(*parts[:-1], f".{parts[-1]}-{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(tmp), self._fs.makeQualified(self._path(*parts)), options)
        except Exception as e:
            self._fs.delete(tmp, False)
            raise StoreError("publish_failed", parts[-1]) from e

    def _read(self, *parts: str) -> str | None:
        if not self._exists(*parts):
            return None
        source = self._fs.open(self._path(*parts))  # a few bytes, read by the driver itself
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def exists(self) -> bool:
        """Whether a snapshot has been published here."""
        return self._exists("snapshots", "current")

    def names(self, *parts: str) -> list[str]:
        """Names of the folders inside a folder of the store."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(*parts)) if s.isDirectory()) if self._exists(*parts) else []

    def drop(self) -> None:
        """Removes the whole store."""
        self._fs.delete(self._path(), True)

    def reap_staging(self, older_than: float, now: float | None = None) -> int:
        """Removes what publications that never ended left behind, if it is older than so many seconds; returns how many."""
        gone, limit = 0, ((now or time.time()) - older_than) * 1000
        for s in self._fs.listStatus(self._path()) if self._exists() else []:
            if s.getPath().getName().startswith("staging-") and s.getModificationTime() < limit:
                gone += self._fs.delete(s.getPath(), True)
        return gone

    # publishing

    def publish(self, facts: DataFrame, relatives: DataFrame, inventory: DataFrame | None = None, *, check: bool = True) -> dict:
        """Publishes a snapshot and points to it; content that is there already is only pointed to (`reused`)."""
        inventory = inventory if inventory is not None else self.spark.createDataFrame([], "source_id string, rel_path string")
        facts = promote(facts.select(*FACT_COLUMNS).withColumn("payload", canonical_json(F.col("payload"))))  # search columns are made here, once
        relatives = relatives.select(*RELATIVE_COLUMNS).withColumn("payload", canonical_json(F.col("payload")))
        tables = {"facts": facts, "relatives": relatives, "source_inventory": inventory}
        staging = f"staging-{uuid.uuid4().hex}"
        began = time.time()
        try:
            at = lambda name: posixpath.join(self.root, staging, name)
            def written(name: str, df: DataFrame, order: list[str]) -> DataFrame:
                df.repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order).write.parquet(at(name))
                return self.spark.read.schema(df.schema).parquet(at(name))

            with ThreadPoolExecutor(8) as pool:  # jobs that don't wait for each other, side by side
                stored = dict(zip(tables, pool.map(lambda n: written(n, tables[n], SORTED[n]), tables)))
                if check:
                    self._check(stored, pool)
                by_to = pool.submit(written, "relatives_by_to", stored["relatives"], SORTED["relatives_by_to"])
                counted = pool.submit(lambda: counters(stored["facts"], stored["relatives"]).write.parquet(at("counters")))
                totals = pool.submit(totals_of, stored["facts"], stored["relatives"])
                hashed = {n: pool.submit(table_digest, df.select(*OWN.get(n, df.columns))) for n, df in stored.items()}
                digests = {f"{n}_sha256": f.result() for n, f in hashed.items()}
                by_to.result(), counted.result()
            sid = "sha256-" + hashlib.sha256("\n".join(digests.values()).encode()).hexdigest()[:16]
            if self._exists("snapshots", sid, "manifest.json"):
                manifest = json.loads(self._read("snapshots", sid, "manifest.json")) | {"reused": True}
            else:
                manifest = {"schema_version": SCHEMA_VERSION, "snapshot_id": sid, **digests, "checked": check, "source_count": stored["source_inventory"].count(), "created_at": began} | totals.result()
                manifest["bytes_on_disk"] = self._fs.getContentSummary(self._path(staging)).getLength()
                self._write(json.dumps(manifest, sort_keys=True), staging, "manifest.json")
                self._fs.mkdirs(self._path("snapshots"))
                if not self._fs.rename(self._path(staging), self._path("snapshots", sid)):
                    raise StoreError("publish_failed", sid)
                manifest["reused"] = False
        finally:
            self._fs.delete(self._path(staging), True)
        self._write(sid, "snapshots", "current")
        return manifest

    def _check(self, stored: dict[str, DataFrame], pool: ThreadPoolExecutor) -> None:
        twice = {n: pool.submit(lambda n=n: duplicate_ids(stored[n], KEYS[n]).limit(1).count()) for n in stored}
        missing = pool.submit(lambda: orphan_edges(stored["facts"], stored["relatives"]).limit(1).count())
        for name, found in twice.items():
            if found.result():
                raise StoreError(f"duplicate_{KEYS[name]}")
        if missing.result():
            raise StoreError("relative_endpoint_missing")

    # reading

    def current(self) -> str | None:
        text = self._read("snapshots", "current")
        return text.strip() if text else None

    def manifest(self, sid: str | None = None) -> dict:
        """The manifest of a snapshot; of an empty store zeros. Another schema is refused."""
        sid = sid or self.current()
        if sid is None:
            return {"fact_count": 0, "relative_count": 0, "source_count": 0}
        text = self._read("snapshots", sid, "manifest.json")
        if text is None:
            raise StoreError("snapshot_missing", sid)
        out = json.loads(text)
        if out.get("schema_version") != SCHEMA_VERSION:
            raise StoreError("unsupported_schema_version", str(out.get("schema_version")))
        return out

    def table(self, name: str, sid: str | None = None) -> DataFrame:
        return self.spark.read.parquet(posixpath.join(self.root, "snapshots", sid or self.current(), name))

    def view(self, sid: str | None = None) -> View:
        m = self.manifest(sid)
        sid = m["snapshot_id"]
        with_source = lambda df: df.withColumn("source_id", F.nullif(F.get_json_object("payload", "$.source_id"), F.lit("")))
        return View(self.table("facts", sid), with_source(self.table("relatives", sid)), with_source(self.table("relatives_by_to", sid)), m["checked"])

    def verify(self, sid: str | None = None) -> None:
        """Raises if the tables don't fit the digests of the manifest."""
        m = self.manifest(sid)
        for name in KEYS:
            df = self.table(name, m["snapshot_id"])
            if table_digest(df.select(*OWN.get(name, df.columns))) != m[f"{name}_sha256"]:
                raise StoreError("snapshot_corrupt", name)

    def snapshots(self) -> list[dict]:
        """Manifests of all snapshots, oldest first."""
        if not self._exists("snapshots"):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("snapshots")) if s.isDirectory()]
        return sorted((self.manifest(n) for n in names), key=lambda m: (m["created_at"], m["snapshot_id"]))

    # overlays

    def publish_overlay(self, patches: dict[str, DataFrame], dirty: int = 0) -> dict:
        """Publishes fact_upserts, relative_upserts, fact_tombstones and relative_tombstones (and source_tombstones) over the current snapshot."""
        sid = self.current()
        names = ["fact_upserts", "fact_tombstones", "relative_upserts", "relative_tombstones", "source_tombstones"]
        digest = hashlib.sha256((sid or "").encode())
        for n in names:
            digest.update(b"\0" + table_digest(patches[n]).encode())
        oid = "overlay-" + digest.hexdigest()[:16]
        for n in names:
            patches[n].write.mode("overwrite").parquet(posixpath.join(self.root, "overlays", oid, n))
        out = {"overlay_id": oid, "base_snapshot_id": sid, "dirty_count": dirty, "created_at": time.time(), **{n: patches[n].count() for n in names}}
        self._write(json.dumps(out, sort_keys=True), "overlays", oid, "manifest.json")
        self._write(oid, "overlays", "active")
        self._reap(oid)
        return out

    def overlay(self, ttl: float = 0, now: float | None = None) -> dict | None:
        """The active overlay's manifest; none if it stands over another snapshot or is older than `ttl` seconds (0: never)."""
        oid = self._read("overlays", "active")
        text = self._read("overlays", oid.strip(), "manifest.json") if oid else None
        m = json.loads(text) if text else None
        if m is None or m["base_snapshot_id"] != self.current() or ttl and (now or time.time()) - m["created_at"] >= ttl:
            return None
        return m

    def overlay_tables(self, oid: str) -> dict[str, DataFrame]:
        names = ["fact_upserts", "fact_tombstones", "relative_upserts", "relative_tombstones", "source_tombstones"]
        return {n: self.spark.read.parquet(posixpath.join(self.root, "overlays", oid, n)) for n in names}

    def drop_overlay(self) -> None:
        self._fs.delete(self._path("overlays", "active"), False)
        self._reap(None)

    def _reap(self, keep: str | None) -> None:
        if self._exists("overlays"):
            for s in self._fs.listStatus(self._path("overlays")):
                if s.isDirectory() and s.getPath().getName() != keep:
                    self._fs.delete(s.getPath(), True)


def export_lines(df: DataFrame, key: str, kind: str, path: str, mode: str = "error") -> None:
    """Stored lines (schema_version, key, kind, payload, payload_sha256) as gzip JSON, sorted by key within each file."""
    payload = canonical_json(F.to_json(F.struct(*df.columns)))
    out = df.select(F.lit(SCHEMA_VERSION).alias("schema_version"), key, F.col(kind), payload.alias("payload")).withColumn("payload_sha256", F.sha2("payload", 256))
    out.repartitionByRange(key).sortWithinPartitions(key).write.mode(mode).option("compression", "gzip").json(path)
