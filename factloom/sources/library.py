"""The graph of a data folder as a published store, made once per session and read by every query after that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.model import RELATIVE_COLUMNS, View, base_view
from factloom.scratch import scratch_root, stage
from factloom.session import table
from factloom.sources.store import Store

TABLES = ["facts", "system_facts", "relatives", "source_inventory"]
_stores: dict[tuple, Store] = {}


def _version(spark: SparkSession, d: str) -> tuple:
    """What tells one state of a folder's tables from another: length and time of their files."""
    seen = []
    for name in TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for s in [fs.getFileStatus(path), *(fs.listStatus(path) if fs.getFileStatus(path).isDirectory() else [])]:
            seen.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return (spark.sparkContext.applicationId, d, *sorted(seen))


def connected_view(spark: SparkSession, d: str) -> View:
    """The current facts and those of the relatives that have both ends: what may be published."""
    base = base_view(spark, d)
    facts = stage(base.facts, "facts")
    return View(facts, View(facts, base.relatives).connected().select(*RELATIVE_COLUMNS))


def inventory(spark: SparkSession, d: str) -> DataFrame:
    """Sources by id, each once (the largest row)."""
    rows = table(spark, d, "source_inventory").where("source_id is not null")
    rest = [c for c in rows.columns if c != "source_id"]
    return rows.groupBy("source_id").agg(F.max(F.struct(*rest)).alias("x")).select("source_id", "x.*")


def published(spark: SparkSession, d: str) -> Store:
    """The store of a data folder, published on first use; a folder whose files changed is published anew."""
    key = _version(spark, d)
    if key not in _stores or not _stores[key].exists():
        store = Store(spark, f"{scratch_root(spark)}/store-{abs(hash(key)):x}")
        view = connected_view(spark, d)
        store.publish(view.facts, view.relatives, inventory(spark, d))
        _stores[key] = store
    return _stores[key]
