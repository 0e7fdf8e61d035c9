"""Overlays: a delta of upserts and tombstones over one base view.

A base row is hidden if an upsert has its id, or its id or source is
tombstoned; relatives also if an end is not visible. All joins are equi-joins on
ids. Stats are counts over the merged view. Null ids and sources hide nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.model import View


@dataclass
class Overlay:
    fact_upserts: DataFrame
    relative_upserts: DataFrame
    fact_tombstones: DataFrame  # object_id
    relative_tombstones: DataFrame  # relative_id
    source_tombstones: DataFrame  # source_id


def _without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*df.columns)


def apply_overlay(base: View, over: Overlay) -> View:
    """The merged view."""
    gone = over.fact_tombstones.select("object_id").unionByName(over.fact_upserts.select("object_id"))
    facts = _without(_without(base.facts, gone, "object_id"), over.source_tombstones, "source_id").unionByName(over.fact_upserts.select(*base.facts.columns))
    gone = over.relative_tombstones.select("relative_id").unionByName(over.relative_upserts.select("relative_id"))
    kept = _without(_without(base.relatives, gone, "relative_id"), over.source_tombstones, "source_id")
    return View(facts, View(facts, kept).connected().unionByName(over.relative_upserts.select(*base.relatives.columns)))


def overlay_orphans(view: View, over: Overlay) -> DataFrame:
    """Upserted relatives with an end that the merged view lacks: (relative_id, end)."""
    ends = over.relative_upserts.select("relative_id", F.explode(F.array("from_fact_id", "to_fact_id")).alias("object_id"))
    return ends.join(view.facts.select("object_id"), "object_id", "left_anti").select("relative_id", F.col("object_id").alias("end"))


def view_stats(view: View) -> DataFrame:
    """(table, kind, n) counts of a view."""
    f = view.facts.groupBy(F.lit("facts").alias("table"), F.col("kind")).agg(F.count(F.lit(1)).alias("n"))
    r = view.relatives.groupBy(F.lit("relatives").alias("table"), F.col("relation_kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return f.unionByName(r)


def patches(lines: DataFrame, base: View) -> Overlay:
    """An overlay from patch lines (source_id, action, object_id, relative_id, payload, patched_at): the last line of an id decides, at equal times a tombstone.

    A fact upsert takes its fields from the payload; a relative upsert must name
    its ends there. A tombstone line with a source only hides the whole source.
    """
    last = lambda key: (
        lines.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("patched_at", (F.col("action") == "tombstone").alias("dead"), "payload", "source_id")).alias("x")).select(key, "x.*")
    )
    facts, rels = last("object_id"), last("relative_id")
    text = lambda k: F.get_json_object("payload", f"$.{k}")
    from factloom.plans.model import FACT_COLUMNS, promote  # here: model reads no overlays

    up = facts.where("not dead").select("object_id", *(text(c).alias(c) for c in FACT_COLUMNS[1:-1]), "payload")
    rel = rels.where("not dead").select(
        "relative_id", text("from_fact_id").alias("from_fact_id"), text("to_fact_id").alias("to_fact_id"), text("relation_kind").alias("relation_kind"),
        F.lit(None).cast(base.relatives.schema["condition"].dataType).alias("condition"), text("object_profile").alias("object_profile"), text("evidence_source").alias("evidence_source"),
        text("confidence").cast("double").alias("confidence"), "payload", "source_id",
    ).where("from_fact_id is not null and to_fact_id is not null")
    sources = lines.where("action = 'tombstone' and object_id is null and relative_id is null").select("source_id")
    return Overlay(promote(up), rel, facts.where("dead").select("object_id"), rels.where("dead").select("relative_id"), sources)
