"""Problem 1: references to records that do not exist.

Distinct non-null foreign keys are anti-joined with the parent keys, and the
broken keys are joined back to the references, which are then counted per
referring field and month. Keys that do exist need more than an anti-join,
since a parent may have come too late or have been deleted before: the few
keys with a deletion go through `asof_state`.

Nulls: a null key is no reference; an empty string is one. A reference without
time is judged by the last state of its parent and has a null period. A change
without time counts as later than every dated reference, and is the last state
of its key. Empty tables give no rows. Repeated rows count once, from their
earliest time. Of a deletion and an arrival at the same moment, the deletion wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.scratch import asof_state, hot_keys, hot_of, skew_join, stage

#: In place of a missing time.
FAR = "9999-12-31 00:00:00"


def find_orphans(
    children: DataFrame,
    parents: DataFrame,
    *,
    child_id: str,
    ref_fields: list[str],
    arrived_at: str,
    parent_id: str,
    changed_at: str,
    deleted: str,
    eternal: DataFrame | None = None,
) -> DataFrame:
    """Broken references: (child_id, ref_field, ref_id, reason, arrived_at).

    `parents` holds one row per change: `parent_id`, `changed_at`, and the
    boolean `deleted`. `eternal` holds parent ids that always exist. `reason`
    is `missing` (no change at all), `late` (all changes come after the
    reference) or `deleted` (the last change at or before it is a deletion).
    """
    far = F.lit(FAR).cast(children.schema[arrived_at].dataType)
    kids = stage(
        children.select(F.col(child_id).alias("child"), *(F.col(f).alias(f"ref{k}") for k, f in enumerate(ref_fields)), F.col(arrived_at).alias("r"))
        .groupBy("child", *(f"ref{k}" for k in range(len(ref_fields))))
        .agg(F.min("r").alias("r")),
        "references",
    )
    refs = kids.select("child", "r", F.explode(F.array(*(F.struct(F.lit(f).alias("ref_field"), F.col(f"ref{k}").alias("key")) for k, f in enumerate(ref_fields)))).alias("x"))
    refs = refs.select("child", "r", "x.*").where("key is not null").withColumn("when", F.coalesce("r", far))

    # One row per key and moment: repeats of a change, however many, are gone after the map-side aggregation.
    changes = (
        parents.select(F.col(parent_id).alias("key"), F.coalesce(F.col(changed_at), far).alias("t"), F.coalesce(F.col(deleted), F.lit(False)).alias("dead"))
        .where("key is not null").groupBy("key", "t").agg(F.max("dead").alias("dead"))
    )
    history = changes.groupBy("key").agg(F.min("t").alias("first"), F.min(F.when(F.col("dead"), F.col("t"))).alias("first_dead"))

    keys = stage(refs.groupBy("key").agg(F.min("when").alias("earliest"), F.max("when").alias("latest"), F.count(F.lit(1)).alias("n")), "keys")
    hot = hot_of(keys, "key")
    if eternal is not None:
        keys = keys.join(eternal.select(F.col(eternal.columns[0]).alias("key")).distinct(), "key", "left_anti")
    missing = keys.join(history, "key", "left_anti").select("key", F.lit("missing").alias("verdict"), F.lit(None).cast("timestamp_ntz").alias("first"))
    dated = keys.join(history, "key").select(
        "key",
        F.when(F.col("first_dead") <= F.col("latest"), "asof").when(F.col("first") > F.col("earliest"), "late").alias("verdict"),
        F.col("first").cast("timestamp_ntz").alias("first"),
    )
    suspects = stage(missing.unionByName(dated.where("verdict is not null")), "suspects")

    at = stage(skew_join(refs, suspects, "key", ["child", "ref_field"], hot), "suspect_refs")
    plain = at.where("verdict = 'missing' or (verdict = 'late' and first > cast(when as timestamp_ntz))").select("child", "ref_field", "key", "verdict", "r")

    questions = at.where("verdict = 'asof'").select(F.col("key").alias("id"), F.col("when").alias("t"), F.lit(None).cast("int").alias("state"), "child", "ref_field", "r")
    watched = skew_join(changes, suspects.where("verdict = 'asof'").select("key"), "key", ["t"], hot_keys(changes, "key"))
    told = watched.select(F.col("key").alias("id"), "t", F.col("dead").cast("int").alias("state"), *(F.lit(None).cast(questions.schema[c].dataType).alias(c) for c in ("child", "ref_field", "r")))
    judged = asof_state(questions.unionByName(told)).select("child", "ref_field", F.col("id").alias("key"), F.when(F.col("state").isNull(), "late").when(F.col("state") == 1, "deleted").alias("verdict"), "r").where("verdict is not null")
    return plain.unionByName(judged).select(F.col("child").alias(child_id), "ref_field", F.col("key").alias("ref_id"), F.col("verdict").alias("reason"), F.col("r").alias(arrived_at))


def count_orphans(orphans: DataFrame, arrived_at: str) -> DataFrame:
    """Orphans per referring field, reason and month."""
    return (
        orphans.groupBy("ref_field", "reason", F.date_format(arrived_at, "yyyy-MM").alias("period"))
        .agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("ref_id").alias("n_missing_ids"))
    )
