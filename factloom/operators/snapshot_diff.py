"""Problem 2: what changed between full snapshots.

Keys get ordinals, dense over all groups and sorted by (group, key); a later
call may keep them, and new keys then follow after the largest. Each snapshot
becomes, per block of 65,536 ordinals, a compressed bitmap of its members and a
vector of 128-bit value digests aligned with it. AND-NOT of the bitmaps of two
successive snapshots gives additions and removals, the aligned vectors show the
changes among common keys. Only differences are turned back into keys.

A snapshot may hold any share of all rows: its rows meet only by block, and a
block has at most 65,536 members.

Nulls: a row without key or snapshot, and a snapshot without group or order, is
left out; a null value is a value that differs from any other. Repeated rows of
a key within a snapshot count once; if their values differ, the latest delivery
decides, then the largest digest. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.functions import bitmap
from factloom.functions.canonical import json_digest
from factloom.scratch import dense_ordinals, hot_keys, skew_join, stage

#: The digest of a null value.
NULL_DIGEST = b"\x00" * 16


def successive(manifest: DataFrame, *, group: str, snapshot: str, published_at: str) -> DataFrame:
    """Each published snapshot with the one before it: (grp, snap, prev); prev is null for the first."""
    first = manifest.select(F.col(group).alias("grp"), F.col(snapshot).alias("snap"), F.col(published_at).alias("at")).dropna().groupBy("grp", "snap").agg(F.min("at").alias("at"))
    return first.select("grp", "snap", F.lag("snap").over(Window.partitionBy("grp").orderBy("at", "snap")).alias("prev"))


def _block(grp: pd.DataFrame) -> pd.DataFrame:
    grp = grp.sort_values("o")
    o = grp["o"].to_numpy()
    return pd.DataFrame(
        {
            "grp": [grp["grp"].iat[0]],
            "snap": [grp["snap"].iat[0]],
            "block": [grp["block"].iat[0]],
            "bits": [bitmap.pack(o)],
            "vec": [b"".join(grp["digest"])],
        }
    )


def _compare(bits, vec, prev_bits, prev_vec):
    added, removed, common = bitmap.and_not(bits, prev_bits), bitmap.and_not(prev_bits, bits), bitmap.both(bits, prev_bits)
    if len(common):
        now = np.frombuffer(vec, dtype="<u8").reshape(-1, 2)[bitmap.rank(bits, common)]
        was = np.frombuffer(prev_vec, dtype="<u8").reshape(-1, 2)[bitmap.rank(prev_bits, common)]
        common = common[(now != was).any(axis=1)]
    return [{"o": int(o), "change": what} for what, members in (("added", added), ("removed", removed), ("changed", common)) for o in members]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("o", T.IntegerType()), T.StructField("change", T.StringType())])))
def _differences(bits: pd.Series, vec: pd.Series, prev_bits: pd.Series, prev_vec: pd.Series) -> pd.Series:
    return pd.Series([_compare(*x) for x in zip(bits, vec, prev_bits, prev_vec)])


def diff_with_ordinals(
    rows: DataFrame, manifest: DataFrame, *, group: str, snapshot: str, key: str, value: str, published_at: str, delivered_at: str, known: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Differences of successive snapshots: (grp, snap, key, change), and the ordinals (grp, key, ordinal) they were found with.

    `change` is `added`, `removed`, or `changed` if the two JSON values differ
    as values. The ordinals are staged; handed to a later call as `known`, from
    there or from a table the caller wrote them to, keys keep theirs.
    """
    pairs = stage(successive(manifest, group=group, snapshot=snapshot, published_at=published_at), "pairs")
    lines = rows.select(F.col(snapshot).alias("snap"), F.col(key).alias("key"), F.coalesce(json_digest(F.col(value)), F.lit(NULL_DIGEST)).alias("digest"), F.col(delivered_at).alias("at")).where("key is not null")
    members = (
        skew_join(lines, pairs.select("grp", "snap"), "snap", ["key"], hot_keys(rows.select(F.col(snapshot).alias("snap")), "snap"))
        .groupBy("grp", "snap", "key")
        .agg(F.max(F.struct("at", "digest"))["digest"].alias("digest"))
    )
    members = stage(members, "members")
    kept = stage(dense_ordinals(members, ["grp", "key"], known=known), "ordinals").select("grp", "key", "ordinal")
    ordinals = kept.select("grp", "key", F.expr("ordinal div 65536").alias("block"), F.expr("cast(ordinal % 65536 as int)").alias("o"))
    blocks = stage(
        members.join(ordinals, ["grp", "key"]).groupBy("grp", "snap", "block").applyInPandas(_block, "grp string, snap string, block bigint, bits binary, vec binary"), "blocks"
    )
    later = pairs.where("prev is not null")
    now = later.join(blocks, ["grp", "snap"]).select("grp", "snap", "block", "bits", "vec")
    was = later.join(blocks.withColumnRenamed("snap", "prev"), ["grp", "prev"]).select("grp", "snap", "block", F.col("bits").alias("prev_bits"), F.col("vec").alias("prev_vec"))
    found = now.join(was, ["grp", "snap", "block"], "full").select("grp", "snap", "block", F.explode(_differences("bits", "vec", "prev_bits", "prev_vec")).alias("d"))
    return found.select("grp", "snap", "block", "d.*").join(ordinals, ["grp", "block", "o"]).select("grp", "snap", "key", "change"), kept


def diff_snapshots(rows: DataFrame, manifest: DataFrame, **names) -> DataFrame:
    """The differences of `diff_with_ordinals`, of which it takes all arguments."""
    return diff_with_ordinals(rows, manifest, **names)[0]
