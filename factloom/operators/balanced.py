"""Problem 4: per-key results although a few keys hold most records.

Rows are sorted by key into input partitions of about equal size; a hot key
simply fills several. Rows are counted per input partition, prefix sums of the
counts give every row its exact number, and equal chunks of row numbers are
dealt to the tasks in turn, whatever keys they hold, so that no task has more
than one chunk more than another. A chunk yields one state per key in it;
the states of a key that spans several chunks are merged in order, so that even
distinct counts come out exact.

Nulls: a null key has no result (its rows still count in the total); a null kind
is a group of its own; a null file is no file. Repeated rows count as delivered.
Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.scratch import numbered, with_positions

#: Into about how many chunks the rows are cut; the states of one key are at most as many.
CHUNKS = 4096
#: Chunks hold at least so many rows.
LEAST_CHUNK = 4096

STATES = "side string, key string, kind string, chunk bigint, place bigint, first_item string, last_item string, n bigint, n_flagged bigint, n_items bigint"


def _states(batches):
    for df in batches:
        if not len(df):
            continue
        number, chunk = df["number"].to_numpy(np.int64), df["chunk"].to_numpy(np.int64)
        cols = [df[c].to_numpy(dtype=object) for c in ("side", "key", "kind")]
        fresh = np.ones(len(df), bool)
        fresh[1:] = chunk[1:] != chunk[:-1]
        for c in cols:
            fresh[1:] |= c[1:] != c[:-1]
        fresh[1:] |= number[1:] != number[:-1] + 1
        item = df["item"].to_numpy(dtype=object)
        known = ~df["item"].isna().to_numpy()
        new_item = fresh.copy()
        new_item[1:] |= item[1:] != item[:-1]
        s = np.flatnonzero(fresh)
        e = np.append(s[1:], len(df)) - 1
        add = lambda x: np.add.reduceat(x.astype(np.int64), s)
        yield pd.DataFrame(
            {
                "side": cols[0][s], "key": cols[1][s], "kind": cols[2][s], "chunk": chunk[s], "place": number[s], "first_item": item[s], "last_item": item[e],
                "n": e - s + 1, "n_flagged": add(df["flag"].to_numpy(bool)), "n_items": add(new_item & known),
            }
        )


def chunked(rows: DataFrame) -> DataFrame:
    """Rows in order of side, key, kind and item with their `number` and `chunk`; chunks go to the tasks in turn."""
    cut, counts = numbered(rows, ["side", "key", "kind", "item", "spread"], "by_key")
    total = sum(n for _, n in counts)
    size = max(LEAST_CHUNK, -(-total // CHUNKS))
    placed = with_positions(cut.drop("spread"), counts, "number").withColumn("chunk", F.expr(f"number div {size}"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionById(tasks, F.expr(f"cast(chunk % {tasks} as int)")).sortWithinPartitions("number")


def per_key(rows: DataFrame) -> DataFrame:
    """Results per (side, key, kind): n, n_flagged (rows with `flag`), n_items (distinct `item`), n_chunks.

    `rows`: side, key, kind, item (strings), flag (boolean), spread (a column
    that tells all rows apart, repeats too, so that no value fills a partition).
    """
    sortable = rows.where("key is not null").withColumn("flag", F.coalesce("flag", F.lit(False)))
    states = chunked(sortable).mapInPandas(_states, STATES)
    in_order = Window.partitionBy("side", "key", "kind").orderBy("place")
    again = (F.lag("last_item").over(in_order) == F.col("first_item")).cast("bigint")
    return (
        states.withColumn("again", F.coalesce(again, F.lit(0)))
        .groupBy("side", "key", "kind")
        .agg(F.sum("n").alias("n"), F.sum("n_flagged").alias("n_flagged"), (F.sum("n_items") - F.sum("again")).alias("n_items"), F.countDistinct("chunk").alias("n_chunks"))
    )


def heavy_keys(results: DataFrame, total: int, share: float) -> DataFrame:
    """Keys whose rows make up at least `share` of `total`: (side, key, n)."""
    return results.groupBy("side", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(share) * F.lit(total))


def edge_ends(relatives: DataFrame) -> DataFrame:
    """The two ends of each edge, as rows for `per_key`; `spread` is the place in the scan, which a retry repeats."""
    ends = F.array(F.struct(F.lit("from").alias("side"), F.col("from_fact_id").alias("key")), F.struct(F.lit("to").alias("side"), F.col("to_fact_id").alias("key")))
    file = F.regexp_replace("evidence_source", r":[0-9]+$", "")
    return relatives.select(
        F.explode(ends).alias("x"), F.col("relation_kind").alias("kind"), file.alias("item"), F.col("condition").isNotNull().alias("flag"), F.monotonically_increasing_id().alias("spread")
    ).select("x.*", "kind", "item", "flag", "spread")
