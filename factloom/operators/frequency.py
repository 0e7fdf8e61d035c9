"""Problem 3: frequency of every distinct value or term.

Pairs of term and record are sorted by range over the cluster, and each sorted
piece is scanned run by run. A run that touches the end of a piece is open: a
term may fill many pieces, and one record may stand on both sides of a border.
Open runs, at most two per piece, are put together in order of the pieces.

Nulls: a null term or record gives no pair. Empty texts are terms like others.
Empty tables give no rows. Repeated pairs count as occurrences, the record once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RUNS = "field string, term string, piece int, place bigint, first_rec string, last_rec string, n bigint, n_rec bigint"


def _scan(batches):
    """Run-length scan of sorted batches (field, term, rec, piece), whose piece is one task's."""
    held, place = None, 0  # the run that is still open: [field, term, piece, place, first, last, n, n_rec]
    for df in batches:
        if not len(df):
            continue
        f, t, r = (df[c].to_numpy(dtype=object) for c in ("field", "term", "rec"))
        new_term = np.ones(len(df), bool)
        new_term[1:] = (f[1:] != f[:-1]) | (t[1:] != t[:-1])
        new_rec = new_term.copy()
        new_rec[1:] |= r[1:] != r[:-1]
        starts = np.flatnonzero(new_term)
        ends = np.append(starts[1:], len(df))
        recs = np.add.reduceat(new_rec.astype(np.int64), starts)
        piece, done = int(df["piece"].iat[0]), []
        for s, e, k in zip(starts.tolist(), ends.tolist(), recs.tolist()):
            if held is not None and s == 0 and held[0] == f[0] and held[1] == t[0]:
                held[7] += k - (held[5] == r[0])
                held[6] += e
                held[5] = r[e - 1]
                continue
            if held is not None:
                done.append(held)
            held = [f[s], t[s], piece, place, r[s], r[e - 1], e - s, k]
            place += 1
        if done:
            yield pd.DataFrame(done, columns=["field", "term", "piece", "place", "first_rec", "last_rec", "n", "n_rec"])
    if held is not None:
        yield pd.DataFrame([held], columns=["field", "term", "piece", "place", "first_rec", "last_rec", "n", "n_rec"])


def term_frequency(pairs: DataFrame) -> DataFrame:
    """(field, term, rec) pairs to (field, term, n_occurrences, n_records)."""
    order = ["field", "term", "rec"]
    runs = (
        pairs.select(*(F.col(c).cast("string") for c in order)).dropna().repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("piece", F.spark_partition_id()).mapInPandas(_scan, RUNS)
    )
    # Runs of one term come from successive pieces; all but those at a border are alone.
    in_order = Window.partitionBy("field", "term").orderBy("piece", "place")
    shared = (F.lag("last_rec").over(in_order) == F.col("first_rec")).cast("bigint")
    return (
        runs.withColumn("again", F.coalesce(shared, F.lit(0)))
        .groupBy("field", "term")
        .agg(F.sum("n").alias("n_occurrences"), (F.sum("n_rec") - F.sum("again")).alias("n_records"))
    )


def mark_terms(frequencies: DataFrame, n_records: int, *, rare: int = 2, common: float = 0.05) -> DataFrame:
    """Adds `mark`: `rare` if at most `rare` records hold the term, else `common` if at least that share of all does, else null."""
    return frequencies.withColumn("mark", F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") >= F.lit(common) * F.lit(n_records), "common"))


def first_rows(df: DataFrame, key: str, columns: list[str], at: str) -> DataFrame:
    """One row per non-null key: its earliest delivery (ties: the smallest row). Pre-aggregates, so a key repeated at will is harmless."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(at, *columns)).alias("x")).select(key, *(F.col(f"x.{c}") for c in columns))


def fact_terms(facts: DataFrame) -> DataFrame:
    """The (field, term, rec) pairs of code facts: kinds, words of names, paths of sources."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    kind = F.lower(strip(F.col("fact_kind")))
    words = F.transform(F.expr(r"regexp_extract_all(object_name, '[A-Za-z0-9]+', 0)"), F.lower)
    path = F.regexp_replace(strip(F.col("object_source")), r":[0-9]+\z", "")
    field = lambda name, terms: F.transform(terms, lambda t: F.struct(F.lit(name).alias("field"), t.alias("term")))
    empty = F.array().cast("array<struct<field:string,term:string>>")
    every = F.concat(*(F.coalesce(field(n, x), empty) for n, x in (("fact_kind", F.array(kind)), ("object_name", words), ("object_source", F.array(path)))))
    return facts.select(F.col("object_id").alias("rec"), F.explode(every).alias("x")).select("x.*", "rec").where("term is not null")
