"""Problem 8: long exact spans shared between records.

Every window of `span` characters is decided by whether it occurs in another
document. Shuffling a hash per window would move many times the corpus; instead
windows that lie side by side and have one smallest anchor (the least of the
Rabin-Karp hashes of their pieces of `ANCHOR` characters) travel as one *cell*:

1. An anchor seen in one document only drops its cells. Equal windows have equal
   anchors, since an anchor follows from the window's text alone; so none of
   the windows of a dropped cell is repeated elsewhere. (Different pieces may
   share a hash; that keeps cells, it drops none.)
2. Cells whose whole stretch of text is the same, by a digest of 128 bits of the
   text itself, in two documents are shared whole, all their windows with them.
3. For the other cells of the anchors that are left, at the edges of repeated
   stretches, every window's own Rabin-Karp hash is counted in Spark, modulo a
   prime and with two bases (122 bits). One cell stands for those of equal text.

So the result is that of counting all windows; none is sampled. Windows that are
shared merge into maximal intervals.

Nulls: a null text or id has no spans. Texts shorter than a span have none.
Empty tables give no rows. A span repeated in one document only is not shared.
Ids may be of any type that sorts, and are taken as unique.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.rolling import PRIME_BASES, blocks, mix, prefix_sums, prime_hashes, prime_sums, sliding_min, window_hashes
from factloom.scratch import drop_staged, hot_of, skew_join, stage

#: Characters of an anchor window.
ANCHOR = 64
#: Ids of documents with edge cells are broadcast up to this many (16 MB of numbers), else joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Rows in one batch of window hashes.
BATCH = 1 << 18

CELLS = "h bigint, sig bigint, sig2 bigint, n int, a int"
WINDOWS = "sig bigint, sig2 bigint, j int, w bigint, w2 bigint"


def _cells(span: int, anchor: int):
    def run(batches):
        for df in batches:
            for ids, starts, points in blocks(df["doc"], df["text"]):
                yield cells_of(ids, starts, points, span, anchor)

    return run


def digests(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of the characters of each stretch [start, end), as two numbers."""
    raw = memoryview(np.ascontiguousarray(points, dtype="<u4")).cast("B")
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(raw[s:e]) for s, e in zip((start * 4).tolist(), (end * 4).tolist())]), dtype=">i8").reshape(-1, 2).astype(np.int64)


def cells_of(ids, starts, points, span: int, anchor: int) -> pd.DataFrame:
    """Cells of texts laid end to end: maximal runs of windows of one text with one smallest anchor."""
    least = sliding_min(mix(window_hashes(prefix_sums(points), anchor)), span - anchor + 1)
    doc = np.repeat(np.arange(len(ids)), np.diff(starts))[: len(least)]
    inside = np.arange(len(least)) + span <= starts[doc + 1]
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(least)] - 1 if len(first) else first
    keep = inside[first]
    first, last = first[keep], last[keep]
    d, sig = doc[first], digests(points, first, last + span)
    return pd.DataFrame({"doc": ids[d], "h": least[first].view(np.int64), "sig": sig[:, 0], "sig2": sig[:, 1], "n": (last - first + 1).astype(np.int32), "a": (first - starts[d]).astype(np.int32)})


def _windows(span: int):
    """Every window hash of the asked cells (sig, sig2, n, a, lo, hi) of each text."""

    def run(batches):
        for df in batches:
            asked = df["cells"].to_list()
            for at, starts, points in blocks(range(len(df)), df["text"]):
                cells = [c for k in at for c in asked[k]]
                begin = np.repeat(starts[:-1], [len(asked[k]) for k in at]) + np.fromiter((c["a"] for c in cells), np.int64, len(cells))
                n = np.fromiter((c["n"] for c in cells), np.int64, len(cells))
                sums = [prime_sums(points, base) for base in PRIME_BASES]
                col = {name: np.array([c[name] for c in cells]) for name in ("sig", "sig2", "lo", "hi")}
                ends = np.cumsum(n)
                for lo in range(0, int(ends[-1]), BATCH):
                    row = np.arange(lo, min(lo + BATCH, int(ends[-1])))
                    cell = np.searchsorted(ends, row, side="right")
                    j = row - (ends[cell] - n[cell])
                    w = [prime_hashes(s, begin[cell] + j, span, base).view(np.int64) for s, base in zip(sums, PRIME_BASES)]
                    yield pd.DataFrame({"sig": col["sig"][cell], "sig2": col["sig2"][cell], "j": j.astype(np.int32), "w": w[0], "w2": w[1], "lo": col["lo"][cell], "hi": col["hi"][cell]})

    return run


def shared_intervals(docs: DataFrame, *, id: str, text: str, span: int = 256, anchor: int = ANCHOR) -> DataFrame:
    """(doc, start_pos, end_pos): maximal runs of characters that lie in a span of at least `span` characters that another document holds too."""
    anchor = min(anchor, span)
    kind = docs.schema[id].dataType.simpleString()
    texts = docs.select(F.col(id).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= span))
    cells = stage(texts.mapInPandas(_cells(span, anchor), f"doc {kind}, {CELLS}"), "cells")
    anchors = stage(cells.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi").select("h", "c"), "anchors")
    hot = hot_of(anchors, "h", "c")
    again = stage(skew_join(cells, anchors.select("h"), "h", ["doc", "a"], hot), "again")
    drop_staged(cells, anchors)

    classes = stage(
        again.groupBy("sig", "sig2").agg(F.min("h").alias("h"), F.min("n").alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(F.struct("doc", "a")).alias("one"), F.count(F.lit(1)).alias("c")), "classes"
    )
    edges = classes.where("lo = hi").select("h").distinct()
    asked = (
        skew_join(classes, edges, "h", ["sig", "sig2"], hot)
        .select("one.doc", F.struct("sig", "sig2", "n", "one.a", "lo", "hi").alias("cell")).groupBy("doc").agg(F.collect_list("cell").alias("cells"))
    )
    asked = stage(asked, "asked")
    few = asked.count() <= BROADCAST_IDS
    wanted = texts.join(F.broadcast(asked.select("doc")), "doc", "left_semi") if few else texts
    windows = stage(wanted.join(asked, "doc").select("text", "cells").mapInPandas(_windows(span), f"{WINDOWS}, lo {kind}, hi {kind}"), "windows")
    twice = windows.groupBy("w", "w2").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.count(F.lit(1)).alias("c")).where("least < most")
    twice = stage(twice.select("w", "w2", "c"), "twice")
    keyed = twice.select("w", F.col("w2").alias("_w2"))
    marked = skew_join(windows.where("lo = hi"), keyed, "w", ["sig", "sig2", "j"], hot_of(twice, "w", "c")).where("w2 = _w2").select("sig", "sig2", "j")
    # Windows side by side in one cell go on as one part.
    in_cell = Window.partitionBy("sig", "sig2").orderBy("j")
    islands = marked.withColumn("_g", F.col("j") - F.row_number().over(in_cell)).groupBy("sig", "sig2", "_g").agg(F.min("j").alias("j"), F.count(F.lit(1)).cast("int").alias("m")).drop("_g")
    parts = stage(classes.where("lo < hi").select("sig", "sig2", F.lit(0).alias("j"), F.col("n").alias("m")).unionByName(islands), "parts")
    hot = hot_of(classes, "sig", "c")
    drop_staged(asked, windows, twice, classes)
    found = skew_join(again, parts.withColumnRenamed("sig2", "_sig2"), "sig", ["doc", "a"], hot).where("sig2 = _sig2")
    return merge_intervals(found.select("doc", (F.col("a") + F.col("j")).alias("s"), (F.col("a") + F.col("j") + F.col("m") - 1 + span).alias("e")))


def merge_intervals(runs: DataFrame) -> DataFrame:
    """Overlapping or touching (doc, s, e) to maximal (doc, start_pos, end_pos)."""
    ordered = Window.partitionBy("doc").orderBy("s", "e")
    reach = F.max("e").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0)).withColumn("g", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc", "g").agg(F.min("s").cast("int").alias("start_pos"), F.max("e").cast("int").alias("end_pos")).drop("g")


def coverage(intervals: DataFrame) -> DataFrame:
    """(doc, n_spans, shared_chars) per document with shared characters."""
    return intervals.groupBy("doc").agg(F.count(F.lit(1)).alias("n_spans"), F.sum((F.col("end_pos") - F.col("start_pos")).cast("bigint")).alias("shared_chars"))
