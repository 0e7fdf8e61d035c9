"""Shared building blocks for distributed operators.

* `stage` cuts lineage by writing a table to the shared checkpoint folder, so
  that a lost executor never takes intermediate data with it.
* `hot_keys` / `skew_join` spread a key that holds a large part of all rows.
* `dense_ordinals` numbers distinct keys 0..n-1 without a single-task window.
* `asof_state` finds the last change at or before a moment, whatever the skew.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A part of a hot key holds at least and at most about so many rows; in between a quarter of an average partition.
LEAST_PART, MOST_PART = 10_000, 1_000_000
#: So many keys at most are split, which bounds what is collected and broadcast; parts grow beyond it.
MOST_HOT = 20_000

_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    It lies in `spark.checkpoint.dir`, which a cluster must name. Only a local
    master may go without; it gets a temporary folder of its own.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="factloom-")
            atexit.register(__import__("shutil").rmtree, base, ignore_errors=True)
        _roots[app] = f"{base.rstrip('/')}/factloom-{app}"
    return _roots[app]


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*frames: DataFrame) -> None:
    """Remove staged tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"/factloom-{spark.sparkContext.applicationId}/" in path:
                hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def clear(spark: SparkSession) -> None:
    """Removes all staged tables of this application; only when no DataFrame over them is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def part_rows(total: int, partitions: int) -> int:
    """How many rows of one key may stay together, of `total` rows in so many partitions."""
    return max(LEAST_PART, -(-total // MOST_HOT), min(MOST_PART, total // (4 * max(1, partitions))))


def hot_of(counted: DataFrame, key: str, n: str = "n") -> list[tuple]:
    """(key, parts) of the keys of a table of keys and row counts that are too large for one part, each into parts of `part_rows`.

    What is collected has at most MOST_HOT rows by arithmetic. A null key may be among them.
    """
    whole = counted.agg(F.sum(n).alias("total"), F.max(n).alias("most")).first()
    size = part_rows(whole["total"] or 0, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not whole["most"] or whole["most"] <= size:
        return []
    return [(r[0], -(-r[1] // size)) for r in counted.where(F.col(n) > size).select(key, n).collect()]


def hot_keys(df: DataFrame, key: str) -> list[tuple]:
    """`hot_of` for rows that are not counted yet."""
    return hot_of(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)


def skew_join(left: DataFrame, right: DataFrame, key: str, spread: list[str], hot: list[tuple], how: str = "inner") -> DataFrame:
    """Join on `key`, with the left rows of each hot key in as many parts as `hot` says.

    The right rows of hot keys are repeated once per part; callers keep them
    few per key. The part follows from the columns `spread`, so that a task
    that runs again sends each row to the same place. Null keys, which meet
    nothing, are spread as well where an outer join keeps them.
    """
    if not hot:
        return left.join(right, key, how)
    named = [(k, n) for k, n in hot if k is not None]
    kind = left.schema[key].dataType.simpleString()
    parts = F.broadcast(left.sparkSession.createDataFrame(named, f"`{key}` {kind}, _parts bigint"))  # at most MOST_HOT rows
    nulls = next((n for k, n in hot if k is None), 1)
    n_parts = F.when(F.col(key).isNull(), F.lit(nulls)).otherwise(F.coalesce("_parts", F.lit(1)))
    salted = left.join(parts, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), n_parts)).drop("_parts")
    copies = right.join(parts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def spread_join(left: DataFrame, right: DataFrame, key: str, spread: list[str], how: str = "inner") -> DataFrame:
    """`skew_join` that looks for the hot keys of `left` itself; `right` has few rows per key."""
    return skew_join(left, right, key, spread, hot_keys(left, key), how)


def numbered(df: DataFrame, order: list[str | Column], name: str = "sorted") -> tuple[DataFrame, list[tuple[int, int]]]:
    """Range-partition and sort `df`, stage it with `_p` (partition) and `_i` (row in it).

    Returns the staged table and the row counts (`_p`, rows), in order of `_p`,
    of which there are as many as partitions. `order` should be unique enough
    that no single value of it fills a partition.
    """
    cut = stage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "*",
            F.spark_partition_id().alias("_p"),
            # the low 33 bits of this built-in are the row's place in its partition
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"),
        ),
        name,
    )
    counts = cut.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()
    return cut, sorted((r["_p"], r["n"]) for r in counts)


def offsets_of(counts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Prefix sums: (`_p`, rows before it)."""
    out, before = [], 0
    for p, n in counts:
        out.append((p, before))
        before += n
    return out


def with_positions(cut: DataFrame, counts: list[tuple[int, int]], name: str = "pos") -> DataFrame:
    """Adds the exact global position of each row of a `numbered` table."""
    spark = cut.sparkSession
    starts = spark.createDataFrame(offsets_of(counts) or [(0, 0)], f"_p int, {name}_0 bigint")  # a row per partition
    return cut.join(F.broadcast(starts), "_p").withColumn(name, F.col(f"{name}_0") + F.col("_i")).drop("_p", "_i", f"{name}_0")


def dense_ordinals(keys: DataFrame, cols: list[str], name: str = "ordinal", known: DataFrame | None = None) -> DataFrame:
    """Distinct keys with ordinals 0..n-1 in sorted order.

    `known` (cols + ordinal) makes them persistent: known keys keep theirs,
    new ones follow after the largest. Keys with a null column get none.
    """
    distinct = keys.select(*cols).dropna().distinct()
    first = 0
    if known is not None:
        distinct = distinct.join(known, cols, "left_anti")
        most = known.agg(F.max(name)).first()[0]
        first = 0 if most is None else most + 1
    cut, counts = numbered(distinct, cols, "ordinals")
    fresh = with_positions(cut, counts, name).withColumn(name, F.col(name) + F.lit(first).cast("bigint"))
    return fresh if known is None else known.select(*cols, name).unionByName(fresh.select(*cols, name))


def asof_state(events: DataFrame) -> DataFrame:
    """For each question the state of the last change at or before it.

    `events`: id, t, state (null for a question), other columns. A change at
    the very time of a question counts; of several changes at one time the
    largest state wins. Rows of one id may fill any number of partitions: they
    are sorted by (id, t), rows of one id and moment by a hash of their other
    columns, and one carried state per partition (collected: a row per
    partition) joins the pieces. Only rows that are equal in all columns stay
    together, so callers leave out repeats. Returns the questions, `state`
    filled in or null if no change precedes.
    """
    spark = events.sparkSession
    ask = F.when(F.col("state").isNull(), 1).otherwise(0)
    rest = [c for c in events.columns if c not in ("id", "t", "state")]
    apart = F.xxhash64(*rest) if rest else F.lit(0).cast("bigint")
    cut, _ = numbered(events.withColumns({"_ask": ask, "_apart": apart}), ["id", "t", "_ask", "state", "_apart"], "asof")
    edges = cut.groupBy("_p").agg(
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.max(F.when(F.col("_ask") == 0, F.struct("id", "_i", "state"))).alias("last"),
    ).collect()
    carried, held_id, held = [], None, None
    for e in sorted(edges, key=lambda e: e["_p"]):
        if held is not None and held_id == e["first_id"]:
            carried.append((e["_p"], held_id, held))
        if e["last"] is not None and e["last"]["id"] == e["last_id"]:
            held_id, held = e["last_id"], e["last"]["state"]
        elif held_id != e["last_id"]:
            held_id, held = None, None
    carry = spark.createDataFrame(carried, "_p int, id string, _carried int")
    within = Window.partitionBy("_p", "id").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    filled = cut.withColumn("_last", F.last("state", ignorenulls=True).over(within)).where("_ask = 1")
    return filled.join(F.broadcast(carry), ["_p", "id"], "left").withColumn("state", F.coalesce("_last", "_carried")).drop("_p", "_i", "_ask", "_apart", "_last", "_carried")
