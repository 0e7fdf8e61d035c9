"""Digests of any number of lines, without an ordered pass and without a large group in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many digests one row puts together, on average.
FAN = 4096


def tree_digest(lines: DataFrame, keys: list[str], fan: int = FAN) -> DataFrame:
    """(keys, digest, n): one digest per group of the rows' `line`, whatever their order; repeats count, null lines are left out.

    Distinct lines with their numbers are hashed. As long as a group has more
    than `fan` digests, those of one hexadecimal prefix are hashed together in
    order; then the rest is. SHA-256 spreads evenly and the depth follows from
    the number of lines of the group, so its digest depends on nothing else.
    Without keys an empty table has the digest of the empty text; with keys, no rows.
    """
    leaf = lines.where("line is not null").groupBy(*keys, F.sha2("line", 256).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    level = leaf.select(*keys, F.sha2(F.concat("d", F.lit(":"), F.col("n").cast("string")), 256).alias("d"), "n")
    sizes = leaf.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    most = sizes.agg(F.max("c")).first()[0] or 0
    together = F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256)
    deepest = _digits(most, fan)
    if deepest:
        steps = F.lit(0)
        for k in range(deepest):
            steps = steps + F.when(F.col("c") > fan * 16**k, 1).otherwise(0)
        deep = sizes.select(*(F.col(k).alias(f"_{k}") for k in keys), steps.alias("_digits"))
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        level = (level.join(deep, on) if keys else level.withColumn("_digits", F.lit(deepest))).drop(*(f"_{k}" for k in keys))
        while deepest > 0:  # prefixes grow shorter by as many digits as one row may put together
            cut = F.col("_digits") > 0
            level = (
                level.groupBy(*keys, "_digits", F.when(cut, F.expr("substring(d, 1, _digits)")).otherwise(F.col("d")).alias("_p")).agg(together.alias("h"), F.sum("n").alias("n"))
                .select(*keys, F.when(cut, F.concat("_p", "h")).otherwise(F.col("_p")).alias("d"), "n", (F.col("_digits") - 3).alias("_digits"))
            )
            deepest -= 3
    return level.groupBy(*keys).agg(together.alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def _digits(n: int, fan: int) -> int:
    k = 0
    while n > fan * 16**k:
        k += 1
    return k
