"""File censuses and source inventories: diffs, digests, dirty sources, include graphs.

Null paths and ids are left out. Repeated rows of a path count once (largest row).
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.digest import tree_digest
from factloom.functions.paths import source_file
from factloom.plans.model import lookup
from factloom.scratch import spread_join, stage

# Which reason for a dirty source outranks which.
REASONS = {"content_changed": 0, "missing": 1, "compile_command_changed": 2, "toolchain_changed": 3, "included_header_changed": 4}
#: After so many hops of an include walk the files met so far become one table again.
RESTAGE = 16


def census_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): new, deleted or changed between two censuses (path, size, mtime_ns, sha256).

    Equal size and time stand for an equal digest where the new one has none.
    """
    one = lambda df, side: df.where("path is not null").groupBy("path").agg(F.max(F.struct("size", "mtime_ns", "sha256")).alias(side))
    both = one(old, "o").join(one(new, "n"), "path", "full")
    same = (F.col("o.size") == F.col("n.size")) & (F.col("o.mtime_ns") == F.col("n.mtime_ns"))
    digest = F.coalesce(F.col("n.sha256"), F.when(same, F.col("o.sha256")))
    status = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when(~digest.eqNullSafe(F.col("o.sha256")), "changed")
    return both.select("path", status.alias("status")).where("status is not null")


def file_line(path: Column, sha: Column) -> Column:
    """What a digest covers of a file: `path NUL sha NUL`; null without a path."""
    return F.concat(path, F.lit("\0"), F.coalesce(sha, F.lit("")), F.lit("\0"))


def content_digest(files: DataFrame, group: list[str] = (), path: str = "path", sha: str = "sha256") -> DataFrame:
    """(group, digest, n_files): one digest per group over its files, by `tree_digest`, so that no group meets in one row. Repeated rows of a file count once."""
    lines = files.select(*group, file_line(F.col(path), F.col(sha)).alias("line")).distinct()
    return tree_digest(lines, list(group)).withColumnRenamed("n", "n_files")


def flat_digest(files: DataFrame, group: list[str], path: str = "path", sha: str = "sha256") -> DataFrame:
    """(group, digest, n_files): sha256 over `path NUL sha NUL` of all files in order of path, as external tools compute it.

    Such a digest can't be split, so one task reads a group; but it reads it
    sorted, row by row, and holds the running hash only.
    """

    def run(batches):
        now, running, n = None, None, 0
        for df in batches:
            for key, line in zip(df[list(group)].itertuples(index=False, name=None), df["_line"]):
                if running is None or key != now:
                    if running is not None:
                        yield pd.DataFrame([(*now, running.hexdigest(), n)], columns=[*group, "digest", "n_files"])
                    now, running, n = key, hashlib.sha256(), 0
                running.update(line.encode())
                n += 1
        if running is not None:
            yield pd.DataFrame([(*now, running.hexdigest(), n)], columns=[*group, "digest", "n_files"])

    lines = files.select(*group, F.col(path).alias("_path"), file_line(F.col(path), F.col(sha)).alias("_line")).where("_line is not null")
    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in group) + ", digest string, n_files bigint"
    return lines.repartition(*group).sortWithinPartitions(*group, "_path", "_line").drop("_path").mapInPandas(run, schema)


def may_have_changed(size: Column, mtime: Column, size_now: Column, mtime_now: Column) -> Column:
    """Cheap test before digests are compared."""
    return (mtime_now > mtime) | (size_now != size)


def changed_sources(inventory: DataFrame, now: DataFrame) -> DataFrame:
    """Inventory rows whose file differs: inventory columns and `sha_now`. `now`: rel_path, size_now, mtime_now, sha_now; files that are gone are skipped."""
    joined = inventory.join(now, "rel_path")
    cheap = may_have_changed(F.col("size_bytes"), F.col("mtime_ns"), F.col("size_now"), F.col("mtime_now"))
    return joined.where(cheap & ~F.col("sha_now").eqNullSafe(F.col("sha256"))).drop("size_now", "mtime_now")


def dirty_sources(changed: DataFrame, inventory: DataFrame, limit: int | None = None) -> DataFrame:
    """(source_id, rel_path, reason, fanout): a changed file, or for a header the known sources that include it.

    One reason per source, the most direct; ordered by path and id if limited.
    """
    known = inventory.select("source_id", "rel_path").where("source_id is not null").groupBy("source_id").agg(F.max("rel_path").alias("rel_path"))
    headers = changed.where("source_kind = 'header'").select(F.col("source_id").alias("header"), F.explode_outer("included_by").alias("source_id"))
    hit = spread_join(headers.where("source_id is not null"), known, "source_id", ["header"])
    fan = hit.groupBy("header").agg(F.count(F.lit(1)).alias("fanout"))
    out = hit.join(fan, "header").select("source_id", "rel_path", F.when(F.col("source_id") == F.col("header"), "content_changed").otherwise("included_header_changed").alias("reason"), "fanout")
    own = changed.join(fan.withColumnRenamed("header", "source_id"), "source_id", "left_anti")
    out = out.unionByName(own.select("source_id", "rel_path", F.lit("content_changed").alias("reason"), F.when(F.col("source_kind") == "header", 1).otherwise(0).cast("bigint").alias("fanout")))
    rank = lookup(REASONS, F.col("reason"), 5)
    best = out.groupBy("source_id").agg(F.min(F.struct(rank.alias("rank"), "rel_path", "reason", "fanout")).alias("x")).select("source_id", "x.rel_path", "x.reason", "x.fanout")
    return best if limit is None else best.orderBy("rel_path", "source_id").limit(limit)


def edges_of_dirty(relatives: DataFrame, dirty: DataFrame) -> DataFrame:
    """Relatives that belong to a dirty source, by source id or by the file of their evidence."""
    by_id = relatives.join(dirty.select("source_id"), "source_id", "left_semi").select("relative_id")
    by_file = relatives.withColumn("rel_path", source_file(F.col("evidence_source"))).join(dirty.select("rel_path"), "rel_path", "left_semi").select("relative_id")
    return relatives.join(by_id.union(by_file).distinct(), "relative_id", "left_semi")


def include_pairs(files: DataFrame) -> DataFrame:
    """(src, dst): `#include "x"` lines of files (path, text) whose target is one of the files, beside the includer or from the root."""
    line = F.explode(F.split("text", "\n"))
    name = F.regexp_extract("line", r'^\s*#\s*include\s+"([^"]+)"', 1)
    named = files.select("path", line.alias("line")).select("path", name.alias("name")).where("name <> ''")
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    asked = named.select(F.col("path").alias("src"), F.explode(F.array_distinct(F.array(F.concat(folder, "name"), F.col("name")))).alias("dst"))
    return asked.join(files.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def invert_includes(pairs: DataFrame) -> DataFrame:
    """(path, included_by, includes) of every file in the pairs; both sorted arrays."""
    by = pairs.groupBy(F.col("dst").alias("path")).agg(F.sort_array(F.collect_set("src")).alias("included_by"))
    to = pairs.groupBy(F.col("src").alias("path")).agg(F.sort_array(F.collect_set("dst")).alias("includes"))
    none = F.array().cast("array<string>")
    return by.join(to, "path", "full").select("path", F.coalesce("included_by", none).alias("included_by"), F.coalesce("includes", none).alias("includes"))


def include_closure(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """(path, hop): files reached from `starts`(path) over includes, at their least hop.

    Each hop is staged, and the known files are every RESTAGE hops, so that
    plans stay short. The walk ends when a hop meets no new file, as it must on circles too.
    """
    known = stage(starts.select("path").dropna().distinct().withColumn("hop", F.lit(0)), "includes")
    frontier, hop = known, 0
    while True:
        hop += 1
        step = frontier.select(F.col("path").alias("src")).join(pairs, "src").select(F.col("dst").alias("path")).distinct()
        frontier = stage(step.join(known.select("path"), "path", "left_anti").withColumn("hop", F.lit(hop)), "includes")
        if not frontier.limit(1).count():
            return known
        known = known.unionByName(frontier)
        if hop % RESTAGE == 0:
            known = stage(known, "includes")


def frozen_violations(pinned: DataFrame, now: DataFrame) -> DataFrame:
    """(path, pinned, current): pinned files (path, sha256) whose digest differs or can't be read; an unreadable file has an empty digest."""
    current = now.groupBy("path").agg(F.max("sha256").alias("current"))
    return pinned.select("path", F.col("sha256").alias("pinned")).join(current, "path", "left").withColumn("current", F.coalesce("current", F.lit(""))).where("current <> pinned")


def under_budget(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """The files (path, size) that come before the count or byte budget runs out, in order of path.

    Running sums over any number of files: sorted partitions, prefix sums of their totals.
    """
    from factloom.scratch import numbered

    cut, counts = numbered(files.where("path is not null"), ["path", "size"], "budget")
    sums = {r["_p"]: r["s"] for r in cut.groupBy("_p").agg(F.sum("size").alias("s")).collect()}
    rows, n, total = [], 0, 0
    for p, m in counts:
        rows.append((p, n, total))
        n, total = n + m, total + (sums[p] or 0)
    from pyspark.sql.window import Window

    before = files.sparkSession.createDataFrame(rows or [(0, 0, 0)], "_p int, _n0 bigint, _s0 bigint")
    running = F.sum("size").over(Window.partitionBy("_p").orderBy("_i"))
    out = cut.withColumn("_s", running).join(F.broadcast(before), "_p")
    return out.where((F.col("_n0") + F.col("_i") < max_files) & (F.col("_s0") + F.col("_s") <= max_bytes)).drop("_p", "_i", "_n0", "_s0", "_s")


C_SUFFIXES = [".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx"]
TEST_PARTS = ["test", "tests", "testing", "spec", "specs"]
SKIPPED_DIRS = [".git", ".hg", ".svn", ".cache", ".mypy_cache", ".pytest_cache", "__pycache__", "build", "cmake-build-debug", "cmake-build-release", "dist", "node_modules", "out", "target", "venv", ".venv"]


def c_files(files: DataFrame, include_tests: bool = False) -> DataFrame:
    """C and C++ files by suffix, outside of skipped directories and, if asked, of tests."""
    parts = F.split(F.col("path"), "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    keep = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(C_SUFFIXES) & ~F.arrays_overlap(folders, F.lit(SKIPPED_DIRS))
    return files.where(keep if include_tests else keep & ~F.arrays_overlap(F.transform(parts, F.lower), F.lit(TEST_PARTS)))
