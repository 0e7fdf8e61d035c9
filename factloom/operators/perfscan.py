"""Static performance scan of C sources, loop containment, ranking of findings.

Files are rows; each is scanned whole in an Arrow batch. A null text has no
findings. Ranking is a global order with a limit, so it is a top-k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import csource
from factloom.operators.ingest import map_files
from factloom.plans.model import lookup
from factloom.scratch import spread_join, stage

FINDINGS = "path string, rule_id string, severity string, confidence string, line int, column int, function string, symbol string, snippet string, loop_start_line int, loop_end_line int, loop_depth int, loop_header string"
COLUMNS = [c.split()[0] for c in FINDINGS.split(", ")]


def scan_sources(files: DataFrame) -> DataFrame:
    """Findings of files (path, text); a file that can't be scanned has none and stops no other (see `ingest.map_files`)."""
    return found_in(map_files(files, csource.scan, FINDINGS.partition(", ")[2]))


def found_in(items: DataFrame) -> DataFrame:
    """The findings of the work items that succeeded."""
    return items.where("error is null").select("path", F.explode("rows").alias("x")).select("path", "x.*")


def explain_rule(rule_id: str) -> dict:
    """What a rule looks for, how it is ranked and what it means; an unknown id raises with those that are known."""
    if rule_id not in csource.RULES:
        raise ValueError(f"unknown rule {rule_id}; known are {', '.join(sorted(csource.RULES))}")
    return {"rule_id": rule_id, "title": csource.RULES[rule_id], "calls": csource.CALLS.get(rule_id, []), "advice": csource.ADVICE[rule_id]}


def summary_lines(findings: DataFrame, most: int = 5) -> list[str]:
    """The worst findings as lines for people."""
    rows = rank_findings(findings, limit=most).orderBy("id").collect()
    return [f"{r['id']} {r['severity']}/{r['confidence']} {r['path']}:{r['line']} {csource.RULES[r['rule_id']]}" for r in rows]


def source_shape(files: DataFrame) -> DataFrame:
    """(path, n_loops, max_depth, n_functions, n_guarded, n_tests) of files (path, text)."""

    def run(batches):
        for df in batches:
            rows = []
            for p, t in zip(df["path"], df["text"]):
                if t is not None:
                    plain = csource.blanked(t)
                    loops = csource.find_loops(plain)
                    rows.append((p, len(loops), max([0, *(x.depth + 1 for x in loops)]), len(csource.find_functions(plain)), len(csource.guards(t)), len(csource.declared_tests(t))))
            yield pd.DataFrame(rows, columns=["path", "n_loops", "max_depth", "n_functions", "n_guarded", "n_tests"])

    return files.select("path", "text").mapInPandas(run, "path string, n_loops int, max_depth int, n_functions int, n_guarded int, n_tests int")


def severity_rank(c: Column) -> Column:
    return lookup({s: i for i, s in enumerate(csource.SEVERITIES)}, c, 1)


def confidence_rank(c: Column) -> Column:
    return lookup({s: i for i, s in enumerate(csource.CONFIDENCES)}, c, 1)


def normalized(value: Column, allowed: list[str], default: str) -> Column:
    """A value of a closed set, or the default."""
    return F.when(value.isin(allowed), value).otherwise(default)


def rank_findings(findings: DataFrame, min_severity: str = "medium", include_low: bool = False, limit: int = 50) -> DataFrame:
    """The findings of at least a severity, worst first, numbered PERF0001 and on; `limit` 1 to 500."""
    keep = severity_rank(F.col("severity")) >= csource.SEVERITIES.index(min_severity)
    keep = keep if include_low else keep & (confidence_rank(F.col("confidence")) >= 1)
    order = [severity_rank(F.col("severity")).desc(), confidence_rank(F.col("confidence")).desc(), F.col("path"), F.col("line"), F.col("column"), F.col("rule_id"), F.col("symbol")]
    top = findings.where(keep).orderBy(*order).limit(max(1, min(limit, 500)))
    place = F.row_number().over(Window.partitionBy(F.lit("top")).orderBy(*order))  # of the few that are left
    return top.withColumn("id", F.format_string("PERF%04d", place))


def count_findings(findings: DataFrame, field: str) -> DataFrame:
    return findings.groupBy(field).agg(F.count(F.lit(1)).alias("n")).orderBy(field)


class Counts:
    """Weights at places 0..n-1, with the sum of those from a place on (a binary indexed tree)."""

    def __init__(self, n: int):
        self.n, self.tree = n, [0] * (n + 1)

    def add(self, at: int, weight: int) -> None:
        at = self.n - at
        while at <= self.n:
            self.tree[at] += weight
            at += at & -at

    def from_on(self, at: int) -> int:
        at, total = self.n - at, 0
        while at > 0:
            total += self.tree[at]
            at -= at & -at
        return total


def _earlier_and_longer(start: np.ndarray, end: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For spans in order of start: the weight of those that start before and end not before."""
    ends, place = np.unique(end, return_inverse=True)
    counts, out, waiting = Counts(len(ends)), np.zeros(len(start), np.int64), []
    for k in range(len(start)):
        if k and start[k] != start[k - 1]:
            for j in waiting:
                counts.add(int(place[j]), int(w[j]))
            waiting = []
        out[k] = counts.from_on(int(place[k]))
        waiting.append(k)
    return out


def _longer_of_earlier_parts(part: np.ndarray, end: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The weight of the spans that end not before and lie in a part before."""
    parts, place = np.unique(-part, return_inverse=True)  # from a place on: the parts not after
    counts, out, order = Counts(len(parts) + 1), np.zeros(len(part), np.int64), np.argsort(-end, kind="stable")
    k = 0
    while k < len(order):
        stop = k
        while stop < len(order) and end[order[stop]] == end[order[k]]:
            counts.add(int(place[order[stop]]), int(w[order[stop]]))
            stop += 1
        for j in order[k:stop]:
            out[j] = counts.from_on(int(place[j]) + 1)
        k = stop
    return out


def _per_group(keys: list[str], first: str, count):
    """Adds `n`, what `count` makes of each group of sorted batches; a group is what one partition holds of it."""

    def run(batches):
        now, held = None, []

        def finish():
            df = pd.concat(held, ignore_index=True)
            return df.assign(n=count(df[first].to_numpy(), df["end"].to_numpy(), df["_w"].to_numpy()))

        for df in batches:
            name = df[keys].isna().astype(str).agg("".join, axis=1) + df[keys].astype(str).agg("\n".join, axis=1)
            for g in name.unique():
                if held and g != now:
                    yield finish()
                    held = []
                now = g
                held.append(df[name == g])
        if held:
            yield finish()

    return run


def containment_depth(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `depth`: how many spans (keys, start, end) of the same group contain this one, starting before it.

    A span that starts before and ends not before contains. No pairs are built,
    and no group must fit one task. Equal spans are counted first. Then spans are
    cut twice, into parts by (group, start) and into blocks by (group, end), and
    those that contain a span are (A) in its own part, (B) in a part before and a
    block after, or (C) in a part before and its own block. A and C are counted
    within one part or block, B from a table of parts and blocks, for the groups
    that fill several parts only. Nulls are values that group, and contain nothing.
    """
    known = spans.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    named = F.to_json(F.struct(*keys, "start", "end"))
    alike = known.groupBy(*keys, "start", "end").agg(F.count(F.lit(1)).alias("_w"))
    typed = ", ".join(f"`{c}` {alike.schema[c].dataType.simpleString()}" for c in (*keys, "start", "end", "_w"))
    # Counted where the rows are after the shuffle: a table read back may be cut elsewhere.
    parts = alike.repartitionByRange(*keys, "start").sortWithinPartitions(*keys, "start", "end").withColumns({"_part": F.spark_partition_id(), "_u": F.monotonically_increasing_id()})
    cut = stage(parts.mapInPandas(_per_group(keys, "start", _earlier_and_longer), f"{typed}, _part int, _u bigint, n bigint"), "spans")
    pieces = [cut.select("_u", "n")]
    same = lambda a, b: [a[k].eqNullSafe(b[f"_{k}"]) for k in keys]
    wide = cut.groupBy(*keys).agg(F.count_distinct("_part").alias("_n")).where("_n > 1").select(*(F.col(k).alias(f"_{k}") for k in keys))  # at most one per part
    far = cut.join(wide, same(cut, wide), "left_semi")
    if far.limit(1).count():
        lines = far.drop("n").repartitionByRange(*keys, "end").sortWithinPartitions(*keys, F.desc("end"), "_u").withColumn("_block", F.spark_partition_id())
        blocks = stage(lines.mapInPandas(_per_group(keys, "_part", _longer_of_earlier_parts), f"{typed}, _part int, _u bigint, _block int, n bigint"), "blocks")
        pieces.append(blocks.select("_u", "n"))
        cells = stage(blocks.groupBy(*keys, "_part", "_block").agg(F.sum("_w").alias("_w")), "cells")
        columns = cells.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_block").alias("_at")).distinct()
        lines = cells.select(*keys, "_part").distinct()
        grid = lines.join(columns, same(lines, columns)).select(*keys, "_part", F.col("_at").alias("_block")).join(cells.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_p"), F.col("_block").alias("_b"), "_w"), [*(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col("_part") == F.col("_p"), F.col("_block") == F.col("_b")], "left")
        before = F.sum(F.coalesce("_w", F.lit(0))).over(Window.partitionBy(*keys, "_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        table = grid.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_p"), F.col("_block").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
        table = table.withColumn("n", F.sum("_before").over(Window.partitionBy(*(f"_{k}" for k in keys), "_p").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)))
        blocks = blocks.drop("n")
        met = blocks.join(table, [*same(blocks, table), blocks["_part"] == table["_p"], blocks["_block"] == table["_b"]]).select("_u", F.coalesce("n", F.lit(0)).alias("n"))
        pieces.append(met)
    total = pieces[0]
    for more in pieces[1:]:
        total = total.unionByName(more)
    summed = total.groupBy("_u").agg(F.sum("n").alias("_depth"))
    depth = stage(cut.drop("n").join(summed, "_u").select(named.alias("_span"), F.col("_depth").cast("int").alias("_depth")), "depths")
    rows = spans.withColumns({"_span": F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), named), "_row": F.monotonically_increasing_id()})
    out = spread_join(rows, depth, "_span", ["_row"], "left")
    return out.select(*(c for c in spans.columns if c != "depth"), F.coalesce("_depth", F.lit(0)).alias("depth"))


def innermost(points: DataFrame, spans: DataFrame, key: str, cell: int = 4096) -> DataFrame:
    """Adds to points (key, pos) the `name` of the innermost span (key, name, start, end) around them.

    A range join by cells of `cell` positions: a span is listed in each cell it
    touches, and a point looks in its own cell only.
    """
    listed = spans.select(key, "name", "start", "end", F.explode(F.sequence(F.expr(f"start div {cell}"), F.expr(f"(end - 1) div {cell}"))).alias("_cell"))
    at = points.withColumn("_cell", F.expr(f"pos div {cell}")).join(listed, [key, "_cell"], "left")
    hit = (F.col("start") <= F.col("pos")) & (F.col("pos") < F.col("end"))
    return at.groupBy(*points.columns).agg(F.max(F.when(hit, F.struct("start", "name")))["name"].alias("name"))


def declared_tests(files: DataFrame) -> DataFrame:
    """(path, macro, suite, name, line) of gtest macros in files (path, text)."""

    def run(batches):
        for df in batches:
            yield pd.DataFrame([(p, *x) for p, t in zip(df["path"], df["text"]) if t is not None for x in csource.declared_tests(t)], columns=["path", "macro", "suite", "name", "line"])

    return files.select("path", "text").mapInPandas(run, "path string, macro string, suite string, name string, line int")


def guard_lines(files: DataFrame) -> DataFrame:
    """(path, line, condition, branch, condition_line) of every line under a compile guard."""

    def run(batches):
        for df in batches:
            yield pd.DataFrame([(p, n, *g) for p, t in zip(df["path"], df["text"]) if t is not None for n, g in csource.guards(t).items()], columns=["path", "line", "condition", "branch", "condition_line"])

    return files.select("path", "text").mapInPandas(run, "path string, line int, condition string, branch string, condition_line int")
