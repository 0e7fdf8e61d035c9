"""Compile journals to compile databases: one entry per (file, output), the last one.

Journal rows: argv (array), cwd, src, out, miss, pos. Rows that missed or lack a
field give no entry.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import compile_args

ENTRY = "arguments array<string>, directory string, file string, output string, pos bigint"


def _read(path: str, cwd: str) -> str | None:
    try:
        with open(os.path.join(cwd, path), encoding="utf-8") as f:
            return f.read()
    except OSError:
        return None


def entries(journal: DataFrame) -> DataFrame:
    """Journal rows as compile entries with absolute paths; response files are read where the task runs."""

    def run(batches):
        for df in batches:
            rows = []
            for argv, cwd, src, out, pos in zip(df["argv"], df["cwd"], df["src"], df["out"], df["pos"]):
                words = compile_args.expand(list(argv), lambda p, cwd=cwd: _read(p, cwd))
                rows.append((compile_args.normalize(words, cwd), cwd, compile_args.absolute(src, cwd), compile_args.absolute(out, cwd) if out else None, pos))
            yield pd.DataFrame(rows, columns=["arguments", "directory", "file", "output", "pos"])

    good = journal.where(~F.coalesce(F.col("miss"), F.lit(False)) & F.col("argv").isNotNull() & ~F.exists("argv", lambda a: a.isNull()) & F.col("cwd").isNotNull() & F.col("src").isNotNull())
    return good.select("argv", "cwd", "src", "out", F.col("pos").cast("bigint").alias("pos")).mapInPandas(run, ENTRY)


def compile_db(rows: DataFrame) -> DataFrame:
    """The last entry of each file and output."""
    key = F.coalesce("output", F.lit(""))
    last = rows.groupBy("file", key.alias("_out")).agg(F.max_by(F.struct("arguments", "directory", "output"), "pos").alias("x"))
    return last.select("x.arguments", "x.directory", "file", "x.output")


def recover(existing: DataFrame, wanted: DataFrame, launcher: str) -> DataFrame:
    """Entries of an existing database whose file is in `wanted`(file), without the launcher."""
    at = F.array_position("arguments", "--").cast("int")
    behind = (F.size("arguments") >= 3) & F.try_element_at("arguments", F.lit(1)).rlike(f"(^|/){launcher}$") & (F.try_element_at("arguments", F.lit(2)) == "cc") & (at > 0)
    bare = F.when(behind, F.slice("arguments", at + 1, F.greatest(F.lit(0), F.size("arguments")))).otherwise(F.col("arguments"))
    return existing.join(wanted.select("file").distinct(), "file", "left_semi").withColumn("arguments", bare).where(F.size("arguments") > 0)


def journal_rows(invocations: DataFrame) -> DataFrame:
    """One journal row per source of compiler invocations (argv, cwd, miss, reason, ts); the output is blank if there are several sources."""

    def run(batches):
        for df in batches:
            rows = []
            for r in df.itertuples(index=False):
                seen = compile_args.classify(list(r.argv))
                rows += [(list(r.argv), r.cwd, s, seen["out"], r.miss, r.reason, r.ts) for s in seen["srcs"] if seen["compile"]]
            yield pd.DataFrame(rows, columns=["argv", "cwd", "src", "out", "miss", "reason", "ts"])

    return invocations.select("argv", "cwd", "miss", "reason", "ts").mapInPandas(run, "argv array<string>, cwd string, src string, out string, miss boolean, reason string, ts string")
