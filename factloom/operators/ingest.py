"""Merging deliveries: latest per key, duplicates and conflicts, merge by file, call resolution.

Everything is one shuffle per key with partial aggregation, so copies of a row
in any number do no harm.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.canonical import canonical, canonical_json
from factloom.functions.jsonops import is_subset
from factloom.plans.model import View
from factloom.scratch import hot_keys, skew_join, spread_join


class MergeConflict(ValueError):
    """Rows of one id that differ."""


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in `order`; of equals, the largest row."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("x")).select(*(F.col(c) if c in keys else F.col(f"x.{c}").alias(c) for c in df.columns))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once, with their number."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def merge_lines(df: DataFrame, key: str, line: Column) -> DataFrame:
    """One row per key: its smallest line, how many were delivered, how many differ.

    Identical lines collapse; `n_lines > 1` is a conflict.
    """
    digest = F.sha2(F.coalesce(line, F.lit("")), 256)
    per_line = df.select(F.col(key), line.alias("line"), digest.alias("d")).groupBy(key, "d").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n"))
    return per_line.groupBy(key).agg(F.min("line").alias("line"), F.sum("n").alias("n_delivered"), F.count(F.lit(1)).alias("n_lines"))


def map_files(files: DataFrame, work, fields: str) -> DataFrame:
    """(path, error, rows): what `work(text)` makes of each file (path, text), a list of dicts of `fields`.

    A file on which it raises gives a row with the error's name and text, and
    stops no other file. A null text has no rows.
    """
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        for df in batches:
            out = []
            for path, text in zip(df["path"], df["text"]):
                try:
                    out.append((path, None, [{n: r.get(n) for n in names} for r in (work(text) if text is not None else [])]))
                except Exception as e:  # noqa: BLE001  whatever went wrong is the result
                    out.append((path, f"{type(e).__name__}: {e}"[:500], []))
            yield pd.DataFrame(out, columns=["path", "error", "rows"])

    return files.select("path", "text").mapInPandas(run, f"path string, error string, rows array<struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>>")


def spooled_bytes(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """(keys, n_lines, n_bytes): lines and their bytes, null lines left out."""
    return lines.groupBy(*keys).agg(F.count(line).alias("n_lines"), F.coalesce(F.sum(F.octet_length(line)), F.lit(0)).alias("n_bytes"))


def content_key(**parts: Column) -> Column:
    """A digest of named values: SHA-256 of their JSON object with keys in order. Null values are left out."""
    return F.sha2(F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts)))), 256)


def require_no_conflict(merged: DataFrame) -> DataFrame:
    """Raises on the first key with differing lines."""
    bad = merged.where("n_lines > 1").limit(1).collect()
    if bad:
        raise MergeConflict(f"{bad[0][0]} has {bad[0]['n_lines']} differing lines")
    return merged


def merge_spool(df: DataFrame, key: str, payload: str, seq: str) -> DataFrame:
    """One row per key: the payload of the lowest `seq`; among those of equal seq the one that contains the others.

    Adds `conflict`: true if at the lowest seq no payload contains all others.
    """
    low = df.groupBy(key).agg(F.min(seq).alias("_s"))
    tied = df.join(low, key).where(F.col(seq).eqNullSafe(F.col("_s"))).select(key, canonical_json(F.col(payload)).alias("p"), F.col(seq).alias("seq")).distinct()
    sizes = tied.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("p"), F.min("seq").alias("seq"))
    alone = sizes.where("n = 1").select(key, F.col("p").alias("payload"), "seq", F.lit(False).alias("conflict"))
    # Only payloads that differ as values meet, and only those of the lowest seq; copies are gone by now.
    several = tied.join(sizes.where("n > 1").select(key), key, "left_semi")
    schema = f"{key} {df.schema[key].dataType.simpleString()}, payload string, seq {df.schema[seq].dataType.simpleString()}, conflict boolean"

    def widest(pdf: pd.DataFrame) -> pd.DataFrame:
        best, clash = None, False
        for text in sorted(pdf["p"], key=lambda t: (-len(t), t)):
            value = json.loads(text)
            clash |= best is not None and not is_subset(value, best[1])
            best = best or (text, value)
        return pd.DataFrame({key: [pdf[key].iat[0]], "payload": [best[0]], "seq": [pdf["seq"].iat[0]], "conflict": [clash]})

    return alone.unionByName(several.groupBy(key).applyInPandas(widest, schema))


def merge_after_build(prior: View, new: View) -> View:
    """A new build merged into a prior view by file.

    Prior facts stay unless their file was rebuilt or their id came again; of
    relatives the first id wins, prior before new; both ends must be visible.
    """
    rebuilt = new.facts.select("source_path").distinct()
    kept = prior.facts.join(rebuilt, "source_path", "left_anti").join(new.facts.select("object_id"), "object_id", "left_anti").select(*prior.facts.columns)
    facts = kept.unionByName(new.facts.select(*prior.facts.columns))
    edges = prior.relatives.unionByName(new.relatives.join(prior.relatives.select("relative_id"), "relative_id", "left_anti").select(*prior.relatives.columns))
    return View(facts, View(facts, edges).connected())


def merge_inventory(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Source inventories: new rows replace prior ones of the same path or id."""
    kept = prior.join(new.select("rel_path"), "rel_path", "left_anti").join(new.select("source_id"), "source_id", "left_anti")
    return kept.select(*prior.columns).unionByName(new.select(*prior.columns))


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Direct calls by name to the function they mean: (call_id, outcome, target_id, strategy, n_filtered).

    `calls`: call_id, caller_id, callee_name, referenced_source. `functions`:
    object_id, object_name, canonical_source, linkage. Candidates are those of
    the referenced source, or, if it has none, all of the name. Internal ones of
    other sources than the caller's are filtered; exactly one must stay.
    Outcomes: resolved, ambiguous, internal_unresolved, external_unresolved,
    missing_caller. Candidates are counted per call, never listed.
    """
    callers = functions.select(F.col("object_id").alias("caller_id"), F.col("canonical_source").alias("caller_source"), F.lit(True).alias("known")).dropDuplicates(["caller_id"])
    asked = spread_join(calls, callers, "caller_id", ["call_id"], "left")
    # Per name and source: how many functions, how many internal, one id of each sort. Few rows per name are joined.
    per = functions.groupBy("object_name", "canonical_source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("linkage") == "internal").alias("n_int"), F.min("object_id").alias("any_id"), F.min(F.when(~F.coalesce(F.col("linkage") == "internal", F.lit(False)), F.col("object_id"))).alias("ext_id")
    )
    by_name = per.groupBy("object_name").agg(F.sum("n").alias("n_all"), F.sum("n_int").alias("int_all"), F.min("ext_id").alias("ext_id_all"), F.min("any_id").alias("any_id_all"))
    hot = hot_keys(calls, "callee_name")
    asked = skew_join(asked.withColumn("object_name", F.col("callee_name")), by_name, "object_name", ["call_id"], hot, "left")
    exact = per.select(F.col("object_name").alias("callee_name"), F.col("canonical_source").alias("referenced_source"), F.col("n").alias("n_ref"), F.col("n_int").alias("int_ref"), F.col("any_id").alias("any_ref"), F.col("ext_id").alias("ext_ref"))
    internal = functions.where("linkage = 'internal'").groupBy(F.col("object_name").alias("callee_name"), F.col("canonical_source").alias("caller_source")).agg(F.count(F.lit(1)).alias("int_own"), F.min("object_id").alias("int_own_id"))
    rows = asked.join(exact, ["callee_name", "referenced_source"], "left").join(internal, ["callee_name", "caller_source"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    use_ref = z("n_ref") > 0
    no_source = F.col("caller_source").isNull()
    same = F.coalesce(F.col("caller_source") == F.col("referenced_source"), F.lit(False))
    n_cand = F.when(use_ref, z("n_ref")).otherwise(z("n_all"))
    n_int = F.when(use_ref, z("int_ref")).otherwise(z("int_all"))
    int_kept = F.when(no_source, n_int).when(use_ref, F.when(same, n_int).otherwise(0)).otherwise(z("int_own"))
    left = n_cand - n_int + int_kept
    target = F.when(n_cand - n_int == 1, F.when(use_ref, F.col("ext_ref")).otherwise(F.col("ext_id_all"))).otherwise(F.when(use_ref, F.col("any_ref")).when(~no_source, F.col("int_own_id")).otherwise(F.col("any_id_all")))
    has_ref = F.col("referenced_source").isNotNull() & (F.col("referenced_source") != "")
    unresolved = F.when(has_ref | (left != n_cand), "internal_unresolved").otherwise("external_unresolved")
    outcome = F.when(F.col("known").isNull(), "missing_caller").when(left == 1, "resolved").when(left > 1, "ambiguous").otherwise(unresolved)
    return rows.select(
        "call_id", outcome.alias("outcome"), F.when(outcome == "resolved", target).alias("target_id"), F.when(outcome == "resolved", F.when(use_ref, "exact_source").otherwise("unique_name")).alias("strategy"),
        F.when(F.col("known").isNotNull(), n_int - int_kept).otherwise(0).cast("bigint").alias("n_filtered"),
    )


def resolved_edges(resolved: DataFrame, calls: DataFrame, profile: str) -> DataFrame:
    """Relatives for resolved calls, with ids derived from their content."""
    rows = resolved.where("outcome = 'resolved'").join(calls, "call_id")
    identity = F.to_json(F.struct(F.col("caller_id").alias("from"), F.lit(profile).alias("profile"), F.col("strategy"), F.col("target_id").alias("to")))
    return rows.select(
        F.concat(F.lit("rel:direct_call:"), F.substring(F.sha2(identity, 256), 1, 20)).alias("relative_id"), F.col("caller_id").alias("from_fact_id"), F.col("target_id").alias("to_fact_id"),
        F.lit("direct_call").alias("relation_kind"), F.lit(profile).alias("object_profile"), F.to_json(F.struct("strategy")).alias("payload"),
    ).dropDuplicates(["relative_id"])


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """Calls per outcome, and candidates filtered by linkage."""
    return resolved.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("n_filtered").alias("n_filtered"))


__all__ = ["canonical", "latest_per_key", "merge_after_build", "merge_lines", "merge_spool", "resolve_calls"]
