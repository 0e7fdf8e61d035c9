"""Typed expectations over evidence rows, failing closed.

Each clause is one boolean column; missing evidence is false, no clause at all
is false. Works on any number of evidence rows at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.jsonops import json_path

SCALARS = {"STRING", "BOOLEAN", "BIGINT", "DOUBLE", "VOID"}


def closed(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def all_ok(clauses: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, map(closed, clauses)) if clauses else F.lit(False)


def run_clauses(expect: dict) -> dict[str, Column]:
    """Clauses over run evidence (overall, passed, failed, results map, facts_published, boot_exit_code, listed_tests).

    Keys: overall (text or {one_of}), max_failed, min_passed, test {name, result},
    facts {published}, boot {exited_zero, exit_code, listed_tests_min}.
    """
    unknown = set(expect) - {"overall", "max_failed", "min_passed", "test", "facts", "boot"}
    if unknown or not expect:
        raise ValueError(f"unknown or no clauses: {sorted(unknown)}")
    out: dict[str, Column] = {}
    if (o := expect.get("overall")) is not None:
        allowed = o["one_of"] if isinstance(o, dict) else [o]
        if not allowed or "" in allowed:
            raise ValueError("overall must not be empty")
        out["overall"] = F.col("overall").isin(allowed)
    if (n := expect.get("max_failed")) is not None:
        out["max_failed"] = F.col("failed") <= n
    if (n := expect.get("min_passed")) is not None:
        out["min_passed"] = F.col("passed") >= n
    if t := expect.get("test"):
        out[f"test.{t['name']}"] = F.try_element_at("results", F.lit(t["name"])) == t["result"]
    if (p := (expect.get("facts") or {}).get("published")) is not None:
        out["facts.published"] = F.coalesce(F.col("facts_published"), F.lit(False)) == p  # no evidence means not published
    boot = expect.get("boot") or {}
    if (z := boot.get("exited_zero")) is not None:
        out["boot.exited_zero"] = (F.col("boot_exit_code") == 0) == z
    if (c := boot.get("exit_code")) is not None:
        out["boot.exit_code"] = F.col("boot_exit_code") == c
    if (n := boot.get("listed_tests_min")) is not None:
        out["boot.listed_tests_min"] = F.col("listed_tests") >= n
    return {k: closed(v) for k, v in out.items()}


def fact_clauses(expect: dict) -> dict[str, Column]:
    """Clauses over fact evidence (result_count, complete, reachable, total_results); `complete` falls back to not truncated."""
    ops = {
        "min_results": lambda v: F.col("result_count") >= v, "max_results": lambda v: F.col("result_count") <= v, "complete": lambda v: F.coalesce(F.col("complete"), F.lit(False)) == v,
        "reachable": lambda v: F.coalesce(F.col("reachable"), F.lit(False)) == v, "total_at_least": lambda v: F.col("total_results") >= v,
    }
    if set(expect) - set(ops) or not expect:
        raise ValueError("unknown or no clauses")
    return {k: closed(ops[k](v)) for k, v in expect.items()}


def fact_evidence(complete: Column, truncated: Column) -> Column:
    return F.coalesce(complete, ~truncated, F.lit(False))


def path_clause(payload: Column, path: str, op: str, value=None) -> Column:
    """`eq`, `ne`, `ge`, `le` or `exists` on a dotted path of a JSON text; a missing path or another kind of value is false."""
    if op not in ("eq", "ne", "ge", "le", "exists"):
        raise ValueError(f"unknown operator {op}")
    at = F.try_variant_get(F.try_parse_json(payload), json_path(path), "variant")
    if op == "exists":
        return at.isNotNull()  # an explicit null is there
    kind = F.schema_of_variant(at)
    number = F.try_variant_get(at, "$", "double")
    is_number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    if op in ("ge", "le"):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return F.lit(False)
        return closed(at.isNotNull() & is_number & ((number >= float(value)) if op == "ge" else (number <= float(value))))
    if value is None:
        same_kind, equal = kind == "VOID", F.lit(True)
    elif isinstance(value, bool):
        same_kind, equal = kind == "BOOLEAN", F.try_variant_get(at, "$", "boolean") == value
    elif isinstance(value, (int, float)):
        same_kind, equal = is_number, number == float(value)
    else:
        same_kind, equal = kind == "STRING", F.try_variant_get(at, "$", "string") == value
    return closed(at.isNotNull() & same_kind & (equal if op == "eq" else ~equal))


def with_verdict(evidence: DataFrame, clauses: dict[str, Column]) -> DataFrame:
    """Adds `report`, an array of (clause, ok), and `ok`."""
    report = F.array(*(F.struct(F.lit(k).alias("clause"), v.alias("ok")) for k, v in clauses.items()))
    return evidence.withColumn("report", report).withColumn("ok", all_ok(list(clauses.values())))


def passes(verdict: Column, failure: Column, exit_code: Column, is_error: Column) -> Column:
    """The verdict if given, else no failure, else exit code 0, else no error; false without any."""
    return F.coalesce(verdict, F.when(F.coalesce(failure, F.lit("")) != "", False), exit_code == 0, ~is_error, F.lit(False))


def round_verdicts(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome per round of tasks (keys, status): incomplete while any is open, failure if any failed, else success."""
    per = tasks.groupBy(*keys).agg(F.count_if(F.col("status") == "open").alias("n_open"), F.count_if(F.col("status") == "fail").alias("n_fail"), F.count("status").alias("n_tasks"))
    outcome = F.when((F.col("n_tasks") == 0) | (F.col("n_open") > 0), "incomplete").when(F.col("n_fail") > 0, "failure").otherwise("success")
    return per.withColumn("outcome", outcome)
