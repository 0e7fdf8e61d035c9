"""The code-fact data model: fixed values, validation, and the cleaned views that operators read."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.fold import casefold
from factloom.functions.paths import source_file
from factloom.scratch import stage
from factloom.session import table

# They must equal those of the stores that are read.
RELATION_KINDS = ["include", "defines", "declares", "has_field", "direct_call", "assigned_to", "dispatches_via", "field_read", "field_write"]
CONDITION_KINDS = ["branch", "case", "loop_guard", "compile_guard", "unknown"]
KIND_RANKS = {"type": 10, "function": 9, "global": 8, "macro": 7, "code_file": 6, "function_pointer_slot": 5, "field": 0}
DEFAULT_KIND_RANK = 4
SALIENCE = {"direct_call": 0, "dispatches_via": 0, "field_write": 1, "field_read": 2, "assigned_to": 3}
DEFAULT_SALIENCE = 5
MAX_FACT_PAYLOAD, MAX_RELATIVE_PAYLOAD, MAX_CONDITION = 4096, 2048, 1024

FACT_COLUMNS = ["object_id", "object_name", "object_description", "object_source", "object_profile", "object_caller", "object_callee", "payload"]
RELATIVE_COLUMNS = ["relative_id", "from_fact_id", "to_fact_id", "relation_kind", "condition", "object_profile", "evidence_source", "confidence", "payload"]


def lookup(values: dict[str, int], key: Column, default: int) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def kind_rank(kind: Column) -> Column:
    return lookup(KIND_RANKS, kind, DEFAULT_KIND_RANK)


def salience(kind: Column) -> Column:
    return lookup(SALIENCE, kind, DEFAULT_SALIENCE)


def first_delivery(df: DataFrame, key: str, columns: list[str], at: str) -> DataFrame:
    """One row per non-null key, its earliest delivery. Columns that don't sort (maps) are not allowed; ties take the smallest row."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(at, *columns)).alias("x")).select(key, *(F.col(f"x.{c}").alias(c) for c in columns))


def promote(facts: DataFrame) -> DataFrame:
    """Facts with the columns that search reads, so that payloads are parsed once."""
    text = lambda k: F.get_json_object("payload", f"$.{k}")
    full = lambda c: F.coalesce(F.col(c), F.lit(""))
    kind = F.coalesce(F.nullif(text("fact_kind"), F.lit("")), F.lit("fact"))
    out = facts.withColumns(
        {
            "kind": kind,
            "owner_name": F.nullif(text("owner_name"), F.lit("")),
            "type_name": F.nullif(text("type"), F.lit("")),
            "linkage": text("linkage"),
            "source_id": F.nullif(text("source_id"), F.lit("")),
            "source_path": source_file(F.col("object_source")),
        }
    )
    aliases = lambda o: F.when(F.col(o).isNotNull(), F.concat(F.col(o), F.lit(" "), F.col(o), F.lit("."), full("object_name"), F.lit(" "), F.col(o), F.lit("::"), full("object_name")))
    once = F.when(casefold("owner_name") != casefold("type_name"), aliases("type_name")).otherwise(F.when(F.col("owner_name").isNull(), aliases("type_name")))
    return out.withColumns(
        {
            "name_cf": casefold(full("object_name")),
            "desc_cf": casefold(full("object_description")),
            "caller_cf": casefold(full("object_caller")),
            "callee_cf": casefold(full("object_callee")),
            "source_cf": casefold(full("object_source")),
            "owner_cf": F.when(F.col("kind") == "field", casefold(F.concat_ws(" ", aliases("owner_name"), once))).otherwise(F.lit("")),
        }
    )


@dataclass
class View:
    """Facts and relatives as one reader sees them."""

    facts: DataFrame
    relatives: DataFrame
    by_to: DataFrame | None = None  # the relatives once more, sorted by to_fact_id, if a store keeps them
    whole: bool = False  # whether every relative is known to have both ends

    def edges_at(self, end: str) -> DataFrame:
        """The copy of the relatives that suits a filter or join on `from_fact_id` or `to_fact_id`."""
        return self.by_to if end == "to_fact_id" and self.by_to is not None else self.relatives

    def staged(self) -> View:
        """The view written to the shared folder, for several queries over it."""
        with ThreadPoolExecutor(2) as pool:  # two jobs side by side
            return View(*pool.map(stage, (self.facts, self.relatives), ("facts", "relatives")))

    def connected(self) -> DataFrame:
        """Relatives with both ends visible."""
        if self.whole:
            return self.relatives
        ids = self.facts.select("object_id")
        return self.relatives.join(ids.withColumnRenamed("object_id", "from_fact_id"), "from_fact_id", "left_semi").join(ids.withColumnRenamed("object_id", "to_fact_id"), "to_fact_id", "left_semi").select(*self.relatives.columns)


def base_view(spark: SparkSession, d: str) -> View:
    """The current facts (with those of the system) and relatives of a data folder, each once."""
    own = first_delivery(table(spark, d, "facts"), "object_id", FACT_COLUMNS[1:], "ingested_at")
    system = table(spark, d, "system_facts").where("object_id is not null").select(*FACT_COLUMNS)
    facts = own.unionByName(system.join(own.select("object_id"), "object_id", "left_anti"))
    relatives = first_delivery(table(spark, d, "relatives"), "relative_id", RELATIVE_COLUMNS[1:], "ingested_at").withColumn("source_id", F.nullif(F.get_json_object("payload", "$.source_id"), F.lit("")))
    return View(promote(facts), relatives)


# --- validation ----------------------------------------------------------------------------------


def _filled(c: str) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def fact_problem(payload_limit: int = MAX_FACT_PAYLOAD) -> Column:
    """Why a fact row can't be stored, or null."""
    out = None
    for c in FACT_COLUMNS[:5]:
        out = F.when(~_filled(c), f"invalid_{c}") if out is None else out.when(~_filled(c), f"invalid_{c}")
    is_object = F.coalesce(F.get_json_object("payload", "$").startswith("{"), F.lit(False))
    return out.when(~is_object, "invalid_payload").when(F.octet_length("payload") > payload_limit, "payload_too_large")


def relative_problem(payload_limit: int = MAX_RELATIVE_PAYLOAD) -> Column:
    """Why a relative row can't be stored, or null."""
    out = None
    for c in ["relative_id", "from_fact_id", "to_fact_id", "object_profile", "evidence_source"]:
        out = F.when(~_filled(c), f"invalid_{c}") if out is None else out.when(~_filled(c), f"invalid_{c}")
    sound = F.coalesce(F.col("confidence").between(0.0, 1.0) & ~F.isnan("confidence"), F.lit(False))
    return (
        out.when(~F.coalesce(F.col("relation_kind").isin(RELATION_KINDS), F.lit(False)), "invalid_relation_kind")
        .when(~sound, "invalid_confidence")
        .when(F.col("condition").isNotNull() & ~F.coalesce(F.col("condition.kind").isin(CONDITION_KINDS), F.lit(False)), "invalid_condition")
        .when(F.col("condition").isNotNull() & (F.octet_length(F.to_json("condition")) > MAX_CONDITION), "condition_too_large")
        .when(F.octet_length("payload") > payload_limit, "payload_too_large")
    )


def inventory_problem() -> Column:
    """Why a source-inventory row can't be stored, or null."""
    digest = lambda c: F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))
    return (
        F.when(~_filled("source_id"), "invalid_source_id").when(~_filled("rel_path"), "invalid_rel_path")
        .when(~F.coalesce(F.col("source_kind").isin("c_source", "header", "other"), F.lit(False)), "invalid_source_kind")
        .when(~digest("sha256"), "invalid_sha256").when(~F.coalesce((F.col("size_bytes") >= 0) & (F.col("mtime_ns") >= 0), F.lit(False)), "invalid_size")
    )
