"""Ranked term search over facts.

Every term must occur in at least one of six weighted fields; a fact's rank adds
an exact-name bonus and the rank of its kind. The best exact-name hits of each
kind come first. One pass over the facts, one top-k; nothing is pre-cut, so the
ranking is exact. Null fields count as empty. Repeated ids count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.plans.model import kind_rank
from factloom.plans.query_lang import owner_field_pairs, split_terms
from factloom.scratch import stage

# Weights of the searched fields, the bonus, the exact hits shown first per kind.
WEIGHTS = {"name_cf": 3, "desc_cf": 2, "caller_cf": 2, "callee_cf": 2, "source_cf": 1, "owner_cf": 1}
EXACT_BONUS = 10
EXACT_PER_KIND = 3


def term_score(terms: list[str]) -> Column:
    """Sum of the weights of the fields that hold each term; 0 unless all terms are found."""
    per_term = [reduce(lambda a, b: a + b, (F.when(F.contains(F.col(c), F.lit(t)), w).otherwise(0) for c, w in WEIGHTS.items())) for t in terms]
    return F.when(reduce(lambda a, b: a & b, (s > 0 for s in per_term)), reduce(lambda a, b: a + b, per_term)).otherwise(0)


def ranked(facts: DataFrame, terms: list[str]) -> DataFrame:
    """Matching facts with score, exact, kind_rank and rank_score."""
    exact = F.when(F.col("name_cf") == " ".join(terms), 1).otherwise(0)
    hits = facts.withColumn("score", term_score(terms)).where("score > 0").withColumn("exact", exact).withColumn("kind_rank", kind_rank(F.col("kind")))
    return hits.withColumn("rank_score", F.col("score") + EXACT_BONUS * F.col("exact") + F.col("kind_rank"))


RANK_KEYS = ["rank_score", "score", "exact", "kind_rank", "object_id"]


def _order() -> list[Column]:
    return [F.col(k).asc() if k == "object_id" else F.col(k).desc() for k in RANK_KEYS]


def search(facts: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The `limit` best facts with their 1-based `position`. Without terms: the first by id."""
    terms = split_terms(query)
    if not terms:
        return _positioned(facts.dropDuplicates(["object_id"]).orderBy("object_id").limit(limit), [F.col("object_id")])
    hits = ranked(facts.dropDuplicates(["object_id"]), terms)
    # Exact hits are cut to the first few per kind by a top-k per kind, all others to the first `limit`.
    place = F.row_number().over(Window.partitionBy("kind").orderBy(*_order()))
    floor = hits.where("exact = 1").withColumn("_n", place).where(F.col("_n") <= EXACT_PER_KIND).drop("_n").withColumn("first", F.lit(1))
    best = hits.orderBy(*_order()).limit(limit).join(floor.select("object_id"), "object_id", "left_anti").withColumn("first", F.lit(0))
    keys = [F.desc("first"), F.when(F.col("first") == 1, F.col("kind_rank")).desc(), F.when(F.col("first") == 1, F.col("kind")).asc(), *_order()]
    return _positioned(floor.unionByName(best).orderBy(*keys).limit(limit), keys)


def _positioned(top: DataFrame, keys: list[Column]) -> DataFrame:
    """Numbers the rows of a top-k, of which there are at most `limit`."""
    return top.withColumn("position", F.row_number().over(Window.partitionBy(F.lit("top")).orderBy(*keys)))


def page(df: DataFrame, order: list, limit: int) -> tuple[DataFrame, bool]:
    """The first `limit` rows in order, and whether there are more, for which one row more is asked for."""
    more = stage(df.orderBy(*order).limit(limit + 1), "page")
    return more.orderBy(*order).limit(limit), more.count() > limit


def owner_alias_match(query: str) -> Column:
    """Whether a field fact is named by `owner field` identifiers: its name, and the owner inside its owner text."""
    hit = F.lit(False)
    for owner, name in owner_field_pairs(query):
        hit = hit | ((F.col("name_cf") == name) & F.contains(F.col("owner_cf"), F.lit(owner)))
    return hit & (F.col("kind") == "field")


def no_exact_note(query: str, names: list[str]) -> str | None:
    """A note for an identifier query that no returned name equals."""
    text = query.strip()
    if not names or not text.isascii() or not text.isidentifier() or any(n.casefold() == text.casefold() for n in names):
        return None
    top = ", ".join(dict.fromkeys(names[:3]))
    return f"No exact object_name match for `{text}`; returned text matches are fallback candidates. Top text matches: {top}."


def recipe_search(recipes: DataFrame, query: str) -> DataFrame:
    """Recipes (id, notes, tests) whose id, notes or any test holds the query in lower case."""
    q = F.lit(query.lower())
    held = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), q)
    return recipes.where(held(F.col("id")) | held(F.col("notes")) | F.coalesce(F.exists("tests", held), F.lit(False)))
