"""Graph operators of the search language: anchors, one-hop relations, closure, shortest path.

Edges whose ends are not both visible don't exist here (inner joins). Frontiers
are bounded by the budgets of the language, so they are broadcast; without a
budget (`closure`) they stay distributed and are staged hop by hop.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.fold import casefold
from factloom.operators.search import owner_alias_match, term_score
from factloom.plans.model import View, salience
from factloom.plans.query_lang import QueryError, RelationQuery, check_limit, parse, split_terms
from factloom.scratch import spread_join, stage

# The budgets of one traversal.
EDGE_BUDGET, VISIT_BUDGET = 50_000, 10_000


# --- anchors -------------------------------------------------------------------------------------


def anchor_candidates(facts: DataFrame, anchor: str, kind: str) -> DataFrame:
    """Facts an anchor may mean, from the first tier that has any: (…, tier, exact_name), in order.

    Tiers: 0 the id, 1 owner and field, 2 the exact name, 3 a text match.
    """
    terms, key = split_terms(anchor), anchor.casefold()
    tier = F.when(F.col("object_id") == anchor, 0)
    if kind == "field":
        tier = tier.when(owner_alias_match(anchor), 1)
    tier = tier.when(F.col("name_cf") == key, 2)
    if terms:
        tier = tier.when(term_score(terms) > 0, 3)
    hits = facts.where(F.col("kind") == kind).withColumn("tier", tier).where("tier is not null")
    exact = (F.col("tier").isin(1, 2)) | (F.col("name_cf") == key)
    best = hits.agg(F.min("tier").alias("tier"))  # one row
    return hits.join(F.broadcast(best), "tier").withColumn("exact_name", exact).orderBy("tier", F.desc("exact_name"), "source_path", "object_source", "object_id")


def needs_refinement(candidates: list) -> bool:
    return len(candidates) > 1 or bool(candidates) and candidates[0]["tier"] >= 3


# --- one hop -------------------------------------------------------------------------------------


def endpoint_filter(spec: RelationQuery) -> Column:
    """Filters of a query on the endpoint fact."""
    ok = F.lit(True)
    for f in spec.files:
        ok = ok & F.contains(casefold("source_path"), F.lit(f))
    for n in spec.names:
        ok = ok & F.contains(F.col("name_cf"), F.lit(n))
    return ok & (term_score(list(spec.terms)) > 0) if spec.terms else ok


def representative() -> Column:
    """What the smallest relative is chosen by: unconditional first, then evidence, then id."""
    return F.struct(F.col("condition").isNotNull().alias("conditional"), F.coalesce("evidence_source", F.lit("")).alias("evidence"), F.col("relative_id").alias("rid"))


def weighed(pairs: DataFrame) -> DataFrame:
    """Edges (endpoint_id, hop, relative columns) as rows that may stand for several: n, rep, unconditional."""
    return pairs.select("endpoint_id", "hop", "relation_kind", F.lit(1).cast("bigint").alias("n"), representative().alias("rep"), F.col("condition").isNull().alias("unconditional"))


def rollup(rows: DataFrame) -> DataFrame:
    """`weighed` edges per endpoint.

    Two steps, both with partial aggregation: per endpoint and kind, of which
    there are few, then per endpoint.
    """
    per_kind = rows.groupBy("endpoint_id", "relation_kind").agg(F.sum("n").alias("n"), F.min("hop").alias("hop"), F.min("rep").alias("rep"), F.bool_or("unconditional").alias("unconditional"))
    rank = salience(F.col("relation_kind"))
    one = F.struct(rank.alias("salience"), F.col("relation_kind").alias("kind"), F.col("rep.rid").alias("representative"), F.col("n").alias("instances"))
    return per_kind.groupBy("endpoint_id").agg(
        F.sum("n").alias("instances"), F.min("hop").alias("hop"), F.min("rep")["rid"].alias("representative"), F.bool_or("unconditional").alias("has_unconditional"), F.min(rank).alias("salience"), F.sort_array(F.collect_list(one)).alias("matched")
    )


def endpoint_order() -> list:
    return ["hop", "salience", F.desc("instances"), F.desc("has_unconditional"), "object_name", "source_path", "object_id", "representative"]


def with_endpoints(rolled: DataFrame, facts: DataFrame, spec: RelationQuery | None = None) -> DataFrame:
    """Adds the endpoint facts and applies a query's filters."""
    named = rolled.join(facts, rolled["endpoint_id"] == facts["object_id"]).drop("endpoint_id")
    return named if spec is None else named.where(endpoint_filter(spec))


def one_hop(view: View, anchor_id: str, kinds: list[str], direction: str) -> DataFrame:
    """Edges of an anchor, with `endpoint_id` and hop 1."""
    near, far = ("to_fact_id", "from_fact_id") if direction == "incoming" else ("from_fact_id", "to_fact_id")
    return view.edges_at(near).where((F.col(near) == anchor_id) & F.col("relation_kind").isin(list(kinds))).withColumn("endpoint_id", F.col(far)).withColumn("hop", F.lit(1)).where("endpoint_id is not null")


def relatives_of(view: View, fact_id: str, direction: str = "both", kind: str | None = None) -> DataFrame:
    """Edges of a fact with both ends visible, in order of kind, ends and id."""
    if direction not in ("incoming", "outgoing", "both"):
        raise QueryError("invalid_direction", "direction must be incoming, outgoing, or both")
    near = {"incoming": ["to_fact_id"], "outgoing": ["from_fact_id"], "both": ["to_fact_id", "from_fact_id"]}[direction]
    found = None
    for end in near:  # each end from the copy sorted by it; a loop on the fact comes in once
        edges = view.edges_at(end).where(F.col(end) == fact_id)
        found = edges if found is None else found.unionByName(edges.where(~F.col("to_fact_id").eqNullSafe(fact_id)))
    found = found if kind is None else found.where(F.col("relation_kind") == kind)
    return View(view.facts, found, whole=view.whole).connected().orderBy("relation_kind", "from_fact_id", "to_fact_id", "relative_id")


# --- call edges ----------------------------------------------------------------------------------


@dataclass
class Calls:
    """What call edges are made of; dispatches are joined with assignments only where a walk passes."""

    direct: DataFrame  # from_id, to_id, relative columns
    dispatch: DataFrame  # from_id, slot, relative columns
    assigned: DataFrame  # slot, to_id, each pair once
    direct_in: DataFrame | None = None  # direct, from the copy sorted by its to_id


def call_graph(view: View) -> Calls:
    """The call edges of a view. Those of a store are read from its sorted copies; others are staged."""
    named = lambda df: df.where("relation_kind = 'direct_call'").withColumns({"from_id": F.col("from_fact_id"), "to_id": F.col("to_fact_id")})
    if view.whole and view.by_to is not None:
        edges = view.relatives
    else:
        used = view.relatives.where(F.col("relation_kind").isin("direct_call", "assigned_to", "dispatches_via"))
        edges = stage(View(view.facts, used).connected(), "call_relatives")
    return Calls(
        named(edges),
        edges.where("relation_kind = 'dispatches_via'").withColumns({"from_id": F.col("from_fact_id"), "slot": F.col("to_fact_id")}),
        edges.where("relation_kind = 'assigned_to'").select(F.col("from_fact_id").alias("slot"), F.col("to_fact_id").alias("to_id")).distinct(),
        named(view.by_to) if view.whole and view.by_to is not None else None,
    )


def call_classes(calls: Calls) -> DataFrame:
    """Call edges in factored form: (slot, role, fact_id, relation_kind, n).

    A dispatch runs from its source to every fact assigned to the slot, so a slot
    with d dispatches and a assignments stands for d * a edges. They are not
    expanded: a slot is a class, its sources and its targets are the members,
    and an edge runs from each source to each target, as often as n of the source
    says; a slot with members of one role only has no edges. Direct calls are `direct_pairs`.
    """
    source = calls.dispatch.groupBy("slot", "from_id", "relation_kind").agg(F.count(F.lit(1)).alias("n")).select("slot", F.lit("source").alias("role"), F.col("from_id").alias("fact_id"), "relation_kind", "n")
    target = calls.assigned.select("slot", F.lit("target").alias("role"), F.col("to_id").alias("fact_id"), F.lit("assigned_to").alias("relation_kind"), F.lit(1).cast("bigint").alias("n"))
    return source.unionByName(target)


def direct_pairs(calls: Calls) -> DataFrame:
    """(from_id, to_id, n) of the direct calls."""
    return calls.direct.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n"))


def _step(calls: Calls, frontier: DataFrame, direction: str) -> DataFrame:
    """`weighed` edges out of a frontier(id), without hop. At a slot, the many sides are summed up before they meet."""
    plain = lambda df, far, n: df.select(F.col(far).alias("endpoint_id"), "relation_kind", n.cast("bigint").alias("n"), representative().alias("rep"), F.col("condition").isNull().alias("unconditional"))
    if direction == "outgoing":
        direct = plain(calls.direct.join(frontier.withColumnRenamed("id", "from_id"), "from_id", "left_semi"), "to_id", F.lit(1))
        at = calls.dispatch.join(frontier.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
        per_slot = at.groupBy("slot", "relation_kind").agg(F.count(F.lit(1)).alias("n"), F.min(representative()).alias("rep"), F.bool_or(F.col("condition").isNull()).alias("unconditional"))
        via = spread_join(calls.assigned, per_slot, "slot", ["to_id"]).select(F.col("to_id").alias("endpoint_id"), "relation_kind", "n", "rep", "unconditional")
    else:
        into = calls.direct if calls.direct_in is None else calls.direct_in
        direct = plain(into.join(frontier.withColumnRenamed("id", "to_id"), "to_id", "left_semi"), "from_id", F.lit(1))
        per_slot = calls.assigned.join(frontier.withColumnRenamed("id", "to_id"), "to_id", "left_semi").groupBy("slot").agg(F.count(F.lit(1)).alias("k"))
        via = plain(spread_join(calls.dispatch, per_slot, "slot", ["relative_id"]), "from_id", F.col("k"))
    return direct.unionByName(via)


def closure(calls: Calls, anchor_id: str, direction: str, depth: int) -> DataFrame:
    """`weighed` edges met by a breadth-first walk: those that reach an endpoint at its least hop. No budget; each hop is staged."""
    visited = calls.direct.sparkSession.createDataFrame([(anchor_id,)], "id string")
    frontier, met = visited, None
    for hop in range(1, depth + 1):
        step = _step(calls, frontier, direction).join(visited.withColumnRenamed("id", "endpoint_id"), "endpoint_id", "left_anti")
        step = stage(step.withColumn("hop", F.lit(hop)), "hop")
        frontier = step.select(F.col("endpoint_id").alias("id")).distinct()
        visited = visited.unionByName(frontier)
        met = step if met is None else met.unionByName(step)
    return met


def reach(calls: Calls, anchor_id: str, target_id: str, depth: int) -> tuple[bool, int, bool]:
    """Whether a walk of at most `depth` hops meets the target: (reachable, hops of the shortest path, complete). No budget; each hop is staged.

    The answer is complete if the target was met or nothing lay beyond; else
    longer paths may exist. The walk ends at the target or without new facts.
    """
    if anchor_id == target_id:
        return True, 0, True
    visited = calls.direct.sparkSession.createDataFrame([(anchor_id,)], "id string")
    frontier = visited
    for hop in range(1, depth + 1):
        step = _step(calls, frontier, "outgoing").select(F.col("endpoint_id").alias("id")).distinct()
        frontier = stage(step.join(visited, "id", "left_anti"), "reached")
        if frontier.where(F.col("id") == target_id).limit(1).count():
            return True, hop, True
        if not frontier.limit(1).count():
            return False, 0, True
        visited = visited.unionByName(frontier)
    return False, 0, False


# --- the language --------------------------------------------------------------------------------


@dataclass
class RelationResult:
    """What a relation query answers; `rows` are plain dicts, at most `limit`."""

    status: str = "ok"  # ok, too_broad, needs_refinement, not_found
    rows: list = field(default_factory=list)
    total: int = 0
    complete: bool = True
    total_is_exact: bool = True
    reachable: bool | None = None
    path: list = field(default_factory=list)
    anchor: str | None = None
    candidates: list = field(default_factory=list)
    budget_kind: str | None = None
    depth_used: int = 0
    visited: int = 0
    edges: int = 0
    message: str | None = None
    examples: tuple = ()


def _budget_message(kind: str) -> str:
    what = {"visited_functions": "visited function", "frontier_edges": "frontier edge"}[kind]
    return f"Relation search exhausted the {what} budget; reduce depth or refine the query."


def _resolve(view: View, anchor: str, kind: str, limit: int) -> tuple[str | None, RelationResult | None]:
    if view.facts.where((F.col("object_id") == anchor) & (F.col("kind") == kind)).limit(1).count():  # the first tier, by a pushed-down filter
        return anchor, None
    rows = [r.asDict() for r in anchor_candidates(view.facts, anchor, kind).select("object_id", "object_name", "object_source", "tier", "exact_name").limit(max(limit, 2)).collect()]
    if not rows:
        return None, RelationResult("not_found", complete=False, message=f"No {kind} matches `{anchor}`.")
    if needs_refinement(rows):
        return None, RelationResult("needs_refinement", complete=False, candidates=rows, message="No exact anchor was selected; refine with an object_id from search results.")
    return rows[0]["object_id"], None


def relation_search(view: View, query: str | RelationQuery, limit: int = 20, calls: Calls | None = None, edge_budget: int = EDGE_BUDGET, visit_budget: int = VISIT_BUDGET) -> RelationResult:
    """Answers a relation query. `calls` may hold the `call_graph` of the view."""
    spec = parse(query) if isinstance(query, str) else query
    check_limit(limit)
    if spec.complaint:
        return RelationResult("needs_refinement", complete=False, message=spec.complaint, examples=spec.examples)
    anchor, refusal = _resolve(view, spec.anchor, spec.anchor_kind, limit)
    if refusal:
        return refusal
    if spec.walks:
        calls = call_graph(view) if calls is None else calls
    if spec.mode == "relation_reachable":
        target, refusal = _resolve(view, spec.target, "function", limit)
        return refusal or _reach(view, calls, anchor, target, spec, edge_budget, visit_budget)
    out = RelationResult(anchor=anchor)
    if spec.walks:
        met = _walk(view, calls, anchor, spec, out, edge_budget, visit_budget)
        pairs = view.facts.sparkSession.createDataFrame(met, "endpoint_id string, hop int, relative_id string")
        pairs = pairs.join(view.relatives, "relative_id")
    else:
        pairs = one_hop(view, anchor, spec.kinds, spec.direction)
        out.depth_used = 1
    rows = with_endpoints(rollup(weighed(pairs)), view.facts, spec)
    out.total = rows.count()
    out.rows = [r.asDict(recursive=True) for r in rows.orderBy(*endpoint_order()).limit(limit).select("object_id", "object_name", "object_source", "hop", "instances", "representative", "matched").collect()]
    if out.budget_kind or out.total > limit:
        out.status = "too_broad"
    if not out.total and spec.predicate == "writers":
        out.message, out.examples = f"No field_write edges were found for this field anchor; try accessors:{anchor}.", (f"accessors:{anchor}",)
    return out


def _frontier_edges(view: View, calls: Calls, frontier: list[str], direction: str, most: int) -> list:
    """Edges of a frontier in traversal order, at most `most`; the frontier has at most VISIT_BUDGET ids and is broadcast.

    A slot with d dispatches and a assignments stands for d * a edges, which are
    not built to be cut afterwards: edges are counted per source first, and only
    sources that begin within the budget are followed; of a slot's far side only
    as many facts in order are taken as `most` edges can use.
    """
    spark = view.facts.sparkSession
    outgoing = direction == "outgoing"
    near, far = ("from_id", "to_id") if outgoing else ("to_id", "from_id")
    base = calls.direct if outgoing or calls.direct_in is None else calls.direct_in
    # Both sides of a slot, as seen from the frontier: (near, slot, m), and (slot, far, relative columns or none).
    here, there = (calls.dispatch, calls.assigned) if outgoing else (calls.assigned, calls.dispatch)
    ids = F.broadcast(spark.createDataFrame([(i,) for i in frontier], f"{near} string"))
    direct = base.join(ids, near)
    slots = here.join(ids, near).groupBy(near, "slot").agg(F.count(F.lit(1)).alias("m"))
    far_sizes = there.groupBy("slot").agg(F.count(F.lit(1)).alias("a"))
    via = stage(slots.join(far_sizes, "slot"), "slots")
    sums = direct.groupBy(near).agg(F.count(F.lit(1)).alias("n")).unionByName(via.groupBy(near).agg(F.sum(F.col("m") * F.col("a")).alias("n")))
    kept, n = [], 0
    for r in sums.groupBy(near).agg(F.sum("n").alias("n")).orderBy(near).collect():  # a row per id of the frontier
        if n >= most:
            break
        kept.append((r[0],))
        n += r["n"]
    if not kept:
        return []
    ids = F.broadcast(spark.createDataFrame(kept, f"{near} string"))
    names = view.facts.select("object_id", "object_name", "object_source")
    shown = ["relative_id", "relation_kind", "condition", "source", "object_id", "object_name", "object_source"]
    plain = base.join(ids, near).select("relative_id", "relation_kind", "condition", F.col(near).alias("source"), F.col(far).alias("object_id")).join(names, "object_id").select(*shown)
    live = via.join(ids, near)
    wanted = there.join(live.select("slot").distinct(), "slot", "left_semi").withColumn("object_id", F.col(far)).join(names, "object_id")
    # Equal ranks stay together, since between them the order goes on by the relative. Two levels, so that no slot is ranked by one task alone.
    order = ["object_name", "object_source"] if outgoing else ["object_name", "object_source", "relative_id", "object_id"]
    part = wanted.withColumn("_part", F.pmod(F.xxhash64("object_id"), F.lit(64)))
    part = part.withColumn("_k", F.rank().over(Window.partitionBy("slot", "_part").orderBy(*order))).where(F.col("_k") <= most)
    ranked = part.withColumn("_k", F.rank().over(Window.partitionBy("slot").orderBy(*order))).where(F.col("_k") <= most)
    use = live.join(ranked, "slot").where(F.col("_k") <= F.ceil(F.lit(most) / F.col("m")))
    if outgoing:  # the relatives of this source and slot, once for each target that is left
        sent = calls.dispatch.join(ids, near).select(near, "slot", "relative_id", "relation_kind", "condition")
        passed = use.select(near, "slot", "object_id", "object_name", "object_source").join(sent, [near, "slot"])
    else:
        passed = use
    passed = passed.select("relative_id", "relation_kind", "condition", F.col(near).alias("source"), "object_id", "object_name", "object_source")
    return plain.unionByName(passed).orderBy("source", "object_name", "object_source", "relative_id", "object_id").limit(most).collect()


def _walk(view, calls, anchor, spec, out, edge_budget, visit_budget) -> list[tuple]:
    """The budgeted breadth-first walk; returns (endpoint, hop, relative) and fills the counters of `out`."""
    hops, visited, frontier, met = {}, {anchor}, [anchor], []
    for hop in range(1, spec.depth + 1):
        out.depth_used, fresh = hop, []
        edges = _frontier_edges(view, calls, frontier, spec.direction, edge_budget - out.edges + 1)
        for e in edges:
            if out.edges >= edge_budget:
                out.budget_kind = "frontier_edges"
                break
            out.edges += 1
            end = e["object_id"]
            if end == anchor or hops.get(end, hop) < hop:
                continue
            if end not in hops:
                hops[end] = hop
                if end not in visited:
                    if len(visited) >= visit_budget:
                        out.budget_kind = "visited_functions"
                        break
                    visited.add(end)
                    fresh.append(end)
            met.append((end, hop, e["relative_id"]))
        frontier = fresh
        if out.budget_kind or not frontier:
            break
    out.visited = len(visited)
    if out.budget_kind:
        out.complete = out.total_is_exact = False
        out.message = _budget_message(out.budget_kind)
    return met


def _reach(view, calls, anchor, target, spec, edge_budget, visit_budget) -> RelationResult:
    """Shortest path: the first edge in order that discovers a fact is its parent."""
    out = RelationResult(anchor=anchor, reachable=anchor == target)
    parents: dict[str, tuple] = {}
    frontier, seen = [anchor], {anchor}
    for hop in range(1, spec.depth + 1):
        if out.reachable:
            break
        out.depth_used, fresh = hop, []
        for e in _frontier_edges(view, calls, frontier, "outgoing", edge_budget - out.edges + 1):
            if out.edges >= edge_budget:
                out.budget_kind = "frontier_edges"
                break
            out.edges += 1
            end = e["object_id"]
            if end in seen:
                continue
            if len(seen) >= visit_budget:
                out.budget_kind = "visited_functions"
                break
            seen.add(end)
            parents[end] = (e["source"], e, hop)
            if end == target:
                out.reachable = True
                break
            fresh.append(end)
        if out.budget_kind or out.reachable:
            break
        frontier = fresh
        if not frontier:
            break
    out.visited = len(seen)
    out.complete = out.reachable or (not out.budget_kind and not frontier)
    out.total, out.total_is_exact = int(out.reachable), out.complete and not out.budget_kind
    if out.budget_kind:
        out.status, out.message = "too_broad", _budget_message(out.budget_kind)
    if out.reachable:
        at, path = target, []
        while at != anchor:
            source, e, hop = parents[at]
            path.append({"object_id": at, "hop": hop, "relation_kind": e["relation_kind"], "relative_id": e["relative_id"], "condition": e["condition"] and e["condition"].asDict()})
            at = source
        out.path = [{"object_id": anchor, "hop": 0, "relation_kind": None, "relative_id": None, "condition": None}, *reversed(path)]
    return out
