"""Queries of the reference's operators over whole test tables, with the SQL they are compared with.

Facts, relatives, patches, snapshots and inventories come from the code-fact
tables; logs, runs and journals are projections of the event and order tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.jsonops import bounded_payload, redacted
from factloom.functions.paths import source_bucket, truncated_text
from factloom.operators import census, detail, graph, ingest, logs, overlay, perfscan, runs, search, verdict
from factloom.plans.model import View, base_view, fact_problem, relative_problem
from factloom.plans.query_lang import REACH_DEPTH, parse
from factloom.scratch import stage
from factloom.session import table
from factloom.sources.library import published
from factloom.sources.store import counters
from factloom.sources.store import orphan_edges as store_orphans

TERMS = "route priority"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# What every statement over the graph starts with: facts and relatives once each, payloads parsed.
VIEW = r"""
f0 as (select object_id, arg_min({'a': object_name, 'b': object_description, 'c': object_source, 'd': object_profile, 'e': object_caller, 'g': object_callee, 'p': payload}, ingested_at) as x
       from facts where object_id is not null group by 1),
f1 as (select object_id, x.a as object_name, x.b as object_description, x.c as object_source, x.d as object_profile, x.e as object_caller, x.g as object_callee, x.p as payload from f0
       union all select object_id, object_name, object_description, object_source, object_profile, object_caller, object_callee, payload from system_facts where object_id not in (select object_id from f0)),
f2 as (select *, coalesce(nullif(payload->>'$.fact_kind', ''), 'fact') as kind, nullif(payload->>'$.owner_name', '') as owner, nullif(payload->>'$.type', '') as typ, payload->>'$.linkage' as linkage,
         nullif(payload->>'$.source_id', '') as source_id,
         case when object_source is null or object_source = '' then '<unknown-source>' when regexp_matches(object_source, '^.+:[0-9]*[1-9][0-9]*$') then regexp_extract(object_source, '^(.+):[0-9]+$', 1) else object_source end as source_path from f1),
f as (select *, lower(coalesce(object_name, '')) as name_cf, lower(coalesce(object_description, '')) as desc_cf, lower(coalesce(object_caller, '')) as caller_cf, lower(coalesce(object_callee, '')) as callee_cf, lower(coalesce(object_source, '')) as source_cf,
        case when kind = 'field' then lower(concat_ws(' ', owner || ' ' || owner || '.' || coalesce(object_name, '') || ' ' || owner || '::' || coalesce(object_name, ''),
          case when owner is null or lower(owner) <> lower(typ) then typ || ' ' || typ || '.' || coalesce(object_name, '') || ' ' || typ || '::' || coalesce(object_name, '') end)) else '' end as owner_cf from f2),
r0 as (select relative_id, arg_min({'a': from_fact_id, 'b': to_fact_id, 'c': relation_kind, 'd': condition, 'e': object_profile, 'g': evidence_source, 'p': payload}, ingested_at) as x from relatives where relative_id is not null group by 1),
r as (select relative_id, x.a as from_fact_id, x.b as to_fact_id, x.c as relation_kind, x.d as condition, x.e as object_profile, x.g as evidence_source, nullif(x.p->>'$.source_id', '') as source_id from r0)
"""


def _score(terms: str) -> str:
    weights = [("name_cf", 3), ("desc_cf", 2), ("caller_cf", 2), ("callee_cf", 2), ("source_cf", 1), ("owner_cf", 1)]
    per = ["(" + " + ".join(f"{w} * (contains({c}, '{t}'))::int" for c, w in weights) + ")" for t in terms.split()]
    return f"case when {' and '.join(p + ' > 0' for p in per)} then {' + '.join(per)} else 0 end"


KIND_RANK = "case kind when 'type' then 10 when 'function' then 9 when 'global' then 8 when 'macro' then 7 when 'code_file' then 6 when 'function_pointer_slot' then 5 when 'field' then 0 else 4 end"
SALIENCE = "case relation_kind when 'direct_call' then 0 when 'dispatches_via' then 0 when 'field_write' then 1 when 'field_read' then 2 when 'assigned_to' then 3 else 5 end"
ROLLUP = f"""
k as (select endpoint_id, relation_kind, count(*) as n, min(hop) as hop, bool_or(condition is null) as unc from pairs group by all),
rep as (select endpoint_id, arg_min(relative_id, ((condition is not null)::int, coalesce(evidence_source, ''), relative_id)) as representative from pairs group by 1),
rolled as (select endpoint_id, sum(n)::bigint as instances, min(hop) as hop, bool_or(unc) as has_unconditional, min({SALIENCE}) as salience, count(*) as n_kinds from k group by 1)
"""
ROLLED = "select o.endpoint_id as object_id, o.hop, o.instances, o.has_unconditional, o.salience, o.n_kinds, p.representative from rolled o join rep p using (endpoint_id) join f on f.object_id = o.endpoint_id"


# --- search --------------------------------------------------------------------------------------


def _ranked_sql(terms: str) -> str:
    return f"hits as (select *, {_score(terms)} as score, (name_cf = '{terms}')::int as exact, {KIND_RANK} as kr from f), ranked as (select *, score + 10 * exact + kr as rank_score from hits where score > 0)"


def _search_sql(terms: str, limit: int) -> str:
    keys = "rank_score desc, score desc, exact desc, kr desc, object_id"
    return f"""with {VIEW}, {_ranked_sql(terms)},
    placed as (select *, case when exact = 1 and row_number() over (partition by kind, exact order by {keys}) <= 3 then 1 else 0 end as first from ranked)
    select object_id, kind, rank_score, (row_number() over (order by first desc, case when first = 1 then kr end desc, case when first = 1 then kind end, {keys}))::int as position from placed qualify position <= {limit}"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts with their search columns, from the published store."""
    return published(spark, d).view().facts


def _graph(spark: SparkSession, d: str) -> View:
    """The published store's view: facts, and the relatives with both ends, sorted by either."""
    return published(spark, d).view()


def _shown(top: DataFrame) -> DataFrame:
    return top.select("object_id", "kind", "rank_score", "position")


@query(_search_sql(TERMS, 20))
def term_search(spark: SparkSession, d: str) -> DataFrame:
    """Two terms, all weighted fields, top 20."""
    return _shown(search.search(_facts(spark, d), TERMS, 20))


@query(_search_sql("anchor", 50))
def term_search_kind_floor(spark: SparkSession, d: str) -> DataFrame:
    """One term; exact names come first, three per kind."""
    return _shown(search.search(_facts(spark, d), "anchor", 50))


@query(f"with {VIEW}, {_ranked_sql(TERMS)} select object_id, score, exact, kr as kind_rank, rank_score from ranked")
def term_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every matching fact."""
    return search.ranked(_facts(spark, d), TERMS.split()).select("object_id", "score", "exact", "kind_rank", "rank_score")


@query(f"with {VIEW} select object_id, kind, (row_number() over (order by object_id))::int as position from f qualify position <= 20")
def empty_search(spark: SparkSession, d: str) -> DataFrame:
    """Without terms: the first facts by id."""
    return search.search(_facts(spark, d), "  ", 20).select("object_id", "kind", "position")


@query(f"with {VIEW} select object_id, owner as owner_name, object_name from f where kind = 'field' and name_cf = 'route_field' or kind = 'field' and contains(owner_cf, 'priority') and name_cf = 'signal_priority'")
def owner_field_search(spark: SparkSession, d: str) -> DataFrame:
    """Fields by owner and name."""
    facts = _facts(spark, d)
    hit = search.owner_alias_match("Priority.signal_priority") | ((F.col("kind") == "field") & (F.col("name_cf") == "route_field"))
    return facts.where(hit).select("object_id", "owner_name", "object_name")


@query(f"""with {VIEW}, t as (select object_id, name_cf, case when object_id = 'route' then 0 when name_cf = 'route' then 2 when {_score('route')} > 0 then 3 end as tier from f where kind = 'field')
select object_id, tier, name_cf = 'route' as exact_name from t where tier = (select min(tier) from t)""")
def anchor_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the first tier that has any."""
    return graph.anchor_candidates(_facts(spark, d), "route", "field").select("object_id", "tier", "exact_name")


# --- graph ---------------------------------------------------------------------------------------


def _busiest(view: View, kind: str, relation: str, side: str) -> str:
    """The fact of a kind with the most relatives of a kind, the smallest id among equals."""
    ids = view.facts.where(F.col("kind") == kind).select(F.col("object_id").alias(side))
    rows = view.edges_at(side).where(F.col("relation_kind") == relation).join(ids, side, "left_semi").groupBy(side).count().orderBy(F.desc("count"), side).limit(1).collect()
    return rows[0][0] if rows else "none"


def _busiest_sql(kind: str, relation: str, side: str) -> str:
    return f"(select {side} from r where relation_kind = '{relation}' and {side} in (select object_id from f where kind = '{kind}') and from_fact_id in (select object_id from f) and to_fact_id in (select object_id from f) group by 1 order by count(*) desc, 1 limit 1)"


def _one_hop_sql(kinds: str, relation: str) -> str:
    return f"""with {VIEW}, pairs as (select *, from_fact_id as endpoint_id, 1 as hop from r where to_fact_id = {_busiest_sql('field', relation, 'to_fact_id')} and relation_kind in ({kinds}) and from_fact_id is not null),
    {ROLLUP} {ROLLED}"""


def _rolled(pairs: DataFrame, view: View, spec=None) -> DataFrame:
    out = graph.with_endpoints(graph.rollup(pairs), view.facts, spec)
    return out.select("object_id", "hop", "instances", "has_unconditional", "salience", F.size("matched").cast("bigint").alias("n_kinds"), "representative")


def _field_hop(spark, d, predicate, relation, extra=""):
    view = _graph(spark, d)
    anchor = _busiest(view, "field", relation, "to_fact_id")
    spec = parse(f"{predicate}:{anchor} {extra}")
    return _rolled(graph.weighed(graph.one_hop(view, anchor, spec.kinds, spec.direction)), view, spec)


@query(_one_hop_sql("'field_read'", "field_read") + " where contains(lower(f.source_path), 'net/')")
def one_hop_readers(spark: SparkSession, d: str) -> DataFrame:
    """Readers of the most read field, in files of one folder."""
    return _field_hop(spark, d, "readers", "field_read", "file:net/")


@query(_one_hop_sql("'field_write'", "field_write"))
def one_hop_writers(spark: SparkSession, d: str) -> DataFrame:
    return _field_hop(spark, d, "writers", "field_write")


@query(_one_hop_sql("'field_write', 'field_read'", "field_read"))
def one_hop_accessors(spark: SparkSession, d: str) -> DataFrame:
    return _field_hop(spark, d, "accessors", "field_read")


CALLS = """
vis as (select * from r where from_fact_id in (select object_id from f) and to_fact_id in (select object_id from f)),
asg as (select distinct from_fact_id as slot, to_fact_id as target from vis where relation_kind = 'assigned_to'),
ce as (select *, from_fact_id as a, to_fact_id as b from vis where relation_kind = 'direct_call'
       union all select v.*, v.from_fact_id as a, g.target as b from vis v join asg g on v.to_fact_id = g.slot where v.relation_kind = 'dispatches_via')
"""


@query(f"""with {VIEW}, {CALLS}, di as (select to_fact_id as slot, from_fact_id as fact_id, relation_kind, count(*) as n from vis where relation_kind = 'dispatches_via' group by all)
select slot, 'source' as role, fact_id, relation_kind, n from di union all select slot, 'target', target, 'assigned_to', 1 from asg""")
def dispatch_targets(spark: SparkSession, d: str) -> DataFrame:
    """Dispatches joined with assignments, as a class per slot: each source reaches each target."""
    return graph.call_classes(graph.call_graph(_graph(spark, d)))


@query(f"with {VIEW}, {CALLS} select from_fact_id as from_id, to_fact_id as to_id, count(*) as n from vis where relation_kind = 'direct_call' group by all")
def direct_call_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of caller and callee with the number of their calls."""
    return graph.direct_pairs(graph.call_graph(_graph(spark, d)))


def _closure_sql(near: str, far: str, depth: int, anchor: str) -> str:
    return f"""with recursive {VIEW}, {CALLS}, start as (select {anchor} as id),
    walk as (select id, 0 as hop from start union select ce.{far}, w.hop + 1 from walk w join ce on ce.{near} = w.id where w.hop < {depth}),
    least as (select id, min(hop) as hop from walk group by 1),
    pairs as (select ce.*, ce.{far} as endpoint_id, e.hop from ce join least s on s.id = ce.{near} join least e on e.id = ce.{far} and e.hop = s.hop + 1 where e.hop > 0),
    {ROLLUP} {ROLLED}"""


def _closure(spark, d, direction, depth, side):
    view = _graph(spark, d)
    anchor = _busiest(view, "function", "direct_call", side)
    return _rolled(graph.closure(graph.call_graph(view), anchor, direction, depth), view)


@query(_closure_sql("a", "b", 3, _busiest_sql("function", "direct_call", "from_fact_id")))
def callees_depth3(spark: SparkSession, d: str) -> DataFrame:
    """All functions called from the busiest caller within three hops, without budget."""
    return _closure(spark, d, "outgoing", 3, "from_fact_id")


@query(_closure_sql("b", "a", 2, _busiest_sql("function", "direct_call", "to_fact_id")))
def callers_depth2(spark: SparkSession, d: str) -> DataFrame:
    return _closure(spark, d, "incoming", 2, "to_fact_id")


def _reach(spark, d, depth: int) -> tuple[bool, int, bool]:
    view = _graph(spark, d)
    a, b = _busiest(view, "function", "direct_call", "from_fact_id"), _busiest(view, "function", "direct_call", "to_fact_id")
    return graph.reach(graph.call_graph(view), a, b, depth)


@query(f"""with recursive {VIEW}, {CALLS}, walk as (select {_busiest_sql('function', 'direct_call', 'from_fact_id')} as id, 0 as hop union select ce.b, w.hop + 1 from walk w join ce on ce.a = w.id where w.hop < 4)
select count(*) > 0 as reachable, coalesce(min(hop), 0)::int as hops from walk where id = {_busiest_sql('function', 'direct_call', 'to_fact_id')}""")
def reachable_path(spark: SparkSession, d: str) -> DataFrame:
    """Whether the busiest callee is reached from the busiest caller within four hops, and in how many, without budget."""
    reachable, hops, _ = _reach(spark, d, 4)
    return spark.createDataFrame([(reachable, hops)], "reachable boolean, hops int")


@query(f"""with recursive {VIEW}, {CALLS}, walk as (select {_busiest_sql('function', 'direct_call', 'from_fact_id')} as id, 0 as hop union select ce.b, w.hop + 1 from walk w join ce on ce.a = w.id where w.hop < {REACH_DEPTH}),
least as (select id, min(hop) as hop from walk group by 1), hit as (select hop from least where id = {_busiest_sql('function', 'direct_call', 'to_fact_id')})
select count(*) > 0 as reachable, coalesce(min(hop), 0)::int as hops, count(*) > 0 or not exists (select 1 from least where hop = {REACH_DEPTH}) as complete from hit""")
def reachable_full_depth(spark: SparkSession, d: str) -> DataFrame:
    """`reachable_path` at the full depth of the language; a false that longer paths may refute is not complete."""
    return spark.createDataFrame([_reach(spark, d, REACH_DEPTH)], "reachable boolean, hops int, complete boolean")


@query(_closure_sql("b", "a", 1, _busiest_sql("function", "direct_call", "to_fact_id")).replace(ROLLED, """, hits as (select o.*, f.object_name, f.source_path, count(*) over () as total from rolled o join f on f.object_id = o.endpoint_id)
select endpoint_id as object_id, hop, instances, case when total > 20 then 'too_broad' else 'ok' end as status, total from hits order by hop, salience, instances desc, has_unconditional desc, object_name, source_path, endpoint_id limit 20"""))
def relation_search_text(spark: SparkSession, d: str) -> DataFrame:
    """The search language end to end: budgeted callers closure."""
    view = _graph(spark, d)
    out = graph.relation_search(view, f"callers:{_busiest(view, 'function', 'direct_call', 'to_fact_id')} depth:1", 20)
    return spark.createDataFrame([(r["object_id"], r["hop"], r["instances"], out.status, out.total) for r in out.rows], "object_id string, hop int, instances bigint, status string, total bigint")


PREVIEW = """ends as (select to_fact_id as fact_id, 'incoming' as direction, from_fact_id as endpoint_id, * from r union all select from_fact_id, 'outgoing', to_fact_id, * from r),
e as (select * from ends where fact_id is not null and endpoint_id is not null),
tot as (select fact_id, direction, relation_kind, count(*) as bucket_total from e group by all),
fetched as (select * from e qualify row_number() over (partition by fact_id, direction, relation_kind order by endpoint_id, relative_id) <= 100),
g as (select fact_id, direction, relation_kind, endpoint_id, count(*) as instances, bool_or(condition is null) as unc, arg_min(relative_id, ((condition is not null)::int, coalesce(evidence_source, ''), relative_id)) as representative from fetched group by all),
n as (select g.*, f.object_id is null as missing, coalesce(case when f.object_id is not null then coalesce(f.object_name, '') end, g.endpoint_id) as endpoint_name, coalesce(f.source_path, '<missing-endpoint>') as endpoint_file from g left join f on f.object_id = g.endpoint_id),
n2 as (select *, count(*) over (partition by fact_id, direction, relation_kind) > 25 and row_number() over (partition by fact_id, direction, relation_kind, endpoint_file order by instances desc, unc desc, missing, endpoint_name, endpoint_file, representative) > 2 as late from n),
n3 as (select *, row_number() over (partition by fact_id, direction, relation_kind order by late, instances desc, unc desc, missing, endpoint_name, endpoint_file, representative) as place from n2 qualify place <= 25)"""


@query(f"""with {VIEW},
{PREVIEW}
select fact_id, direction, relation_kind, endpoint_id, endpoint_name, endpoint_file, instances, representative, place::int as place, bucket_total from n3 join tot using (fact_id, direction, relation_kind)""")
def relation_preview(spark: SparkSession, d: str) -> DataFrame:
    """The relation preview of every fact: buckets, rollups, at most two endpoints of a file first."""
    return detail.preview(base_view(spark, d)).select("fact_id", "direction", "relation_kind", "endpoint_id", "endpoint_name", "endpoint_file", "instances", "representative", "place", "bucket_total")


BUCKET_RANK = "case direction || '/' || relation_kind " + " ".join(f"when '{d}/{k}' then {i}" for i, (d, k) in enumerate(detail.bucket_keys())) + f" else {len(detail.bucket_keys())} end"


@query(f"""with {VIEW},
{PREVIEW},
cond as (select fact_id, direction, relation_kind, endpoint_id, list_sort(list_distinct(list(json_merge_patch('{{}}', to_json(condition))::varchar) filter (condition is not null))) as conditions from fetched group by all),
flat as (select *, row_number() over (partition by fact_id order by place, {BUCKET_RANK}, direction, relation_kind)::int as flat_place from n3 qualify flat_place <= 8)
select fact_id, direction, relation_kind, endpoint_id, flat_place, coalesce(conditions, []) as conditions from flat join cond using (fact_id, direction, relation_kind, endpoint_id)""")
def relation_preview_sample(spark: SparkSession, d: str) -> DataFrame:
    """The round-robin sample over the preview's buckets of every fact, with the conditions of its endpoints."""
    return detail.preview(base_view(spark, d)).where("flat_place is not null").select("fact_id", "direction", "relation_kind", "endpoint_id", "flat_place", "conditions")


# --- overlays, merges, snapshots -----------------------------------------------------------------

OVER = """
pf as (select object_id, max_by({'dead': action = 'tombstone', 'p': payload}, (patched_at, action = 'tombstone')) as x from fact_patches where object_id is not null group by 1),
pr as (select relative_id, max_by(action, (patched_at, action = 'tombstone')) as action from fact_patches where relative_id is not null group by 1),
up as (select object_id, x.p->>'$.object_name' as object_name, x.p->>'$.object_source' as object_source, coalesce(nullif(x.p->>'$.fact_kind', ''), 'fact') as kind from pf where not x.dead),
ov as (select object_id, object_name, object_source, kind from f where object_id not in (select object_id from pf) union all select * from up),
orel as (select * from r where relative_id not in (select relative_id from pr) and from_fact_id in (select object_id from ov) and to_fact_id in (select object_id from ov))
"""


def _merged(spark, d) -> View:
    base = base_view(spark, d)
    return overlay.apply_overlay(base, overlay.patches(table(spark, d, "fact_patches"), base))


@query(f"with {VIEW}, {OVER} select object_id, object_name, object_source, kind from ov")
def overlay_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts under the overlay of all patch lines."""
    return _merged(spark, d).facts.select("object_id", "object_name", "object_source", "kind")


@query(f"with {VIEW}, {OVER} select relative_id, from_fact_id, to_fact_id, relation_kind from orel")
def overlay_relatives(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).relatives.select("relative_id", "from_fact_id", "to_fact_id", "relation_kind")


@query(f"with {VIEW}, {OVER} select 'facts' as \"table\", kind, count(*) as n from ov group by 2 union all select 'relatives', relation_kind, count(*) from orel group by 2")
def overlay_stats(spark: SparkSession, d: str) -> DataFrame:
    return overlay.view_stats(_merged(spark, d))


@query(f"""with {VIEW}, nf as (select * from f where object_profile = 'release'), pfx as (select * from f where object_profile = 'debug'),
mf as (select object_id, source_path from pfx where source_path not in (select source_path from nf) and object_id not in (select object_id from nf) union all select object_id, source_path from nf),
me as (select relative_id, from_fact_id, to_fact_id from r where object_profile in ('debug', 'release') and from_fact_id in (select object_id from mf) and to_fact_id in (select object_id from mf))
select 'fact' as what, object_id as id from mf union all select 'relative', relative_id from me""")
def merge_after_build(spark: SparkSession, d: str) -> DataFrame:
    """A release build merged into a debug build by file."""
    base = base_view(spark, d)
    part = lambda p: View(base.facts.where(F.col("object_profile") == p), base.relatives.where(F.col("object_profile") == p))
    out = ingest.merge_after_build(part("debug"), part("release"))
    return out.facts.select(F.lit("fact").alias("what"), F.col("object_id").alias("id")).unionByName(out.relatives.select(F.lit("relative").alias("what"), F.col("relative_id").alias("id")))


@query("select object_id, min(payload) as line, count(*) as n_delivered, count(distinct payload) as n_lines from facts group by 1")
def merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Fact lines merged by id: copies collapse, differing lines show."""
    out = ingest.merge_lines(table(spark, d, "facts"), "object_id", F.col("payload"))
    return out


@query("with p as (select object_id, arg_min(payload, ingested_at) as p, min(ingested_at) as seq from facts where object_id is not null group by 1) select object_id, seq, false as conflict, p->>'$.fact_kind' as fact_kind, (p->>'$.line')::bigint as line, p->>'$.source_id' as source_id from p")
def merge_spool(spark: SparkSession, d: str) -> DataFrame:
    """Fact payloads merged by id: the first delivery wins, of equals the larger one."""
    out = ingest.merge_spool(table(spark, d, "facts").where("object_id is not null").withColumn("seq", F.col("ingested_at")), "object_id", "payload", "seq")
    at = lambda k: F.get_json_object("payload", f"$.{k}")
    return out.select("object_id", "seq", "conflict", at("fact_kind").alias("fact_kind"), at("line").cast("bigint").alias("line"), at("source_id").alias("source_id"))


@query("select object_id, max((delivered_at, snapshot_id))[1] as delivered_at, max((delivered_at, snapshot_id))[2] as snapshot_id from fact_snapshots group by 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The last delivered snapshot line of each fact."""
    return ingest.latest_per_key(table(spark, d, "fact_snapshots").select("object_id", "delivered_at", "snapshot_id"), ["object_id"], ["delivered_at", "snapshot_id"])


@query(f'with {VIEW}, e as (select relative_id, from_fact_id as "end" from r union all select relative_id, to_fact_id from r) select relative_id, "end" from e where "end" is null or "end" not in (select object_id from f)')
def orphan_edges(spark: SparkSession, d: str) -> DataFrame:
    """Ends of relatives that are no fact, by a left anti join."""
    v = base_view(spark, d)
    return store_orphans(v.facts, v.relatives)


@query(f"""with {VIEW}, b as (select *, case when regexp_matches(object_source, '^.+:[0-9]+$') then regexp_extract(object_source, '^(.+):[0-9]+$', 1) else split_part(object_source, ':', 1) end as bucket from f),
m as (select 'kind' as what, kind as value from b union all select 'profile', object_profile from b union all select 'source', bucket from b) select what, value, count(*) as n from m group by all""")
def snapshot_fact_counters(spark: SparkSession, d: str) -> DataFrame:
    """Facts by kind, profile and source in one pass."""
    marks = F.array(*(F.struct(F.lit(n).alias("what"), c.alias("value")) for n, c in (("kind", F.col("kind")), ("profile", F.col("object_profile")), ("source", source_bucket(F.col("object_source"))))))
    return base_view(spark, d).facts.select(F.explode(marks).alias("x")).groupBy("x.what", "x.value").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {VIEW} select relation_kind, count(*) as n, count(*) filter (condition is not null) as n_conditional from r group by 1")
def snapshot_edge_counters(spark: SparkSession, d: str) -> DataFrame:
    return base_view(spark, d).relatives.groupBy("relation_kind").agg(F.count(F.lit(1)).alias("n"), F.count("condition").alias("n_conditional"))


@query("""with p as (select 'facts' as "table", case when coalesce(object_id, '') = '' then 'invalid_object_id' when coalesce(object_name, '') = '' then 'invalid_object_name' when coalesce(object_description, '') = '' then 'invalid_object_description'
when coalesce(object_source, '') = '' then 'invalid_object_source' when coalesce(object_profile, '') = '' then 'invalid_object_profile' when not coalesce(json_valid(payload) and json_type(payload) = 'OBJECT', false) then 'invalid_payload' when octet_length(encode(payload)) > 4096 then 'payload_too_large' end as problem from facts
union all select 'relatives', case when coalesce(relative_id, '') = '' then 'invalid_relative_id' when coalesce(from_fact_id, '') = '' then 'invalid_from_fact_id' when coalesce(to_fact_id, '') = '' then 'invalid_to_fact_id' when coalesce(object_profile, '') = '' then 'invalid_object_profile'
when coalesce(evidence_source, '') = '' then 'invalid_evidence_source' when not coalesce(relation_kind in ('include', 'defines', 'declares', 'has_field', 'direct_call', 'assigned_to', 'dispatches_via', 'field_read', 'field_write'), false) then 'invalid_relation_kind'
when not coalesce(confidence between 0 and 1, false) then 'invalid_confidence' when condition is not null and not coalesce(condition.kind in ('branch', 'case', 'loop_guard', 'compile_guard', 'unknown'), false) then 'invalid_condition'
when octet_length(encode(payload)) > 2048 then 'payload_too_large' end from relatives) select "table", problem, count(*) as n from p where problem is not null group by all""")
def invalid_rows(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows that break a rule of the model, counted by rule."""
    f = table(spark, d, "facts").select(F.lit("facts").alias("table"), fact_problem().alias("problem"))
    r = table(spark, d, "relatives").select(F.lit("relatives").alias("table"), relative_problem().alias("problem"))
    return f.unionByName(r).where("problem is not null").groupBy("table", "problem").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {VIEW}, fn as (select object_id, object_name, source_path, linkage from f where kind = 'function'),
calls as (select r.relative_id as call_id, r.from_fact_id as caller_id, t.object_name as callee_name, regexp_replace(r.evidence_source, ':[0-9]+$', '') as ref from r join f t on r.to_fact_id = t.object_id where r.relation_kind = 'direct_call'),
c as (select calls.*, k.object_id is not null as known, k.source_path as csrc from calls left join fn k on calls.caller_id = k.object_id),
ex as (select c.call_id, fn.object_id, fn.linkage, fn.source_path, 'exact_source' as strategy from c join fn on fn.object_name = c.callee_name and fn.source_path = c.ref),
al as (select c.call_id, fn.object_id, fn.linkage, fn.source_path, 'unique_name' as strategy from c join fn on fn.object_name = c.callee_name where c.call_id not in (select call_id from ex)),
cand as (select * from ex union all select * from al),
ok as (select cand.call_id, count(*) as n_all, count(*) filter (not coalesce(linkage = 'internal' and csrc is not null and source_path <> csrc, false)) as n_left,
       min(object_id) filter (not coalesce(linkage = 'internal' and csrc is not null and source_path <> csrc, false)) as target, any_value(strategy) as strategy from cand join c using (call_id) group by 1)
select c.call_id, case when not c.known then 'missing_caller' when n_left = 1 then 'resolved' when n_left > 1 then 'ambiguous' when c.ref is not null or coalesce(n_left, 0) <> coalesce(n_all, 0) then 'internal_unresolved' else 'external_unresolved' end as outcome,
       case when c.known and n_left = 1 then target end as target_id, case when c.known and n_left = 1 then strategy end as strategy from c left join ok using (call_id)""")
def call_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Calls resolved by name: source first, then all; internal functions of other sources don't count."""
    v = base_view(spark, d).staged()
    names = v.facts.select(F.col("object_id").alias("to_fact_id"), F.col("object_name").alias("callee_name"))
    calls = v.relatives.where("relation_kind = 'direct_call'").join(names, "to_fact_id").select(
        F.col("relative_id").alias("call_id"), F.col("from_fact_id").alias("caller_id"), "callee_name", F.regexp_replace("evidence_source", ":[0-9]+$", "").alias("referenced_source")
    )
    functions = v.facts.where("kind = 'function'").select("object_id", "object_name", F.col("source_path").alias("canonical_source"), "linkage")
    return ingest.resolve_calls(stage(calls, "calls"), functions).select("call_id", "outcome", "target_id", "strategy")


# --- censuses and includes -----------------------------------------------------------------------

INV = "inv as (select rel_path as path, max((size_bytes, mtime_ns, sha256))[1] as size, max((size_bytes, mtime_ns, sha256))[2] as mtime_ns, max((size_bytes, mtime_ns, sha256))[3] as sha256, any_value(source_kind) as source_kind from source_inventory where rel_path is not null group by 1)"


def _census(spark, d) -> DataFrame:
    return table(spark, d, "source_inventory").select(F.col("rel_path").alias("path"), F.col("size_bytes").alias("size"), "mtime_ns", "sha256", "source_kind")


@query(f"""with {INV}, now as (select path, size, mtime_ns, case when source_kind = 'header' then 'x' || sha256 else sha256 end as sha256 from inv where size > 1500 union all select 'new/' || path, size, mtime_ns, sha256 from inv where size > 3500)
select coalesce(o.path, n.path) as path, case when o.path is null then 'new' when n.path is null then 'deleted' else 'changed' end as status from inv o full join now n on o.path = n.path where o.path is null or n.path is null or o.sha256 is distinct from n.sha256 and n.sha256 is not null""")
def census_diff(spark: SparkSession, d: str) -> DataFrame:
    """The inventory against a changed copy of itself: small files gone, headers rewritten, large files added."""
    old = _census(spark, d)
    sha = F.when(F.col("source_kind") == "header", F.concat(F.lit("x"), F.col("sha256"))).otherwise(F.col("sha256"))
    new = old.where("size > 1500").withColumn("sha256", sha).unionByName(old.where("size > 3500").withColumn("path", F.concat(F.lit("new/"), "path")))
    return census.census_diff(old, new)


@query("""with inv as (select rel_path, any_value(source_kind) as source_kind, any_value(included_by) as included_by from source_inventory where rel_path is not null group by 1),
h as (select rel_path as header, unnest(included_by) as source from inv where source_kind = 'header'), hit as (select h.* from h join inv on inv.rel_path = h.source), fan as (select header, count(*) as fanout from hit group by 1),
a as (select source, case when source = header then 0 else 4 end as rank, fanout from hit join fan using (header) union all select rel_path, 0, 1 from inv where source_kind = 'header' and rel_path not in (select header from hit))
select source as rel_path, case when min((rank, fanout))[1] = 0 then 'content_changed' else 'included_header_changed' end as reason, min((rank, fanout))[2]::bigint as fanout from a group by 1""")
def header_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Sources made dirty if every header changed. In this data paths stand for ids."""
    inv = table(spark, d, "source_inventory").where("rel_path is not null").dropDuplicates(["rel_path"]).withColumn("source_id", F.col("rel_path"))
    return census.dirty_sources(inv.where("source_kind = 'header'"), inv).select("rel_path", "reason", "fanout")


@query("""with recursive p as (select distinct rel_path as src, unnest(includes) as dst from source_inventory), s as (select distinct rel_path as path from source_inventory where source_kind = 'c_source' and rel_path is not null),
w as (select path, 0 as hop from s union select p.dst, w.hop + 1 from w join p on p.src = w.path where w.hop < 64 and p.dst not in (select path from s)), l as (select path, min(hop)::int as hop from w group by 1) select * from l""")
def include_closure(spark: SparkSession, d: str) -> DataFrame:
    """Files reached over includes from all C sources, with hops."""
    inv = table(spark, d, "source_inventory")
    pairs = inv.select(F.col("rel_path").alias("src"), F.explode("includes").alias("dst")).distinct()
    return census.include_closure(stage(pairs, "pairs"), inv.where("source_kind = 'c_source'").select(F.col("rel_path").alias("path")))


@query("with l as (select distinct source_kind, rel_path || chr(0) || coalesce(sha256, '') || chr(0) as line from source_inventory where rel_path is not null) select source_kind, sha256(string_agg(line, '' order by line)) as digest, count(*) as n_files from l group by 1")
def content_digest(spark: SparkSession, d: str) -> DataFrame:
    """One digest per kind of source, over path and digest of its files."""
    rows = table(spark, d, "source_inventory").select("source_kind", "rel_path", "sha256").distinct()
    return census.flat_digest(rows, ["source_kind"], "rel_path")


# --- logs (from the event table) -----------------------------------------------------------------

LOG = """l as (select event_id as pos, event_type as event_name, case when event_type = 'error' then 'error' else 'ok' end as status, case when event_type = 'error' then 'E' || ((props->>'$.k')::int % 5) end as error_code,
 value as duration_ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as "timestamp", props from events)"""


def _log(spark, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    bad = F.col("event_type") == "error"
    return table(spark, d, "events").select(
        F.col("event_id").alias("pos"), F.col("event_type").alias("event_name"), F.when(bad, "error").otherwise("ok").alias("status"), F.when(bad, F.concat(F.lit("E"), (k % 5).cast("string"))).alias("error_code"),
        F.col("value").alias("duration_ms"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.from_json("props", "map<string,bigint>").alias("counts"),
    )


@query(f"with {LOG} select event_name, count(*) as n from l where event_name <> '' group by 1")
def log_summary_by_name(spark: SparkSession, d: str) -> DataFrame:
    return logs.count_by(_log(spark, d), "event_name")


@query(f"with {LOG} select error_code, count(*) as n from l where error_code <> '' group by 1")
def log_summary_by_error(spark: SparkSession, d: str) -> DataFrame:
    return logs.count_by(_log(spark, d), "error_code")


@query(f"with {LOG} select count(*) as total_events, round(sum(duration_ms), 2) as duration_ms_total, max(\"timestamp\") as latest_event_at, arg_max(error_code, (\"timestamp\", pos)) filter (error_code is not null) as latest_error_code from l")
def log_latest_error(spark: SparkSession, d: str) -> DataFrame:
    return logs.summary_totals(_log(spark, d), ["pos"]).withColumn("duration_ms_total", F.round("duration_ms_total", 2))


@query(f"with {LOG} select pos, event_name from l where \"timestamp\" between '2024-01-10T00:00:00.000000Z' and '2024-01-20T23:59:59.999999Z'")
def log_time_window(spark: SparkSession, d: str) -> DataFrame:
    """Events between two inclusive bounds, as texts."""
    return _log(spark, d).where(logs.in_window(F.col("timestamp"), "2024-01-10T00:00:00.000000Z", "2024-01-20T23:59:59.999999Z")).select("pos", "event_name")


@query("with k as (select unnest(json_keys(props)) as key, props from events) select key, sum((props->>('$.' || key))::bigint)::bigint as total from k group by 1")
def log_counts_sum(spark: SparkSession, d: str) -> DataFrame:
    return logs.sum_counts(_log(spark, d))


# --- runs (from the order tables) ----------------------------------------------------------------

TESTS = "t as (select l_orderkey as run_id, l_linenumber as pos, 's' || (l_suppkey % 7) as suite, 't' || (l_partkey % 5) as name, case l_returnflag when 'R' then 'failed' when 'A' then 'passed' else 'skipped' end as status from lineitem)"
TALLY = "runs as (select o_orderkey as run_id from orders), n as (select run_id, count(*) filter (status = 'passed') as passed, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'skipped') as skipped, arg_min(suite || '.' || name, (pos, suite || '.' || name)) filter (status = 'failed') as first_failure from t group by 1)"


def _tests(spark, d) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "passed").otherwise("skipped")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")).alias("suite"), F.concat(F.lit("t"), (F.col("l_partkey") % 5).cast("string")).alias("name"), status.alias("status")
    )


def _tallies(spark, d) -> DataFrame:
    return runs.run_tallies(_tests(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id")))


@query(f"""with {TESTS}, {TALLY} select run_id, coalesce(passed, 0) as passed, coalesce(failed, 0) as failed, coalesce(skipped, 0) as skipped, first_failure,
case when n.run_id is null then 'errored' when failed > 0 then 'failed' else 'passed' end as overall, case when n.run_id is null then 'no_tests_ran' end as failure from runs left join n using (run_id)""")
def run_tallies(spark: SparkSession, d: str) -> DataFrame:
    """Tallies of every run; a run without tests is errored."""
    return _tallies(spark, d)


@query(f"with {TESTS} select run_id, pos, (row_number() over (partition by run_id, suite, name order by pos))::int as occurrence from t")
def occurrence_numbers(spark: SparkSession, d: str) -> DataFrame:
    return runs.occurrences(_tests(spark, d)).select("run_id", "pos", "occurrence")


DECLARED = "decl as (select p_brand as suite, p_name || p_partkey as name, case when p_size > 45 then 'extra/' else 'tests/' end || p_type || '.cc' as file, p_size as line from part), built as (select p_brand as suite, p_name || p_partkey as name, 'fact:' || p_partkey as fact_id from part where p_retailprice > 1500)"


def _declared(spark, d) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    name = F.concat("p_name", F.col("p_partkey").cast("string")).alias("name")
    file = F.concat(F.when(F.col("p_size") > 45, "extra/").otherwise("tests/"), "p_type", F.lit(".cc")).alias("file")
    return p.select(F.col("p_brand").alias("suite"), name, file, F.col("p_size").alias("line")), p.where("p_retailprice > 1500").select(F.col("p_brand").alias("suite"), name, file, F.concat(F.lit("fact:"), F.col("p_partkey").cast("string")).alias("fact_id"))


@query(f"""with {DECLARED}, j as (select d.*, b.name is not null as hit from decl d left join built b using (suite, name) where not starts_with(file, 'extra/'))
select count(distinct file) as declared, count(distinct file) filter (hit) as built, count(*) as declared_tests, count(*) filter (hit) as built_tests, round_even(count(distinct file) filter (hit) / count(distinct file), 4) as ratio from j""")
def coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Declared and built test files of the project."""
    return runs.coverage(*_declared(spark, d))


@query(f"""with {DECLARED}, dd as (select * from decl where line >= 10) select coalesce(d.suite, b.suite) as suite, coalesce(d.name, b.name) as name, d.file is not null as is_declared, b.fact_id is not null as is_built, b.fact_id from dd d full join built b on d.suite = b.suite and d.name = b.name""")
def discovery_union(spark: SparkSession, d: str) -> DataFrame:
    """Declared and built tests, outer joined."""
    declared, built = _declared(spark, d)
    return runs.union_tests(declared.where("line >= 10"), built).select("suite", "name", "is_declared", "is_built", "fact_id")


@query(f"with {TESTS}, known as (select distinct suite, name from t where suite <> 's3') select run_id, pos, suite, name, (row_number() over (partition by run_id order by pos, suite, name))::int as place from t join known using (suite, name) where status = 'failed' qualify place <= 4")
def guidance_top4(spark: SparkSession, d: str) -> DataFrame:
    """The first four known failed tests of every run."""
    t = _tests(spark, d)
    return runs.guidance(t, t.where("suite <> 's3'").select("suite", "name").distinct()).select("run_id", "pos", "suite", "name", "place")


@query("select e.event_id as event_pos, case when e.value > 100 then e.event_type else c.c_name end as task_id, e.user_id as run_id, c.c_mktsegment as overall, 'completed' as state from events e join customer c on e.user_id = c.c_custkey")
def journal_report(spark: SparkSession, d: str) -> DataFrame:
    """Journal events with the runs they name."""
    events = table(spark, d, "events").select(F.col("event_id").alias("event_pos"), F.col("user_id").alias("run_id"), F.when(F.col("value") > 100, F.col("event_type")).alias("task"), F.lit("").alias("task_id"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_name").alias("task_id"), F.col("c_mktsegment").alias("overall"), F.lit("completed").alias("state"))
    return runs.report(events, rows)


@query("select user_id, median(value) filter (event_type <> 'error') as median_s, min(value) filter (event_type <> 'error') as min_s, max(value) filter (event_type <> 'error') as max_s, count(*) filter (event_type <> 'error') as n_ok, count(*) as n_runs from events group by 1")
def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Median, least and largest time of the good runs of each user."""
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"), F.col("value").alias("wall_seconds"))
    return runs.timing_summary(e, ["user_id"])


# --- verdicts ------------------------------------------------------------------------------------


@query(f"with {TESTS}, {TALLY} select run_id, coalesce(n.run_id is not null and failed <= 2 and passed >= 1, false) as ok from runs left join n using (run_id)")
def clause_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Runs against an expectation of three clauses."""
    clauses = verdict.run_clauses({"overall": {"one_of": ["passed", "failed"]}, "max_failed": 2, "min_passed": 1})
    return verdict.with_verdict(_tallies(spark, d), clauses).select("run_id", "ok")


@query("""select object_id, ingested_at, coalesce(json_type(payload, '$.linkage') = 'VARCHAR' and payload->>'$.linkage' = 'internal', false) as eq_ok, coalesce(json_type(payload, '$.rank') in ('UBIGINT', 'BIGINT', 'DOUBLE') and (payload->>'$.rank')::double >= 5, false) as ge_ok,
coalesce(json_exists(payload, '$.owner_name'), false) as exists_ok from facts""")
def json_path_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Clauses on paths of fact payloads; missing paths and other kinds are false."""
    p = F.col("payload")
    return table(spark, d, "facts").select("object_id", "ingested_at", verdict.path_clause(p, "linkage", "eq", "internal").alias("eq_ok"), verdict.path_clause(p, "rank", "ge", 5).alias("ge_ok"), verdict.path_clause(p, "owner_name", "exists").alias("exists_ok"))


@query("select l_orderkey as round, count(*) filter (l_returnflag = 'N') as n_open, count(*) filter (l_returnflag = 'R') as n_fail, count(*) as n_tasks, case when count(*) filter (l_returnflag = 'N') > 0 then 'incomplete' when count(*) filter (l_returnflag = 'R') > 0 then 'failure' else 'success' end as outcome from lineitem group by 1")
def round_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of every round of tasks."""
    flag = F.col("l_returnflag")
    tasks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("round"), F.when(flag == "N", "open").when(flag == "R", "fail").otherwise("pass").alias("status"))
    return verdict.round_verdicts(tasks, ["round"])


@query("with m as (select o_custkey as match_id, o_orderkey as step, o_orderstatus, l_linenumber as id, l_returnflag as status from orders join lineitem on o_orderkey = l_orderkey) select match_id, step, o_orderstatus = 'O' as is_current, id, status from m")
def task_list_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Nested match documents back to a flat list of tasks."""
    tasks = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("status"))).alias("tasks"))
    rounds = table(spark, d, "orders").join(tasks, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("match_id"), "o_orderstatus", F.struct(F.lit(1).alias("round"), F.col("o_orderkey").alias("step"), "tasks").alias("r"))
    docs = rounds.groupBy("match_id").agg(F.collect_list(F.when(F.col("o_orderstatus") != "O", F.col("r"))).alias("history"), F.collect_list(F.when(F.col("o_orderstatus") == "O", F.col("r"))).alias("open"))
    many = docs.select("match_id", "history", F.explode_outer("open").alias("current"), F.monotonically_increasing_id().alias("_d"), F.col("open").alias("_o"))
    first = many.withColumn("history", F.when(F.col("current").isNull() | (F.col("current") == F.try_element_at("_o", F.lit(1))), F.col("history")).otherwise(F.array().cast(docs.schema["history"].dataType)))
    return runs.task_list(first.select("match_id", "history", "current")).select("match_id", "step", "is_current", "id", "status")


# --- static scan, payload shaping ----------------------------------------------------------------


@query()
def source_shape(spark: SparkSession, d: str) -> DataFrame:
    """Loops, functions, guarded lines and declared tests of every source text."""
    files = table(spark, d, "documents").where("kind = 'source_file'").select(F.col("doc_id").cast("string").alias("path"), "text")
    return perfscan.source_shape(files)


@query("""with s as (select o_custkey, o_orderkey as start, floor(o_orderkey + o_totalprice / 20)::bigint as "end" from orders)
select s.o_custkey, s.start, s."end", (select count(*) from s o where o.o_custkey = s.o_custkey and o.start < s.start and s."end" <= o."end")::int as depth from s""")
def loop_containment(spark: SparkSession, d: str) -> DataFrame:
    """How many spans of the same group contain each span."""
    spans = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("start"), F.floor(F.col("o_orderkey") + F.col("o_totalprice") / 20).cast("bigint").alias("end"))
    return perfscan.containment_depth(spans, ["o_custkey"])


@query(f"""with {VIEW} select object_id, case when length(object_description) > 40 then substring(object_description, 1, 40) || '...[TRUNCATED]' else object_description end as description, payload->>'$.fact_kind' as kind_shown,
case when length(typ) > 4 then substring(typ, 1, 4) || '...[TRUNCATED]' else typ end as type_shown, least(len(json_keys(payload)), 4)::int as n_fields from f""")
def bounded_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payload previews of all facts: the first four fields by name with 4 characters each; the kind is asked with 128."""
    v = base_view(spark, d).facts
    short, kind = bounded_payload(F.col("payload"), fields=4, chars=4), bounded_payload(F.col("payload"))
    rows = v.select("object_id", truncated_text(F.col("object_description"), 40).alias("description"), short.alias("s"), kind.alias("k"), bounded_payload(F.to_json(F.struct(F.col("type_name").alias("t"))), chars=4).alias("t"))
    at = lambda c, k: F.get_json_object(c, k)
    return rows.select("object_id", "description", at("k.preview", "$.fact_kind").alias("kind_shown"), at("t.preview", "$.t").alias("type_shown"), F.json_object_keys("s.preview").alias("_k")).select("object_id", "description", "kind_shown", "type_shown", F.size("_k").alias("n_fields"))


@query("""select event_id, case when props is not null then '{"k":"[REDACTED]"}' end as props from events""")
def redacted_props(spark: SparkSession, d: str) -> DataFrame:
    """Event properties with the values of secret keys hidden."""
    return table(spark, d, "events").select("event_id", redacted(F.col("props"), ["(?i)^k$"]).alias("props"))


# --- streams (drained at once) -------------------------------------------------------------------


@query("""with o as (select object_id as path, payload_sha256 as sha256, epoch_us(delivered_at) as seq from fact_snapshots where object_id is not null and payload_sha256 is not null),
p as (select *, lag(sha256) over (partition by path order by seq) as previous from o) select path, sha256, previous, seq from p where previous is not null and previous <> sha256""")
def change_feed(spark: SparkSession, d: str) -> DataFrame:
    """Changes of digests per fact over all deliveries: the batch twin of the change stream."""
    from factloom.streaming import feeds

    o = table(spark, d, "fact_snapshots").select(F.col("object_id").alias("path"), F.col("payload_sha256").alias("sha256"), F.unix_micros(F.col("delivered_at").cast("timestamp")).alias("seq"))
    return feeds.batch_changes(o)
