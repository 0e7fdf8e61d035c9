"""Queries of the general data-preparation problems 1 to 5, over the code-fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import balanced, frequency, hierarchy, orphans, snapshot_diff
from factloom.scratch import stage
from factloom.session import table

#: Kinds of relatives whose `from` is the parent of their `to`.
PARENT_KINDS = ["include", "defines", "has_field"]
#: A fact is heavy if it holds at least this share of the relatives.
HEAVY_SHARE = 0.015


# --- problem 1 -----------------------------------------------------------------------------------


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    facts, patches = table(spark, d, "facts"), table(spark, d, "fact_patches")
    changes = facts.select("object_id", F.col("ingested_at").alias("at"), F.lit(False).alias("dead")).unionByName(
        patches.select("object_id", F.col("patched_at").alias("at"), (F.col("action") == "tombstone").alias("dead"))
    )
    return orphans.find_orphans(
        table(spark, d, "relatives"), changes, child_id="relative_id", ref_fields=["from_fact_id", "to_fact_id"], arrived_at="ingested_at",
        parent_id="object_id", changed_at="at", deleted="dead", eternal=table(spark, d, "system_facts").select("object_id"),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Broken endpoints of relatives, with reason and month."""
    return _orphans(spark, d).select("relative_id", "ref_field", "reason", F.date_format("ingested_at", "yyyy-MM").alias("period"))


def p1_orphans_by_period(spark: SparkSession, d: str) -> DataFrame:
    """Broken endpoints counted per referring field, reason and month."""
    return orphans.count_orphans(_orphans(spark, d), "ingested_at")


_P1_BROKEN = """
refs0 as (select relative_id, from_fact_id, to_fact_id, min(ingested_at) as r from relatives group by all),
refs as (select relative_id, 'from_fact_id' as ref_field, from_fact_id as id, r from refs0 where from_fact_id is not null
         union all select relative_id, 'to_fact_id', to_fact_id, r from refs0 where to_fact_id is not null),
ch as (select object_id as id, ingested_at as t, 0 as dead from facts where object_id is not null
       union all select object_id, patched_at, case when action = 'tombstone' then 1 else 0 end from fact_patches where object_id is not null),
ids as (select distinct id from ch),
judged as (select q.relative_id, q.ref_field, q.id, q.r, any_value(k.id) as known, max(c.t) as last_t, arg_max(c.dead, (c.t, c.dead)) as dead
           from refs q left join ids k on q.id = k.id left join ch c on q.id = c.id and c.t <= q.r
           where q.id not in (select object_id from system_facts) group by all),
broken as (select relative_id, ref_field, id, r, case when known is null then 'missing' when last_t is null then 'late' else 'deleted' end as reason
           from judged where known is null or last_t is null or dead = 1)
"""

P1_FOUND_SQL = f"with {_P1_BROKEN} select relative_id, ref_field, reason, strftime(r, '%Y-%m') as period from broken"
P1_COUNT_SQL = f"with {_P1_BROKEN} select ref_field, reason, strftime(r, '%Y-%m') as period, count(*) as n_references, count(distinct id) as n_missing_ids from broken group by 1, 2, 3"


# --- problem 2 -----------------------------------------------------------------------------------


_P2_NAMES = dict(group="store_name", snapshot="snapshot_id", key="object_id", value="payload", published_at="created_at", delivered_at="delivered_at")


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff.diff_snapshots(table(spark, d, "fact_snapshots"), table(spark, d, "storage_manifest"), **_P2_NAMES)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Facts added, removed or changed between successive published snapshots."""
    return _diff(spark, d).select(F.col("snap").alias("snapshot_id"), F.col("key").alias("object_id"), "change")


def p2_found_continued(spark: SparkSession, d: str) -> DataFrame:
    """`p2_found` in a second call, with the ordinals of a first one that knew all snapshots but the last of each store."""
    rows, manifest = table(spark, d, "fact_snapshots"), table(spark, d, "storage_manifest")
    pairs = snapshot_diff.successive(manifest, group="store_name", snapshot="snapshot_id", published_at="created_at")
    earlier = manifest.join(pairs.select(F.col("grp").alias("store_name"), F.col("prev").alias("snapshot_id")), ["store_name", "snapshot_id"], "left_semi")
    _, known = snapshot_diff.diff_with_ordinals(rows, earlier, **_P2_NAMES)
    found, _ = snapshot_diff.diff_with_ordinals(rows, manifest, known=known, **_P2_NAMES)
    return found.select(F.col("snap").alias("snapshot_id"), F.col("key").alias("object_id"), "change")


def p2_changes_by_store(spark: SparkSession, d: str) -> DataFrame:
    """Differences counted per store, snapshot and kind of change."""
    return _diff(spark, d).groupBy(F.col("grp").alias("store_name"), F.col("snap").alias("snapshot_id"), "change").agg(F.count(F.lit(1)).alias("n_facts"))


# Two payloads are equal as JSON values if the leaves of their trees are.
_P2_DIFF = r"""
with pub as (select store_name, snapshot_id, min(created_at) as published from storage_manifest where store_name is not null and snapshot_id is not null group by 1, 2),
pairs as (select store_name, snapshot_id, lag(snapshot_id) over (partition by store_name order by published, snapshot_id) as prev from pub),
texts as (select distinct payload from fact_snapshots where payload is not null),
leaves as (select t.payload, j.fullkey, case when j.type in ('UBIGINT', 'BIGINT', 'DOUBLE') then 'n' || (j.atom::varchar)::double else j.type || coalesce(j.atom::varchar, '') end as v from texts t, json_tree(t.payload) j),
canon as (select payload, string_agg(fullkey || '=' || v, chr(1) order by fullkey) as c from leaves group by 1),
full_ as (select f.snapshot_id, f.object_id, arg_max(c.c, f.delivered_at) as c from fact_snapshots f left join canon c using (payload) where f.object_id is not null group by 1, 2),
now_ as (select p.store_name, p.snapshot_id, f.object_id, f.c from pairs p join full_ f on f.snapshot_id = p.snapshot_id where p.prev is not null),
was as (select p.store_name, p.snapshot_id, f.object_id, f.c from pairs p join full_ f on f.snapshot_id = p.prev),
diff as (select coalesce(n.store_name, w.store_name) as store_name, coalesce(n.snapshot_id, w.snapshot_id) as snapshot_id, coalesce(n.object_id, w.object_id) as object_id,
  case when w.object_id is null then 'added' when n.object_id is null then 'removed' when n.c is distinct from w.c then 'changed' end as change
  from now_ n full join was w on n.store_name = w.store_name and n.snapshot_id = w.snapshot_id and n.object_id = w.object_id)
"""
P2_FOUND_SQL = _P2_DIFF + "select snapshot_id, object_id, change from diff where change is not null"
P2_COUNT_SQL = _P2_DIFF + "select store_name, snapshot_id, change, count(*) as n_facts from diff where change is not null group by 1, 2, 3"


# --- problem 3 -----------------------------------------------------------------------------------


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    # Staged, since a sort by range reads its input twice: for the borders, then for the rows.
    rows = stage(frequency.first_rows(table(spark, d, "facts"), "object_id", ["fact_kind", "object_name", "object_source"], "ingested_at"), "facts")
    return frequency.term_frequency(frequency.fact_terms(rows))


def p3_term_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences, facts and mark of every kind, name word and source path."""
    n = table(spark, d, "facts").select("object_id").dropna().distinct().count()
    return frequency.mark_terms(_frequencies(spark, d), n)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The terms that are too rare or too common."""
    return p3_term_frequency(spark, d).where("mark is not null").select("field", "term", "mark")


_P3_TERMS = r"""
one as (select object_id, arg_min((fact_kind, object_name, object_source), ingested_at) as x from facts where object_id is not null group by object_id),
rows as (select object_id, x[1] as fact_kind, x[2] as object_name, x[3] as object_source from one),
terms as (
  select 'fact_kind' as field, lower(regexp_replace(fact_kind, '^\s+|\s+$', '', 'g')) as term, object_id from rows
  union all select 'object_name', lower(unnest(regexp_extract_all(object_name, '[A-Za-z0-9]+'))), object_id from rows
  union all select 'object_source', regexp_replace(regexp_replace(object_source, '^\s+|\s+$', '', 'g'), ':[0-9]+$', ''), object_id from rows),
freq as (select field, term, count(*) as n_occurrences, count(distinct object_id) as n_records from terms where term is not null group by 1, 2),
marked as (select *, case when n_records <= 2 then 'rare' when n_records >= 0.05 * (select count(*) from one) then 'common' end as mark from freq)
"""
P3_FREQ_SQL = f"with {_P3_TERMS} select field, term, n_occurrences, n_records, mark from marked"
P3_FOUND_SQL = f"with {_P3_TERMS} select field, term, mark from marked where mark is not null"


# --- problem 4 -----------------------------------------------------------------------------------


def p4_per_fact(spark: SparkSession, d: str) -> DataFrame:
    """Relatives, conditions and files per fact, side and kind."""
    out = balanced.per_key(balanced.edge_ends(table(spark, d, "relatives")))
    return out.select("side", F.col("key").alias("fact_id"), F.col("kind").alias("relation_kind"), F.col("n").alias("n_relatives"), F.col("n_flagged").alias("n_conditional"), F.col("n_items").alias("n_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The facts that hold at least 1.5 % of all relatives."""
    rows = table(spark, d, "relatives")
    return balanced.heavy_keys(balanced.per_key(balanced.edge_ends(rows)), rows.count(), HEAVY_SHARE).select("side", F.col("key").alias("fact_id"))


P4_PER_FACT_SQL = r"""
with ends as (select 'from' as side, from_fact_id as fact_id, * from relatives union all select 'to', to_fact_id, * from relatives)
select side, fact_id, relation_kind, count(*) as n_relatives, count(*) filter (condition is not null) as n_conditional,
       count(distinct regexp_replace(evidence_source, ':[0-9]+$', '')) as n_files
from ends where fact_id is not null group by 1, 2, 3
"""
P4_FOUND_SQL = """
with ends as (select 'from' as side, from_fact_id as fact_id from relatives union all select 'to', to_fact_id from relatives)
select side, fact_id from ends where fact_id is not null group by 1, 2 having count(*) >= 0.015 * (select count(*) from relatives)
"""


# --- problem 5 -----------------------------------------------------------------------------------


def _tree(spark: SparkSession, d: str, core_rows: int = hierarchy.CORE_ROWS) -> DataFrame:
    links = table(spark, d, "relatives").where(F.col("relation_kind").isin(PARENT_KINDS)).select("from_fact_id", "to_fact_id")
    return hierarchy.build_hierarchy(links, parent="from_fact_id", child="to_fact_id", core_rows=core_rows)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every fact that is a parent or child; -1 on a circle, -2 below one."""
    return _tree(spark, d).select(F.col("id").alias("fact_id"), "root_id", "depth")


def p5_distributed(spark: SparkSession, d: str) -> DataFrame:
    """`p5_found` with so small a base case that circles and tours are worked out over the cluster at any size."""
    return _tree(spark, d, 200).select(F.col("id").alias("fact_id"), "root_id", "depth")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path from the root, and number of descendants, of every fact on a tree."""
    tree = stage(_tree(spark, d), "tree")
    out = hierarchy.count_descendants(hierarchy.with_paths(tree))
    return out.select(F.col("id").alias("fact_id"), F.array_join("path", ">").alias("path"), "n_descendants")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every fact on a tree with each fact below it, from the intervals of the tour."""
    out = hierarchy.all_descendants(stage(_tree(spark, d), "tree"))
    return out.select(F.col("ancestor_id").alias("fact_id"), F.col("id").alias("descendant_id"))


_P5_TREE = """
with recursive e as (select distinct from_fact_id as p, to_fact_id as c from relatives
  where relation_kind in ('include', 'defines', 'has_field') and from_fact_id is not null and to_fact_id is not null),
ids as (select p as id from e union select c from e),
tree as (select id, id as root_id, 0 as depth, id as path from ids where id not in (select c from e)
  union all select e.c, t.root_id, t.depth + 1, t.path || '>' || e.c from tree t join e on e.p = t.id),
up as (select c as id, p as anc from e where c not in (select id from tree) union select up.id, e.p from up join e on e.c = up.anc)
"""
P5_FOUND_SQL = _P5_TREE + """
select id as fact_id, root_id, depth from tree
union all select id, '', case when exists (select 1 from up where up.id = i.id and up.anc = i.id) then -1 else -2 end from ids i where id not in (select id from tree)
"""
P5_PATHS_SQL = _P5_TREE + """
, below as (select a as id, count(*) - 1 as n from (select unnest(string_split(path, '>')) as a from tree) group by 1)
select i.id as fact_id, t.path, b.n as n_descendants from ids i left join tree t on i.id = t.id left join below b on b.id = i.id
"""
P5_DESCENDANTS_SQL = _P5_TREE + """
, pairs as (select unnest(string_split(path, '>')) as fact_id, id as descendant_id from tree) select * from pairs where fact_id <> descendant_id
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_orphans_by_period, p2_found, p2_changes_by_store, p2_found_continued, p3_found, p3_term_frequency, p4_found, p4_per_fact, p5_found, p5_distributed, p5_paths, p5_descendants)}

SQL = {
    "p1_found": P1_FOUND_SQL,
    "p1_orphans_by_period": P1_COUNT_SQL,
    "p2_found": P2_FOUND_SQL,
    "p2_changes_by_store": P2_COUNT_SQL,
    "p2_found_continued": P2_FOUND_SQL,
    "p3_found": P3_FOUND_SQL,
    "p3_term_frequency": P3_FREQ_SQL,
    "p4_found": P4_FOUND_SQL,
    "p4_per_fact": P4_PER_FACT_SQL,
    "p5_found": P5_FOUND_SQL,
    "p5_distributed": P5_FOUND_SQL,
    "p5_paths": P5_PATHS_SQL,
    "p5_descendants": P5_DESCENDANTS_SQL,
}
