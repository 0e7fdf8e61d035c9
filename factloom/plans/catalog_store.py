"""Queries over published stores, overlays, censuses and details, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.jsonops import counts_of, subset_of
from factloom.functions.paths import line_at, snippet
from factloom.operators import census, detail, graph, ingest, overlay, search
from factloom.plans.catalog import CALLS, OVER, PREVIEW, VIEW, _busiest, _busiest_sql, _graph, _one_hop_sql, query
from factloom.plans.model import View, base_view, inventory_problem
from factloom.scratch import dense_ordinals, numbered, scratch_root, stage, with_positions
from factloom.session import table
from factloom.sources import library, scans
from factloom.sources.store import Store, export_lines
from factloom.streaming.incremental import Refresher

# --- the published store -------------------------------------------------------------------------


@query(f"with {VIEW} select object_id, object_name, kind, source_path, replace(name_cf, 'ß', 'ss') as name_cf, replace(owner_cf, 'ß', 'ss') as owner_cf from f")
def store_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts as a store was published with and as they are read back."""
    return _graph(spark, d).facts.select("object_id", "object_name", "kind", "source_path", "name_cf", "owner_cf")


@query(f"with {VIEW}, {CALLS} select relative_id, from_fact_id, to_fact_id, relation_kind, condition is not null as conditional, 2 as n_copies from vis")
def store_relatives(spark: SparkSession, d: str) -> DataFrame:
    """Relatives of a store, from both of its copies."""
    v = _graph(spark, d)
    both = v.relatives.unionByName(v.by_to).groupBy("relative_id", "from_fact_id", "to_fact_id", "relation_kind", F.col("condition").isNotNull().alias("conditional"))
    return both.agg(F.count(F.lit(1)).cast("int").alias("n_copies"))


@query("select source_id, max(struct_pack(a := rel_path, b := source_kind, c := sha256)).a as rel_path, count(*) > 0 as found, (row_number() over (order by source_id))::int as position from source_inventory where source_id is not null group by 1")
def store_inventory(spark: SparkSession, d: str) -> DataFrame:
    """The source inventory of a store in order of source id."""
    rows = library.published(spark, d).table("source_inventory").select("source_id", "rel_path", F.lit(True).alias("found"))
    return with_positions(*numbered(rows, ["source_id"], "inventory"), "position").withColumn("position", (F.col("position") + 1).cast("int"))


@query(f"""with {VIEW}, {CALLS} select (select count(*) from f) as fact_count, (select count(object_caller) from f) as with_caller, (select count(object_callee) from f) as with_callee,
(select count(*) from vis) as relative_count, (select count(condition) from vis) as conditional_relative_count, (select count(distinct source_id) from source_inventory) as source_count""")
def store_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The totals of the manifest."""
    m = library.published(spark, d).manifest()
    names = ["fact_count", "with_caller", "with_callee", "relative_count", "conditional_relative_count", "source_count"]
    return spark.createDataFrame([tuple(m[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


@query(f"""with {VIEW}, {CALLS}, b as (select *, case when regexp_matches(object_source, '^.+:[0-9]+$') then regexp_extract(object_source, '^(.+):[0-9]+$', 1) else split_part(object_source, ':', 1) end as bucket from f),
m as (select 'fact_kind' as what, kind as value from b union all select 'profile', object_profile from b union all select 'source', bucket from b)
select what, value, count(*) as n, null::bigint as n_conditional from m group by all union all select 'relation_kind', relation_kind, count(*), count(condition) from vis group by 2""")
def store_counters(spark: SparkSession, d: str) -> DataFrame:
    """The counters that a snapshot keeps: facts by kind, profile and source, relatives by kind."""
    return library.published(spark, d).table("counters")


@query(f"""with {VIEW}, {CALLS}, a as (select {_busiest_sql('function', 'direct_call', 'to_fact_id')} as id)
select relative_id, from_fact_id, to_fact_id, relation_kind, (row_number() over (order by relation_kind, from_fact_id, to_fact_id, relative_id))::int as position from vis, a where to_fact_id = id or from_fact_id = id""")
def store_edges_of_fact(spark: SparkSession, d: str) -> DataFrame:
    """All relatives of the most called function, each end read from the copy sorted by it, in order."""
    v = _graph(spark, d)
    rows = graph.relatives_of(v, _busiest(v, "function", "direct_call", "to_fact_id"))
    order = ["relation_kind", "from_fact_id", "to_fact_id", "relative_id"]
    return with_positions(*numbered(rows.select(*order), order, "edges"), "position").withColumn("position", (F.col("position") + 1).cast("int"))


@query(f"with {VIEW}, {CALLS} select 'facts' as \"table\", count(*) as n, true as sound from f union all select 'relatives', count(*), true from vis union all select 'source_inventory', count(distinct source_id), true from source_inventory")
def store_verified(spark: SparkSession, d: str) -> DataFrame:
    """The tables of a store after their digests were checked against the manifest; a table that doesn't fit raises."""
    store = library.published(spark, d)
    store.verify()
    out = None
    for name in ("facts", "relatives", "source_inventory"):
        one = store.table(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n", F.lit(True).alias("sound"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with {VIEW}, {CALLS}, rf as (select * from f where object_profile = 'release'), rr as (select * from vis where from_fact_id in (select object_id from rf) and to_fact_id in (select object_id from rf))
select 1 as place, (select count(*) from f) as fact_count, (select count(*) from vis) as relative_count, false as reused, 2 as n_snapshots
union all select 2, (select count(*) from rf), (select count(*) from rr), false, 2 union all select 3, (select count(*) from f), (select count(*) from vis), true, 2""")
def store_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Three publications into one store: all, the release profile, and all again in another order, which is there already."""
    view = library.published(spark, d).view()
    release = view.facts.where("object_profile = 'release'")
    store = Store(spark, f"{scratch_root(spark)}/history-{abs(hash(d)):x}")
    store.drop()
    told = [
        store.publish(view.facts, view.relatives),
        store.publish(release, View(release, view.relatives).connected()),
        store.publish(view.facts.orderBy(F.desc("object_id")), view.by_to),
    ]
    n = len(store.snapshots())
    return spark.createDataFrame([(k + 1, m["fact_count"], m["relative_count"], m["reused"], n) for k, m in enumerate(told)], "place int, fact_count bigint, relative_count bigint, reused boolean, n_snapshots int")


@query(f"""with {VIEW}, {OVER} select 'fact_upserts' as part, (select count(*) from up) as n, true as active, false as expired union all select 'fact_tombstones', (select count(*) from pf where x.dead), true, false
union all select 'relative_upserts', 0, true, false union all select 'relative_tombstones', (select count(*) from pr where action = 'tombstone'), true, false
union all select 'source_tombstones', (select count(*) from fact_patches where action = 'tombstone' and object_id is null and relative_id is null), true, false""")
def store_overlay(spark: SparkSession, d: str) -> DataFrame:
    """All patch lines published as an overlay over the store, and read back through its pointer; past its time to live it is not active."""
    store = library.published(spark, d)
    over = overlay.patches(table(spark, d, "fact_patches"), store.view())
    parts = ["fact_upserts", "fact_tombstones", "relative_upserts", "relative_tombstones", "source_tombstones"]
    published = store.publish_overlay({p: getattr(over, p) for p in parts})
    seen, late = store.overlay(ttl=3600), store.overlay(ttl=60, now=published["created_at"] + 61)
    tables = store.overlay_tables(published["overlay_id"])
    out = None
    for p in parts:
        one = tables[p].agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "n", F.lit(seen is not None).alias("active"), F.lit(late is not None).alias("expired"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with {VIEW}, done as (select distinct source_path from f where length(source_path) % 2 = 0 and length(source_path) % 10 > 0),
v as (select source_path from f where source_path not in (select source_path from done) union all select source_path from done) select source_path, count(*) as n_facts from v group by 1""")
def incremental_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Facts per source after a stream told of changed sources: those are extracted again, some can't be, all others stay."""
    store = library.published(spark, d)
    at = f"{scratch_root(spark)}/watch-{abs(hash(d)):x}"
    watch = Store(spark, at)
    watch.drop()
    paths = store.view().facts.select(F.col("source_path").alias("path")).distinct()
    observed = paths.select("path", F.when(F.length("path") % 2 == 0, "b").otherwise("a").alias("sha256"), F.lit(2).cast("bigint").alias("seq"))
    observed.write.mode("overwrite").parquet(f"{at}/feed")

    def extract(text: str) -> list[dict]:
        if len(text) % 10 == 0:
            raise ValueError("can't be read")
        return [{"object_id": f"new:{text}", "object_name": text, "object_description": "", "object_source": f"{text}:1", "object_profile": "debug", "payload": '{"fact_kind":"function"}'}]

    refresher = Refresher(store, lambda dirty: dirty.withColumn("text", F.col("path")), extract)
    store._fs.delete(store._path("digests"), True)
    store.drop_overlay()
    refresher.prime(paths.select("path", F.lit("a").alias("sha256"), F.lit(1).cast("bigint").alias("seq")))
    refresher.start(spark.readStream.schema(observed.schema).parquet(f"{at}/feed"), f"{at}/checkpoint").awaitTermination()
    if refresher.stop().error:
        raise RuntimeError(refresher.status.error)
    return refresher.view().facts.groupBy("source_path").agg(F.count(F.lit(1)).alias("n_facts"))


@query(f"with {VIEW} select object_id, kind as fact_kind, true as sound, 1 as schema_version from f")
def store_exported_lines(spark: SparkSession, d: str) -> DataFrame:
    """Facts written as gzip JSON lines with a digest each, scanned again and checked line by line."""
    at = f"{scratch_root(spark)}/lines-{abs(hash(d)):x}"
    facts = _graph(spark, d).facts.select("object_id", F.col("kind").alias("fact_kind"), "object_name", "object_source", "payload")
    export_lines(facts, "object_id", "fact_kind", at, mode="overwrite")
    return scans.require_sound(scans.stored_lines(spark, at)).select("object_id", "fact_kind", "sound", "schema_version")


@query(f"with {VIEW}, {OVER} select object_id, object_name from ov where contains(lower(coalesce(object_name, '')), 'route')")
def overlay_search(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the merged view whose name holds a word."""
    base = base_view(spark, d)
    return overlay.apply_overlay(base, overlay.patches(table(spark, d, "fact_patches"), base)).facts.where(F.contains("name_cf", F.lit("route"))).select("object_id", "object_name")


@query(f"""with {VIEW}, {OVER}, seen as (select arg_min({{'r': relative_id, 'a': from_fact_id, 'b': 'gone:' || to_fact_id}}, relative_id) as x from r where relation_kind = 'declares' and from_fact_id in (select object_id from ov) and to_fact_id is not null group by from_fact_id)
select 'new:' || x.r as relative_id, x.b as "end" from seen""")
def overlay_orphan_ends(spark: SparkSession, d: str) -> DataFrame:
    """Upserted relatives that point to facts which the merged view lacks: here one for each fact that declares something."""
    base = base_view(spark, d)
    over = overlay.patches(table(spark, d, "fact_patches"), base)
    merged = overlay.apply_overlay(base, over).facts
    mine = base.relatives.where("relation_kind = 'declares' and to_fact_id is not null").join(merged.select(F.col("object_id").alias("from_fact_id")), "from_fact_id", "left_semi")
    rest = [c for c in base.relatives.columns if c not in ("relative_id", "from_fact_id")]
    new = mine.groupBy("from_fact_id").agg(F.min_by(F.struct("relative_id", *rest), "relative_id").alias("x")).select("from_fact_id", "x.*")
    over.relative_upserts = new.withColumns({"relative_id": F.concat(F.lit("new:"), "relative_id"), "to_fact_id": F.concat(F.lit("gone:"), "to_fact_id")}).select(*base.relatives.columns)
    return overlay.overlay_orphans(View(merged, base.relatives), over)


# --- previews and details ------------------------------------------------------------------------


@query(f"""with {VIEW},
{PREVIEW.replace(' <= 100', ' > 0')}
select fact_id, direction, relation_kind, endpoint_id, endpoint_name, endpoint_file, instances, representative, place::int as place, bucket_total from n3 join tot using (fact_id, direction, relation_kind)""")
def relation_preview_exact(spark: SparkSession, d: str) -> DataFrame:
    """The relation preview of every fact over all of its relatives."""
    out = detail.preview(base_view(spark, d), fetch=None)
    return out.select("fact_id", "direction", "relation_kind", "endpoint_id", "endpoint_name", "endpoint_file", "instances", "representative", "place", "bucket_total")


@query(f"""with {VIEW}, {CALLS}, a as (select {_busiest_sql('function', 'direct_call', 'to_fact_id')} as id),
e as (select 'incoming' as direction, relation_kind from vis, a where to_fact_id = id union all select 'outgoing', relation_kind from vis, a where from_fact_id = id),
b as (select direction, relation_kind, count(*) as total_count from e group by all)
select unnest(['small', 'normal', 'large']) as budget, direction, relation_kind, total_count, true as fits from b""")
def detail_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The buckets of the most called function in detail, under each byte budget, which every response keeps."""
    v = _graph(spark, d)
    fact, rows = _busiest(v, "function", "direct_call", "to_fact_id"), []
    for budget, limits in detail.BUDGETS.items():
        out = detail.fact_detail(v, fact, budget)
        rows += [(budget, b["direction"], b["relation_kind"], b["total_count"], out["response_bytes"] <= limits["bytes"]) for b in out["buckets"]]
    return spark.createDataFrame(rows, "budget string, direction string, relation_kind string, total_count bigint, fits boolean")


@query(f"""with {VIEW}, {CALLS}, c as (select from_fact_id as id, count(*) as n from vis where relation_kind = 'direct_call' group by 1 order by 2 desc, 1 limit 3) select id as object_id, object_name, true as fits from c join f on object_id = id""")
def briefing_cards(spark: SparkSession, d: str) -> DataFrame:
    """Small details of the three busiest callers, all or none."""
    v = _graph(spark, d)
    top = v.relatives.where("relation_kind = 'direct_call'").groupBy("from_fact_id").count().orderBy(F.desc("count"), "from_fact_id").limit(3).collect()
    cards = detail.briefing(v, [r[0] for r in top], 64 << 10)
    return spark.createDataFrame([(c["fact"]["object_id"], c["fact"]["object_name"], c["response_bytes"] <= 8 << 10) for c in cards], "object_id string, object_name string, fits boolean")


_FILES = "files as (select rel_path as path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) as l, text from documents where rel_path is not null and text is not null)"


@query(f"""with {_FILES}, spot as (select path, l, (length(path) * 7 % len(l) + 1)::int as line from files)
select 'fact:' || path as object_id, greatest(1, line - 3)::int as start_line, least(len(l), line + 3)::int as end_line, array_to_string(l[greatest(1, line - 3):least(len(l), line + 3)], chr(10)) as lines, line > 4 or line + 3 < len(l) as truncated from spot""")
def source_windows(spark: SparkSession, d: str) -> DataFrame:
    """Lines around one place in every source file."""
    files = table(spark, d, "documents").where("rel_path is not null and text is not null").select(F.col("rel_path").alias("path"), "text")
    n = F.size(F.split(F.regexp_replace("text", r"\n\z", ""), "\n"))
    line = (F.length("path") * 7 % n + 1).cast("int")
    facts = files.select(F.concat(F.lit("fact:"), "path").alias("object_id"), F.col("path").alias("source_path"), F.concat("path", F.lit(":"), line.cast("string")).alias("object_source"))
    return detail.source_windows(facts, files, 3).select("object_id", "start_line", "end_line", F.array_join("lines", "\n").alias("lines"), "truncated")


@query(f"""with {_FILES}, spot as (select path, l, text, strpos(text, '(') as o from files)
select path, (len(substring(text, 1, o - 1)) - len(replace(substring(text, 1, o - 1), chr(10), '')) + 1)::int as line, substring(trim(l[(len(substring(text, 1, o - 1)) - len(replace(substring(text, 1, o - 1), chr(10), '')) + 1)::int], ' '), 1, 240) as snippet from spot where o > 0""")
def snippets_at_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Line and trimmed text of the first parenthesis of every source file."""
    files = table(spark, d, "documents").where("rel_path is not null and text is not null").select(F.col("rel_path").alias("path"), "text", (F.instr("text", "(") - 1).alias("o")).where("o >= 0")
    return files.withColumn("line", line_at(F.col("text"), F.col("o"))).select("path", "line", snippet(F.col("text"), F.col("line")).alias("snippet"))


# --- orders and pages ----------------------------------------------------------------------------


@query(_one_hop_sql("'field_read'", "field_read") + " order by hop, salience, instances desc, has_unconditional desc, object_name, source_path, object_id limit 20")
def one_hop_page(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 readers of the most read field in the order of the language, as a bounded page that tells whether more follow."""
    v = _graph(spark, d)
    hits = graph.one_hop(v, _busiest(v, "field", "field_read", "to_fact_id"), ["field_read"], "incoming")
    named = graph.with_endpoints(graph.rollup(graph.weighed(hits)), v.facts)
    rows, _ = search.page(named, graph.endpoint_order(), 20)
    return rows.select("object_id", "hop", "instances", "has_unconditional", "salience", F.size("matched").cast("bigint").alias("n_kinds"), "representative")


@query(f"with {VIEW} select unnest([10, 50, 1000000]) as \"limit\", least(unnest([10, 50, 1000000]), (select count(*) from f where kind = 'field'))::bigint as shown, (select count(*) from f where kind = 'field') > unnest([10, 50, 1000000]) as truncated")
def truncation_probe(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the fields by id: one row more than the limit is asked for and tells whether the page was cut."""
    fields, out = _graph(spark, d).facts.where("kind = 'field'").select("object_id"), []
    for limit in (10, 50, 1_000_000):
        rows, truncated = search.page(fields, ["object_id"], limit)
        out.append((limit, rows.count(), truncated))
    return spark.createDataFrame(out, "`limit` int, shown bigint, truncated boolean")


@query(f"with {VIEW} select object_id, row_number() over (order by object_id) as fact_key from f")
def surrogate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Facts numbered from 1 in order of id, without a single task for all."""
    return dense_ordinals(_graph(spark, d).facts, ["object_id"], "fact_key").withColumn("fact_key", F.col("fact_key") + 1)


@query(f"with {VIEW} select relative_id, ((row_number() over (order by relative_id)) - 1) % 7 as shard from r")
def shard_split(spark: SparkSession, d: str) -> DataFrame:
    """Relatives dealt to seven shards in turn, in order of id."""
    rows = with_positions(*numbered(base_view(spark, d).relatives.select("relative_id"), ["relative_id"], "shards"), "shard")
    return rows.select("relative_id", (F.col("shard") % 7).alias("shard"))


@query("select object_id, count(*) as n from facts group by 1 having count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of facts that were delivered more than once."""
    return ingest.duplicate_ids(table(spark, d, "facts"), "object_id")


# --- censuses ------------------------------------------------------------------------------------

_INV1 = "inv1 as (select source_id, max(struct_pack(a := rel_path, b := source_kind, c := sha256, d := size_bytes, e := mtime_ns)) as x from source_inventory where source_id is not null group by 1), inv as (select source_id, x.a as rel_path, x.b as source_kind, x.c as sha256, x.d as size_bytes, x.e as mtime_ns from inv1)"


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    """Sources by id, each once."""
    rows = table(spark, d, "source_inventory").where("source_id is not null")
    one = rows.groupBy("source_id").agg(F.max(F.struct("rel_path", "source_kind", "sha256", "size_bytes", "mtime_ns")).alias("x"))
    return one.select("source_id", "x.*")


@query(f"""with {_INV1} select source_id, rel_path, case when source_kind = 'header' then 'x' || sha256 else sha256 end as sha_now from inv
where rel_path is not null and (mtime_ns + case when size_bytes % 3 = 0 then 1 else 0 end > mtime_ns) and (case when source_kind = 'header' then 'x' || sha256 else sha256 end) is distinct from sha256""")
def changed_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose file differs now, after the cheap test of size and time: headers were rewritten, a third of all files touched."""
    inv = _inventory(spark, d)
    sha = F.when(F.col("source_kind") == "header", F.concat(F.lit("x"), "sha256")).otherwise(F.col("sha256"))
    now = inv.where("rel_path is not null").select("rel_path", F.col("size_bytes").alias("size_now"), (F.col("mtime_ns") + F.when(F.col("size_bytes") % 3 == 0, 1).otherwise(0)).alias("mtime_now"), sha.alias("sha_now"))
    return census.changed_sources(inv, now).select("source_id", "rel_path", "sha_now")


@query(f"""with {_INV1}, pinned as (select rel_path as path, sha256 from inv where rel_path is not null and sha256 is not null)
select path, sha256 as pinned, case when length(path) % 3 = 1 then upper(sha256) else '' end as "current" from pinned where length(path) % 3 > 0 and (length(path) % 3 = 2 or upper(sha256) <> sha256)""")
def frozen_violations(spark: SparkSession, d: str) -> DataFrame:
    """Pinned files whose digest differs, or that can't be read any more."""
    pinned = _inventory(spark, d).where("rel_path is not null and sha256 is not null").select(F.col("rel_path").alias("path"), "sha256")
    now = pinned.where("length(path) % 3 < 2").withColumn("sha256", F.when(F.length("path") % 3 == 1, F.upper("sha256")).otherwise(F.col("sha256")))
    return census.frozen_violations(pinned, now)


@query("""with f as (select rel_path as path, size_bytes as size from source_inventory where rel_path is not null), t as (select (sum(size) * 0.4)::bigint as most from f),
s as (select path, size, row_number() over (order by path, size) as n, sum(size) over (order by path, size rows unbounded preceding) as s from f) select path, size from s, t where n <= 2000000 and s <= most""")
def files_under_budget(spark: SparkSession, d: str) -> DataFrame:
    """The files in order of path until two fifths of all bytes are used up."""
    files = table(spark, d, "source_inventory").where("rel_path is not null").select(F.col("rel_path").alias("path"), F.col("size_bytes").alias("size"))
    most = int(files.agg(F.round(F.sum("size") * 0.4)).first()[0] or 0)
    return census.under_budget(files, 2_000_000, most).select("path", "size")


@query(r"""with f as (select distinct rel_path as path from source_inventory where rel_path is not null union select distinct 'build/' || rel_path from source_inventory where rel_path is not null union select distinct 'src/tests/' || rel_path from source_inventory where rel_path is not null)
select path from f where regexp_matches(lower(path), '\.(c|h|cc|cpp|cxx|hpp|hh|hxx)$') and not regexp_matches(path, '^(.*/)?(build|out|dist|target)/') and not list_has_any(string_split(lower(path), '/'), ['test', 'tests', 'testing', 'spec', 'specs'])""")
def c_files(spark: SparkSession, d: str) -> DataFrame:
    """C files outside of build folders and tests."""
    own = table(spark, d, "source_inventory").where("rel_path is not null").select(F.col("rel_path").alias("path")).distinct()
    more = own.select(F.explode(F.array("path", F.concat(F.lit("build/"), "path"), F.concat(F.lit("src/tests/"), "path"))).alias("path"))
    return census.c_files(more)


@query("""with p as (select distinct rel_path as src, unnest(includes) as dst from source_inventory where rel_path is not null), n as (select src as path from p union select dst from p)
select path, array_to_string(list_sort(list_distinct(coalesce((select list(src) from p where dst = path), []))), ',') as included_by, array_to_string(list_sort(list_distinct(coalesce((select list(dst) from p where src = path), []))), ',') as includes from n""")
def included_by(spark: SparkSession, d: str) -> DataFrame:
    """Includes turned round: for every file who includes it and what it includes."""
    pairs = table(spark, d, "source_inventory").where("rel_path is not null").select(F.col("rel_path").alias("src"), F.explode("includes").alias("dst")).where("dst is not null")
    return census.invert_includes(pairs).select("path", F.array_join("included_by", ",").alias("included_by"), F.array_join("includes", ",").alias("includes"))


@query("""with inv as (select rel_path, any_value(includes) as includes from source_inventory where rel_path is not null group by 1), p as (select rel_path as src, unnest(includes) as dst from inv)
select distinct src, dst from p where dst in (select rel_path from inv)""")
def scanned_includes(spark: SparkSession, d: str) -> DataFrame:
    """Includes scanned from source texts; the texts are written from the inventory, an include line each, with comments and missing files between."""
    inv = table(spark, d, "source_inventory").where("rel_path is not null").groupBy("rel_path").agg(F.any_value("includes").alias("includes"))
    line = F.transform("includes", lambda i: F.concat(F.lit('#  include "'), i, F.lit('" // in\n#include <stdio.h>\n#include "not/there.h"')))
    return census.include_pairs(inv.select(F.col("rel_path").alias("path"), F.array_join(F.coalesce(line, F.array().cast("array<string>")), "\n").alias("text")))


@query(f"""with {VIEW}, {_INV1}, dirty as (select source_id, rel_path from inv where source_kind = 'header')
select relative_id from r where source_id in (select source_id from dirty) or relative_id in (select relative_id from (select relative_id, case when regexp_matches(evidence_source, '^.+:[0-9]*[1-9][0-9]*$') then regexp_extract(evidence_source, '^(.+):[0-9]+$', 1) else evidence_source end as p from r) where p in (select rel_path from dirty))""")
def edges_of_dirty(spark: SparkSession, d: str) -> DataFrame:
    """Relatives that belong to a header, by source or by the file of their evidence."""
    dirty = _inventory(spark, d).where("source_kind = 'header'").select("source_id", "rel_path")
    return census.edges_of_dirty(base_view(spark, d).relatives, dirty).select("relative_id")


@query("""with s as (select distinct rel_path, sha256, left(rel_path, 2) as g from source_inventory where rel_path is not null),
l as (select g, sha256(sha256(rel_path || chr(0) || coalesce(sha256, '') || chr(0)) || ':1') as d from s) select g, sha256(string_agg(d, '' order by d)) as digest, count(*) as n_files from l group by 1""")
def tree_digests(spark: SparkSession, d: str) -> DataFrame:
    """One digest per group of files that never brings a group together in one row."""
    rows = table(spark, d, "source_inventory").select(F.substring("rel_path", 1, 2).alias("g"), "rel_path", "sha256").where("rel_path is not null")
    return census.content_digest(rows, ["g"], "rel_path")


@query(r"""select case when coalesce(source_id, '') = '' then 'invalid_source_id' when coalesce(rel_path, '') = '' then 'invalid_rel_path' when source_kind is null or source_kind not in ('c_source', 'header', 'other') then 'invalid_source_kind'
when sha256 is null or not regexp_matches(sha256, '^[0-9a-f]{64}$') then 'invalid_sha256' when not coalesce(size_bytes >= 0 and mtime_ns >= 0, false) then 'invalid_size' end as problem, count(*) as n from source_inventory group by 1""")
def inventory_problems(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the inventory by what is wrong with them; null for sound ones."""
    return table(spark, d, "source_inventory").groupBy(inventory_problem().alias("problem")).agg(F.count(F.lit(1)).alias("n"))


# --- JSON ----------------------------------------------------------------------------------------


@query("""select object_id, ingested_at, coalesce(case when json_type(payload, '$.line') in ('UBIGINT', 'BIGINT') then (payload->>'$.line')::bigint end, -1) as line, coalesce(case when json_type(payload, '$.rank') in ('UBIGINT', 'BIGINT') then (payload->>'$.rank')::bigint end, -1) as rank,
(json_type(payload, '$.line') in ('UBIGINT', 'BIGINT'))::int + (json_type(payload, '$.rank') in ('UBIGINT', 'BIGINT'))::int as n from facts""")
def whitelisted_counts(spark: SparkSession, d: str) -> DataFrame:
    """Integer values of the named keys of a payload; texts and other keys don't count."""
    c = counts_of(F.col("payload"), ["line", "rank", "fact_kind", "absent"])
    rows = table(spark, d, "facts").select("object_id", "ingested_at", c.alias("c"))
    return rows.select("object_id", "ingested_at", F.coalesce(F.col("c")["line"], F.lit(-1).cast("bigint")).alias("line"), F.coalesce(F.col("c")["rank"], F.lit(-1).cast("bigint")).alias("rank"), F.size("c").alias("n"))


@query("""select object_id, ingested_at, json_exists(payload, '$.fact_kind') and payload->>'$.fact_kind' = 'function' as has_kind from facts""")
def json_subset(spark: SparkSession, d: str) -> DataFrame:
    """Whether a payload holds all of a smaller document."""
    return table(spark, d, "facts").select("object_id", "ingested_at", subset_of(F.lit('{"fact_kind": "function"}'), F.col("payload")).alias("has_kind"))


@query(f"with {VIEW} select relation_kind, count(*) as n_lines, sum(octet_length(encode(coalesce(evidence_source, ''))))::bigint as n_bytes from r group by 1")
def spooled_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Lines and bytes that are spooled per kind of relative."""
    rows = base_view(spark, d).relatives.select("relation_kind", F.coalesce("evidence_source", F.lit("")).alias("line"))
    return ingest.spooled_bytes(rows, ["relation_kind"], "line")


@query("""with k as (select c_custkey, '{"census":"' || c_name || '","recipes":"' || c_mktsegment || '","spec":' || c_nationkey || ',"toolchain":"gcc"}' as doc from customer) select c_custkey, sha256(doc) as key from k""")
def memo_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of remembered results: the digest of what they depend on, keys in order."""
    rows = table(spark, d, "customer")
    return rows.select("c_custkey", ingest.content_key(spec=F.col("c_nationkey"), census=F.col("c_name"), toolchain=F.lit("gcc"), recipes=F.col("c_mktsegment")).alias("key"))
