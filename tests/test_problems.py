"""Problems 1 to 5 against brute force, with nulls, ties, repeats, skew, empty tables and clashing extra columns."""

import datetime as dt
import json
import random
from collections import Counter, defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from factloom import scratch
from factloom.functions import bitmap
from factloom.functions.canonical import canonical
from factloom.operators import balanced, frequency, hierarchy, orphans, snapshot_diff
from factloom.scratch import asof_state, dense_ordinals, numbered, skew_join, with_positions

T0 = dt.datetime(2024, 1, 1)


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


# --- building blocks -----------------------------------------------------------------------------


def test_dense_ordinals_are_exact_and_persistent(spark):
    df = spark.createDataFrame([(k,) for k in ["b", "a", None, "c", "a"]], "k string")
    first = dense_ordinals(df, ["k"])
    assert rows(first, "k", "ordinal") == [("a", 0), ("b", 1), ("c", 2)]
    again = dense_ordinals(spark.createDataFrame([("aa",), ("c",)], "k string"), ["k"], known=first)
    assert rows(again, "k", "ordinal") == [("a", 0), ("aa", 3), ("b", 1), ("c", 2)]


def test_positions_number_all_rows(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    out = with_positions(*numbered(df, ["k", "id"]), "pos")
    got = [(r["k"], r["id"]) for r in out.orderBy("pos").collect()]
    assert got == sorted(got) and sorted(r["pos"] for r in out.collect()) == list(range(1000))


def test_staged_tables_can_be_dropped(spark):
    from factloom.scratch import drop_staged, stage

    kept, gone = stage(spark.range(5)), stage(spark.range(6))
    drop_staged(gone)
    assert kept.count() == 5
    with pytest.raises(Exception):
        gone.count()


def test_skew_join_equals_plain_join(spark):
    left = spark.range(500).select(F.when(F.col("id") < 300, 1).when(F.col("id") < 450, F.col("id")).alias("k"), "id")
    right = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(skew_join(left, right, "k", ["id"], [(1, 7), (None, 3)], how)) == rows(left.join(right, "k", how))


@pytest.fixture
def plain_shuffles(spark):
    """16 partitions that stay as they are, and no broadcasts but those asked for."""
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_hot_keys_are_those_of_many_rows(spark, plain_shuffles, monkeypatch):
    """A key of half the rows, one of 0.9 % of them, and nulls: no partition of the join has more than twice the mean."""
    monkeypatch.setattr(scratch, "LEAST_PART", 100)
    n = 100_000
    key = F.when(F.col("id") < n // 2, -1).when(F.col("id") < n // 2 + n * 9 // 1000, -2).when(F.col("id") < n * 6 // 10, None).otherwise(F.col("id") % 20_000)
    left = spark.range(n).select(key.alias("k"), "id")
    right = left.select("k").distinct().dropna().withColumn("v", F.lit(1))
    hot = scratch.hot_keys(left, "k")
    assert dict(hot).keys() == {-1, None} and scratch.part_rows(n, 16) == n // 64 > n * 9 // 1000
    for how in ("inner", "left"):
        out = skew_join(left, right, "k", ["id"], hot, how).groupBy(F.spark_partition_id().alias("p")).count().collect()
        total = sum(r["count"] for r in out)
        assert total == (n if how == "left" else left.dropna().count()) and max(r["count"] for r in out) <= 2 * total / 16


def test_one_moment_of_one_id_fills_many_partitions(spark, plain_shuffles):
    ask = spark.range(200_000).select(F.lit("x").alias("id"), F.lit(at(1)).alias("t"), F.lit(None).cast("int").alias("state"), F.col("id").alias("child"))
    told = spark.createDataFrame([("x", at(0), 1, -1)], ask.schema)
    events = ask.unionByName(told)
    cut, counts = numbered(events.withColumn("_apart", F.xxhash64("child")), ["id", "t", "state", "_apart"])
    assert max(n for _, n in counts) <= 2 * 200_001 / 16
    assert asof_state(events).where("state = 1").count() == 200_000


def test_undated_changes_come_last(spark):
    child = spark.createDataFrame([("undated", "x", None), ("dated", "x", at(5)), ("new", "y", None), ("early", "y", at(5))], "c string, f string, r timestamp_ntz")
    parent = spark.createDataFrame([("x", at(1), False), ("x", None, True), ("x", None, True), ("y", None, False)], "k string, w timestamp_ntz, d boolean")
    found = orphans.find_orphans(child, parent, child_id="c", ref_fields=["f"], arrived_at="r", parent_id="k", changed_at="w", deleted="d")
    assert rows(found, "c", "reason") == [("early", "late"), ("undated", "deleted")]


@pytest.mark.parametrize("n", [0, 1, 4])
def test_ordinals_never_collide(spark, n):
    known = dense_ordinals(spark.createDataFrame([(f"k{i}",) for i in range(n)], "k string"), ["k"])
    out = dense_ordinals(spark.createDataFrame([(c,) for c in "abc"], "k string"), ["k"], known=known)
    assert sorted(r["ordinal"] for r in out.collect()) == list(range(n + 3))


@pytest.mark.parametrize("seed", range(2))
def test_asof_state(spark, seed):
    rng = random.Random(seed)
    ids = ["hot"] * 6 + ["a", "b"]
    events = [(rng.choice(ids), rng.randrange(40), rng.choice([None, None, 0, 1]), n) for n in range(300)]
    df = spark.createDataFrame([(i, at(t), s, n) for i, t, s, n in events], "id string, t timestamp_ntz, state int, n int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["n"]: r["state"] for r in asof_state(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for i, t, s, n in events:
        if s is None:
            past = [(u, v) for j, u, v, _ in events if j == i and v is not None and u <= t]
            want[n] = max(past)[1] if past else None
    assert got == want


# --- problem 1 -----------------------------------------------------------------------------------


def brute_orphans(children, changes, eternal):
    out, first = set(), {}
    for c, f, t, r in children:
        k = (c, f, t)
        first[k] = min((x for x in (first.get(k), r) if x is not None), default=None)
    for (c, f, t), r in first.items():
        for field, key in (("f", f), ("t", t)):
            if key is None or key in eternal:
                continue
            mine = [(float("inf") if w is None else w, d) for k, w, d in changes if k == key]  # undated: after all
            past = [(w, d) for w, d in mine if r is None or w <= r]
            reason = "missing" if not mine else "late" if not past else "deleted" if max(past)[1] else None
            if reason:
                out.add((c, field, key, reason))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_orphans(spark, seed):
    rng = random.Random(seed)
    keys = ["hot"] * 10 + ["k%d" % k for k in range(12)] + [None, "", "sys"]
    kids = [("r%d" % rng.randrange(60), None, None, rng.choice([None, *range(30)])) for _ in range(90)]
    ends = {c: (rng.choice(keys), rng.choice(keys)) for c, *_ in kids}
    kids = [(c, *ends[c], r) for c, _, _, r in kids]
    changes = [(rng.choice(keys[5:18] + [None, "hot"]), rng.choice([None, *range(30)]), rng.random() < 0.4) for _ in range(40)]
    child = spark.createDataFrame([(c, f, t, at(r), "x") for c, f, t, r in kids], "c string, f string, t string, r timestamp_ntz, verdict string")
    parent = spark.createDataFrame([(k, at(w), d, "y") for k, w, d in changes], "k string, w timestamp_ntz, d boolean, key string")
    out = orphans.find_orphans(child, parent, child_id="c", ref_fields=["f", "t"], arrived_at="r", parent_id="k", changed_at="w", deleted="d", eternal=spark.createDataFrame([("sys",)], "s string"))
    assert {tuple(x) for x in rows(out, "c", "ref_field", "ref_id", "reason")} == brute_orphans(kids, changes, {"sys"})
    assert out.count() == len(set(rows(out, "c", "ref_field", "ref_id")))


def test_orphans_of_empty_tables(spark):
    child, parent = spark.createDataFrame([], "c string, f string, r timestamp_ntz"), spark.createDataFrame([], "k string, w timestamp_ntz, d boolean")
    args = dict(child_id="c", ref_fields=["f"], arrived_at="r", parent_id="k", changed_at="w", deleted="d")
    assert orphans.find_orphans(child, parent, **args).count() == 0
    one = spark.createDataFrame([("a", "x", at(1))], child.schema)
    found = orphans.find_orphans(one, parent, **args)
    assert rows(found, "c", "reason") == [("a", "missing")]
    assert rows(orphans.count_orphans(found, "r")) == [("f", "missing", "2024-01", 1, 1)]


# --- problem 2 -----------------------------------------------------------------------------------


def test_bitmap_algebra():
    rng = random.Random(1)
    for n, m in ((0, 5), (100, 50), (9000, 20), (30000, 40000)):
        a, b = (sorted(rng.sample(range(bitmap.BLOCK), k)) for k in (n, m))
        import numpy as np

        x, y = bitmap.pack(np.array(a, np.int64)), bitmap.pack(np.array(b, np.int64))
        assert bitmap.unpack(x).tolist() == a
        assert bitmap.and_not(x, y).tolist() == sorted(set(a) - set(b))
        assert bitmap.both(x, y).tolist() == sorted(set(a) & set(b))
        assert len(x) <= bitmap.BLOCK // 8 + 1
    assert bitmap.and_not(None, x).tolist() == [] and bitmap.both(x, None).tolist() == []


def test_canonical_json():
    assert canonical('{"b": 1.0, "a": "\\u00e9"}') == canonical('{ "a":"é","b":1}')
    assert canonical("[1]") != canonical("[true]") and canonical("1") != canonical('"1"')
    assert canonical("no json") != canonical('"no json"') and canonical(None) is None


@pytest.mark.parametrize("seed", range(2))
def test_snapshot_diff(spark, seed):
    rng = random.Random(seed)
    manifest, lines = [], []
    for store in ("s1", "s2", "s3"):
        keys = {"k%d" % k: rng.randrange(3) for k in range(30)}
        for n in range(4):
            snap = f"{store}-{n}"
            manifest += [(store, snap, at(n * 10 + 5)), (store, snap, at(n * 10 + rng.choice([5, 9])))]
            for k in rng.sample(sorted(keys), 5):
                keys[k] = rng.randrange(3)
            for k in rng.sample(sorted(keys), 3):
                del keys[k]
            for k in rng.sample(range(40), 3):
                keys["k%d" % k] = 7
            for k, v in keys.items():
                for _ in range(rng.choice([1, 1, 2])):
                    text = rng.choice(['{"v": %d, "w": null}', '{"w":null,"v":%d}', '{"\\u0076":%d.0,"w":null}']) % v if v else None
                    lines.append((snap, k, text, at(n)))
    lines += [("unpublished", "k1", "{}", at(0)), (None, "k1", "{}", at(0)), ("s1-0", None, "{}", at(0))]
    manifest += [(None, "s1-1", at(0)), ("s1", None, at(0))]
    cols = dict(group="g", snapshot="s", key="k", value="v", published_at="p", delivered_at="d")
    df = spark.createDataFrame(lines, "s string, k string, v string, d timestamp_ntz")
    mf = spark.createDataFrame(manifest, "g string, s string, p timestamp_ntz")
    got = set(rows(snapshot_diff.diff_snapshots(df, mf, **cols), "snap", "key", "change"))
    full = defaultdict(dict)
    for s, k, v, _ in lines:
        if s and k:
            full[s][k] = canonical(v)
    want = set()
    for store in ("s1", "s2", "s3"):
        for n in range(1, 4):
            a, b = full[f"{store}-{n}"], full[f"{store}-{n - 1}"]
            want |= {(f"{store}-{n}", k, "added") for k in a.keys() - b.keys()} | {(f"{store}-{n}", k, "removed") for k in b.keys() - a.keys()}
            want |= {(f"{store}-{n}", k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    assert got == want
    assert snapshot_diff.diff_snapshots(df.limit(0), mf, **cols).count() == 0
    assert snapshot_diff.diff_snapshots(df, mf.limit(0), **cols).count() == 0


def test_snapshot_diff_keeps_ordinals(spark):
    cols = dict(group="g", snapshot="s", key="k", value="v", published_at="p", delivered_at="d")
    df = spark.createDataFrame([("s0", "m", "1", at(0)), ("s1", "m", "1", at(1)), ("s1", "a", "1", at(1)), ("s2", "a", "2", at(2)), ("s2", "z", "1", at(2))], "s string, k string, v string, d timestamp_ntz")
    mf = spark.createDataFrame([("g", f"s{n}", at(n)) for n in range(3)], "g string, s string, p timestamp_ntz")
    _, first = snapshot_diff.diff_with_ordinals(df, mf.where("s = 's0'"), **cols)
    assert rows(first, "grp", "key", "ordinal") == [("g", "m", 0)]
    found, second = snapshot_diff.diff_with_ordinals(df, mf, known=first, **cols)
    assert rows(second, "key", "ordinal") == [("a", 1), ("m", 0), ("z", 2)]
    assert rows(found, "snap", "key", "change") == [("s1", "a", "added"), ("s2", "a", "changed"), ("s2", "m", "removed"), ("s2", "z", "added")]


# --- problem 3 -----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(2))
def test_term_frequency(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.choice("ab"), rng.choice(["hot"] * 8 + ["", "x", "y", None]), rng.choice([None, *("r%d" % k for k in range(15))])) for _ in range(400)]
    df = spark.createDataFrame(pairs, "field string, term string, rec string").withColumn("piece", F.lit("clash"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["field"], r["term"]): (r["n_occurrences"], r["n_records"]) for r in frequency.term_frequency(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = defaultdict(list)
    for f, t, r in pairs:
        if None not in (t, r):
            want[f, t].append(r)
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()}


def test_terms_of_facts(spark):
    facts = spark.createDataFrame([("1", " Field\t", "ns::Foo_bar9 Foo", " ./a/B.c:12 "), ("2", None, None, None), ("3", "", "é_x", "p:q")], "object_id string, fact_kind string, object_name string, object_source string")
    assert rows(frequency.fact_terms(facts)) == sorted(
        [("fact_kind", "field", "1"), ("object_name", "ns", "1"), ("object_name", "foo", "1"), ("object_name", "bar9", "1"), ("object_name", "foo", "1"), ("object_source", "./a/B.c", "1"),
         ("fact_kind", "", "3"), ("object_name", "x", "3"), ("object_source", "p:q", "3")], key=repr)
    marked = frequency.mark_terms(spark.createDataFrame([("a", 2), ("b", 5), ("c", 3)], "term string, n_records int"), 100)
    assert rows(marked, "term", "mark") == [("a", "rare"), ("b", "common"), ("c", None)]
    assert frequency.term_frequency(frequency.fact_terms(facts.limit(0))).count() == 0


# --- problem 4 -----------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [3, 17, 4096])
def test_per_key(spark, chunk, monkeypatch):
    monkeypatch.setattr(balanced, "LEAST_CHUNK", chunk)
    monkeypatch.setattr(balanced, "CHUNKS", 10**9)
    rng = random.Random(chunk)
    data = [(rng.choice(["from", "to"]), rng.choice(["hot"] * 9 + ["a", "b", None]), rng.choice(["x", "y", None]), rng.choice(["f1", "f2", "f3", None]), rng.choice([True, False, None]), n // 2) for n in range(500)]
    df = spark.createDataFrame(data, "side string, key string, kind string, item string, flag boolean, spread long").withColumn("chunk", F.lit(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = {(r["side"], r["key"], r["kind"]): (r["n"], r["n_flagged"], r["n_items"]) for r in balanced.per_key(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = defaultdict(list)
    for s, k, d, i, f, _ in data:
        if k is not None:
            want[s, k, d].append((i, f))
    assert got == {k: (len(v), sum(f is True for _, f in v), len({i for i, _ in v} - {None})) for k, v in want.items()}
    heavy = balanced.heavy_keys(balanced.per_key(df), len(data), 0.2)
    n = Counter((s, k) for s, k, *_ in data if k is not None)
    assert set(rows(heavy, "side", "key")) == {k for k, c in n.items() if c >= 100}
    assert balanced.per_key(df.limit(0)).count() == 0


def test_chunks_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(balanced, "LEAST_CHUNK", 10)
    data = [("from", "hot" if n % 10 else f"k{n}", "x", None, False, n) for n in range(205)]
    df = spark.createDataFrame(data, "side string, key string, kind string, item string, flag boolean, spread long").repartition(5)
    got = balanced.chunked(df).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["number"] for r in got) == list(range(205)) and all(r["chunk"] == r["number"] // 10 for r in got)
    assert sorted(Counter(r["task"] for r in got).values()) == [65, 70, 70]
    assert all(len({r["task"] for r in got if r["chunk"] == c}) == 1 for c in range(21))
    assert rows(balanced.per_key(df).where("key = 'hot'"), "n", "n_chunks") == [(184, 19)]


# --- problem 5 -----------------------------------------------------------------------------------


def random_forest(rng, n):
    links = []
    for c in range(1, n):
        if rng.random() < 0.9:
            links.append((rng.choice([c - 1, max(0, c - 2), rng.randrange(c)]), c))
    ring = [n + k for k in range(5)]
    links += list(zip(ring, ring[1:] + ring[:1])) + [(n, n + 10), (n + 10, n + 11), (n + 20, n + 20), (n + 20, n + 21)]
    return [("n%d" % p, "n%d" % c) for p, c in links]


def brute_tree(links):
    parent = {}
    for p, c in links:
        parent[c] = min(p, parent.get(c, p))
    out = {}
    for x in {i for e in links for i in e}:
        seen, y = [], x
        while y in parent and y not in seen:
            seen.append(y)
            y = parent[y]
        if y in seen:
            out[x] = ("", -1 if x in seen[seen.index(y):] else -2, None)
        else:
            out[x] = (y, len(seen), [*reversed(seen), ] if seen else [x])
            out[x] = (y, len(seen), [y, *reversed(seen)])
    return out


@pytest.mark.parametrize("seed,core", [(0, 10**6), (1, 24)])
def test_hierarchy(spark, seed, core):
    rng = random.Random(seed)
    links = random_forest(rng, 36)
    df = spark.createDataFrame(links + links[:9] + [(None, "n1"), ("n2", None)], "p string, c string").withColumn("id", F.lit("clash"))
    tree = hierarchy.build_hierarchy(df, parent="p", child="c", core_rows=core)
    got = {r["id"]: r for r in tree.collect()}
    want = brute_tree(links)
    assert {k: (r["root_id"], r["depth"]) for k, r in got.items()} == {k: v[:2] for k, v in want.items()}
    on = {k: r for k, r in got.items() if r["depth"] >= 0}
    for a, r in on.items():
        below = {b for b, s in on.items() if s["root_id"] == r["root_id"] and r["entry"] < s["entry"] < r["exit"]}
        assert below == {b for b in on if a in want[b][2][:-1]}
    assert len({(r["root_id"], r["entry"]) for r in on.values()}) == len(on)
    if core == 24:
        paths = {r["id"]: r["path"] for r in hierarchy.with_paths(tree).collect()}
        assert paths == {k: v[2] for k, v in want.items()}
        counts = {r["id"]: r["n_descendants"] for r in hierarchy.count_descendants(tree).collect() if r["depth"] >= 0}
        assert all(n == sum(a in want[b][2][:-1] for b in on) for a, n in counts.items())
        roots = spark.createDataFrame([("n0",)], "id string")
        assert {r["id"] for r in hierarchy.descendants_of(tree, roots).collect()} == {b for b in on if want[b][2][0] == "n0" and b != "n0"}


@pytest.mark.parametrize("core", [10**6, 24])
def test_all_descendants(spark, core):
    links = random_forest(random.Random(3), 36)
    tree = hierarchy.build_hierarchy(spark.createDataFrame(links, "p string, c string"), parent="p", child="c", core_rows=core).cache()
    want = {(a, b) for b, (_, depth, path) in brute_tree(links).items() if depth >= 0 for a in path[:-1]}
    got = rows(hierarchy.all_descendants(tree, 3), "ancestor_id", "id")
    assert len(want) > 30 and len(got) == len(want) and set(got) == want
    assert hierarchy.all_descendants(tree.limit(0)).count() == 0


def test_many_small_trees_and_a_tiny_core(spark):
    links = [("r%d" % k, "c%d" % k) for k in range(8)] + [("c%d" % k, "d%d" % k) for k in range(4)] + [("x", "y"), ("y", "x"), ("y", "z")]
    tree = hierarchy.build_hierarchy(spark.createDataFrame(links, "p string, c string"), parent="p", child="c", core_rows=2)
    assert {r["id"]: (r["root_id"], r["depth"]) for r in tree.collect()} == {k: v[:2] for k, v in brute_tree(links).items()}


def test_ranking_more_lists_than_fit(spark):
    arcs = [(10 * k + j, 10 * k + j + 1 if j < 3 else None, 1, j) for k in range(6) for j in range(4)]
    out = hierarchy.rank_arcs(spark.createDataFrame(arcs, "a long, nxt long, w long, l long"), 3)
    assert rows(out, "a", "w", "l") == sorted(((10 * k + j, 4 - j, sum(range(j, 4))) for k in range(6) for j in range(4)), key=repr)


def test_hierarchy_wide_and_empty(spark):
    wide = spark.range(300).select(F.lit("top").alias("p"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("c"))
    tree = hierarchy.build_hierarchy(wide, parent="p", child="c", core_rows=200)
    assert tree.where("depth = 1 and root_id = 'top'").count() == 300 and tree.select("entry").distinct().count() == 301
    assert hierarchy.build_hierarchy(wide.limit(0), parent="p", child="c").count() == 0


def test_payloads_in_different_dress_are_equal():
    assert canonical(json.dumps({"a": [1, 2.5, {"b": None}]}, indent=3)) == canonical('{"a":[1,2.5,{"b":null}]}')
