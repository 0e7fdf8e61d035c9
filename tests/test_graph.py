"""Search, relation queries, detail and overlays on small golden graphs."""

import json
import random

import pytest
from conftest import rows

from factloom.operators import detail, graph, overlay, search
from factloom.plans.model import SALIENCE, View, fact_problem, promote, relative_problem, salience
from factloom.plans.query_lang import QueryError, owner_field_pairs, parse

FACT = "object_id string, object_name string, object_description string, object_source string, object_profile string, object_caller string, object_callee string, payload string"
EDGE = "relative_id string, from_fact_id string, to_fact_id string, relation_kind string, condition struct<kind:string,expression:string,branch:string,source:string>, object_profile string, evidence_source string, confidence double, payload string, source_id string"


def fact(i, name=None, kind="function", source="src/a.c:1", desc="", **payload):
    return (i, name if name is not None else i, desc, source, "default", None, None, json.dumps({"fact_kind": kind, **payload}))


def edge(a, b, kind="direct_call", rid=None, cond=None, evidence="src/a.c:9", source=None):
    return (rid or f"rel:{a}:{b}", a, b, kind, cond, "default", evidence, 1.0, "{}", source)


def view(spark, facts, edges):
    return View(promote(spark.createDataFrame(facts, FACT)), spark.createDataFrame(edges, EDGE)).staged()


def test_parser():
    q = parse("callers:Main depth:2 file:Src/ name:X foo")
    assert (q.mode, q.depth, q.files, q.names, q.terms) == ("relation_transitive", 2, ("src/",), ("x",), ("foo",))
    assert parse("plain words") is None and parse("callers:x").mode == "relation"
    assert parse("readers:x depth:2").complaint and parse("callers:x depth:9").complaint and parse("callers:x depth:1 depth:2").complaint
    r = parse("reachable:a->b")
    assert (r.anchor, r.target, r.depth) == ("a", "b", 8)
    for bad in ("callers:", "callers:a callees:b", "reachable:a", "callers:a file:", "callers:a condition:x"):
        with pytest.raises(QueryError):
            parse(bad)
    assert owner_field_pairs("struct Foo.bar") == [("struct", "bar"), ("foo", "bar"), ("struct foo", "bar")]
    assert owner_field_pairs("struct a b.c")[-1] == ("a b", "c") and owner_field_pairs("x") == []


def test_diamond_with_cycle(spark):
    v = view(spark, [fact(i) for i in ("root", "left", "right", "leaf")], [edge("root", "left"), edge("root", "right"), edge("left", "leaf"), edge("right", "leaf"), edge("leaf", "root")])
    out = graph.relation_search(v, "callees:root depth:2")
    assert [(r["object_id"], r["hop"], r["instances"]) for r in out.rows] == [("left", 1, 1), ("right", 1, 1), ("leaf", 2, 2)]
    assert (out.total, out.complete, out.status) == (3, True, "ok")
    met = graph.rollup(graph.closure(graph.call_graph(v), "root", "outgoing", 2))
    assert rows(met, "endpoint_id", "hop", "instances") == [("leaf", 2, 2), ("left", 1, 1), ("right", 1, 1)]
    assert graph.relation_search(v, "callees:root depth:2", limit=2).status == "too_broad"
    assert graph.relation_search(v, "callees:nowhere").status == "not_found"


def test_paths_and_budgets(spark):
    cond = ("branch", "a", "then", "src/m.c:9")
    v = view(spark, [fact(i) for i in ("root", "middle", "leaf", "target", "b")], [edge("root", "middle", cond=cond), edge("middle", "leaf"), edge("leaf", "target"), edge("root", "b")])
    out = graph.relation_search(v, "reachable:root->target")
    assert out.reachable and out.complete and [(p["object_id"], p["hop"]) for p in out.path] == [("root", 0), ("middle", 1), ("leaf", 2), ("target", 3)]
    assert out.path[1]["condition"]["expression"] == "a"
    short = graph.relation_search(v, "reachable:root->target depth:2")
    assert (short.reachable, short.complete, short.status, short.path) == (False, False, "ok", [])
    assert graph.relation_search(v, "reachable:root->root").path[0]["hop"] == 0
    tight = graph.relation_search(v, "callees:root depth:2", edge_budget=1)
    assert (tight.status, tight.complete, tight.budget_kind) == ("too_broad", False, "frontier_edges")


def test_reach_has_no_budget(spark, monkeypatch):
    facts, edges = [fact(i) for i in ("root", "a", "b", "c", "z", "alone")], [edge("root", i) for i in ("a", "b", "c", "z")] + [edge("c", "root"), edge("z", "last")]
    v = view(spark, facts + [fact("last")], edges)
    assert not graph.relation_search(v, "reachable:root->z", edge_budget=3).reachable  # the budget ends before a fact that is called directly
    calls = graph.call_graph(v)
    assert graph.reach(calls, "root", "z", 8) == (True, 1, True)
    assert graph.reach(calls, "root", "last", 1) == (False, 0, False) and graph.reach(calls, "root", "last", 2) == (True, 2, True)
    assert graph.reach(calls, "root", "alone", 8) == (False, 0, True) and graph.reach(calls, "root", "root", 8) == (True, 0, True)

    from factloom.plans import catalog

    monkeypatch.setattr(catalog, "_graph", lambda *_: view(spark, facts + [fact("hub")], [edge("root", f"{i}") for i in ("a", "b", "c", "z")] + [edge("b", "z")]))
    monkeypatch.setattr(graph.relation_search, "__defaults__", (20, None, 3, 10_000))
    assert catalog.reachable_path(spark, "").collect()[0][:] == (True, 1)
    assert catalog.reachable_full_depth(spark, "").collect()[0][:] == (True, 1, True)


def test_dispatch(spark):
    facts = [fact("root"), fact("slot", "ExecProcNode", "field"), fact("target"), fact("leaf")]
    v = view(spark, facts, [edge("root", "slot", "dispatches_via"), edge("slot", "target", "assigned_to"), edge("target", "leaf")])
    out = graph.relation_search(v, "callees:root depth:2")
    assert [(r["object_id"], r["hop"], r["matched"][0]["kind"]) for r in out.rows] == [("target", 1, "dispatches_via"), ("leaf", 2, "direct_call")]
    assert [p["object_id"] for p in graph.relation_search(v, "reachable:root->leaf").path] == ["root", "target", "leaf"]
    calls = graph.call_graph(view(spark, facts + [fact("t2"), fact("r2")], [edge(a, "slot", "dispatches_via", rid=f"{a}{k}") for a in ("root", "r2") for k in range(3)] + [edge("slot", t, "assigned_to") for t in ("target", "t2")]))
    assert rows(graph.rollup(graph.closure(calls, "root", "outgoing", 1)), "endpoint_id", "instances", "representative") == [("t2", 3, "root0"), ("target", 3, "root0")]
    assert rows(graph.rollup(graph.closure(calls, "t2", "incoming", 1)), "endpoint_id", "instances", "representative") == [("r2", 3, "r20"), ("root", 3, "root0")]
    assert rows(graph.call_classes(calls), "slot", "role", "fact_id", "n") == [("slot", "source", "r2", 3), ("slot", "source", "root", 3), ("slot", "target", "t2", 1), ("slot", "target", "target", 1)]
    hop = graph.relation_search(v, "dispatches_via:ExecProcNode")
    assert [(r["object_id"], r["matched"][0]["kind"]) for r in hop.rows] == [("target", "assigned_to")]


@pytest.mark.parametrize("seed", range(2))
def test_frontier_edges_are_the_first_in_order(spark, seed):
    """Whatever the budget, the edges are the head of the whole list, which is built here by brute force."""
    rng = random.Random(seed)
    funcs = [fact(f"f{k}", f"n{rng.randrange(3)}", source=f"src/{rng.choice('ab')}.c:1") for k in range(8)]
    slots = [fact(s, kind="function_pointer_slot") for s in ("s1", "s2")]
    edges = [edge(f"f{rng.randrange(8)}", f"f{rng.randrange(8)}", rid=f"d{k:02}") for k in range(12)]
    edges += [edge(f"f{rng.randrange(8)}", rng.choice(["s1", "s2"]), "dispatches_via", rid=f"v{k:02}") for k in range(14)]
    edges += [edge(rng.choice(["s1", "s2"]), f"f{rng.randrange(8)}", "assigned_to", rid=f"a{k:02}") for k in range(9)]
    v = view(spark, funcs + slots, edges)
    calls = graph.call_graph(v)
    known = {r["object_id"]: (r["object_name"], r["object_source"]) for r in v.facts.collect()}
    raw = [(r["from_fact_id"], r["to_fact_id"], r["relation_kind"], r["relative_id"]) for r in v.relatives.collect()]
    assigned = {(a, b) for a, b, k, _ in raw if k == "assigned_to"}
    every = [(a, b, i) for a, b, k, i in raw if k == "direct_call"] + [(a, t, i) for a, s, k, i in raw if k == "dispatches_via" for s2, t in assigned if s == s2]
    frontier = ["f0", "f1", "f2", "f5"]
    for direction in ("outgoing", "incoming"):
        mine = [(a, b, i) if direction == "outgoing" else (b, a, i) for a, b, i in every]
        want = sorted((n, known[f], i, f) for n, f, i in mine if n in frontier)
        for most in (1, 4, 9, 500):
            got = [(e["source"], (e["object_name"], e["object_source"]), e["relative_id"], e["object_id"]) for e in graph._frontier_edges(v, calls, frontier, direction, most)]
            assert got == want[:most]


def test_readers_and_anchors(spark):
    facts = [fact("f", "width", "field", owner_name="Window", type="int"), fact("g", "width", "field", owner_name="Page"), fact("a", source="src/a.c:3"), fact("b", source="lib/b.c:4")]
    v = view(spark, facts, [edge("a", "f", "field_read"), edge("b", "f", "field_read"), edge("b", "f", "field_read", rid="rel:2"), edge("gone", "f", "field_read")])
    assert [r["object_id"] for r in graph.relation_search(v, "readers:f file:SRC/").rows] == ["a"]
    assert [(r["object_id"], r["instances"]) for r in graph.relation_search(v, "readers:Window.width").rows] == [("b", 2), ("a", 1)]
    asked = graph.relation_search(v, "readers:width")
    assert asked.status == "needs_refinement" and [c["object_id"] for c in asked.candidates] == ["f", "g"]
    none = graph.relation_search(v, "writers:f")
    assert none.total == 0 and none.examples == ("accessors:f",)
    assert rows(graph.relatives_of(v, "f", "incoming"), "relative_id") == [("rel:2",), ("rel:a:f",), ("rel:b:f",)]


def test_search_order_and_folding(spark):
    facts = [fact("1", "StraßeReader"), fact("2", "reader", "field", owner_name="Log"), fact("3", "reader", "type"), fact("4", "other", desc="a reader of logs"), fact("5", None), fact("6", "reader", "type")]
    v = view(spark, facts, [])
    assert [r["object_id"] for r in search.search(v.facts, "strasse").collect()] == ["1"]
    assert [r["object_id"] for r in search.search(v.facts, "reader", 10).orderBy("position").collect()] == ["3", "6", "2", "1", "4"]
    assert [r["object_id"] for r in search.search(v.facts, "log reader").orderBy("position").collect()] == ["4", "2"]
    assert [r["object_id"] for r in search.search(v.facts, "", 2).orderBy("position").collect()] == ["1", "2"]
    assert search.search(v.facts, "nothing at all").count() == 0
    assert search.no_exact_note("Reader", ["StraßeReader"]) and search.no_exact_note("reader", ["Reader"]) is None


def test_preview_and_detail(spark):
    facts = [fact("f", "field", "field", payload_text="x" * 500)] + [fact(f"c{k}", source=f"src/{k // 4}.c:1") for k in range(12)]
    edges = [edge(f"c{k}", "f", "field_read") for k in range(12)] + [edge("c0", "f", "field_read", rid="again"), edge("f", "c1", "direct_call")]
    v = view(spark, facts, edges)
    got = detail.preview(v, spark.createDataFrame([("f",)], "fact_id string"), "small").collect()
    read = sorted((r for r in got if r["relation_kind"] == "field_read"), key=lambda r: r["place"])
    assert [r["endpoint_id"] for r in read] == ["c0", "c1", "c10", "c11", "c4"] and read[0]["instances"] == 2 and read[0]["bucket_total"] == 13
    flat = [r["relation_kind"] for r in sorted((r for r in got if r["flat_place"]), key=lambda r: r["flat_place"])]
    assert flat[:3] == ["direct_call", "field_read", "field_read"]
    files = spark.createDataFrame([("src/a.c", "one\ntwo\nthree\nfour\nfive\n")], "path string, text string")
    out = detail.fact_detail(v, "f", "small", files)
    assert out["lines"] == ["one", "two", "three", "four"] and out["payload"]["payload_text"].endswith("...[TRUNCATED]") and not out["truncated"]
    cut = detail.shrink({"fact": {"object_id": "f", "object_name": "n" * 400}, "payload": {"a": "b" * 300}, "payload_truncated": False, "lines": ["z" * 300] * 9, "flat": [], "buckets": []}, 400)
    assert cut["truncated"] and cut["response_bytes"] <= 400 and cut["fact"]["object_id"] == "f"
    with pytest.raises(QueryError):
        detail.fact_detail(v, "none")
    assert detail.bucket_keys()[:4] == [("incoming", "direct_call"), ("outgoing", "direct_call"), ("incoming", "field_read"), ("incoming", "field_write")] and len(detail.bucket_keys()) == 18


def test_preview_sample_query(spark, monkeypatch):
    from factloom.plans import catalog

    cond = ("branch", "x", None, None)
    v = view(spark, [fact("f", "field", "field")] + [fact(f"c{k:02}") for k in range(12)], [edge(f"c{k:02}", "f", "field_read", cond=cond if k == 1 else None) for k in range(12)] + [edge("f", "c03", "direct_call")])
    monkeypatch.setattr(catalog, "base_view", lambda *_: v)
    got = catalog.relation_preview_sample(spark, "").where("fact_id = 'f'").orderBy("flat_place").collect()
    assert [(r["flat_place"], r["relation_kind"]) for r in got] == [(1, "direct_call"), *((k, "field_read") for k in range(2, 9))]
    assert all(r["conditions"] == [] for r in got)
    seen = catalog.relation_preview_sample(spark, "").where("fact_id = 'c01'").collect()
    assert [(r["direction"], r["endpoint_id"], r["conditions"]) for r in seen] == [("outgoing", "f", ['{"kind":"branch","expression":"x"}'])]


def test_overlay(spark):
    base = view(spark, [fact("old", source_id="source:a"), fact("keep"), fact("dead")], [edge("old", "keep"), edge("keep", "dead"), edge("keep", "keep", rid="self")])
    lines = spark.createDataFrame(
        [("source:a", "tombstone", None, None, None, 1), (None, "tombstone", "dead", None, None, 1), (None, "upsert", "new", None, '{"fact_kind":"type","object_name":"New"}', 2),
         (None, "upsert", None, "r9", '{"from_fact_id":"new","to_fact_id":"keep","relation_kind":"declares"}', 2), (None, "upsert", None, "r8", '{"from_fact_id":"new","to_fact_id":"lost"}', 2)],
        "source_id string, action string, object_id string, relative_id string, payload string, patched_at int",
    )
    over = overlay.patches(lines, base)
    merged = overlay.apply_overlay(base, over)
    assert rows(merged.facts, "object_id") == [("keep",), ("new",)]
    assert rows(merged.relatives, "relative_id") == [("r8",), ("r9",), ("self",)]
    assert rows(overlay.overlay_orphans(merged, over)) == [("r8", "lost")]
    assert ("facts", "type", 1) in rows(overlay.view_stats(merged))


def test_validation(spark):
    good, bad = fact("x"), (None, "n", "d", "s", "p", None, None, "[1]")
    df = spark.createDataFrame([(*good[:2], "d", *good[3:]), bad, ("y", "n", "d", "s", "p", None, None, "[1]"), ("z", "n", "d", "s", "p", None, None, '{"a":"' + "x" * 5000 + '"}')], FACT)
    assert [r[0] for r in df.select(fact_problem()).collect()] == [None, "invalid_object_id", "invalid_payload", "payload_too_large"]
    edges = spark.createDataFrame([edge("a", "b"), edge("a", "b", "sings"), edge("a", "b", cond=("mood", "x", None, None))], EDGE)
    assert [r[0] for r in edges.select(relative_problem()).collect()] == [None, "invalid_relation_kind", "invalid_condition"]
    from pyspark.sql import functions as F

    assert {r[0]: r[1] for r in edges.select("relation_kind", salience(F.col("relation_kind"))).collect()} == {"direct_call": SALIENCE["direct_call"], "sings": 5}
