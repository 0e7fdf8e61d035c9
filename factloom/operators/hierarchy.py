"""Problem 5: parent-child links to full hierarchies.

Every node gets its root, depth, and an interval (entry, exit) of an Euler tour
of its tree: a node's descendants are the nodes whose entry lies inside its
interval, its ancestors those whose interval holds its entry.

1. Ids become dense ordinals.
2. Leaves are peeled off in rounds; a parent takes over the size of each leaf
   under it. Bushy trees melt away; what is left is the core: circles, what
   they hang from, and the inner nodes of tall trees.
3. The core's leaves are peeled on to the end, which leaves the circles bare,
   and the Euler tour of the other core trees is laid out as a linked list of
   arcs, each weighted with the nodes peeled below it, and ranked.
4. Rounds are undone: each peeled leaf takes root, depth and entry from its parent.

A core of at most `core_rows` nodes is finished in one task, which is the base
case of the recursion and has that bound. A larger one is finished with
DataFrames: circles by pointer doubling, the list by random-mate contraction,
down to `core_rows` arcs.

A node on a circle has depth -1 and no root, one below a circle -2 and no root.
Nulls: a link with a null end is left out. Parallel links count once; a link
from a node to itself is a circle. If a node has several parents, the smallest
counts. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.scratch import dense_ordinals, drop_staged, hot_keys, numbered, skew_join, spread_join, stage, with_positions

#: The largest core, in nodes or arcs, that one task finishes (about 30 bytes each).
CORE_ROWS = 100_000
ON_CIRCLE, BELOW_CIRCLE = -1, -2

NODES = "v bigint, root bigint, depth bigint, entry bigint, size bigint"


# --- in one task ---------------------------------------------------------------------------------


def rank_list(nxt: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of the weights from each element to the end of its list (itself included); nxt -1 ends a list."""
    total, nxt = weight.astype(np.int64).copy(), nxt.copy()
    while (live := np.flatnonzero(nxt >= 0)).size:
        total[live] += total[nxt[live]]
        nxt[live] = nxt[nxt[live]]
    return total


def peel(parent: np.ndarray) -> np.ndarray:
    """True for nodes that stay when leaves are removed until there are none: those on a circle."""
    kids = np.bincount(parent[parent >= 0], minlength=len(parent))
    stays, leaves = np.ones(len(parent), bool), np.flatnonzero(kids == 0)
    while leaves.size:
        stays[leaves] = False
        up = parent[leaves]
        up = up[up >= 0]
        np.subtract.at(kids, up, 1)
        up = np.unique(up)
        leaves = up[kids[up] == 0]
    return stays


def tour(v: np.ndarray, parent_id: np.ndarray, own: np.ndarray, peeled: np.ndarray) -> pd.DataFrame:
    """Root, depth, entry and subtree size of each core node, by list ranking of the Euler tour.

    `v` sorted; `parent_id` -1 for none; `own` 1 + nodes peeled below; `peeled`
    is what of them stands before the core children (all of it).
    """
    n = len(v)
    parent = np.where(parent_id >= 0, np.searchsorted(v, parent_id), -1)
    circle = peel(parent)
    # Whoever reaches a circle hangs from it: double pointers until they rest at a root or a circle.
    top = np.where((parent < 0) | circle, np.arange(n), parent)
    while (top[top] != top).any():
        top = top[top]
    in_tree = ~circle[top]
    # Arcs: down(x) = x, up(x) = n + x. A root has both, too, so that each tree is one list.
    kids = np.flatnonzero(in_tree & (parent >= 0))
    kids = kids[np.lexsort((kids, parent[kids]))]
    nxt = np.full(2 * n, -1, np.int64)
    first = np.full(n, -1, np.int64)
    if kids.size:
        p = parent[kids]
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        ends = np.r_[starts[1:], len(p)] - 1
        first[p[starts]] = kids[starts]
        nxt[n + kids[:-1]] = kids[1:]  # up(x) -> down(next sibling)
        nxt[n + kids[ends]] = n + p[ends]  # up(last) -> up(parent)
    down = np.flatnonzero(in_tree)
    nxt[down] = np.where(first[down] >= 0, first[down], n + down)
    weight = np.zeros(2 * n, np.int64)
    weight[down] = own[down]
    level = np.zeros(2 * n, np.int64)
    level[down], level[n + down] = 1, -1
    after, steps = rank_list(nxt, weight), rank_list(nxt, level)
    whole = after[top[down]]
    out = pd.DataFrame({"v": v, "root": np.int64(-1), "depth": np.where(circle, ON_CIRCLE, BELOW_CIRCLE), "entry": np.int64(0), "size": np.int64(0)})
    out.loc[down, "root"] = v[top[down]]
    out.loc[down, "depth"] = -steps[down]  # from down(x) to the end all levels but those above x cancel out
    out.loc[down, "entry"] = whole - after[down]
    out.loc[down, "size"] = after[down] - after[n + down]
    return out


def _finish(df: pd.DataFrame) -> pd.DataFrame:
    df = df.sort_values("v")
    return tour(df["v"].to_numpy(), df["p"].fillna(-1).to_numpy(np.int64), df["own"].to_numpy(np.int64), df["own"].to_numpy(np.int64) - 1)


# --- with DataFrames -----------------------------------------------------------------------------


def rank_arcs(arcs: DataFrame, core_rows: int) -> DataFrame:
    """List ranking of (a, nxt, w, l): sums of w and l from each arc to its end, as (a, w, l).

    Each round the last arcs of all lists are finished and the arcs before them
    become the last, so that many short lists melt away. Then random mate: an
    arc whose coin shows 1 and whose predecessor's shows 0 is taken out and its
    sums go to the predecessor; about a quarter goes. Taken-out arcs come back
    in reverse order.
    """
    rounds, finished, k = [], None, 0
    while arcs.count() > core_rows:
        ends = arcs.where("nxt is null").select("a", "w", "l")
        finished = ends if finished is None else finished.unionByName(ends)
        last = ends.select(F.col("a").alias("nxt"), F.col("w").alias("w2"), F.col("l").alias("l2"))
        cut = arcs.where("nxt is not null").join(last, "nxt", "left")
        live = stage(cut.select("a", F.expr("if(w2 is null, nxt, null)").alias("nxt"), F.expr("w + coalesce(w2, 0)").alias("w"), F.expr("l + coalesce(l2, 0)").alias("l")), "live")

        coin = lambda c, k=k: F.xxhash64(c, F.lit(k)).bitwiseAND(F.lit(1))
        out = live.where(coin(F.col("a")) == 1).select(F.col("a").alias("nxt"), F.col("nxt").alias("n2"), F.col("w").alias("w2"), F.col("l").alias("l2"))
        jump = (coin(F.col("a")) == 0) & F.col("w2").isNotNull()
        joined = stage(live.join(out, "nxt", "left").select("a", "nxt", "w", "l", "n2", "w2", "l2", jump.alias("jump")), "mates")
        gone = joined.where("jump").select(F.col("nxt").alias("a"))
        rounds.append(stage(live.join(gone, "a"), "out"))
        arcs = stage(
            joined.join(gone, "a", "left_anti").select("a", F.expr("if(jump, n2, nxt)").alias("nxt"), F.expr("if(jump, w + w2, w)").alias("w"), F.expr("if(jump, l + l2, l)").alias("l")), "arcs"
        )
        drop_staged(joined, live)
        k += 1
    ranked = arcs.groupBy(F.lit("all").alias("_all")).applyInPandas(_rank_rest, "a bigint, w bigint, l bigint")  # at most core_rows
    ranked = stage(ranked if finished is None else ranked.unionByName(finished), "ranked")
    for out in reversed(rounds):
        back = out.join(ranked.select(F.col("a").alias("nxt"), F.col("w").alias("w2"), F.col("l").alias("l2")), "nxt", "left")
        ranked = stage(ranked.unionByName(back.select("a", F.expr("w + coalesce(w2, 0)").alias("w"), F.expr("l + coalesce(l2, 0)").alias("l"))), "ranked")
    return ranked


def _rank_rest(df: pd.DataFrame) -> pd.DataFrame:
    df = df.sort_values("a")
    a, nxt = df["a"].to_numpy(), df["nxt"].fillna(-1).to_numpy(np.int64)
    at = np.where(nxt >= 0, np.searchsorted(a, nxt), -1)
    return pd.DataFrame({"a": a, "w": rank_list(at, df["w"].to_numpy()), "l": rank_list(at, df["l"].to_numpy())})


def resting_places(core: DataFrame) -> DataFrame:
    """(v, top, on_circle): the root above v, or null if v is on or below a circle. Pointer doubling, log2(nodes) rounds at most."""
    n = core.count()
    jump = stage(core.select("v", "p", F.coalesce("p", "v").alias("to"), F.col("p").isNull().alias("done")), "jump")
    step = 1
    while step < 2 * n and jump.where("not done").limit(1).count():
        ahead = jump.select(F.col("v").alias("to"), F.col("to").alias("to2"), F.col("done").alias("done2"))
        resting = jump.where("done")
        moved = spread_join(jump.where("not done"), ahead, "to", ["v"]).select("v", "p", F.col("to2").alias("to"), F.col("done2").alias("done"))
        new = stage(resting.unionByName(moved), "jump")
        drop_staged(jump)
        jump, step = new, 2 * step
    # Pointers that never came to rest now all point into circles, and at every node of each circle.
    circle = jump.where("not done").select(F.col("to").alias("v")).distinct().withColumn("on_circle", F.lit(True))
    return stage(jump.join(circle, "v", "left").select("v", "p", F.when(F.col("done"), F.col("to")).alias("top"), F.coalesce("on_circle", F.lit(False)).alias("on_circle")), "tops")


def tour_large(core: DataFrame, core_rows: int) -> DataFrame:
    """What `tour` gives, for a core of any size."""
    tops = resting_places(core)
    off = tops.where("top is null").select("v", F.lit(-1).cast("bigint").alias("root"), F.when(F.col("on_circle"), ON_CIRCLE).otherwise(BELOW_CIRCLE).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("entry"), F.lit(0).cast("bigint").alias("size"))
    trees = tops.where("top is not null").join(core.select("v", "own"), "v").select("v", "p", "top", "own")
    # Siblings stand side by side in one global sort; neighbours meet by their place in it, however many a parent has.
    lined = stage(with_positions(*numbered(trees.where("p is not null").select("v", "p"), ["p", "v"], "kids"), "pos"), "kids")
    before = lined.select((F.col("pos") + 1).alias("pos"), F.col("p").alias("p0"))
    behind = lined.select((F.col("pos") - 1).alias("pos"), F.col("p").alias("p2"), F.col("v").alias("v2"))
    kids = stage(
        lined.join(before, "pos", "left").join(behind, "pos", "left").select("v", "p", F.when(F.col("p2") == F.col("p"), F.col("v2")).alias("right"), (~F.coalesce(F.col("p0") == F.col("p"), F.lit(False))).alias("is_first")), "kids"
    )
    down, up = (lambda c: c * 2), (lambda c: c * 2 + 1)
    first = kids.where("is_first").select(F.col("p").alias("v"), F.col("v").alias("first"))
    downs = trees.join(first, "v", "left").select(down(F.col("v")).alias("a"), F.coalesce(down(F.col("first")), up(F.col("v"))).alias("nxt"), F.col("own").alias("w"), F.lit(1).cast("bigint").alias("l"))
    ups = trees.select("v").join(kids.select("v", "p", "right"), "v", "left").select(up(F.col("v")).alias("a"), F.coalesce(down(F.col("right")), up(F.col("p"))).alias("nxt"), F.lit(0).cast("bigint").alias("w"), F.lit(-1).cast("bigint").alias("l"))
    ranked = rank_arcs(stage(downs.unionByName(ups), "arcs"), core_rows)
    pairs = ranked.groupBy(F.expr("a div 2").alias("v")).agg(
        F.max(F.when(F.col("a") % 2 == 0, F.col("w"))).alias("after"), F.max(F.when(F.col("a") % 2 == 1, F.col("w"))).alias("rest"), F.max(F.when(F.col("a") % 2 == 0, F.col("l"))).alias("l")
    )
    pairs = stage(pairs, "pairs")
    whole = pairs.select(F.col("v").alias("top"), F.col("after").alias("whole"))
    inside = spread_join(trees.join(pairs, "v"), whole, "top", ["v"]).select("v", F.col("top").alias("root"), (-F.col("l")).alias("depth"), (F.col("whole") - F.col("after")).alias("entry"), (F.col("after") - F.col("rest")).alias("size"))
    return off.unionByName(inside)


# --- the operator --------------------------------------------------------------------------------


def build_hierarchy(links: DataFrame, *, parent: str, child: str, core_rows: int = CORE_ROWS) -> DataFrame:
    """(id, parent_id, root_id, depth, entry, exit, on_circle) of every id in `links`.

    entry and exit are null off the trees; entries are unique within a root.
    """
    pairs = stage(links.select(F.col(parent).alias("pid"), F.col(child).alias("cid")).dropna().groupBy("cid").agg(F.min("pid").alias("pid")), "links")
    ids = stage(dense_ordinals(links.select(F.col(parent).alias("pid"), F.col(child).alias("cid")).dropna().select(F.explode(F.array("pid", "cid")).alias("id")), ["id"], "v"), "ids")
    to_parent = ids.select(F.col("id").alias("pid"), F.col("v").alias("p"))
    edges = skew_join(pairs, to_parent, "pid", ["cid"], hot_keys(pairs, "pid")).join(ids.select(F.col("id").alias("cid"), "v"), "cid").select("v", "p")
    alive = stage(ids.select("v").join(edges, "v", "left").withColumn("own", F.lit(1).cast("bigint")), "alive")  # v, p, own = 1 + nodes peeled below

    peeled, done = [], None
    n = ids.count()
    while n > core_rows:
        inner = alive.where("p is not null").select(F.col("p").alias("v")).distinct()
        childless = alive.join(inner, "v", "left_anti")
        # A root left without children is finished; any other node without children is a leaf.
        alone = childless.where("p is null").select("v", F.col("v").alias("root"), *(F.lit(0).cast("bigint").alias(c) for c in ("depth", "entry")), F.col("own").alias("size"))
        done = alone if done is None else done.unionByName(alone)
        leaves = stage(placed(childless.where("p is not null")), "leaves")
        gained = leaves.groupBy(F.col("p").alias("v")).agg(F.sum("own").alias("more"))
        rest = stage(alive.join(inner, "v", "left_semi").join(gained, "v", "left").select("v", "p", (F.col("own") + F.coalesce("more", F.lit(0))).alias("own"), F.col("own").alias("before")), "rest")
        # Leaves of this round come after what the parent had gained before.
        starts = rest.select(F.col("v").alias("p"), F.col("before").alias("base"))
        peeled.append(spread_join(leaves, starts, "p", ["v"]).select("v", "p", (F.col("at") + F.col("base")).alias("at"), F.col("own").alias("size")))
        alive, m = rest.drop("before"), rest.count()
        tall = n - m < 0.05 * n  # peeling on would take a round per level
        n = m
        if tall:
            break
    core = alive.groupBy(F.lit("all").alias("_all")).applyInPandas(_finish, NODES) if n <= core_rows else tour_large(alive, core_rows)
    done = stage(core if done is None else core.unionByName(done), "core")
    for leaves in reversed(peeled):
        above = done.select(F.col("v").alias("p"), F.col("root"), F.col("depth").alias("d"), F.col("entry").alias("e"))
        off = F.col("d") < 0
        done = stage(
            done.unionByName(
                spread_join(leaves, above, "p", ["v"]).select(
                    "v", "root", F.when(off, BELOW_CIRCLE).otherwise(F.col("d") + 1).cast("bigint").alias("depth"), F.when(off, 0).otherwise(F.col("e") + F.col("at")).alias("entry"), F.when(off, 0).otherwise(F.col("size")).alias("size")
                )
            ),
            "done",
        )
    named = spread_join(done, ids.select(F.col("id").alias("root_id"), F.col("v").alias("root")), "root", ["v"], "left").join(ids, "v")
    named = named.join(pairs.select(F.col("cid").alias("id"), F.col("pid").alias("parent_id")), "id", "left")
    off = F.col("depth") < 0
    return named.select(
        "id", "parent_id", F.when(off, "").otherwise(F.col("root_id")).alias("root_id"), F.col("depth").cast("int").alias("depth"),
        F.when(~off, F.col("entry")).alias("entry"), F.when(~off, F.col("entry") + F.col("size")).alias("exit"), (F.col("depth") == ON_CIRCLE).alias("on_circle"),
    )


def placed(leaves: DataFrame, part: int = 4096) -> DataFrame:
    """Adds `at`: the sizes of the leaves before this one under the same parent.

    Two levels, so that no parent's leaves meet in one task: sums within
    ordinal ranges of `part`, then over the ranges.
    """
    cut = leaves.withColumn("_part", F.expr(f"v div {part}"))
    inner = Window.partitionBy("p", "_part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("p", "_part").agg(F.sum("own").alias("s"))
    outer = sums.withColumn("_base", F.coalesce(F.sum("s").over(Window.partitionBy("p").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return cut.withColumn("at", F.coalesce(F.sum("own").over(inner), F.lit(0))).join(outer.drop("s"), ["p", "_part"]).withColumn("at", F.col("at") + F.col("_base")).drop("_part", "_base")


def with_paths(tree: DataFrame) -> DataFrame:
    """Adds `path`, the ids from root to node, of every node on a tree (null otherwise).

    Doubling over the parent links: about log2(depth) joins, spread where many
    nodes share an ancestor; paths that are complete are not joined again. A
    path is as long as its node is deep, so this output, unlike the intervals,
    is not linear.
    """
    here = stage(tree.select("id", F.when(F.col("depth") > 0, F.col("parent_id")).alias("up"), F.when(F.col("depth") >= 0, F.array("id")).alias("path")), "paths")
    while here.where("up is not null").limit(1).count():
        above = here.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        moved = spread_join(here.where("up is not null"), above, "up", ["id"]).select("id", F.col("up2").alias("up"), F.concat("path2", "path").alias("path"))
        new = stage(here.where("up is null").unionByName(moved), "paths")
        drop_staged(here)
        here = new
    return tree.join(here.select("id", "path"), "id")


def count_descendants(tree: DataFrame) -> DataFrame:
    """Adds `n_descendants`, the length of the interval less one."""
    return tree.withColumn("n_descendants", F.col("exit") - F.col("entry") - 1)


def descendants_of(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """(ancestor_id, id) for the asked ancestors `ids`(id): an equi-join on the root with an interval test."""
    asked = tree.join(ids.select("id").distinct(), "id").where("depth >= 0").select(F.col("id").alias("ancestor_id"), "root_id", F.col("entry").alias("lo"), F.col("exit").alias("hi"))
    return tree.where("depth >= 0").join(asked, "root_id").where("entry > lo and entry < hi").select("ancestor_id", "id")


def all_descendants(tree: DataFrame, part: int = 4096) -> DataFrame:
    """(ancestor_id, id) for every node of a tree and every node below it, from the intervals.

    Entries number a tree's nodes without gaps, so each place inside an interval
    is one descendant, found by an equi-join. Intervals are cut into pieces of
    `part` places, so that no task unfolds a large one alone.
    """
    on = tree.where("depth >= 0").select("id", "root_id", "entry", "exit")
    pieces = on.where("exit - entry > 1").select(F.col("id").alias("ancestor_id"), "root_id", "exit", F.explode(F.expr(f"sequence(entry + 1, exit - 1, {part}L)")).alias("lo"))
    places = pieces.repartition("ancestor_id", "lo").select("ancestor_id", "root_id", F.explode(F.expr(f"sequence(lo, least(lo + {part - 1}L, exit - 1), 1L)")).alias("entry"))
    return places.join(on.select("root_id", "entry", "id"), ["root_id", "entry"]).select("ancestor_id", "id")
