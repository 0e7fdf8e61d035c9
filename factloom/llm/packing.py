"""Problem 6: filling fixed-capacity containers with items.

A grouping genetic algorithm. An individual is a complete packing; crossover
injects whole well-filled bins of one parent into the other, removes the bins
that now hold duplicates, and puts the displaced items back, by replacing
smaller ones where that fills a bin better and by best fit. Items are dealt to
blocks of about `BLOCK_ITEMS`; each block is evolved on several islands, whose
elites migrate between epochs in a ring. The poorly filled bins of all blocks
are dissolved and packed once more together, level by level, as long as that
leaves at most half of the items and more than one block.

An island begins with best fit of the items by falling size and stops as soon as
no packing can have fewer bins (the sizes' sum over the capacity, rounded up),
so that where best fit is as good as can be, nothing is left to evolve.
`evolve=False` leaves the islands with that first packing, to compare.

An item larger than the capacity is split into full pieces and a rest; no other
item is split. A full piece fills a bin of its own.

Nulls: an item without id is left out; one of null or zero size gets a null
bin. Repeated ids are separate items only if their pieces differ; ids are taken
as unique, and may be of any type that sorts. Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.scratch import stage

#: The splitting pattern published with the GPT-2 tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_ITEMS = 4000
ISLANDS, EPOCHS, POPULATION, GENERATIONS, ELITES = 2, 2, 6, 6, 2
#: Bins below this fill are packed again with those of other blocks.
POOR_FILL = 0.97

_SPLIT = regex.compile(PATTERN)


@F.pandas_udf(T.LongType())
def count_tokens(texts: pd.Series) -> pd.Series:
    """Matches of the splitting pattern; 0 for null."""
    return texts.map(lambda t: 0 if t is None else sum(1 for _ in _SPLIT.finditer(t)) if len(t) > 1_000_000 else len(_SPLIT.findall(t))).astype("int64")


# --- one packing ---------------------------------------------------------------------------------


def best_fit(sizes: list[int], order: list[int], bins: list[int], room: list[int], capacity: int) -> None:
    """Puts the items of `order` each into the open bin it fills best, or a new one. `bins` (item to bin) and `room` (bin to room left) change in place."""
    open_bins: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        if r > 0:
            open_bins.setdefault(r, []).append(b)
            mask |= 1 << r
    for i in order:
        s = sizes[i]
        fits = mask >> s
        if fits:
            r = (fits & -fits).bit_length() - 1 + s
            stack = open_bins[r]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << r)
            r -= s
        else:
            b, r = len(room), capacity - s
            room.append(r)
        room[b] = r
        bins[i] = b
        if r:
            open_bins.setdefault(r, []).append(b)
            mask |= 1 << r


def compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Mean squared fill: of packings with equally many bins, the one with fuller full bins."""
    fill = np.bincount(bins, weights=sizes) / capacity
    return float((fill * fill).mean())


def fresh(sizes: np.ndarray, capacity: int, rng: np.random.Generator, noise: float) -> np.ndarray:
    order = np.argsort(-(sizes * (1 + noise * rng.random(len(sizes)))), kind="stable")
    bins = [0] * len(sizes)
    best_fit(sizes.tolist(), order.tolist(), bins, [], capacity)
    return np.array(bins, np.int32)


def reinsert(bins: np.ndarray, out: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Puts the items `out` (mask), whose bins have been emptied, back among the others.

    First each item that stays gives its place to the largest free one that is
    larger and still fits, so that the free items become smaller and the bins
    fuller; then the free ones are best-fitted.
    """
    kept = np.flatnonzero(~out)
    new = np.full(len(bins), -1, np.int64)
    new[kept] = compact(bins[kept]) if len(kept) else 0
    room = (capacity - np.bincount(new[kept], weights=sizes[kept]).astype(np.int64)).tolist() if len(kept) else []
    free = sorted(zip(sizes[out].tolist(), np.flatnonzero(out).tolist()))
    size_of, at = sizes.tolist(), new.tolist()
    for i in kept.tolist():
        b, s = at[i], size_of[i]
        if room[b] > 0 and free:
            k = bisect_right(free, (s + room[b], len(bins))) - 1
            if k >= 0 and free[k][0] > s:
                p, j = free.pop(k)
                at[j], at[i] = b, -1
                room[b] -= p - s
                insort(free, (s, i))
    best_fit(size_of, [i for _, i in sorted(free, key=lambda x: (-x[0], x[1]))], at, room, capacity)
    return np.array(at, np.int32)


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Well-filled bins of b, whole, into a; a's bins with duplicates go, their other items are put back."""
    fill = np.bincount(b, weights=sizes)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, len(good) // 5), replace=False)] = True
    injected = chosen[b]
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[injected]] = True
    displaced = hit[a] & ~injected
    child = np.where(injected, int(a.max()) + 1 + b, a)
    return reinsert(child, displaced, sizes, capacity)


def mutate(a: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolves some of the emptiest bins and a few others."""
    fill = np.bincount(a, weights=sizes)
    gone = np.zeros(len(fill), bool)
    gone[np.argsort(fill)[: max(2, len(fill) // 50)]] = True
    gone[rng.integers(0, len(fill), max(1, len(fill) // 50))] = True
    return reinsert(a, gone[a], sizes, capacity)


def evolve(sizes: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS) -> list[np.ndarray]:
    """One epoch of one island: the best packings, best first."""
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    people = list(elites)
    while len(people) < POPULATION:
        people.append(fresh(sizes, capacity, rng, 0.0 if not people else 0.3 * rng.random()))
        if int(people[-1].max()) + 1 <= least:
            break  # no packing has fewer bins
    score = lambda p: (-(int(p.max()) + 1), fitness(p, sizes, capacity))
    people.sort(key=score, reverse=True)
    idle = 0
    for _ in range(generations):
        if int(people[0].max()) + 1 <= least or idle >= 3 or len(people) < 2:
            break
        best = score(people[0])
        for _ in range(POPULATION // 2):
            i, j = rng.choice(len(people), 2, replace=False)
            child = crossover(people[min(i, j)], people[max(i, j)], sizes, capacity, rng)
            people.append(mutate(child, sizes, capacity, rng) if rng.random() < 0.5 else child)
        people.sort(key=score, reverse=True)
        del people[POPULATION:]
        idle = 0 if score(people[0]) > best else idle + 1
    return people[:ELITES]


# --- over the cluster ----------------------------------------------------------------------------


def _gather(df: pd.DataFrame) -> pd.DataFrame:
    df = df.sort_values(["doc", "piece"])
    blob = lambda c, t: df[c].to_numpy(t).tobytes()
    return pd.DataFrame({"block": [int(df["block"].iat[0])], "docs": [df["doc"].tolist()], "pieces": [blob("piece", np.int64)], "sizes": [blob("size", np.int32)]})


def _epoch(capacity: int, epoch: int, evolving: bool):
    def run(batches):
        for df in batches:
            out = []
            for row in df.itertuples(index=False):
                sizes = np.frombuffer(row.sizes, np.int32)
                met = [np.frombuffer(e, np.int32) for e in (row.elites if row.elites is not None else [])]
                seed = (row.block * ISLANDS + row.island) * EPOCHS + epoch
                best = evolve(sizes, met, capacity, seed) if evolving else [fresh(sizes, capacity, np.random.default_rng(seed), 0.0)]
                out.append((row.block, row.island, row.docs, row.pieces, row.sizes, [e.astype(np.int32).tobytes() for e in best]))
            if out:
                yield pd.DataFrame(out, columns=["block", "island", "docs", "pieces", "sizes", "elites"])

    return run


def _settle(capacity: int):
    def run(batches):
        for df in batches:
            for row in df.itertuples(index=False):
                sizes = np.frombuffer(row.sizes, np.int32)
                people = [np.frombuffer(e, np.int32) for e in row.elites]
                best = max(people, key=lambda p: (-(int(p.max()) + 1), fitness(p, sizes, capacity)))
                fill = np.bincount(best, weights=sizes).astype(np.int64)
                yield pd.DataFrame({"doc": list(row.docs), "piece": np.frombuffer(row.pieces, np.int64), "size": sizes, "block": row.block, "bin": best, "fill": fill[best]})

    return run


def pack_blocks(items: DataFrame, capacity: int, n_blocks: int, level: int, evolving: bool = True) -> DataFrame:
    """(doc, piece, size, block, bin, fill) of items (doc, piece, size) below the capacity."""
    kind = items.schema["doc"].dataType.simpleString()
    block = f"docs array<{kind}>, pieces binary, sizes binary"
    dealt = items.select("doc", "piece", "size", F.pmod(F.xxhash64("doc", "piece", F.lit(level)), F.lit(n_blocks)).alias("block"))
    gathered = dealt.groupBy("block").applyInPandas(_gather, f"block bigint, {block}")
    islands = ISLANDS if evolving else 1
    state = gathered.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "docs", "pieces", "sizes", F.lit(None).cast("array<binary>").alias("elites"))
    epochs = EPOCHS if evolving else 1
    # A number is named, since islands are few bytes but much work: left to itself the engine would put them into few tasks.
    tasks = min(islands * n_blocks, 4 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for epoch in range(epochs):
        state = stage(state.repartition(tasks, F.col("block"), F.col("island")).mapInPandas(_epoch(capacity, epoch, evolving), f"block bigint, island int, {block}, elites array<binary>"), "islands")
        if epoch < epochs - 1:  # the elites go on to the next island, which keeps its own best too
            guests = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elites").alias("guests"))
            state = state.join(guests.hint("merge"), ["block", "island"]).select("block", "island", "docs", "pieces", "sizes", F.concat(F.slice("elites", 1, 1), "guests").alias("elites"))
    best = state.groupBy("block").agg(F.first("docs").alias("docs"), F.first("pieces").alias("pieces"), F.first("sizes").alias("sizes"), F.flatten(F.collect_list("elites")).alias("elites"))
    return stage(best.mapInPandas(_settle(capacity), f"doc {kind}, piece bigint, size int, block bigint, bin int, fill bigint"), "packed")


def pieces(sizes: DataFrame, *, id: str, size: str, capacity: int) -> DataFrame:
    """(doc, piece, size) of the items: those above the capacity in full pieces and a rest, the others whole."""
    sized = sizes.select(F.col(id).alias("doc"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n")).where("doc is not null")
    cut = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {capacity}"))))
    return sized.select("doc", "n", cut.alias("piece")).select("doc", "piece", F.least(F.lit(capacity).cast("bigint"), F.expr(f"n - piece * {capacity}")).cast("int").alias("size"))


def pack(sizes: DataFrame, *, id: str, size: str, capacity: int = 1024, block_items: int = BLOCK_ITEMS, evolve: bool = True) -> DataFrame:
    """(doc, piece, first_token, size, bin_id) of each item or piece; a bin_id is unique, null for items without size."""
    items = stage(pieces(sizes, id=id, size=size, capacity=capacity), "items")
    naming = lambda level: F.concat(F.lit(f"{level}-"), F.col("block").cast("string"), F.lit("-"), F.col("bin").cast("string"))
    out = items.where(f"size = {capacity}").select("doc", "piece", "size", F.concat(F.lit("full-"), F.col("doc").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("bin_id"))
    out = out.unionByName(items.where("size <= 0").select("doc", "piece", "size", F.lit(None).cast("string").alias("bin_id")))
    open_items = items.where(f"size > 0 and size < {capacity}").select("doc", "piece", "size")
    n, level, before = open_items.count(), 0, None
    while n:
        n_blocks = -(-n // block_items)
        packed = pack_blocks(open_items, capacity, n_blocks, level, evolve)
        poor = packed.where(F.col("fill") < F.lit(POOR_FILL * capacity))
        left = 0 if n_blocks == 1 else poor.count()
        # One block is all there is to pack together; and bins that stay poor in spite of new company would stay so again.
        last = n_blocks == 1 or before is not None and 2 * n > before
        good = packed if last else packed.where(F.col("fill") >= F.lit(POOR_FILL * capacity))
        out = out.unionByName(good.select("doc", "piece", "size", naming(level).alias("bin_id")))
        open_items, before, n = poor.select("doc", "piece", "size"), n, 0 if last else left
        level += 1
    return out.select("doc", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("first_token"), "size", "bin_id")


def sizes_of(docs: DataFrame, *, id: str, text: str) -> DataFrame:
    """(id, n): the tokens of each text, staged."""
    return stage(docs.select(F.col(id).alias("id"), count_tokens(F.col(text)).alias("n")), "sizes")


def pack_texts(docs: DataFrame, *, id: str, text: str, capacity: int = 1024) -> DataFrame:
    """`pack` of texts, each as large as it has tokens."""
    return pack(sizes_of(docs, id=id, text=text), id="id", size="n", capacity=capacity)
