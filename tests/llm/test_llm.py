"""Problems 6 to 8 against brute force, with nulls, empty and long texts, repeats, skew and empty tables."""

import random
import unicodedata
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from factloom import scratch
from factloom.llm import contamination, packing, rolling, shared_spans

DOC = "doc_id long, text string, doc string, h long"


def docs(spark, texts, first=1):
    return spark.createDataFrame([(None if k == -1 else k + first, t, "clash", 0) for k, t in enumerate(texts)], DOC)


# --- rolling hashes ------------------------------------------------------------------------------


def test_hashes_follow_content():
    text = "abcabcabc" + "ß\U0001f600" * 3
    sums = rolling.prefix_sums(rolling.code_points(text))
    seen = defaultdict(set)
    for k in (1, 3, 5):
        for i, h in enumerate(rolling.window_hashes(sums, k).tolist()):
            seen[h].add(text[i : i + k])
            assert h == int(rolling.hashes(sums, np.array([i]), np.array([i + k]))[0])
    assert all(len(v) == 1 for v in seen.values()) and len(seen) == len({text[i : i + k] for k in (1, 3, 5) for i in range(len(text) - k + 1)})
    x = np.random.default_rng(1).integers(0, 50, 100).astype(np.uint64)
    for w in (1, 7, 100, 101):
        assert rolling.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(100 - w + 1)]


# --- problem 6 -----------------------------------------------------------------------------------


def test_tokens_are_matches_of_the_pattern(spark):
    texts = ["", "  ", "It's  they'll\n\n x1 ?!é b\x1c", None, "a" * 5000]
    got = [r[0] for r in docs(spark, texts).select(packing.count_tokens("text")).collect()]
    assert got == [0 if t is None else len(regex.findall(packing.PATTERN, t)) for t in texts]
    assert packing.count_tokens.func(pd.Series(["ab " * 400_000]))[0] == len(regex.findall(packing.PATTERN, "ab " * 400_000))


def test_genetic_steps_keep_packings_sound():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 60, 300).astype(np.int32)

    def sound(bins):
        assert len(bins) == 300 and np.bincount(bins, weights=sizes).max() <= 100
        assert set(np.unique(bins)) == set(range(int(bins.max()) + 1))

    a, b = (packing.fresh(sizes, 100, rng, 0.4) for _ in range(2))
    for child in (a, b, packing.crossover(a, b, sizes, 100, rng), packing.mutate(a, sizes, 100, rng)):
        sound(child)
    best = packing.evolve(sizes, [], 100, 1)[0]
    sound(best)
    assert best.max() <= packing.fresh(sizes, 100, rng, 0.0).max()
    hard = np.array([51, 49, 34, 33, 33, 26, 25, 25, 24] * 6, np.int32)  # fills 100 exactly
    assert packing.evolve(hard, [], 100, 2)[0].max() + 1 <= 19


def test_evolution_beats_best_fit_where_that_is_poor():
    """Triplets that fill a container exactly: best fit wastes room, crossover and mutation win some of it back."""
    rng = np.random.default_rng(11)
    a = rng.integers(380, 490, 80)
    b = rng.integers(250, 300, 80)
    sizes = np.concatenate([a, b, 1000 - a - b]).astype(np.int32)
    alone = int(packing.fresh(sizes, 1000, rng, 0.0).max()) + 1
    people, score = [], []
    for epoch in range(6):
        people = packing.evolve(sizes, people, 1000, epoch, generations=30)
        score.append((int(people[0].max()) + 1, -packing.fitness(people[0], sizes, 1000)))
    assert score == sorted(score, reverse=True) and score[-1][0] < alone


def test_packing_without_evolution_and_with_text_ids(spark):
    df = spark.createDataFrame([(f"d{k}", 30 + k % 40) for k in range(120)], "id string, n int")
    for evolve in (True, False):
        out = packing.pack(df, id="id", size="n", capacity=100, block_items=50, evolve=evolve).toPandas()
        assert sorted(out["doc"]) == sorted(f"d{k}" for k in range(120)) and out.groupby("bin_id")["size"].sum().max() <= 100


@pytest.mark.parametrize("block", [4000, 25])
def test_packing(spark, block):
    rng = random.Random(block)
    sizes = [rng.choice([0, 1, 40, 99, 100, 101, 250, 300, 7]) for _ in range(220)] + [None]
    df = spark.createDataFrame([(k, n, "clash") for k, n in enumerate(sizes)] + [(None, 5, "x")], "id long, n long, piece string")
    out = packing.pack(df, id="id", size="n", capacity=100, block_items=block).toPandas()
    per = out.groupby("doc")
    assert per.ngroups == 221 and all(per.get_group(k)["size"].sum() == (n or 0) for k, n in enumerate(sizes))
    assert all(len(per.get_group(k)) == max(1, -(-(n or 0) // 100)) for k, n in enumerate(sizes))
    placed = out[out.bin_id.notna()]
    fill = placed.groupby("bin_id")["size"].sum()
    assert fill.max() <= 100 and (out[out.bin_id.isna()]["size"] == 0).all() and (placed["size"] > 0).all()
    assert (out["first_token"] == out["piece"] * 100).all()
    assert len(fill) <= -(-int(placed["size"].sum()) // 100) * 1.08 + 1
    assert packing.pack(df.limit(0), id="id", size="n").count() == 0


# --- problem 7 -----------------------------------------------------------------------------------


def words(t):
    return regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFKC", t).lower())


def brute_leaks(corpus, items, least):
    """(document, item) to longest match, stretches and words covered."""
    out = {}
    for d, t in corpus:
        for i, s in items:
            if t is None or s is None:
                continue
            a, b = words(t), words(s)
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            longest, covered = 0, set()
            for x in range(len(a)):
                for y in range(len(b)):
                    if a[x] == b[y]:
                        best[x + 1][y + 1] = best[x][y] + 1
                        longest = max(longest, best[x + 1][y + 1])
                        if best[x + 1][y + 1] >= least:
                            covered.add(x + 1 - least)
            if longest >= least:
                spots = sorted(covered)
                cells = {w for x in spots for w in range(x, x + least)}
                out[d, i] = (longest, 1 + sum(q - p > least for p, q in zip(spots, spots[1:])), len(cells))
    return out


@pytest.mark.parametrize("seed,kind", [(0, "long"), (1, "string")])
def test_leaks(spark, seed, kind, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(rolling, "BLOCK_CHARS", 300)
    monkeypatch.setattr(contamination, "SHARD_CHARS", 900)
    monkeypatch.setattr(contamination, "CHUNK", 7)
    vocab = ["Ärger", "ﬁx", "x1", "é", "foo", "bar", "Straße", "№5", "baz"]
    make = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", "--", "\n", ". "]) for _ in range(n))
    items = [(k, make(rng.randrange(3, 14))) for k in range(12)] + [(50, None), (51, ""), (52, "foo bar"), (53, "foo " * 9), (54, "foo " * 9)]
    corpus = [(k, make(rng.randrange(0, 40))) for k in range(30)]
    corpus += [(100 + k, make(5) + items[k % 3][1].upper() + make(5)) for k in range(40)] + [(200, None), (201, ""), (202, "?!"), (203, items[0][1] * 3), (204, items[0][1]), (205, "foo " * 30), (206, "foo " * 7)]
    left = spark.createDataFrame([(k, t, 9) for k, t in corpus], "doc_id long, text string, item long").withColumn("doc_id", F.col("doc_id").cast(kind))
    right = spark.createDataFrame(items, "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
    for chars in (4_000_000, 150):
        monkeypatch.setattr(contamination, "ITEM_CHARS", chars)
        found = contamination.find_leaks(left, right, id="doc_id", text="text", item="item_id", item_text="text", least=5)
        rows = found.collect()
        got = {(int(r["doc"]), int(r["item"])): (r["n_words"], r["n_passages"], r["n_covered"]) for r in rows}
        assert got == brute_leaks(corpus, items, 5) and len(rows) == len(got)
        for hit in rows:
            a, b = words(dict(corpus)[int(hit["doc"])]), words(dict(items)[int(hit["item"])])
            assert a[hit["doc_word"] : hit["doc_word"] + hit["n_words"]] == b[hit["item_word"] : hit["item_word"] + hit["n_words"]]
    clean = contamination.remove_leaks(left, found, id="doc_id")
    assert clean.count() == len(corpus) - len({d for d, _ in got})
    for l, r in ((left.limit(0), right), (left, right.limit(0))):
        assert contamination.find_leaks(l, r, id="doc_id", text="text", item="item_id", item_text="text", least=5).count() == 0


def test_leaks_of_texts_that_repeat_themselves():
    """Memory grows with the texts, not with the pairs of their places."""
    import tracemalloc

    tracemalloc.start()
    assert contamination.search_shard(["a " * 50_000], ["a " * 1_000], 13)
    found = contamination.search_shard(["x " + "a " * 50_000], ["a " * 1_000], 13)
    assert [(f[2], f[5], f[6]) for f in found] == [(1000, 1, 50_000)]
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


# --- problem 8 -----------------------------------------------------------------------------------


def brute_spans(corpus, span):
    holders = defaultdict(set)
    for d, t in corpus:
        for k in range(len(t or "") - span + 1):
            holders[t[k : k + span]].add(d)
    out = set()
    for d, t in corpus:
        covered = [False] * (len(t or "") + 1)
        for k in range(len(t or "") - span + 1):
            if len(holders[t[k : k + span]]) > 1:
                covered[k : k + span] = [True] * span
        k = 0
        while k < len(covered):
            if covered[k]:
                e = covered.index(False, k)
                out.add((d, k, e))
                k = e
            k += 1
    return out


@pytest.mark.parametrize("seed,span,anchor", [(0, 20, 6), (1, 12, 12), (2, 33, 8)])
def test_shared_spans(spark, seed, span, anchor, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(rolling, "BLOCK_CHARS", 400)
    make = lambda n: "".join(rng.choice("abé\U0001f600 d") for _ in range(n))
    plate = make(60)
    corpus = [(k, make(rng.randrange(0, 120))) for k in range(25)]
    corpus += [(100 + k, make(rng.randrange(9)) + plate[rng.randrange(30) :][: rng.randrange(60)] + make(rng.randrange(9))) for k in range(40)]
    corpus += [(200, "=" * 90), (201, "=" * 40 + "x"), (202, "-" * 80), (203, plate), (204, plate), (205, plate + plate), (206, make(50) * 2), (207, None), (208, ""), (209, make(19) + plate)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in corpus] + [(None, plate, 1, "x")], "doc_id long, text string, h long, sig string")
    out = shared_spans.shared_intervals(df, id="doc_id", text="text", span=span, anchor=anchor)
    assert {tuple(r) for r in out.select("doc", "start_pos", "end_pos").collect()} == brute_spans(corpus, span)
    cover = {r["doc"]: r["shared_chars"] for r in shared_spans.coverage(out).collect()}
    assert cover[204] == len(plate) and 206 not in cover
    assert shared_spans.shared_intervals(df.limit(0), id="doc_id", text="text").count() == 0


def test_shared_spans_with_a_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(scratch, "LEAST_PART", 3)
    monkeypatch.setattr(scratch, "MOST_PART", 3)
    monkeypatch.setattr(shared_spans, "BROADCAST_IDS", 1)
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    plate = make(50)
    corpus = [(k, make(15) + plate + make(15)) for k in range(60)]
    out = shared_spans.shared_intervals(spark.createDataFrame(corpus, "i long, t string"), id="i", text="t", span=24, anchor=8)
    assert {tuple(r) for r in out.select("doc", "start_pos", "end_pos").collect()} == brute_spans(corpus, 24)


def test_shared_spans_of_periodic_and_automatic_texts(spark):
    """Texts that collide modulo 2^64 whatever the base, and texts of one repeated passage."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    points = rolling.code_points(word + other)
    weak = rolling.hashes(rolling.prefix_sums(points), np.array([0, 2048]), np.array([2048, 4096]))
    assert weak[0] == weak[1]  # the hash that only chooses candidates
    for base in rolling.PRIME_BASES:
        strong = rolling.prime_hashes(rolling.prime_sums(points, base), np.array([0, 2048]), 2048, base)
        assert strong[0] != strong[1]
        at = np.array([5, 2000])
        power = lambda s, base=base: sum((int(points[s + k]) + 1) * pow(base, k, rolling.PRIME) for k in range(7)) % rolling.PRIME
        assert rolling.prime_hashes(rolling.prime_sums(points, base), at, 7, base).tolist() == [power(5), power(2000)]
    corpus = [("t1", word[:1200]), ("t2", other[:1200]), ("p1", "abc" * 200), ("p2", "x" + "abc" * 90), ("p3", "cab" * 30 + "y" * 300), ("p4", "y" * 299)]
    for span in (64, 300):
        out = shared_spans.shared_intervals(spark.createDataFrame(corpus, "i string, t string"), id="i", text="t", span=span, anchor=16)
        assert {tuple(r) for r in out.select("doc", "start_pos", "end_pos").collect()} == brute_spans(corpus, span)
