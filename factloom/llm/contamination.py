"""Problem 7: evaluation texts leaking into training text.

1. The corpus is read once, whatever the number of items. A document goes on if
   the hash of any `least` successive words of it is set in a Bloom filter of the
   hashes of the items' words; no leak is lost, and the filter's size is bounded.
2. Items lie in blocks of bounded size, and each document that is left meets the
   blocks that hold one of its hashes (a join; with one block all meet it).
3. The documents of a block are cut into shards. Each shard gets a suffix array
   of its words and those of the items, by prefix doubling: after round k equal
   ranks mean 2^k equal words, exactly. The suffixes of every item are
   binary-searched among those of the shard, which tells the documents that hold
   `least` of its words; then, in the part of the array that belongs to one
   document, the neighbours of each of the item's suffixes give its longest
   verbatim match and the place.

Pairs of places are never laid out, so texts that repeat themselves need memory
in proportion to their length. A document that leaks is one row per item.

Words are the maximal runs of letters and digits of the text in NFKC, lower case.

Nulls: a null text or id has no words. Items of fewer than `least` words can't
leak. Repeated items or documents are reported each. Empty tables give no rows.
Ids may be of any type.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.rolling import blocks, hashes, mix, prefix_sums, window_hashes
from factloom.scratch import spread_join, stage

#: Shared words in a row that count as a leak.
LEAST = 13
#: Items are searched in blocks of about so many characters, documents in shards of about so many.
ITEM_CHARS, SHARD_CHARS = 4_000_000, 4_000_000
#: Bits of the filter, at most: 16 MB, which is what is broadcast. Beyond some ten million item words more documents pass it, none is lost.
FILTER_BITS = 1 << 27
#: Odd factors, one for each place that a hash has in the filter.
PROBES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]
#: Rows of (place, document) pairs that are looked at together.
CHUNK = 1 << 21

_WORD = regex.compile(r"[\p{L}\p{N}]+")


@lru_cache(maxsize=1)
def word_points() -> np.ndarray:
    """For each code point whether it belongs to a word."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in "".join(_WORD.findall(every))]] = True
    return table


def folded(text: str | None) -> str | None:
    if text is None:
        return None
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


# --- the filter ----------------------------------------------------------------------------------


def gram_hashes(starts: np.ndarray, points: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid end to end: the hash of each `least` successive words of one text, and the text it is in."""
    is_word = word_points()[points]
    edge = np.zeros(len(points) + 1, bool)
    edge[starts] = True
    before = np.r_[False, is_word[:-1]] & ~edge[:-1]
    after = np.r_[is_word[1:], False] & ~edge[1:]
    s, e = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    text = np.searchsorted(starts, s, side="right") - 1
    if len(s) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = mix(window_hashes(prefix_sums(mix(hashes(prefix_sums(points), s, e))), least))
    whole = text[: len(grams)] == text[least - 1 :]
    return grams[whole].view(np.int64), text[: len(grams)][whole]


def _grams_of_items(least: int):
    def run(batches):
        for df in batches:
            block = df["block"].to_numpy()
            for at, starts, points in blocks(range(len(df)), map(folded, df["text"])):
                grams, text = gram_hashes(starts, points, least)
                yield pd.DataFrame({"gram": grams, "block": block[at[text]]}).drop_duplicates()

    return run


def probes(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places of each gram in a filter of 2^bits bits."""
    return [(grams.view(np.uint64) * np.uint64(odd)) >> np.uint64(64 - bits) for odd in PROBES]


def filter_of(grams: DataFrame, most: int = FILTER_BITS) -> np.ndarray:
    """A bitmap with every probe of each gram set, about 64 bits a gram, at most `most` bits. What is collected has a row per 64 bits."""
    n, bits = grams.count(), 16
    while 1 << bits < most and 1 << bits < 64 * n:
        bits += 1

    def run(batches):
        for df in batches:
            place = np.unique(np.concatenate(probes(df["gram"].to_numpy(np.int64), bits)))
            yield pd.DataFrame({"at": (place >> np.uint64(6)).astype(np.int64), "bits": (np.uint64(1) << (place & np.uint64(63))).view(np.int64)})

    words = grams.select("gram").mapInPandas(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros((1 << bits) // 64, np.int64)
    out[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _candidates(filled: np.ndarray, least: int):
    bits = (len(filled) * 64 - 1).bit_length()

    def run(batches):
        for df in batches:
            for at, starts, points in blocks(range(len(df)), map(folded, df["text"])):
                grams, text = gram_hashes(starts, points, least)
                hit = np.ones(len(grams), bool)
                for place in probes(grams, bits):
                    hit &= (filled[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                found = pd.DataFrame({"at": at[text[hit]], "gram": grams[hit]}).drop_duplicates()
                if len(found):
                    per = found.groupby("at")["gram"].agg(list)
                    yield pd.DataFrame({"doc": df["doc"].to_numpy()[per.index], "text": df["text"].to_numpy()[per.index], "grams": per.to_numpy()})

    return run


# --- one shard -----------------------------------------------------------------------------------


class Texts:
    """Runs of words laid end to end, and exact ranks of their suffixes."""

    def __init__(self, runs: list[np.ndarray], longest: int):
        self.words = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        lengths = np.array([len(r) for r in runs], np.int64)
        self.first = np.cumsum(lengths) - lengths
        self.end = np.repeat(np.cumsum(lengths), lengths)  # of the run, for each place
        ranks = np.unique(self.words, return_inverse=True)[1].astype(np.int64)
        self.levels = [ranks]
        k = 1
        while k < longest:
            ahead = np.arange(len(ranks)) + k
            inside = ahead < self.end
            second = np.zeros(len(ranks), np.int64)
            second[inside] = ranks[ahead[inside]] + 1  # what ends sorts first
            ranks = np.unique(ranks * (len(ranks) + 1) + second, return_inverse=True)[1].astype(np.int64)
            self.levels.append(ranks)
            k *= 2

    def classes(self, at: np.ndarray, length: int) -> np.ndarray:
        """Numbers that are equal for places with the same `length` words ahead, by two overlapping stretches."""
        k = length.bit_length() - 1
        ranks = self.levels[k]
        return ranks[at] * (len(ranks) + 1) + ranks[at + length - (1 << k)]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b."""
        n, rest = np.zeros(len(a), np.int64), np.minimum(self.end[a] - a, self.end[b] - b)
        for k in range(len(self.levels) - 1, -1, -1):
            live = np.flatnonzero(n < rest)
            live = live[self.levels[k][a[live] + n[live]] == self.levels[k][b[live] + n[live]]]
            n[live] += 1 << k
        return np.minimum(n, rest)  # ranks of suffixes that end are equal only if all of both is


def _long_runs(words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches of at least `least` words that are known (not 0)."""
    known = np.r_[False, words > 0, False]
    s, e = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(~known[1:] & known[:-1])
    return [(a, b) for a, b in zip(s.tolist(), e.tolist()) if b - a >= least]


def _pairs(doc_keys: np.ndarray, doc_of: np.ndarray, item_keys: np.ndarray, item_of: np.ndarray) -> list[tuple[int, int]]:
    """Distinct (document, item) that share a key: the items' keys are binary-searched in the sorted keys of the documents."""
    docs = np.unique(np.stack([doc_keys, doc_of], axis=1), axis=0)
    items = np.unique(np.stack([item_keys, item_of], axis=1), axis=0)
    lo, hi = np.searchsorted(docs[:, 0], items[:, 0], side="left"), np.searchsorted(docs[:, 0], items[:, 0], side="right")
    found, n_items = np.zeros(0, np.int64), int(item_of.max()) + 1 if len(item_of) else 1
    cuts = np.searchsorted(np.cumsum(hi - lo), np.arange(CHUNK, int((hi - lo).sum()) + CHUNK, CHUNK), side="left")
    begin = 0
    for stop in (*(cuts + 1).tolist(), len(items)):
        part = slice(begin, min(stop, len(items)))
        n = (hi - lo)[part]
        at = np.repeat(lo[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found = np.union1d(found, docs[at, 1] * n_items + np.repeat(items[part, 1], n))
        begin = part.stop
    return [(int(x) // n_items, int(x) % n_items) for x in found]


def search_shard(doc_texts: list[str], item_texts: list[str], least: int) -> list[tuple]:
    """(document, item, n_words, doc_word, item_word, n_passages, n_covered) by their places in the lists.

    n_words is the longest match, doc_word and item_word where it begins. The
    places of a document that stand in matches of at least `least` words make up
    n_passages stretches of n_covered words.
    """
    vocabulary: dict[str, int] = {}
    item_runs = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in _WORD.findall(folded(t))], np.int64) for t in item_texts]
    runs, run_doc, run_word = list(item_runs), [], []
    for k, t in enumerate(doc_texts):
        words = np.array([vocabulary.get(w, 0) for w in _WORD.findall(folded(t))], np.int64)
        for a, b in _long_runs(words, least):
            runs.append(words[a:b])
            run_doc.append(k)
            run_word.append(a)
    if not run_doc:
        return []
    texts = Texts(runs, max(least, *(len(r) for r in item_runs)))
    n_items, n_item_words = len(item_runs), int(sum(len(r) for r in item_runs))
    place = np.arange(len(texts.words))
    long = place[place + least <= texts.end]  # suffixes long enough to count
    of_run = np.searchsorted(texts.first, long, side="right") - 1
    keys = np.unique(texts.classes(long, least), return_inverse=True)[1]
    is_item = long < n_item_words
    item_at, item_of, item_keys = long[is_item], of_run[is_item], keys[is_item]
    doc_at, doc_run, doc_keys = long[~is_item], of_run[~is_item] - n_items, keys[~is_item]
    doc_of = np.array(run_doc, np.int64)[doc_run]
    doc_word = doc_at - texts.first[doc_run + n_items] + np.array(run_word, np.int64)[doc_run]
    top = texts.levels[-1]
    by_doc = np.lexsort((top[doc_at], doc_of))  # one suffix array per document, side by side
    doc_edge = np.searchsorted(doc_of[by_doc], np.arange(len(doc_texts) + 1))
    item_edge = np.searchsorted(item_of, np.arange(n_items + 1))
    out = []
    for d, i in _pairs(doc_keys, doc_of, item_keys, item_of):
        mine = by_doc[doc_edge[d] : doc_edge[d + 1]]
        asked = slice(item_edge[i], item_edge[i + 1])
        t = item_at[asked]
        j = np.searchsorted(top[doc_at[mine]], top[t])
        best = None
        for near in (np.maximum(j - 1, 0), np.minimum(j, len(mine) - 1)):
            n = texts.common(doc_at[mine[near]], t)
            k = int(n.argmax())
            if best is None or n[k] > best[0]:
                best = (int(n[k]), int(doc_word[mine[near[k]]]), int(t[k] - texts.first[i]))
        covered = np.sort(doc_word[mine[np.isin(doc_keys[mine], item_keys[asked])]])
        gap = np.diff(covered)
        out.append((d, i, *best, int((gap > least).sum()) + 1, int(np.minimum(gap, least).sum()) + least))
    return out


# --- over the cluster ----------------------------------------------------------------------------


def find_leaks(docs: DataFrame, evals: DataFrame, *, id: str, text: str, item: str, item_text: str, least: int = LEAST) -> DataFrame:
    """(doc, item, n_words, doc_word, item_word, n_passages, n_covered): each document and item that share at least `least` words in a row.

    The fields are those of `search_shard`; words are counted from 0.
    """
    spark = docs.sparkSession
    doc_type, item_type = docs.schema[id].dataType.simpleString(), evals.schema[item].dataType.simpleString()
    texts = docs.select(F.col(id).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    asked = evals.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    n_blocks = max(1, -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // ITEM_CHARS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)))
    grams = stage(asked.select("text", "block").mapInPandas(_grams_of_items(least), "gram bigint, block bigint").distinct(), "grams")
    filled = filter_of(grams, FILTER_BITS)
    kept = stage(texts.mapInPandas(_candidates(filled, least), f"doc {doc_type}, text string, grams array<bigint>"), "candidates")
    if n_blocks == 1:
        routed = kept.select("doc", "text", F.col("doc").isNull().cast("bigint").alias("block"))  # 0
    else:
        wanted = spread_join(kept.select("doc", F.explode("grams").alias("gram")), grams, "gram", ["doc"]).select("doc", "block").distinct()
        routed = stage(kept.select("doc", "text").join(wanted, "doc"), "routed")
    sizes = routed.groupBy("block").agg(F.ceil(F.sum(F.length("text")) / SHARD_CHARS).cast("bigint").alias("shards")).collect()  # a row per block of items
    shards = F.broadcast(spark.createDataFrame([(r["block"], max(1, r["shards"])) for r in sizes], "block bigint, shards bigint"))
    left = routed.join(shards, "block").select("block", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("shards")).alias("shard"), "doc", "text")
    right = asked.join(shards, "block").select("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard"), "item", "text")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = search_shard(a["text"].tolist(), b["text"].tolist(), least) if len(a) and len(b) else []
        cols = ["n_words", "doc_word", "item_word", "n_passages", "n_covered"]
        out = pd.DataFrame([f[2:] for f in found], columns=cols)
        out.insert(0, "doc", [a["doc"].iat[f[0]] for f in found])
        out.insert(1, "item", [b["item"].iat[f[1]] for f in found])
        return out

    schema = f"doc {doc_type}, item {item_type}, n_words int, doc_word int, item_word int, n_passages int, n_covered int"
    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(search, schema)


def remove_leaks(docs: DataFrame, leaks: DataFrame, *, id: str) -> DataFrame:
    """`docs` without the documents that hold a passage of an item."""
    bad = leaks.select(F.col("doc").alias(id)).distinct()
    return docs.join(bad, id, "left_anti")
