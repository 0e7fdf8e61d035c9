"""Queries of the training-data problems 6 to 8."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import contamination, packing, shared_spans
from factloom.scratch import stage
from factloom.session import table


#: Tokens in a container.
CAPACITY = 1024


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    """The container of each text or piece."""
    out = packing.pack_texts(table(spark, d, "documents"), id="doc_id", text="text", capacity=CAPACITY)
    return out.select(F.col("doc").alias("doc_id"), "piece", "first_token", F.col("size").alias("n_tokens"), "bin_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that were split: those of more tokens than a container holds."""
    return p6_packing(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The texts and pieces that are laid into containers, without the containers."""
    return p6_packing(spark, d).select("doc_id", "piece", "first_token", "n_tokens")


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What any sound filling has: items and tokens all there, no container over its capacity, no needless split, full pieces alone."""
    out = stage(p6_packing(spark, d), "packing")
    bins = out.where("bin_id is not null").groupBy("bin_id").agg(F.sum("n_tokens").alias("fill"), F.count(F.lit(1)).alias("n"), F.max("n_tokens").alias("largest"))
    bad = bins.agg(F.count_if(F.col("fill") > CAPACITY).alias("n_overfull"), F.count_if((F.col("largest") == CAPACITY) & (F.col("n") > 1)).alias("n_crowded"))
    per_doc = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.count_distinct("piece").alias("k"))
    docs = per_doc.agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("t").alias("n_tokens"), F.sum("n").alias("n_pieces"), F.count_if(F.col("n") != F.greatest(F.lit(1), F.ceil(F.col("t") / CAPACITY))).alias("n_needless"), F.count_if(F.col("n") != F.col("k")).alias("n_repeated")
    )
    lost = out.agg(F.count_if(F.col("bin_id").isNull() & (F.col("n_tokens") > 0)).alias("n_unplaced"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  three rows side by side
    return one(docs).join(one(bad), "_one").join(one(lost), "_one").drop("_one")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, those of best fit alone over the same blocks, the least possible number, and the mean fill."""
    sizes = packing.sizes_of(table(spark, d, "documents"), id="doc_id", text="text")
    bins = lambda evolve: packing.pack(sizes, id="id", size="n", capacity=CAPACITY, evolve=evolve).where("bin_id is not null")
    used = bins(True).agg(F.countDistinct("bin_id").alias("n_bins"), F.sum("size").alias("n_tokens"))
    plain = bins(False).agg(F.countDistinct("bin_id").alias("n_bins_best_fit"))
    both = used.withColumn("_one", F.lit(1)).join(plain.withColumn("_one", F.lit(1)), "_one")
    return both.select("n_bins", "n_bins_best_fit", "n_tokens", F.ceil(F.col("n_tokens") / CAPACITY).alias("least_bins"), F.round(F.col("n_tokens") / (F.col("n_bins") * CAPACITY), 6).alias("fill"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return contamination.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), id="doc_id", text="text", item="item_id", item_text="text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold 13 or more successive words of an item, with the item."""
    return _leaks(spark, d).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p7_longest(spark: SparkSession, d: str) -> DataFrame:
    """The longest leaked passage of each document and item, and how many stretches and words of the document stand in the item."""
    return _leaks(spark, d).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_words", "n_passages", "n_covered")


def p7_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay when those with leaks are removed."""
    return contamination.remove_leaks(table(spark, d, "documents").select("doc_id", "source", "n_chars"), _leaks(spark, d), id="doc_id")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_intervals(table(spark, d, "documents"), id="doc_id", text="text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Maximal runs of characters that stand in another document too, in spans of 256 or more."""
    return _spans(spark, d).select(F.col("doc").alias("doc_id"), "start_pos", "end_pos")


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document is shared with others."""
    docs = table(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("n_chars"))
    shares = shared_spans.coverage(_spans(spark, d)).withColumnRenamed("doc", "doc_id")
    out = docs.join(shares, "doc_id", "left").na.fill(0, ["n_chars", "n_spans", "shared_chars"])
    return out.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))


QUERIES = {f.__name__: f for f in (p6_found, p6_packing, p6_pieces, p6_invariants, p6_fill, p7_found, p7_longest, p7_clean_documents, p8_found, p8_coverage)}
# The pattern without look-ahead: a mark (U+E000) parts the last of several white spaces from the others.
_P6_SIZES = r"""
with w as (select doc_id, regexp_replace(text, '([\t-\r\x{85}\p{Z}]+)([\t-\r\x{85}\p{Z}][^\t-\r\x{85}\p{Z}])', '\1' || chr(57344) || '\2', 'g') as t from documents),
size as (select doc_id, coalesce(len(regexp_extract_all(t, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\t-\r\x{85}\x{E000}\p{Z}\p{L}\p{N}]+|[\t-\r\x{85}\p{Z}]+')), 0) as n from w)
"""
P6_FOUND_SQL = _P6_SIZES + "select doc_id from size where n > 1024"
P6_PIECES_SQL = _P6_SIZES + """, cut as (select doc_id, n, unnest(range(greatest(1, (n + 1023) // 1024))) as k from size)
select doc_id, k::int as piece, k * 1024 as first_token, least(1024, n - k * 1024)::int as n_tokens from cut"""
P6_INVARIANTS_SQL = _P6_SIZES + """select count(*) as n_docs, sum(n)::bigint as n_tokens, sum(greatest(1, (n + 1023) // 1024))::bigint as n_pieces,
0::bigint as n_needless, 0::bigint as n_repeated, 0::bigint as n_overfull, 0::bigint as n_crowded, 0::bigint as n_unplaced from size"""



def _nfkc(text: str) -> str:
    """SQL for NFKC, which DuckDB lacks: its NFC after the compatibility forms of one character, and the Latin ligatures, were replaced; longer forms stay."""
    own = lambda c: unicodedata.normalize("NFKC", c)
    single = [c for c in map(chr, [*range(0xA0, 0xD800), *range(0xE000, 0x10000)]) if len(own(c)) == 1 and own(c) != unicodedata.normalize("NFC", c)]
    quoted = lambda chars: "'" + "".join(chars).replace("'", "''") + "'"
    for c in map(chr, range(0xFB00, 0xFB07)):
        text = f"replace({text}, '{c}', '{own(c)}')"
    return f"nfc_normalize(translate({text}, {quoted(single)}, {quoted(map(own, single))}))"


_P7_GRAMS = rf"""
with dw as (select doc_id, regexp_extract_all(lower({_nfkc('text')}), '[\p{{L}}\p{{N}}]+') as w from documents where text is not null),
iw as (select item_id, regexp_extract_all(lower({_nfkc('text')}), '[\p{{L}}\p{{N}}]+') as w from eval_items),
dg as (select doc_id, i, array_to_string(w[i:i+12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from dw where len(w) >= 13)),
ig as (select item_id, i, array_to_string(w[i:i+12], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 11)) as i from iw where len(w) >= 13))
"""
_P7_DISTINCT = """, dd as (select distinct doc_id, g from dg), ii as (select distinct item_id, g from ig) select distinct doc_id, item_id from dd join ii using (g)"""
P7_FOUND_SQL = _P7_GRAMS + _P7_DISTINCT
P7_LONGEST_SQL = _P7_GRAMS + """, hit as (select doc_id, item_id, dg.i, dg.i - ig.i as diagonal from dg join ig using (g)),
runs as (select doc_id, item_id, diagonal, i - row_number() over (partition by doc_id, item_id, diagonal order by i) as run from hit),
longest as (select doc_id, item_id, max(n) + 12 as n_words from (select doc_id, item_id, count(*) as n from runs group by doc_id, item_id, diagonal, run) group by all),
spots as (select distinct doc_id, item_id, i from hit), gaps as (select *, i - lag(i) over (partition by doc_id, item_id order by i) as gap from spots),
cover as (select doc_id, item_id, (count(*) filter (gap > 13) + 1)::int as n_passages, (sum(case when gap is null then 13 else least(gap, 13) end))::int as n_covered from gaps group by all)
select doc_id, item_id, n_words::int as n_words, n_passages, n_covered from longest join cover using (doc_id, item_id)"""
P7_CLEAN_SQL = f"with bad as ({P7_FOUND_SQL}) select doc_id, source, n_chars from documents where doc_id not in (select doc_id from bad)"

P8_FOUND_SQL = r"""
with t as (select doc_id, text from documents where length(text) >= 256),
w as (select doc_id, i, hash(substring(text, i + 1, 256)) as h from (select doc_id, text, unnest(range(length(text) - 255)) as i from t)),
two as (select h from w group by h having min(doc_id) < max(doc_id)),
s as (select doc_id, i from w where h in (select h from two)),
g as (select doc_id, i, sum(case when i - p <= 256 then 0 else 1 end) over (partition by doc_id order by i) as g from (select doc_id, i, coalesce(lag(i) over (partition by doc_id order by i), -1000) as p from s))
select doc_id, min(i)::int as start_pos, (max(i) + 256)::int as end_pos from g group by doc_id, g
"""
P8_COVERAGE_SQL = f"""
with found as ({P8_FOUND_SQL}), c as (select doc_id, count(*) as n_spans, sum(end_pos - start_pos)::bigint as shared_chars from found group by 1)
select d.doc_id, coalesce(length(d.text), 0)::bigint as n_chars, coalesce(n_spans, 0) as n_spans, coalesce(shared_chars, 0) as shared_chars, case when length(d.text) > 0 then coalesce(shared_chars, 0) / length(d.text) else 0.0 end as share
from documents d left join c using (doc_id)
"""

SQL = {
    "p6_found": P6_FOUND_SQL, "p6_pieces": P6_PIECES_SQL, "p6_invariants": P6_INVARIANTS_SQL, "p7_found": P7_FOUND_SQL, "p7_longest": P7_LONGEST_SQL,
    "p7_clean_documents": P7_CLEAN_SQL, "p8_found": P8_FOUND_SQL, "p8_coverage": P8_COVERAGE_SQL,
}
