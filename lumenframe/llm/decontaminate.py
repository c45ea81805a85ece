"""Benchmark decontamination: a prefix-filtered set join with exact verification, in DataFrame functions only.

A window is `window` consecutive words of an item, or the whole of a shorter
item.  A document can hold a window only if it holds all its words, so one
necessary prefix word is enough to find it: the one that is rarest over all
documents.  Candidate places of prefix words are filtered inside each row,
joined with the windows of that word, bounded by length (the window must fit
behind its start) and position (the prefix word's place in the window fixes
the start), and verified word by word.

Only windows of the benchmark are broadcast, in blocks of at most
BLOCK_WINDOWS; a larger benchmark is a stated query set that meets the
documents block by block, with the same result.

Null or wordless texts hold nothing.  Items without id, text or words are no
items.  Repeated document rows are judged each for itself; repeated items
count once.  Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import own_columns

WINDOW, BLOCK_WINDOWS = 10, 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; [] for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAPS), "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(win, items): the distinct windows of all items, and the ids of the items that have each."""
    w = own_columns(items, "item_id", "text").where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    size = F.size("w")
    starts = F.sequence(F.lit(0), F.greatest(size - window, F.lit(0)))
    each = w.where(size > 0).select("item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s + 1, F.lit(window)))).alias("win"))
    return each.groupBy("win").agg(F.collect_set("item_id").alias("items"))


def word_counts(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, times): how often each word of the vocabulary stands in all texts."""
    each = texts.select(F.explode("w").alias("token"))
    return each.join(vocabulary, "token").groupBy("token").agg(F.count("*").alias("times"))


def prefix_windows(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, place, win, items): each window under its rarest word; windows with a word that no document has are gone."""
    each = windows.select("win", "items", F.posexplode("win").alias("place", "token"))
    ranked = each.join(counts, "token", "left").groupBy("win").agg(
        F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "token", "place")).alias("least"), F.first("items").alias("items")
    )
    return ranked.where("least.times > 0").select("least.token", "least.place", "win", "items")


def _hits(texts: DataFrame, block: DataFrame, tokens: list[str], window: int) -> DataFrame:
    """Rows of texts with (start, size, items) of each verified window, or one with nulls where there is none."""
    at = texts.withColumn("at", F.array_compact(F.transform("w", lambda w, i: F.when(w.isin(tokens), i))))
    around = F.transform(
        "at",
        lambda p: F.struct(
            p.alias("p"), F.element_at("w", p + 1).alias("token"), F.greatest(p - (window - 1), F.lit(0)).alias("base"),
            F.slice(F.col("w"), F.greatest(p - (window - 1), F.lit(0)) + 1, F.lit(2 * window - 1)).alias("near"),
        ),
    )
    each = at.select("row", "doc_id", "n_words", F.explode_outer(around).alias("c")).select("row", "doc_id", "n_words", "c.*")
    start, size = F.col("p") - F.col("place"), F.size("win")
    fits = (each["token"] == block["token"]) & (start >= 0) & (start + size <= F.col("n_words"))
    same = F.slice(F.col("near"), start - F.col("base") + 1, size) == F.col("win")
    found = each.join(F.broadcast(block), fits & F.when(start >= 0, same).otherwise(False), "left")
    hit = F.col("win").isNotNull()
    return found.select("row", "doc_id", "n_words", F.when(hit, F.struct(start.alias("start"), size.alias("size"))).alias("hit"), F.when(hit, F.col("items")).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a hit window) and items (ids of the items with hit windows, sorted as strings)."""
    spark = docs.sparkSession
    texts = own_columns(docs, "doc_id", "text").select("doc_id", words(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    windows = item_windows(items, window)
    vocabulary = windows.select(F.explode("win").alias("token")).distinct()
    n = vocabulary.count()
    counts = word_counts(texts, F.broadcast(vocabulary) if n <= 10 * BLOCK_WINDOWS else vocabulary)
    rows = prefix_windows(windows, counts).collect()  # the query set: as large as the benchmark
    rows.sort(key=lambda r: (r["token"], r["win"]))
    blocks = [rows[i : i + BLOCK_WINDOWS] for i in range(0, len(rows), BLOCK_WINDOWS)] or [[]]
    texts = texts.withColumn("row", F.monotonically_increasing_id())
    schema = "token string, place int, win array<string>, items array<string>"
    parts = [_hits(texts, spark.createDataFrame(b, schema), sorted({r["token"] for r in b}), window) for b in blocks]
    hits = reduce(DataFrame.unionAll, parts)
    per_row = hits.groupBy("row", "doc_id", "n_words").agg(F.collect_set("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1)))))
    return per_row.select("doc_id", F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), "items")


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM documents
), items AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM benchmark
), item_windows AS (
    SELECT item_id, array_to_string(w[s + 1:s + 10], ' ') AS win, least(len(w), 10) AS size
    FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM items WHERE len(w) > 0)
), sizes AS (
    SELECT DISTINCT size FROM item_windows
), doc_windows AS (
    SELECT doc_id, s, size, array_to_string(w[s + 1:s + size], ' ') AS win
    FROM (SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS s FROM words, sizes WHERE len(w) >= size)
), hits AS (
    SELECT d.doc_id, d.s, d.size, i.item_id FROM doc_windows d JOIN item_windows i ON d.win = i.win AND d.size = i.size
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id
), lists AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(l.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c USING (doc_id) LEFT JOIN lists l USING (doc_id)
"""
