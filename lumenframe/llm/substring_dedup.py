"""Substring de-duplication over words, behind a count-min prefilter.

Pass 1 sketches the windows of n consecutive words in every task and merges
the sketches.  A window is counted under its seed, the least fingerprint of
its runs of 8 words, once for each run of neighbouring windows that share the
seed, and once for each window where such a run holds a window twice: so the
count of a seed is never below that of any of its windows, the sketch
overestimates both, and no repeated window is missed, with a seventh of the
entries.  Pass 2 groups exactly, and only, the windows whose estimate is two
or more (see repeats.py), and marks each that also starts earlier: in a
smaller doc_id, or earlier in the same document.  Every word in a marked
window goes; windows are judged on the input.

Null or empty text: no words.  Texts shorter than a window: kept.  Null
doc_ids can't be ordered and are an error of the input: such rows are
returned with nothing removed.  Repeated doc_ids: windows of all their rows count
as one document's, each at its start in its own row; equal starts aren't
earlier, so a repeated row never loses text to its copy, and what is found in
one text is removed from that text only.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import repeats
from lumenframe.llm.common import SPACE, WORDS, all_runs, own_columns, prefix_sums, spans, word_bounds, word_hashes
from lumenframe.llm.sketch import BITS, releasing

WINDOW, SEED, STRIPPED = 20, 8, 1000


def word_sequence(data: np.ndarray, offsets: np.ndarray) -> repeats.Sequence:
    starts, ends, bounds = word_bounds(data, offsets, SPACE)
    sums = prefix_sums(word_hashes(data, starts, ends), WORDS)
    return repeats.Sequence(bounds, len(starts), lambda k: all_runs(sums, k, WORDS), lambda s, e: spans(sums, s, e, WORDS))


def find_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """(doc, key, start, n): runs of windows, by word, that also start earlier."""
    return repeats.Search(word_sequence, window, min(seed, window), True, bits).covered(docs)


def words_left(words: list[bytes], starts: list[int] | None, counts: list[int] | None, window: int) -> list[bytes]:
    if not starts or not words:
        return words
    gone = repeats.covered_mask(len(words), window, np.array(starts), np.array(counts))
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def remove_repeats(docs: DataFrame, window: int = WINDOW, bits: int = BITS) -> DataFrame:
    """docs with all their columns; where words go, the text is what is left, joined by one space, else it stays as it is."""
    known = own_columns(docs, "doc_id", "text").where(F.col("doc_id").isNotNull())
    joined = repeats.with_runs(docs, find_repeats(known, window, bits=bits))
    names = docs.columns

    def strip(batches):
        for batch in (b.slice(i, STRIPPED) for b in batches for i in range(0, b.num_rows, STRIPPED)):
            at = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            texts = []
            for text, s, c in zip(at["text"].to_pylist(), at[repeats.RUN_STARTS].to_pylist(), at[repeats.RUN_COUNTS].to_pylist(), strict=True):
                texts.append(b" ".join(words_left(text.encode().split(), s, c, window)).decode() if s and text else text)
            yield pa.record_batch([pa.array(texts, pa.string()) if n == "text" else at[n] for n in names], names=names)

    return joined.mapInArrow(releasing(strip), docs.schema)


def dedup_words(docs: DataFrame, window: int = WINDOW, keep_text: bool = True, bits: int = BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text: the words left, joined by one space."""
    docs = own_columns(docs, "doc_id", "text")
    known = docs.where(F.col("doc_id").isNotNull())
    joined = repeats.with_runs(docs, find_repeats(known, window, bits=bits))

    def strip(batches):
        for batch in batches:
            at = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            starts, counts, texts = at[repeats.RUN_STARTS].to_pylist(), at[repeats.RUN_COUNTS].to_pylist(), at["text"].to_pylist()
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for text, s, c in zip(texts, starts, counts, strict=True):
                words = (text or "").encode().split()
                left = words_left(words, s, c, window)
                kept = b" ".join(left)
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                digests.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    kept_texts.append(kept.decode())
            columns = [at["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.record_batch([*columns, *[pa.array(kept_texts, pa.string())] * keep_text], names=[*names, *["kept_text"] * keep_text])

    return joined.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)


ORACLE_SQL = r"""
WITH words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
    SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 18)) AS p, w FROM words WHERE len(w) >= 20
), named AS (
    SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS win FROM windows
), ranked AS (
    SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k FROM named
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM ranked WHERE k > 1
), lists AS (
    SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id
), each_word AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words
), kept AS (
    SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS t, count(*) AS n
    FROM each_word e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""
