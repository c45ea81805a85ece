"""Best-fit packing of token sequences by patterns of few documents.

Documents become token pieces of at most `size`; only their lengths matter
for packing.  The histogram of lengths (at most `size` numbers, whatever the
corpus) goes to the driver.  There, patterns of one to four lengths that fill
a sequence are enumerated, repeat counts are fitted to the histogram by
non-negative least squares, rounded down to what is there, and what remains is
packed best-fit decreasing, by counts.  The result, a table of slots per
length, goes back to Spark: the k-th piece of a length takes the k-th slot.
Pieces are numbered within a length in salted groups, so that no length, not
even that of full pieces, is numbered in one task.

Null text is empty: one piece of the end token.  A text of any length is cut
from its end, so only its first piece may be shorter.  Repeated rows are
packed each.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import own_columns, save

SIZE, END, SALTS, PARTNERS = 1024, 2, 64, 24
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of the byte-level BPE in a tokenizers file; its rank file gives the same ids several times faster.

    A text with the special token's string goes to the tokenizers library,
    which reads it as that token.
    """

    def __init__(self, json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken"):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(public_tokenizers.path(json_name))
        with open(public_tokenizers.path(ranks_name), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def pieces(docs: DataFrame, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, and its ids if asked for."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.list_(pa.int64()))] * with_ids])

    def run(batches):
        encode = Encoder()
        for batch in batches:
            ids, texts = batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), batch.column(batch.schema.get_field_index("text"))
            rows = []
            for doc, text in zip(ids, texts, strict=True):
                tokens = np.append(encode(text.as_py() or ""), END).astype("<u4")
                first = len(tokens) % size or size
                cuts = [0, *range(first, len(tokens) + 1, size)]
                for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append((doc, piece, a, b - a, zlib.crc32(tokens[a:b].tobytes()), *[tokens[a:b].tolist()] * with_ids))
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


# --- the plan, on the driver: its size depends on `size` alone -------------------------------------------------


def enumerate_patterns(lengths: np.ndarray, counts: np.ndarray, size: int, partners: int = PARTNERS) -> np.ndarray:
    """Rows of four lengths, decreasing, 0 for none, that fill a sequence: pairs, and triples and fours with the commonest lengths."""
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    common = lengths[np.argsort(-counts, kind="stable")[:partners]]
    out = {(size,)} if there[size] else set()
    for a in lengths.tolist():
        if 2 * a <= size and there[size - a]:
            out.add((size - a, a))
        for b in common.tolist():
            c = size - a - b
            if c > 0 and there[c]:
                out.add(tuple(sorted((a, b, c), reverse=True)))
            for d in common[: partners // 4].tolist():
                if c - d > 0 and there[c - d]:
                    out.add(tuple(sorted((a, b, d, c - d), reverse=True)))
    return np.array([p + (0,) * (4 - len(p)) for p in sorted(out)], np.int64).reshape(-1, 4)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares of the patterns' repeat counts, by multiplicative updates."""
    column = np.repeat(np.arange(len(patterns)), 4)
    row = patterns.ravel()
    used = row > 0
    column, row = column[used], row[used]
    wanted = np.bincount(column, histogram[row], len(patterns))
    x = np.full(len(patterns), histogram.sum() / (4 * max(1, len(patterns))), float)
    for _ in range(rounds):
        made = np.bincount(row, x[column], len(histogram))
        x *= wanted / np.maximum(np.bincount(column, made[row], len(patterns)), 1e-12)
    return x


def best_fit(left: np.ndarray, size: int) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing over counts: how often each combination is packed."""
    open_bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    room = np.zeros(size + 1, bool)
    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(room[length:])
            if len(fits):
                gap = length + int(fits[0])
                inside, there = next(iter(open_bins[gap].items()))
                k = min(n, there)
                if there > k:
                    open_bins[gap][inside] = there - k
                else:
                    del open_bins[gap][inside]
                    room[gap] = bool(open_bins[gap])
            else:
                gap, inside = size, ()
                k = max(1, n // max(1, size // length)) if size // length > 1 else n
            packed, rest = (*inside, length), gap - length
            open_bins[rest][packed] = open_bins[rest].get(packed, 0) + k
            room[rest] = True
            n -= k
    out: dict[tuple[int, ...], int] = defaultdict(int)
    for bins in open_bins.values():
        for packed, k in bins.items():
            out[packed] += k
    return out


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, rank after the last, first sequence, offset) for every piece of the histogram."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    lengths = np.flatnonzero(left)
    chosen: dict[tuple[int, ...], int] = defaultdict(int)
    patterns = enumerate_patterns(lengths, left[lengths], size)
    if len(patterns):
        fitted = fit_counts(patterns, left.astype(float))
        for rounding in (np.floor, np.ceil):
            for j in np.argsort(-fitted, kind="stable").tolist():
                parts = patterns[j][patterns[j] > 0]
                distinct, times = np.unique(parts, return_counts=True)
                k = int(min(rounding(fitted[j]), (left[distinct] // times).min()))
                if k > 0:
                    chosen[tuple(parts.tolist())] += k
                    left[distinct] -= k * times
    for packed, k in best_fit(left, size).items():
        chosen[packed] += k
    slots, sequence, rank = [], 0, defaultdict(int)
    for packed, k in sorted(chosen.items()):
        offset = 0
        for length in packed:
            slots.append((length, rank[length], rank[length] + k, sequence, offset))
            rank[length] += k
            offset += length
        sequence += k
    return slots


def pack(found: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces (saved, as they are read several times) with sequence_id and offset."""
    spark = found.sparkSession
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    groups = found.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    firsts = groups.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))  # at most size * SALTS rows
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(plan(histogram, size), "length long, low long, high long, first long, offset long")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = found.withColumn("own", own).join(F.broadcast(firsts), ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select(*[ranked[c] for c in found.columns if c != "salt"], (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(save(pieces(own_columns(docs, "doc_id", "text"), size), "pieces"), size)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
