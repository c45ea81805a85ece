"""Shared pieces: a shared scratch folder, Arrow text buffers, and vectorised word and byte hashing.

Texts reach Python as Arrow batches.  The helpers work on the batch's own byte
buffer, in slices that fit a core's cache, so memory doesn't grow with the batch.
"""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 17  # arrays of eight bytes for each of these fit a core's cache
U = np.uint64
_B, _C = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, the checkpoint folder already set, or, with a local master only, one of our own."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        set_already = sc._jsc.sc().getCheckpointDir()
        if set_already.isDefined():
            shared = set_already.get()
        elif sc.master.split("[")[0] == "local":
            shared = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
            sc.setCheckpointDir(shared)
        else:
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
    return shared.rstrip("/") + "/lumenframe"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries made and run within delete their shuffle files as they end; else those of all steps lie on the disks until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: a cut of the lineage that survives a lost executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


HOT, SPREAD = 100_000, 64


def is_crowded(counts: DataFrame, column: str) -> bool:
    """Whether some key has more than HOT rows; counts: rows by key."""
    return not counts.where(F.col(column) > HOT).isEmpty()


def join_unique(table: DataFrame, other: DataFrame, keys: list[str], how: str = "inner", crowded: bool = True) -> DataFrame:
    """table joined with `other`, which has each key at most once; a key may be in a third of table's rows.

    Where no key is crowded (is_crowded of table's counts) this is a plain join.  Else rows of a hot key are dealt over
    SPREAD tasks by their other columns, and the one row of `other` is copied to each.  There are at most
    (rows of table) / HOT such keys, so what is broadcast is small beside the table.
    """
    if not crowded:
        return table.join(other, keys, how)
    hot_keys = table.groupBy(*keys).count().where(F.col("count") > HOT).select(*keys, F.lit(True).alias("_hot"))
    others = [c for c in table.columns if c not in keys]
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*(others or keys)), F.lit(SPREAD))).otherwise(0).cast("int")
    dealt = table.join(F.broadcast(hot_keys), keys, "left").withColumn("_salt", salt).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    copied = other.join(F.broadcast(hot_keys), keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")


def cleanup(spark: SparkSession) -> None:
    """Delete every scratch table. Call it once the results that read them are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return a Python worker's freed memory to the system: workers live on, and an executor's are counted with it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra ones, whatever their names, never meet the operator's own."""
    return df.select(*[df[n] for n in names])


# --- text buffers ---------------------------------------------------------------------------------------------


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows with about `limit` bytes, or one longer row; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.type != pa.large_string():
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i, n = 0, len(col)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def longs(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False).astype(np.int64)


# --- hashing --------------------------------------------------------------------------------------------------


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            grow = lambda b: np.concatenate([np.ones(1, U), np.cumprod(np.full(n - 1, b, U))])
            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up[:n], self.down[:n]


BYTES, WORDS, WORDS2 = Powers(_B), Powers(_C), Powers(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Running sums of values[i] * base**i, with a leading 0."""
    up, _ = powers.get(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum((values.astype(U) + U(1)) * up[: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit fingerprints of [start, end) of the sequence behind sums: equal content, equal value, wherever it stands."""
    _, down = powers.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0xE7037ED1A0B428DB))


def all_runs(sums: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """Fingerprints of every run of k symbols, comparable with each other only."""
    if len(sums) <= k:
        return np.zeros(0, U)
    out = sums[k:] - sums[:-k]
    out *= powers.get(len(sums))[1][: len(out)]
    out *= U(0xBF58476D1CE4E5B9)
    out ^= out >> U(32)
    out *= U(0x94D049BB133111EB)
    return out


def byte_set(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


SPACE = byte_set(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice, and the number of words before each row; words never cross rows."""
    inside = ~gap[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    edge = offsets[(offsets >= 0) & (offsets < len(data))]
    start = inside & ~before[:-1]
    start[edge] = inside[edge]
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[edge] = False
    starts, ends = np.flatnonzero(start), np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans(prefix_sums(data, BYTES), starts, ends, BYTES)


def windows(size: int, bounds: np.ndarray, n: int) -> np.ndarray:
    """Starts of the runs of n of `size` values that lie within one row; bounds: values before each row."""
    if size < n:
        return np.zeros(0, np.int64)
    start = np.ones(size + 1, bool)
    for end in bounds[1:]:
        start[max(0, end - n + 1) : end] = False
    return np.flatnonzero(start[:size])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
