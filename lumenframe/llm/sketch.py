"""Counts of 64-bit fingerprints, merged by Spark in shards, answering "seen at least so often?".

Each task sorts the cells of its fingerprints (2**40 of them, far more than
there are fingerprints) and sends every shard of the cell range its own, as
gaps and low halves; a shard counts what all tasks have sent, by sorting.
Only the cells counted often enough enter a table of bits, three bits a cell:
so its load follows what is repeated, not all that was counted, and what
stands once leaves no trace.  A table never misses: a fingerprint that occurs
so often is always reported.  Each Python worker holds 2 * 2**bits / 8 bytes
whatever the input's size (64 MB with the defaults), and the driver less, as
shards are compressed; where far more is repeated more fingerprints pass the
filter, and the exact pass behind it has more to do but finds the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lumenframe.llm.common import U, give_back, mix, shuffles_dropped

BITS, SHARD_BITS, CELL_BITS = 28, 10, 30  # bits of a table (half of them), of a shard's number, of a cell within its shard
_PROBES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))
_FLUSH = 1_000_000
_SCHEMA = pa.schema([("shard", pa.int32()), ("low", pa.binary()), ("high", pa.binary())])


def shard_bits(bits: int) -> int:
    return max(0, min(SHARD_BITS, bits - 12))


def cells(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard (of 2**shards) and the cell in it, as one number."""
    return mix(hashes + U(0x632BE59BD9B4E019)) >> U(64 - CELL_BITS - shards)


def pack(sorted_cells: np.ndarray, cut: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
    """For each run cut[i]:cut[i + 1] of sorted cells: their low 16 bits, and gaps of the rest, one byte each and one more for every 255."""
    low, high = (sorted_cells & U(0xFFFF)).astype(np.uint16), (sorted_cells >> U(16)).astype(np.int64)
    gaps = np.diff(high, prepend=0)
    first = cut[:-1][cut[:-1] < cut[1:]]
    gaps[first] = high[first]
    more, rest = np.divmod(gaps, 255)
    end = np.cumsum(more + 1)
    out = np.full(int(end[-1]) if len(end) else 0, 255, np.uint8)
    out[end - 1] = rest
    at = np.concatenate([[0], end])[cut]
    for a, b, i, j in zip(cut[:-1], cut[1:], at[:-1], at[1:], strict=True):
        yield low[a:b].tobytes(), out[i:j].tobytes()


def unpack(low: list[bytes], high: list[bytes]) -> np.ndarray:
    """The cells of all runs, one after the other."""
    sizes = np.array([len(x) // 2 for x in low])
    a = np.frombuffer(b"".join(high), np.uint8)
    at = np.flatnonzero(a != 255)
    total = np.cumsum(a[at].astype(np.int64) + 255 * (np.diff(at, prepend=-1) - 1))
    before = np.concatenate([[0], total])[np.cumsum(sizes) - sizes]
    return ((total - np.repeat(before, sizes)) << 16 | np.frombuffer(b"".join(low), np.uint16)).astype(np.uint32)


def _emit(hashes: list[np.ndarray], shards: int, cap: int) -> Iterator[pa.RecordBatch]:
    c = np.sort(cells(np.concatenate(hashes), shards))
    c = c[np.concatenate([np.ones(min(cap, len(c)), bool), c[cap:] != c[:-cap]])]  # so many of a cell say enough
    cut = np.searchsorted(c, np.arange((1 << shards) + 1, dtype=U) << U(CELL_BITS))
    blobs = list(pack(c & U((1 << CELL_BITS) - 1), cut))
    ids = [s for s, (low, _) in enumerate(blobs) if low]
    yield pa.record_batch([pa.array(ids, pa.int32()), *(pa.array([blobs[s][k] for s in ids], pa.binary()) for k in (0, 1))], schema=_SCHEMA)


def _places(within: np.ndarray, probe: np.uint64, width: int) -> np.ndarray:
    """One of a cell's bits among the 2**width of its shard."""
    return (within * probe & U((1 << CELL_BITS) - 1)) >> U(CELL_BITS - width)


_HELD_BYTES = 152_000_000  # two tables of the default size and a small one
_TABLES: dict[str, np.ndarray] = {}  # of this Python worker: the tables last loaded


def release() -> None:
    """Forget this worker's tables: 64 MB each that would stay beside the stages that come after."""
    _TABLES.clear()
    give_back()


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with the worker's tables held only as long as a task uses them."""

    def held(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return held


class Repeated:
    """A merged table, for use within tasks; calling it tells which fingerprints may occur so often."""

    def __init__(self, broadcast, bits: int, shards: int):
        self.broadcast, self.bits, self.shards, self.key = broadcast, bits, shards, uuid.uuid4().hex

    def table(self) -> np.ndarray:
        if self.key not in _TABLES:
            size = max(1, (2 << self.bits) // 8)
            while _TABLES and sum(t.nbytes for t in _TABLES.values()) + size > _HELD_BYTES:
                _TABLES.pop(next(iter(_TABLES)))
            table = np.zeros(size, np.uint8)
            for shard, packed in self.broadcast.value.items():
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
                table[shard * len(part) : (shard + 1) * len(part)] = part
            _TABLES[self.key] = table
        return _TABLES[self.key]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        table, width = self.table(), self.bits + 1 - self.shards
        c = cells(hashes, self.shards)
        within, base = c & U((1 << CELL_BITS) - 1), c >> U(CELL_BITS) << U(width)
        left = np.arange(len(hashes))
        for probe in _PROBES:
            at = base + _places(within, probe, width)
            hit = (table[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & np.uint8(1) > 0
            left, within, base = left[hit], within[hit], base[hit]
        seen = np.zeros(len(hashes), bool)
        seen[left] = True
        return seen


def counted(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], levels: tuple[tuple[int, int], ...]) -> list[Repeated]:
    """For each (level, bits), which fingerprints that hashes_of draws from the batches of df may occur so often, in a table of so many bits."""
    cap, shards = max(level for level, _ in levels), shard_bits(min(bits for _, bits in levels))

    def local(batches):
        held, n = [], 0
        for batch in batches:
            for h in hashes_of(batch):
                held.append(h)
                n += len(h)
                if n >= _FLUSH:
                    yield from _emit(held, shards, cap)
                    held, n = [], 0
        if n:
            yield from _emit(held, shards, cap)

    def merge(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.sort(np.concatenate([unpack(*(p.column(p.schema.get_field_index(k)).to_pylist() for k in ("low", "high"))) for p in parts if p.num_rows]))
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        count = np.diff(np.append(first, len(c)))
        tables = []
        for level, bits in levels:
            chosen, width = c[first[count >= level]].astype(U), bits + 1 - shards
            table = np.zeros(1 << width, bool)
            for probe in _PROBES:
                table[_places(chosen, probe, width)] = True
            tables.append(zstandard.ZstdCompressor(level=1).compress(np.packbits(table, bitorder="little").tobytes()))
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), *[pa.array([t], pa.binary()) for t in tables]], names=["shard", *names])

    names = [f"level{i}" for i in range(len(levels))]
    schema = "shard int, " + ", ".join(f"{n} binary" for n in names)
    with shuffles_dropped(df.sparkSession):
        # what is collected is compressed, and below 2 * 2**bits / 8 bytes a level
        rows = df.mapInArrow(releasing(local), "shard int, low binary, high binary").groupBy("shard").applyInArrow(merge, schema).collect()
    share = df.sparkSession.sparkContext.broadcast
    return [Repeated(share({r["shard"]: bytes(r[name]) for r in rows}), bits, shards) for name, (_, bits) in zip(names, levels, strict=True)]


def repeated(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = BITS) -> Repeated:
    """Which fingerprints that hashes_of draws from the batches of df may occur twice."""
    return counted(df, hashes_of, ((2, bits),))[0]


def present(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = BITS) -> Repeated:
    """Which fingerprints may be among those that hashes_of draws from the batches of df."""
    return counted(df, hashes_of, ((1, bits),))[0]


def members(df: DataFrame, column: str, bits: int = BITS) -> Repeated:
    """Which fingerprints, mix()ed, may be in a column of longs."""

    def each(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield mix(batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False).astype(np.int64).view(U))

    return present(df.select(column), each, bits)
