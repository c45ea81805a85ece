"""Exact search for runs of n symbols that also start earlier, in three ranks, each behind a merged sketch.

A window is n consecutive symbols (words or bytes) of a document.  Its seed is
the least fingerprint among its runs of k symbols, so equal windows have equal
seeds.  A segment is a maximal run of neighbouring windows with one seed;
there are several times fewer of them than windows.

rank 1  seeds: a segment whose seed stands nowhere else can't repeat.
rank 2  whole segments, sorted by (seed, segment, place): one that also stands
        earlier is covered in one row.
rank 3  windows, sorted by (seed, window, place): only of the first of each
        segment, and only where its seed has several different segments.

A text that a smaller doc_id has too is covered whole and takes no part
(copies.py).  A sketch (sketch.py) of each rank drops what is unique before it is sorted; it
may keep too much, never too little.  Each task first settles what it can
among its own rows: a copy that comes later than another in the same task is
covered at once, so a very frequent segment leaves a task at most once.  Names
are 64-bit fingerprints beside a 64-bit seed: 128 bits decide equality.
Sorted rows are read as a stream, so no group is held in memory.

A place is (doc_id, start), and only a strictly smaller one is earlier.  What is
found belongs to a text of a doc_id, not to the doc_id: beside it goes the
text's key, a 64-bit hash.  Rows equal in both have the same places, so none of
them covers another, and one finding serves them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import U, longs, mix, save, sliding_min, text_slices, windows
from lumenframe.llm.copies import KEY, once, text_key
from lumenframe.llm.sketch import BITS, present, repeated, releasing

FOUND = "kind int, seed long, name long, doc long, key long, start int, n int"
_FOUND = pa.schema([("kind", pa.int32()), ("seed", pa.int64()), ("name", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
COVERED, TO_RANK, FIRST = 0, 1, 2
_RANKED = ("seed", "name", "doc", "key", "start", "n")
_ORDER = ("seed", "name", "doc", "start", "key")
_HOLD = 500_000
WHOLE = (1 << 31) - 1  # windows of a run that goes to the end of its text


@dataclass
class Sequence:
    """The symbols of a slice of rows."""

    bounds: np.ndarray  # symbols before each row
    size: int
    runs: Callable[[int], np.ndarray]  # fingerprints of every run of k symbols
    name: Callable[[np.ndarray, np.ndarray], np.ndarray]  # fingerprints of [start, end)


@dataclass
class Rows:
    """Segments or windows: seed, name, document, key of its text, first window (in the slice, and in the document) and number of windows."""

    seed: np.ndarray
    name: np.ndarray
    doc: np.ndarray
    key: np.ndarray
    at: np.ndarray
    start: np.ndarray
    n: np.ndarray

    def take(self, which: np.ndarray) -> Rows:
        return Rows(self.seed[which], self.name[which], self.doc[which], self.key[which], self.at[which], self.start[which], self.n[which])

    def place(self) -> np.ndarray:
        """Names of these segments at just these places."""
        return mix(self.name.view(U) ^ mix(self.seed.view(U) + mix(self.doc.astype(U) + U(0x9E3779B97F4A7C15)) + self.start.astype(U)))


def each_window(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The windows of all segments, one segment after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def batch_of(kind: int, seed, name, doc, key, start, n) -> pa.RecordBatch:
    arrays = [np.full(len(doc), kind, np.int32), seed.view(np.int64), name.view(np.int64), doc.astype(np.int64), key.astype(np.int64), start.astype(np.int32), n.astype(np.int32)]
    return pa.record_batch([pa.array(a) for a in arrays], schema=_FOUND)


def covered_batch(doc: np.ndarray, key: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Covered windows, runs that touch made one."""
    order = np.lexsort((start, key, doc))
    doc, key, start, n = doc[order], key[order], start[order], n[order]
    end = start + n
    new = np.concatenate([np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] != end[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    nothing = np.zeros(len(first), np.int64)
    return batch_of(COVERED, nothing, nothing, doc[first], key[first], start[first], (end[last] - start[first]) if len(first) else n)


@dataclass
class Local:
    """What one task has found, settled among its own rows before it is sent on."""

    same_doc: bool
    held: list[Rows] = field(default_factory=list)
    size: int = 0

    def add(self, rows: Rows) -> Iterator[pa.RecordBatch]:
        self.held.append(rows)
        self.size += len(rows.doc)
        if self.size >= _HOLD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        t = {c: np.concatenate([getattr(r, c) for r in self.held]) for c in _RANKED}
        self.held, self.size = [], 0
        order = np.lexsort(tuple(t[c] for c in reversed(_ORDER)))
        t = {c: v[order] for c, v in t.items()}
        t, _ = _without_copies(t, None)
        later = _groups(t, None, self.same_doc)[3]
        yield covered_batch(*(t[c][later] for c in ("doc", "key", "start", "n")))
        yield batch_of(TO_RANK, *(t[c][~later] for c in _RANKED))


def _without_copies(t: dict[str, np.ndarray], last: tuple | None) -> tuple[dict[str, np.ndarray], tuple | None]:
    """Sorted rows that go on from `last`, each place in each text once."""
    if not len(t["seed"]):
        return t, last
    new = np.zeros(len(t["seed"]), bool)
    for k, c in enumerate(_ORDER):
        new[1:] |= t[c][1:] != t[c][:-1]
        new[0] |= last is None or t[c][0] != last[k]
    last = tuple(t[c][-1] for c in _ORDER)
    return (t if new.all() else {c: v[new] for c, v in t.items()}), last


def _groups(t: dict[str, np.ndarray], before: tuple | None, same_doc: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """For sorted rows that go on from `before` (seed, name, first doc, first start): where seeds and names begin, and what comes later than the first."""
    seed, name, doc, start = t["seed"], t["name"], t["doc"], t["start"]
    old_seed = before is not None and seed[0] == before[0]
    new_seed = np.concatenate([[not old_seed], seed[1:] != seed[:-1]])
    new = new_seed | np.concatenate([[not (old_seed and name[0] == before[1])], name[1:] != name[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(len(seed)), -1))
    first_doc = np.where(head >= 0, doc[head], before[2] if before else 0)
    first_start = np.where(head >= 0, start[head], before[3] if before else 0)
    later = doc > first_doc
    if same_doc:
        later |= start > first_start  # equal places, in rows of one doc_id, aren't later
    return new_seed, new, head, later, (seed[-1], name[-1], first_doc[-1], first_start[-1])


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: longs(batch, c) for c in ("kind", *_RANKED)}


def settle_segments(same_doc: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For segments sorted by (seed, name, doc, start): those covered, and the FIRST of each where a seed has several."""

    def run(batches):
        before, last, several, held = None, None, False, []  # held: firsts of a seed that has shown one name so far
        for batch in batches:
            t = _columns(batch)
            ready = t["kind"] == COVERED
            if ready.any():
                yield covered_batch(*(t[c][ready] for c in ("doc", "key", "start", "n")))
            t, last = _without_copies({c: v[~ready] for c, v in t.items()}, last)
            if not len(t["seed"]):
                continue
            new_seed, new, _, later, before = _groups(t, before, same_doc)
            if later.any():
                yield covered_batch(*(t[c][later] for c in ("doc", "key", "start", "n")))
            group = np.cumsum(new_seed)  # 0: the seed of the rows before
            many = np.zeros(group[-1] + 1, bool)
            many[group[new & ~new_seed]] = True
            many[0] |= several
            if many[0] and held:
                yield from held
            if many[0] or group[-1]:
                held = []
            first = ~later
            first[1:] &= new[1:] | (t["doc"][1:] != t["doc"][:-1]) | (t["start"][1:] != t["start"][:-1])  # a place once, whatever its texts
            now, waits = first & many[group], first & ~many[group] & (group == group[-1])
            pick = lambda w: batch_of(FIRST, *(t[c][w] for c in _RANKED))  # noqa: B023, E731
            if now.any():
                yield pick(now)
            if waits.any():
                held.append(pick(waits))
            several = bool(many[group[-1]])

    return run


def settle_windows(same_doc: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For windows sorted by (seed, name, doc, start): those that also stand earlier."""

    def run(batches):
        before, last = None, None
        for batch in batches:
            t = _columns(batch)
            ready = t["kind"] == COVERED
            if ready.any():
                yield covered_batch(*(t[c][ready] for c in ("doc", "key", "start", "n")))
            t, last = _without_copies({c: v[~ready] for c, v in t.items()}, last)
            if len(t["seed"]):
                _, _, _, later, before = _groups(t, before, same_doc)
                if later.any():
                    yield covered_batch(*(t[c][later] for c in ("doc", "key", "start", "n")))

    return run


@dataclass
class Search:
    """Windows of n symbols, seeds of k; same_doc: earlier places in the same document count too."""

    sequence: Callable[[np.ndarray, np.ndarray], Sequence]
    n: int
    k: int
    same_doc: bool
    bits: int = BITS
    kept: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda batch: batch  # the rows of a batch to look at

    def segments(self, seq: Sequence, docs: np.ndarray, keys: np.ndarray) -> Rows:
        starts = windows(seq.size, seq.bounds, self.n)
        if not len(starts):
            return Rows(np.zeros(0, U), np.zeros(0, U), docs[:0], keys[:0], starts, starts, starts)
        least = sliding_min(seq.runs(self.k), self.n - self.k + 1)[starts]
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)])
        first = np.flatnonzero(new)
        seed, at, count = least[first], starts[first], np.diff(np.append(first, len(starts)))
        if self.same_doc:
            seed, at, count = self.split_inner_repeats(seq, seed, at, count)
        row = np.searchsorted(seq.bounds, at, "right") - 1
        return Rows(seed, seq.name(at, at + count + self.n - 1), docs[row], keys[row], at, at - seq.bounds[row], count)

    def split_inner_repeats(self, seq: Sequence, seed: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments that hold one window twice become segments of one window each."""
        every = each_window(start, count)
        names = seq.name(every, every + self.n) + np.repeat(np.arange(len(start)), count).astype(U) * U(0x9E3779B97F4A7C15)
        order = np.argsort(names)
        same = names[order][1:] == names[order][:-1]
        if not same.any():
            return seed, start, count
        split = np.zeros(len(start), bool)
        split[np.repeat(np.arange(len(start)), count)[order[1:][same]]] = True
        parts = np.where(split, count, 1)
        inner = each_window(np.zeros(len(parts), np.int64), parts)
        return np.repeat(seed, parts), np.repeat(start, parts) + inner, np.where(np.repeat(split, parts), 1, np.repeat(count, parts))

    def open(self, seq: Sequence, r: Rows) -> Rows:
        at = each_window(r.at, r.n)
        start = each_window(r.start, r.n)
        return Rows(np.repeat(r.seed, r.n), seq.name(at, at + self.n), np.repeat(r.doc, r.n), np.repeat(r.key, r.n), at, start, np.ones(len(at), np.int64))

    def scan(self, batch: pa.RecordBatch) -> Iterator[tuple[Sequence, Rows]]:
        batch = self.kept(batch)
        docs, keys = longs(batch, "doc_id"), longs(batch, KEY)
        for i, j, data, offsets in text_slices(batch):
            seq = self.sequence(data, offsets)
            rows = self.segments(seq, docs[i:j], keys[i:j])
            if len(rows.doc):
                yield seq, rows

    def found(self, docs: DataFrame, pick: Callable[[Sequence, Rows], Rows]) -> DataFrame:
        same_doc, scan = self.same_doc, self.scan

        def run(batches):
            local = Local(same_doc)
            for batch in batches:
                for seq, rows in scan(batch):
                    picked = pick(seq, rows)
                    if len(picked.doc):
                        yield from local.add(picked)
            yield from local.flush()

        return docs.mapInArrow(releasing(run), FOUND)

    def ranked(self, found: DataFrame, settle: Callable, *key: str) -> DataFrame:
        # what is covered already goes anywhere: only what is still to be compared meets by its key
        dealt = F.when(F.col("kind") == COVERED, F.xxhash64("doc")).otherwise(F.xxhash64(*key))
        return found.repartition(dealt).sortWithinPartitions(*_ORDER).mapInArrow(settle(self.same_doc), FOUND)

    def covered(self, docs: DataFrame) -> DataFrame:
        """(doc, key, start, n): windows start .. start+n-1 of doc's text of this key also start earlier; n may go beyond the last. docs: doc_id (not null) and text."""
        docs, copies, kept = once(docs, self.bits)
        found = replace(self, kept=kept).settled(docs)
        if copies is None:
            return found
        return found.unionAll(copies.select(F.col("doc_id").alias("doc"), F.col(KEY).alias("key"), F.lit(0).alias("start"), F.lit(WHOLE).alias("n")))

    def settled(self, docs: DataFrame) -> DataFrame:
        """covered, of the rows to look at."""
        seeds = repeated(docs, lambda batch: (rows.seed for _, rows in self.scan(batch)), self.bits)

        def candidates(seq: Sequence, rows: Rows) -> Rows:
            return rows.take(seeds(rows.seed))

        ranks = save(self.ranked(self.found(docs, candidates), settle_segments, "seed"), "ranks")

        def places(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            t = _columns(batch)
            yield Rows(t["seed"], t["name"], t["doc"], t["key"], t["start"], t["start"], t["n"]).place()

        firsts = present(ranks.where(F.col("kind") == FIRST), places, self.bits - 1)

        def opened(seq: Sequence, rows: Rows) -> Rows:
            rows = rows.take(seeds(rows.seed))
            return self.open(seq, rows.take(firsts(rows.place())))

        def window_names(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for seq, rows in self.scan(batch):
                w = opened(seq, rows)
                yield w.name ^ mix(w.seed)

        names = repeated(docs, window_names, self.bits - 1)

        def repeated_windows(seq: Sequence, rows: Rows) -> Rows:
            w = opened(seq, rows)
            return w.take(names(w.name ^ mix(w.seed)))

        again = self.ranked(self.found(docs, repeated_windows), settle_windows, "seed", "name").select("doc", "key", "start", "n")
        return ranks.where(F.col("kind") == COVERED).select("doc", "key", "start", "n").unionAll(save(again, "windows"))


def covered_mask(size: int, n: int, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which of a document's symbols the windows cover."""
    if size < n:
        return np.zeros(size, bool)
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + counts + n - 1, size), -1)
    return np.cumsum(step[:-1]) > 0


RUN_STARTS, RUN_COUNTS = "_covered_starts", "_covered_counts"


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """docs and, for each, lists of where its covered runs start and how many windows they have."""
    lists = runs.groupBy(F.col("doc").alias("doc_id"), F.col("key").alias(KEY)).agg(F.collect_set(F.struct("start", "n")).alias("_covered"))
    joined = docs.withColumn(KEY, text_key()).join(lists, ["doc_id", KEY], "left")
    return joined.select(*docs.columns, F.col("_covered.start").alias(RUN_STARTS), F.col("_covered.n").alias(RUN_COUNTS))
