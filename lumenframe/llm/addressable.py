"""Directly addressable codes: a file format for token ids from which any token can be read alone.

An id is split into chunks of bits.  Level 0 holds the lowest chunk of every
id; a continuation bitmap marks the ids that have more, and level k + 1 holds
the next chunk of those only.  A rank directory, the number of marks before
each run of RUN bits, leads from an id's place on one level to its place on the
next, so neither a token nor a range needs anything before it.

The widths of the levels are chosen for each file from its own ids: those with
the fewest bits in all, by dynamic programming over the number of ids that
need more than b bits.

Layout, little-endian but for the first line, which SQL reads too:

    8 bytes MAGIC, then big-endian longs: partition, shard, ids before in the partition, ids, documents, levels
    per level: width, values (int64)
    doc_id int64 each, 1 byte each (1: null), end of each document's ids int64 each
    per level: chunks (bits), continuation marks (bits, none on the last level), rank directory uint32
    every section is padded to 8 bytes
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, RUN, BLOCK = b"LFDAC01\0", 256, 1 << 18


def level_widths(ids: np.ndarray) -> list[int]:
    """Bits of each level, lowest first, for the fewest bits in all."""
    top = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    need = np.zeros(top + 1, np.int64)
    need[:] = np.bincount(np.frexp(ids.astype(np.float64))[1], minlength=top + 1)[: top + 1]
    more = len(ids) - np.cumsum(need)  # ids with more than b bits
    at_level = lambda b: len(ids) if b == 0 else int(more[b])
    best: list[tuple[float, list[int]]] = [(0.0, [])] * (top + 1)
    for low in range(top - 1, -1, -1):
        options = []
        for high in range(low + 1, min(top, low + 24) + 1):
            marks = 0 if high == top else 1 + 32 / RUN
            options.append(((high - low + marks) * at_level(low) + best[high][0], [high - low, *best[high][1]]))
        best[low] = min(options)
    return best[0][1]


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Each value's lowest `width` bits, one after the other, lowest bit first: eight values fill `width` bytes."""
    out = []
    for i in range(0, len(values), BLOCK):
        part = values[i : i + BLOCK]
        eights = np.pad(part, (0, -len(part) % 8)).reshape(-1, 8).T & np.uint32((1 << width) - 1)
        made = np.zeros((width, eights.shape[1]), np.uint8)
        for k in range(8):
            byte, bit = k * width >> 3, k * width & 7
            made[byte] |= (eights[k] << np.uint32(bit)).astype(np.uint8)
            for more in range(1, (bit + width + 7) // 8):
                made[byte + more] |= (eights[k] >> np.uint32(8 * more - bit)).astype(np.uint8)
        out.append(made.T.tobytes()[: (len(part) * width + 7) // 8])
    return b"".join(out)


def unpack_bits(data: np.ndarray, width: int, start: int, end: int) -> np.ndarray:
    """Values [start, end) of packed bits, read from the eight that the first is in."""
    low, high = start >> 3, (end + 7) >> 3
    part = data[low * width : high * width]
    eights = np.ascontiguousarray(np.pad(part, (0, (high - low) * width - len(part))).reshape(-1, width).T)
    out = np.empty((high - low, 8), np.uint32)
    for k in range(8):
        byte, bit = k * width >> 3, k * width & 7
        value = eights[byte].astype(np.uint32) >> np.uint32(bit)
        for more in range(1, (bit + width + 7) // 8):
            value |= eights[byte + more].astype(np.uint32) << np.uint32(8 * more - bit)
        out[:, k] = value & np.uint32((1 << width) - 1)
    return out.ravel()[start - 8 * low : end - 8 * low]


def _padded(part: bytes, spare: int = 0) -> bytes:
    return part + b"\0" * (-(len(part) + spare) % 8 + spare)


def encode(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, partition: int = 0, shard: int = 0, before: int = 0) -> bytes:
    """A file of the documents' ids; ends: the number of ids up to each document's end."""
    ids = ids.astype(np.uint32)
    levels, sizes, left, widths = [], [], ids, level_widths(ids)
    for k, width in enumerate(widths):
        last = k == len(widths) - 1
        levels.append(_padded(pack_bits(left, width), spare=8))  # a value is read as four bytes
        sizes.append((width, len(left)))
        if not last:
            marks = (left >> np.uint32(width)) > 0
            levels.append(_padded(np.packbits(np.append(marks, np.zeros(-len(marks) % RUN, bool)), bitorder="little").tobytes()))
            per_run = np.add.reduceat(marks, np.arange(0, len(marks), RUN)) if len(marks) else np.zeros(0, np.int64)
            levels.append(_padded(np.concatenate([np.zeros(1, np.uint32), np.cumsum(per_run).astype(np.uint32)]).tobytes()))
            left = left[marks] >> np.uint32(width)
    nulls = bytes(d is None for d in doc_ids)
    head = MAGIC + struct.pack(">6q", partition, shard, before, len(ids), len(doc_ids), len(sizes))
    index = b"".join(struct.pack("<2q", *x) for x in sizes) + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + _padded(nulls) + np.asarray(ends, "<i8").tobytes()
    return head + index + b"".join(levels)


class Reader:
    """Random access to a file's ids: data is bytes, a memory map or any other buffer."""

    def __init__(self, data):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.partition, self.shard, self.before, self.n_ids, n_docs, n_levels = struct.unpack(">6q", data[8:56])
        self.buffer, self.at = np.frombuffer(data, np.uint8), 56
        sizes = [self._take("<i8", 2).tolist() for _ in range(n_levels)]
        ids, nulls = self._take("<i8", n_docs), self._take(np.uint8, n_docs)
        self.doc_ids = [None if gone else d for d, gone in zip(ids.tolist(), nulls.tolist(), strict=True)]
        self.ends = self._take("<i8", n_docs)
        self.levels = []
        for k, (width, n) in enumerate(sizes):
            chunks = self._take(np.uint8, (n * width + 7) // 8, spare=8)
            marks = directory = None
            if k < n_levels - 1:
                runs = -(-n // RUN)
                marks, directory = self._take(np.uint8, runs * RUN // 8), self._take("<u4", runs + 1)
            self.levels.append((width, chunks, marks, directory))

    def _take(self, kind, n: int, spare: int = 0) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        out = self.buffer[self.at : self.at + size + spare].view(kind)
        self.at += size + spare + -(size + spare) % 8
        return out

    @staticmethod
    def _chunks(chunks: np.ndarray, width: int, places: np.ndarray) -> np.ndarray:
        bit = places * width
        byte = bit >> 3
        word = chunks[byte].astype(np.uint32)
        for k in range(1, (width + 14) // 8):
            word |= chunks[byte + k].astype(np.uint32) << np.uint32(8 * k)
        return (word >> (bit & 7).astype(np.uint32)) & np.uint32((1 << width) - 1)

    @staticmethod
    def _rank(marks: np.ndarray, directory: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Number of marks before each place, from the directory and the marks of one run."""
        out = directory[places // RUN].astype(np.int64)
        words = marks.view("<u8")
        first, word = places // RUN * (RUN // 64), places >> 6
        for k in range(RUN // 64 - 1):
            out += np.where(first + k < word, np.bitwise_count(words[np.minimum(first + k, len(words) - 1)]), 0)
        inside = np.where(word < len(words), words[np.minimum(word, len(words) - 1)], np.uint64(0))
        return out + np.bitwise_count(inside & ((np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)))

    def take(self, places) -> np.ndarray:
        """Ids at any places, in any order."""
        places = np.asarray(places, np.int64)
        if len(places) and (places.min() < 0 or places.max() >= self.n_ids):
            raise IndexError("no such token")
        out, rows, shift = np.zeros(len(places), np.uint32), np.arange(len(places)), 0
        for width, chunks, marks, directory in self.levels:
            out[rows] |= self._chunks(chunks, width, places) << np.uint32(shift)
            if marks is None or not len(rows):
                break
            more = (marks[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            rows, places, shift = rows[more], self._rank(marks, directory, places[more]), shift + width
        return out

    def range(self, start: int, end: int) -> np.ndarray:
        """Ids of [start, end): on every level the chunks needed stand together, so two ranks find them."""
        out, rows, shift = np.zeros(max(0, end - start), np.uint32), None, 0
        for width, chunks, marks, directory in self.levels:
            if end <= start:
                break
            values = unpack_bits(chunks, width, start, end)
            if rows is None:
                out |= values
            else:
                out[rows] |= values << np.uint32(shift)
            if marks is None:
                break
            more = np.flatnonzero(np.unpackbits(marks[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 :][: end - start])
            rows = more if rows is None else rows[more]
            start, end = self._rank(marks, directory, np.array([start, end], np.int64)).tolist()
            shift += width
        return out

    def documents(self):
        """(doc_id, ids before it in this file, its ids) of each document."""
        ids, start = self.range(0, self.n_ids), 0
        for doc, end in zip(self.doc_ids, self.ends.tolist(), strict=True):
            yield doc, start, ids[start:end]
            start = end
