"""Texts cut into chunks that both tokenizers treat alone, so that each distinct chunk of a batch is encoded once.

A chunk begins at a text's start or at a space behind a character that isn't
white space.  The byte-level pattern begins a token at every such space, and no
piece of the sentence-piece vocabulary holds a space mark behind another
character, so a text's ids are those of its chunks in order.  Cutting at fewer
places is always right; characters that might be white space don't cut.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPECIAL = "<|endoftext|>"
JOINED_BYTES = 1 << 20  # regular chunks encoded in one call
GATHERED = 1 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True


def _solid_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each byte is surely no white space; each `at` is behind at least one character."""
    one = data[at - 1]
    two = data[np.maximum(at - 2, 0)]
    three = data[np.maximum(at - 3, 0)]
    of_two = (two >= 0xC3) & (two <= 0xDF)
    of_more = (two >= 0x80) & (two <= 0xBF) & ~((three >= 0xE1) & (three <= 0xE3))
    return np.where(one < 0x80, ~_WHITE[one], of_two | of_more)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array without nulls."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct chunks, the chunk at each place, and the number of chunks before each text (and after the last)."""
    data, at = buffers(texts)
    low, high = (int(at[0]), int(at[-1])) if len(texts) else (0, 0)
    data, at = data[low:high], at - low
    begins = np.zeros(len(data) + 1, bool)
    spaces = np.flatnonzero(data == 32)
    spaces = spaces[spaces > 0]
    begins[spaces[_solid_before(data, spaces)]] = True
    begins[at] = True
    starts = np.flatnonzero(begins[: len(data)])
    ends = np.append(starts, len(data)).astype(np.int64)
    each = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))
    found = each.dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), np.searchsorted(starts, at)


def flatten(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists in order, and the number of values before each list (and after the last)."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    return np.fromiter((v for x in lists for v in x), np.uint32, int(ends[-1])), ends


def gather(values: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[ends[k]:ends[k + 1]] of each key k, one after the other, and the number of values before each key (and after the last)."""
    first, sizes = ends[keys], ends[keys + 1] - ends[keys]
    after = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    out, first = np.empty(int(after[-1]), values.dtype), first - after[:-1]
    edges = np.searchsorted(after, np.arange(0, len(out), GATHERED)).tolist() + [len(keys)]
    for i, j in zip(edges[:-1], edges[1:], strict=True):  # in blocks, as the places take far more room than the values
        low, high = int(after[i]), int(after[j])
        out[low:high] = values[np.repeat(first[i:j], sizes[i:j]) + np.arange(low, high)]
    return out, after


class ByteLevel:
    """Ids of chunks by the byte-level vocabulary; its rank file gives the tokenizers file's ids several times faster.

    With special=True a chunk with the special token's string goes to the
    tokenizers library, which reads it as that token; else it is plain text.
    """

    def __init__(self, json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken", special: bool = True):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact, self.special = Tokenizer.from_file(public_tokenizers.path(json_name)), special
        self.exact.encode_special_tokens = not special
        with open(public_tokenizers.path(ranks_name), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.lengths = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def one(self, chunk: str) -> np.ndarray:
        if len(chunk) > 10_000 or (self.special and SPECIAL in chunk):  # long runs without a cut: the library's merge is the faster one there
            return np.array(self.exact.encode(chunk, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(chunk, disallowed_special=())

    def many(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in order, and the number of ids before each (and after the last)."""
        data, at = buffers(chunks)
        sizes = np.diff(at)
        regular = (sizes > 1) & (sizes <= 10_000)
        regular[regular] &= (data[at[:-1][regular]] == 32) & _solid_before(data, at[1:][regular])
        if self.special:
            regular &= ~pc.match_substring(chunks, SPECIAL).to_numpy(zero_copy_only=False)
        where, alone = np.flatnonzero(regular), np.flatnonzero(~regular)
        parts, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for group in np.split(where, np.flatnonzero(np.diff(np.cumsum(sizes[where]) // JOINED_BYTES)) + 1):
            text = "".join(chunks.take(pa.array(group)).to_pylist())
            ids = self.fast.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)
            cuts, wanted = np.cumsum(self.lengths[ids]), np.cumsum(sizes[group])
            ends = np.searchsorted(cuts, wanted)
            if len(group) and (cuts[ends] != wanted).any():
                raise ValueError("a token crosses the border of two chunks")
            parts.append(ids)
            counts.append(np.diff(ends + 1, prepend=0))
        singles = [self.one(chunks[i].as_py()) for i in alone.tolist()]
        counts.append(np.fromiter(map(len, singles), np.int64, len(singles)))
        made = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(counts))])
        place = np.empty(len(chunks), np.int64)
        place[np.concatenate([where, alone])] = np.arange(len(chunks))
        return gather(np.concatenate([*parts, *singles]).astype(np.uint32), made, place)


class Pieces:
    """Ids of chunks by a sentence-piece model that puts a space mark before each text: a chunk's own first space, or one more."""

    def __init__(self, name: str = "piece_bpe_32k.model"):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("a piece holds a space mark behind another character: chunks can't be encoded alone")
        self.bytes_of = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.mark = [self.model.piece_to_id("▁")]

    def many(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, each beginning with a space, in order, and the number of ids before each (and after the last)."""
        found = self.model.encode([x[1:] for x in chunks.to_pylist()], num_threads=1)
        return flatten([x or self.mark for x in found])  # no mark is put before nothing, but a lone space is one
