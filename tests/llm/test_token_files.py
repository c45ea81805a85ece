import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenframe.llm import addressable as A
from lumenframe.llm import chunks as C
from lumenframe.llm import token_files as T

ALPHABET = ["a", "the", "Ünder", "12", "'s", " ", "  ", "\n", "\t", " ", " ", "　", " ", "\x85", "\x1c", "漢字", "é", "é", "!?", "...", "😀", "<|endoftext|>", "▁", "ﬁ"]


def texts(n: int, seed: int = 3) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(n)]


def exact() -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("special", [True, False])
def test_chunks_give_the_ids_of_whole_texts(special):
    rows = [*texts(1500), "", " ", "\n\n", "x" * 30_000, " " * 5000, "a b " * 4000, "<|endoftext|>", " <|endoftext|> a"]
    found, codes, bounds = C.split(pa.array(rows, pa.large_string()))
    tokens = C.ByteLevel(special=special)
    ids, ends = C.gather(*tokens.many(found), codes)
    library = exact()
    library.encode_special_tokens = not special
    for i, e in enumerate(library.encode_batch(rows, add_special_tokens=False)):
        assert ids[ends[bounds[i]] : ends[bounds[i + 1]]].tolist() == e.ids, rows[i][:80]
    for i, t in enumerate(rows):
        assert "".join(found.take(pa.array(codes[bounds[i] : bounds[i + 1]])).to_pylist()) == t


def test_any_token_and_any_range_come_back():
    r = np.random.default_rng(5)
    kinds = [np.zeros(0), np.zeros(7), r.integers(0, 50257, 5000), r.geometric(0.01, 5000), np.array([2**32 - 1, 0, 1, 2**16]), 2 ** r.integers(0, 32, 3000), np.full(600, 300), r.integers(0, 2, 1000)]
    for ids in kinds:
        ids = ids.astype(np.uint32)
        ends = np.sort(r.integers(0, len(ids) + 1, 4)) if len(ids) else np.zeros(1, int)
        ends[-1] = len(ids)
        data = A.encode([3, None, 5, 9][: len(ends)], ends, ids, 2, 7, 11)
        file = A.Reader(data + b"\n")
        assert (file.partition, file.shard, file.before, file.n_ids) == (2, 7, 11, len(ids))
        assert sum(A.level_widths(ids)) >= max(1, int(ids.max()).bit_length() if len(ids) else 1)
        if len(ids):
            at = r.integers(0, len(ids), 200)
            assert (file.take(at) == ids[at]).all() and (file.take([len(ids) - 1, 0]) == ids[[-1, 0]]).all()
        for _ in range(60):
            a, b = np.sort(r.integers(0, len(ids) + 1, 2)).tolist()
            assert (file.range(a, b) == ids[a:b]).all()
        assert [(d, p.tolist()) for d, _, p in file.documents()] == [(d, p.tolist()) for d, p in zip([3, None, 5, 9], np.split(ids, ends[:-1]), strict=False)]
        with pytest.raises(IndexError):
            file.take([len(ids)])
    with pytest.raises(ValueError):
        A.Reader(b"something else" * 9)


def test_widths_are_the_cheapest():
    ids = np.random.default_rng(1).geometric(0.05, 3000).astype(np.uint32)
    top = int(ids.max()).bit_length()

    def cost(widths):
        low, total = 0, 0
        for w in widths:
            low += w
            total += (w + (low < top) * (1 + 32 / A.RUN)) * (len(ids) if low == w else int((ids >> np.uint32(low - w) > 0).sum()))
        return total

    def splits(n):
        return [[n], *[[k, *rest] for k in range(1, n) for rest in splits(n - k)]]

    assert cost(A.level_widths(ids)) == pytest.approx(min(cost(s) for s in splits(top)))


def brute(rows) -> list[tuple]:
    library, out, start = exact(), [], 0
    for doc, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def written(spark, tmp_path, docs, **options) -> list[tuple]:
    T.write_token_files(docs, str(tmp_path / "files"), **options)
    return sorted(map(tuple, T.read_token_files(spark, str(tmp_path / "files")).collect()), key=lambda x: x[1])


def test_files_hold_every_document_in_order(spark, tmp_path):
    rows = list(zip(random.Random(1).sample(range(-50, 5000), 300), texts(296, 9) + [None, "", "word " * 30_000, "z" * 20_000], strict=True))
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, start int, content string").repartition(5)
    assert written(spark, tmp_path, docs, shard=2000) == brute(rows)
    assert spark.read.format("binaryFile").load(str(tmp_path / "files")).where(F.col("path").contains("part-")).count() > 8


def test_null_and_repeated_ids(spark, tmp_path):
    rows = [(1, "b"), (1, "b"), (None, "n"), (1, "a c"), (0, None)]
    got = written(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string"))
    assert [x[0] for x in got] == [None, 0, 1, 1, 1] and sorted((x[0] or -1, *x[2:]) for x in got) == sorted((x[0] or -1, *x[2:]) for x in brute(rows))
    assert [x[1] for x in got] == [sum(y[2] for y in got[:k]) for k in range(len(got))]


def test_no_documents(spark, tmp_path):
    assert written(spark, tmp_path, spark.createDataFrame([], "doc_id long, text string")) == []
