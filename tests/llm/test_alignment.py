import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lumenframe.llm import alignment as X
from lumenframe.llm import queries
from tests.llm.test_token_files import ALPHABET


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def brute(rows) -> tuple[list[tuple], Counter]:
    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table, links, seen = byte_of_char(), [], Counter()
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        a_ids = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = b_side.encode(text) if text else []
        a_bytes = [bytes(table[c] for c in a_side.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            links.append(None)
            continue
        groups, i, j, a_end, b_end = [([], [])], 0, 0, 0, 0
        while i < len(a_ids) or j < len(b_ids):
            if a_end <= b_end and i < len(a_ids) and (a_end < b_end or not groups[-1][0]):
                groups[-1][0].append(a_ids[i])
                a_end += len(a_bytes[i])
                i += 1
            else:
                groups[-1][1].append(b_ids[j])
                b_end += len(b_bytes[j])
                j += 1
            if a_end == b_end and groups[-1][0] and groups[-1][1]:
                groups.append(([], []))
        groups.pop()
        pairs = [(x, y) for g, h in groups for x in g for y in h]
        seen.update(set(pairs))
        text_of = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        links.append((len(a_ids), len(b_ids), len(groups), pairs, hashlib.sha256(text_of.encode()).hexdigest()))
    top = Counter()
    for (a, _), n in seen.items():
        top[a] = max(top[a], n)
    out = []
    for (doc, _), x in zip(rows, links, strict=True):
        if x is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((doc, *x[:3], len(x[3]), sum(seen[p] == top[p[0]] for p in x[3]), sum(seen[p] for p in x[3]), x[4]))
    return out, seen


KEY = lambda x: (x[0] is None, x)
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("shard_bytes", [X.SHARD_BYTES, 500])
def test_alignment_matches_brute_force(spark, shard_bytes):
    r = random.Random(6)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(250)]
    texts += [None, "", " ", "\n", "x▁y", "<s> </s> <unk> <0x41>", "the cat " * 3000, "qxzj" * 4000, "same text", "same text", "日本語 テキスト", "\x00\x01 a\x7f"]
    rows = list(enumerate(texts)) + [(3, "repeated id"), (3, "repeated id"), (None, "no id here")]
    docs = spark.createDataFrame([(d, t, 5, "s") for d, t in rows], "doc_id long, text string, shard int, a string").repartition(3)
    found, counts = X.alignment(docs, shard_bytes)
    wanted, seen = brute(rows)
    assert sorted((tuple(x[c] for c in COLUMNS) for x in found.collect()), key=KEY) == sorted(wanted, key=KEY)
    assert {(x.a, x.b): x.n for x in counts.collect()} == seen


def test_alignment_of_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = queries.QUERIES["op11_tokenizer_alignment"](spark, "/root/testdata/sf0.001")
    assert sorted(tuple(x[c] for c in COLUMNS) for x in got.collect()) == sorted(brute([(x.doc_id, x.text) for x in docs.collect()])[0])


def test_no_documents_and_none_with_tokens(spark):
    assert X.alignment(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0
    found, counts = X.alignment(spark.createDataFrame([(1, None), (2, "▁")], "doc_id long, text string"))
    assert [x.n_links for x in found.collect()] == [0, 0] and counts.count() == 0


def test_a_group_without_inner_cuts_is_counted_by_ids():
    """The worst group: one byte of A beside pieces of another length, thousands of tokens on either side."""
    aligner = X.Aligner()
    import pyarrow as pa

    good = aligner.groups(pa.array([" " + "ﬁ" * 3000, " a"], pa.large_string()))
    rows = aligner.db.execute(X.PER_CHUNK_SQL + " ORDER BY chunk").fetchall()
    assert good.all() and rows[0][1] > 3000 and rows[0][4] == sum(n for (n,) in aligner.db.execute("SELECT n FROM chunk_pairs WHERE chunk = 0").fetchall())
