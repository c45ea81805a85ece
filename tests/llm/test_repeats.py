import hashlib
import random

import pytest

from lumenframe.llm.substring_dedup import dedup_words, remove_repeats
from lumenframe.llm.suffix_dedup import dedup_bytes


def brute_words(docs, n):
    seen, out = {}, {}
    rows = {d: (t or "").encode().split() for d, t in docs}
    for d in sorted(rows):
        for i in range(len(rows[d]) - n + 1):
            seen.setdefault(tuple(rows[d][i : i + n]), (d, i))
    for d, w in rows.items():
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] != (d, i) for j in range(i, i + n)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def brute_bytes(docs, n):
    first = {}
    rows = {d: (t or "").encode() for d, t in docs}
    for d in sorted(rows):
        for i in range(len(rows[d]) - n + 1):
            first.setdefault(rows[d][i : i + n], d)
    out = {}
    for d, b in rows.items():
        gone = {j for i in range(len(b) - n + 1) if first[b[i : i + n]] < d for j in range(i, i + n)}
        kept = bytes(x for i, x in enumerate(b) if i not in gone)
        spans = sum(1 for j in gone if j - 1 not in gone)
        out[d] = (len(b), len(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    vocab = ["a", "bé", "cc", "d d", "e f", "g", "\x1ch"]
    passages = [" ".join(r.choice(vocab) for _ in range(r.randint(15, 60))) for _ in range(4)]
    docs = []
    for i in range(60):
        parts = [r.choice([*passages, "x%d y" % r.randint(0, 9), " ".join(r.choice(vocab) for _ in range(30))]) for _ in range(r.randint(0, 4))]
        docs.append((i * 7 % 61, r.choice([" ", "\n", "\t  "]).join(parts)))
    docs += [(90, "k " * 25), (91, "w " * 300 + "end"), (100, docs[0][1]), (101, None), (102, ""), (103, " \n "), (104, "z " * 3000), (105, "z " * 2999), (106, "q" * 49), (107, "q" * 50), (108, "q" * 51)]
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_words(spark, seed):
    docs = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in dedup_words(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), bits=16).collect()}
    assert got == brute_words(docs, 20)


@pytest.mark.parametrize("seed", range(3))
def test_bytes(spark, seed):
    docs = corpus(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_bytes(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), bits=16).collect()}
    assert got == brute_bytes(docs, 50)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, start int, n int")
    assert dedup_words(empty).count() == dedup_bytes(empty).count() == 0
    clash = spark.createDataFrame([(1, "a b", 3, 4), (None, None, 1, 1)], "doc_id long, text string, start int, runs int")
    assert dedup_words(clash).count() == dedup_bytes(clash).count() == 2


def brute_rows(rows, n, same_doc):
    """What is left of each row, where rows may share doc_ids; only a strictly smaller (doc_id, start), or doc_id, is earlier."""
    first = {}
    place = (lambda d, i: (d, i)) if same_doc else (lambda d, i: d)
    for d, s in rows:
        for i in range(len(s) - n + 1):
            k = tuple(s[i : i + n])
            first[k] = min(first.get(k, place(d, i)), place(d, i))
    out = []
    for d, s in rows:
        gone = {j for i in range(len(s) - n + 1) if first[tuple(s[i : i + n])] < place(d, i) for j in range(i, i + n)}
        out.append((d, len(gone), [x for i, x in enumerate(s) if i not in gone]))
    return out


def repeated_rows(seed):
    r = random.Random(seed)
    docs = [(d, t) for d, t in corpus(seed) if t]
    docs += [docs[0]] + [docs[-1]] * 3 + docs[5:15]  # the same rows again
    docs += [(d, " ".join(r.sample([docs[k][1], docs[k + 1][1], "x y z"], 3))) for k, (d, _) in enumerate(docs[10:30])]  # other texts of the same doc_id
    return docs + [(200, "only " + " ".join(map(str, range(30))))] * 2


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("parts", [1, 7])
def test_rows_that_share_a_doc_id(spark, seed, parts):
    docs = repeated_rows(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    want = sorted((d, g, hashlib.sha256(b" ".join(x)).hexdigest()) for d, g, x in brute_rows([(d, t.encode().split()) for d, t in docs], 20, True))
    assert sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in dedup_words(df, bits=16).collect()) == want
    want = sorted((d, g, hashlib.sha256(bytes(x)).hexdigest()) for d, g, x in brute_rows([(d, t.encode()) for d, t in docs], 50, False))
    assert sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in dedup_bytes(df, bits=16).collect()) == want


def test_a_repeated_row_keeps_its_text(spark):
    text = " ".join(f"w{i}" for i in range(40))
    left = remove_repeats(spark.createDataFrame([(1, text), (1, text), (2, "a " + text)], "doc_id long, text string"), bits=16).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(1, text), (1, text), (2, "a")]
