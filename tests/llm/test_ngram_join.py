import random

import numpy as np
import pytest

from lumenframe.llm import ngram_join as J
from lumenframe.llm import components as C
from lumenframe.llm import common
from lumenframe.llm.common import join_unique
from lumenframe.llm.components import components


def shingle_set(t, n):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in (t or "").encode().split()]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n, percent):
    sets = {d: shingle_set(t, n) for d, t in docs}
    comp = {d: d for d in sets}
    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if a < b and i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {d: low if c == high else c for d, c in comp.items()}
    return {d: (len(sets[d]), comp[d]) for d in sets}


def corpus(seed, size=120):
    r = random.Random(seed)
    docs = []
    for i in range(size):
        if docs and r.random() < 0.6:
            w = (r.choice(docs)[1] or "x").split()
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = f"E{r.randint(0, 3)}"
            w = w[: len(w) - r.randint(0, 2)] or ["x"]
        else:
            w = [r.choice(["a", "B", "c", f"u{r.randint(0, 300)}"]) for _ in range(r.choice([1, 3, 4, 20, 60, 90]))]
        docs.append((r.randint(1, 9) + 10 * i, " ".join(w)))
    return [*docs, (5000, None), (5001, ""), (5002, None), (5003, "A b"), (5004, "a  B"), (5005, "a b c")]


@pytest.mark.parametrize("seed, n, percent", [(0, 4, 85), (1, 5, 80)])
def test_components(spark, seed, n, percent, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 500 if seed else 10**6)
    monkeypatch.setattr(J, "PER_SET", 10)
    docs = corpus(seed)
    got = J.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), n, percent, bits=14).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, n, percent)


def test_trie_finds_every_link():
    r = np.random.default_rng(0)
    for _ in range(40):
        base = np.sort(r.choice(400, 60, replace=False)).astype(np.uint64)
        sets = [np.unique(np.where(r.random(60) < r.choice([0, 0.02, 0.2]), r.integers(0, 400, 60), base).astype(np.uint64))[r.integers(0, 3) :] for _ in range(30)]
        sizes = np.array([len(s) for s in sets])
        every = np.arange(30)
        trie_links = J.forest(every, sizes, sets, every, every, 85)
        comp = list(range(30))
        for a, b in trie_links:
            comp = [comp[a] if c == comp[b] else c for c in comp]
        want = list(range(30))
        for a in range(30):
            for b in range(a):
                i = len(np.intersect1d(sets[a], sets[b]))
                if 100 * i >= 85 * (sizes[a] + sizes[b] - i):
                    want = [want[a] if c == want[b] else c for c in want]
        assert len(set(zip(comp, want, strict=True))) == len(set(comp)) == len(set(want))


def test_contraction(spark, monkeypatch):
    saved = []
    monkeypatch.setattr(C, "save", lambda df, name, save=C.save: saved.append(name) or save(df, name))
    edges = [(i, i + 1) for i in range(3000)] + [(4001, 4000), (4002, 4001), (7, 7), (None, 5000)] + [(5000 + i, 9999) for i in range(200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(3001)}, 4000: 4000, 4001: 4000, 4002: 4000, **{5000 + i: 5000 for i in range(200)}, 9999: 5000}
    assert saved.count("edges") <= 13 and len(saved) <= 40  # O(log n) rounds, not 3,000


def test_a_hot_key_joins_like_any(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 50)
    rows = [(1, i, None if i % 7 else "x") for i in range(300)] + [(2, 1, "y"), (3, 1, "z")]
    other = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    table = spark.createDataFrame(rows, "k long, i long, s string")
    got = sorted((r.k, r.i, r.v or "") for r in join_unique(table, other, ["k"], "left").collect())
    assert got == sorted((k, i, {1: "a", 2: "b"}.get(k, "")) for k, i, _ in rows)
    assert join_unique(table, other, ["k"]).count() == 301


def test_rows_that_share_a_doc_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (3, b + " x"), (4, c), (4, ""), (5, c + " y"), (5, c), (6, "z"), (7, ""), (7, None), (8, a[:200])]
    got = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    sets = [(d, shingle_set(t, 4)) for d, t in docs]
    comp = {d: d for d, _ in docs}
    for d, s in sets:
        for e, t in sets:
            if s and 100 * len(s & t) >= 85 * len(s | t) and comp[d] != comp[e]:
                low, high = sorted((comp[d], comp[e]))
                comp = {k: low if v == high else v for k, v in comp.items()}
    assert comp[2] == comp[3] == 1
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(got, bits=14).collect()) == sorted((d, len(s), comp[d]) for d, s in sets)


def test_a_large_group_of_near_copies_and_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 3000)
    monkeypatch.setattr(common, "HOT", 20)
    r = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(w if r.random() < 0.98 else "new" for w in base)) for i in range(150)]
    docs += [(1000, " ".join(f"v{i % 9000}" for i in range(20000))), (1001, " ".join(f"v{i % 9000}" for i in range(1, 20000)))]
    got = J.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bits=16).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 4, 85)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, component long, n int")
    assert J.near_duplicates(empty, bits=12).count() == 0
    assert J.near_duplicates(spark.createDataFrame([(None, "a b c d")], "doc_id long, text string"), bits=12).collect()[0].component_id is None
