import random

import numpy as np
from pyspark.sql import functions as F

from lumenframe.llm import language_id as G
from lumenframe.llm import quality_classifier as Q
from lumenframe.llm import toxicity as T


def sentences(r, n, words):
    return " ".join(r.choice(words) for _ in range(n))


CLEAN = ["river", "stone", "window", "garden", "letter", "music", "winter", "paper", "orange", "travel", "market", "simple"]


def test_toxicity_tolerates_gaps(spark):
    r = random.Random(0)
    docs, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        w = [r.choice(CLEAN) for _ in range(r.randint(5, 60))]
        if toxic:
            w[r.randrange(len(w))] = r.choice(["blockhead", "nincompoop", "dunderhead"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    tests = {1000: "river b.l-o.c_k-head stone", 1001: "garden n i n c o m p o o p music", 1002: "dundxerhead letter", 1003: "NINC0MPOOP!", 1004: "river stone winter", 1005: None, 1006: "", 1007: "x" * 500 + " music"}
    out = T.score(spark.createDataFrame([*docs, *tests.items()], "doc_id long, text string").withColumn("score", F.lit("s")), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x.doc_id: x for x in out.collect()}
    assert len(got) == len(docs) + len(tests)
    assert np.mean([got[i].predicted == t for i, t in labels if got[i].held_out]) > 0.98
    assert [got[i].predicted for i in range(1000, 1008)] == [1, 1, 1, 1, 0, 0, 0, 0]
    import zlib

    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 for x in got.values())


def test_kernel_against_every_subsequence():
    def brute(s, t):
        def phi(w):
            out = {}
            for a in range(len(w)):
                for b in range(a + 1, len(w)):
                    for c in range(b + 1, len(w)):
                        if c - a < T.SPAN:
                            out[w[a], w[b], w[c]] = out.get((w[a], w[b], w[c]), 0) + T.DECAY ** (c - a - 2)
            return out

        x, y = phi(s), phi(t)
        return sum(v * y.get(k, 0) for k, v in x.items())

    r = np.random.default_rng(0)
    words = [bytes(r.integers(0, 4, r.integers(3, 12)).tolist()) for _ in range(30)]
    k = T.Kernel(words[:6])
    got = k.values(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])[:-1], np.cumsum([*map(len, words)]))
    want = [[min(1, max(0, (brute(w, m) / max(brute(m, m), T.self_weight(len(w) - T.INSERTED)) - T.NOTHING) / (T.ALL - T.NOTHING))) for m in words[:6]] for w in words]
    assert np.allclose(got, want, rtol=1e-3, atol=1e-4)


def test_quality(spark):
    r = random.Random(1)
    docs, labels = [], []
    for i in range(800):
        good = i % 4 != 0
        text = sentences(r, r.randint(5, 80), CLEAN)
        docs.append((i, text if good else r.choice([text.upper().replace(" ", "!! "), text.replace(" ", "*** "), "stone " * 80])))
        labels.append((i, int(good)))
    labels += [(3, None), (None, 1), (99_999, 0)]
    docs += [(2000, None), (2001, ""), (None, "a river")]
    out = Q.classify(spark.createDataFrame(docs, "doc_id long, text string").withColumn("label", F.lit(1)), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    got = {x.doc_id: x for x in out}
    assert len(out) == len(docs)
    assert np.mean([got[i].predicted == q for i, q in labels if q is not None and i in got and i is not None and got[i].held_out]) > 0.97
    nothing = Q.classify(spark.createDataFrame(docs[:5], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {x.score for x in nothing} == {0.5}


def test_languages(spark):
    r = random.Random(2)
    speech = {"aa": ["bli", "blo", "blu", "blip"], "bb": ["kra", "krö", "krik"], "cc": ["mno", "mna", "mnè"]}
    docs = [(i, sentences(r, r.randint(3, 40), speech[k]), k) for i, k in enumerate(random.Random(3).choices(sorted(speech), k=500))]
    docs += [(1000, None, "aa"), (1001, "123 !?", "bb"), (1002, "", None), (1003, "KRA KRIK", None)]
    got = {x.doc_id: x for x in G.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert [got[i].lang_pred for i in range(1000, 1004)] == ["und", "und", "und", "bb"]
    assert np.mean([got[i].lang_pred == k for i, _, k in docs[:500] if got[i].held_out]) > 0.98
    assert all(0 <= x.score <= 1 for x in got.values())
    none = G.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert none[0].lang_pred == "und"


def test_no_letter_is_no_language(spark):
    docs = [(i, "kra mno blip" if i % 2 else "ола куку мен", "aa" if i % 2 else "bb") for i in range(60)]
    signs = ["² ½ 3", "①②", "Ⅷ", "_1_", "٣", "—", "a²", "漢", "ª"]
    got = G.identify(spark.createDataFrame([*docs, *[(100 + i, t, None) for i, t in enumerate(signs)]], "doc_id long, text string, lang string")).collect()
    got = {x.doc_id: x.lang_pred for x in got}
    assert [got[100 + i] == "und" for i in range(len(signs))] == [True] * 6 + [False] * 3
    assert all(got[i] == ("aa" if i % 2 else "bb") for i in range(60))


def test_character_ngrams():
    for text in ("", "a", "ab", "naïve café", "漢字かな", "плюс a", "e\u0301🙂x"):
        grams = [text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)]
        got = G.grams(text).tolist()
        assert len(got) == len(grams)
        one = {}
        for g, h in zip(grams, got, strict=True):
            assert one.setdefault(g, h) == h and h >> G.BITS == len(g) - 1
        # an n-gram has one number, whatever text it stands in
        assert set(G.grams("zz " + text).tolist()) >= set(got)


def test_ftrl_is_sparse_and_separates():
    r = np.random.default_rng(3)
    y = r.integers(0, 3, 300)
    rows = [(np.unique(np.concatenate([r.integers(0, 50, 3), [100 + c, 200 + c]])), None) for c in y]
    rows = [(at, np.ones(len(at)) / np.sqrt(len(at))) for at, _ in rows]
    w = G.ftrl(rows, y, 3)
    assert np.mean([int(np.argmax(G.logits_of(w, *x))) == c for x, c in zip(rows, y, strict=True)]) > 0.99
    assert np.count_nonzero(w[:-1].any(1)) <= 60 and np.count_nonzero(G.ftrl(rows, y, 3, l1=5.0)[:-1]) < np.count_nonzero(w[:-1])


def test_hinge_fit_meets_the_dual_conditions():
    from lumenframe.llm.training import hinge_fit

    r = np.random.default_rng(1)
    x = r.normal(size=(80, 3))
    y = np.where(x @ [1, -2, 0.5] + 0.3 * r.normal(size=80) > 0, 1, -1)
    w = hinge_fit([(np.arange(4), np.append(v, 1.0)) for v in x], y, 4, rounds=2000)
    cost = np.where(y > 0, 80 / (2 * (y > 0).sum()), 80 / (2 * (y < 0).sum()))
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (np.c_[x, np.ones(80)] @ w))).sum()
    assert all(loss(w) <= loss(w + d) + 1e-2 for d in r.normal(scale=0.05, size=(400, 4)))


def test_temperature_lowers_the_loss():
    r = np.random.default_rng(0)
    y = r.integers(0, 3, 500)
    logits = 20 * (np.eye(3)[np.where(r.random(500) < 0.8, y, r.integers(0, 3, 500))])
    t = G.temperature(logits, y)
    loss = lambda x: float((np.log(np.exp(x).sum(1)) - x[np.arange(500), y]).mean())
    assert t > 2 and loss(logits / t) < loss(logits)
