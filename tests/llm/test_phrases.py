import random
import re
from collections import Counter

import numpy as np
import pytest

from lumenframe.llm import phrases as P
from lumenframe.llm.automaton import SuffixAutomaton


def strings_of(symbols):
    out, now = [], []
    for i, s in enumerate([*symbols, -1]):
        if s < 0:
            out.append(now)
            now = []
        else:
            now.append((i, s))
    return [x for x in out if x]


@pytest.mark.parametrize("seed", range(12))
def test_states_are_the_classes_of_equal_endpos(seed):
    r = random.Random(seed)
    symbols, depth = [r.choice([-1, 0, 0, 1, 2, 5][: r.randint(2, 6)]) for _ in range(r.randint(0, 60))], r.randint(1, 5)
    endpos = {}
    for string in strings_of(symbols):
        for i in range(len(string)):
            for n in range(1, min(depth, i + 1) + 1):
                endpos.setdefault(tuple(s for _, s in string[i + 1 - n : i + 1]), set()).add(string[i][0])
    a = SuffixAutomaton(np.array(symbols, np.int64), depth)
    got, state_of = {}, {}
    for state in range(len(a.count)):
        for n in range(a.shortest[state], a.longest[state] + 1):
            word = tuple(symbols[a.end[state] - n + 1 : a.end[state] + 1])
            assert word not in got
            got[word], state_of[word] = a.count[state], state
    assert got == {w: len(e) for w, e in endpos.items()}
    for w, s in state_of.items():
        for v, t in state_of.items():
            suffixes = w[len(w) - len(v) :] == v or v[len(v) - len(w) :] == w
            assert (s == t) == (endpos[w] == endpos[v] and suffixes)
    for w, s in state_of.items():
        if len(w) == a.shortest[s]:
            assert a.link[s] == (state_of[w[1:]] if len(w) > 1 else -1)
    length, end, count = a.substrings(2)
    assert sorted((tuple(symbols[e - n + 1 : e + 1]), c) for n, e, c in zip(length.tolist(), end.tolist(), count.tolist(), strict=True)) == sorted((w, len(e)) for w, e in endpos.items() if len(w) > 1)


def brute(rows, least, share, top):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            total[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    counts[lang, tuple(w[i : i + n])] += 1
    held = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    out = {}
    for (lang, p), a in held.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731,B023
        if any(m == lang and len(q) > len(p) and inside(q) and 100 * b >= share * a for (m, q), b in held.items()):
            continue
        score, k = min((2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted(
        (lang, i, p.decode(), -a, left, right, total[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1)
    )


def corpus(seed, n):
    r = random.Random(seed)
    words = ["The", "of", "new", "york", "é", "\x1fx", "x y", "漢", "a-b", "Z"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b", " ", "?"]
    texts = ["".join(r.choice(words) + r.choice(gaps) for _ in range(r.randint(0, 80))) for _ in range(n)]
    texts += ["new york times square " * 40, None, "", " .,\n", "of " * 3000]
    return [(r.choice(["en", "en", "fr", None, "und"]), t) for t in texts]


@pytest.mark.parametrize(("shard_bytes", "broadcast"), [(P.SHARD_BYTES, P.BROADCAST), (600, 0)])
def test_phrases_match_brute_force(spark, monkeypatch, shard_bytes, broadcast):
    monkeypatch.setattr(P, "BROADCAST", broadcast)
    rows = corpus(4, 120)
    rows += rows[:10]  # repeated rows count each
    docs = spark.createDataFrame([(*x, "p", 3) for x in rows], "lang string, text string, phrase string, shard int").repartition(3)
    for least, share, top in ((3, 80, 2000), (6, 50, 7)):
        got = P.collocations(docs, least=least, share=share, top=top, shard_bytes=shard_bytes).collect()
        assert sorted(map(tuple, got)) == brute(rows, least, share, top)


def test_none_and_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert P.collocations(empty).count() == 0
    assert P.collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0


def test_products_beyond_64_bits(spark):
    a = 10**14
    got = spark.sql(f"SELECT CAST((CAST({a}L AS DECIMAL(19, 0)) * 2000000) DIV (CAST({a}L AS DECIMAL(19, 0)) + CAST({a + 7}L AS DECIMAL(19, 0))) AS LONG) AS s").first().s
    assert got == 2000000 * a // (2 * a + 7)


def joined_rows(spark, work):
    """Rows that the joins of the work's queries made."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    work()
    total, listed = 0, store.executionsList()
    for i in range(before, listed.size()):
        execution = listed.apply(i).executionId()
        values, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            for metric in map(node.metrics().apply, range(node.metrics().size())):
                if "Join" in node.name() and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total


def test_no_join_makes_a_row_a_shard_for_each_frequent_pair(spark):
    r = random.Random(7)
    docs = spark.createDataFrame([("en", " ".join(f"w{r.randrange(40)}" for _ in range(60))) for _ in range(400)], "lang string, text string").repartition(30)
    found = []
    made = joined_rows(spark, lambda: found.extend(P.counted(docs, least=10, shard_bytes=2000)[0].where("size > 1").collect()))
    shards = P.shards(docs, shard_bytes=2000).count()
    assert shards > 20 and len(found) > 1000  # nearly all pairs occur 10 times or more
    assert 0 < made <= (2 * shards + 1) * 40 + 4 * len(found)  # words of shards and their numbers, words of phrases
