import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import signals as G
from lumenframe.functions import text as T
from lumenframe.operators import labels as L
from lumenframe.operators import metrics as E
from lumenframe.operators import pairs as D
from lumenframe.operators import sampling as S
from lumenframe.operators import series as R
from lumenframe.sources import files as X


def test_running_means_over_block_edges(spark):
    r = random.Random(2)
    rows = [(k, r.random() if k % 7 else None) for k in r.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(5)
    assert [x.n for x in R.numbered(df, "n", "k").orderBy("k").collect()] == list(range(300))
    rows.sort()
    for width, block in ((20, 32), (20, 5), (1, 10), (400, 10)):
        got = {x.k: x.running for x in R.running_means(df, "v", width, "k", block=block).collect()}
        assert len(got) == 300
        for i, (k, _) in enumerate(rows):
            last = [v for _, v in rows[max(0, i - width + 1) : i + 1] if v is not None]
            assert got[k] is None if not last else abs(got[k] - sum(last) / len(last)) < 1e-12
    assert R.running_means(df.limit(0), "v", 3, "k").count() == 0


def test_quantiles_by_narrowing_ranges(spark):
    r = random.Random(4)
    values = {"a": [r.lognormvariate(0, 5) for _ in range(700)], "b": [r.choice([-1.0, 0.0, 2.5]) for _ in range(500)], "c": [7.0] * 300, None: [1.0, 2.0], "d": [-1e300, 1e-300, 0.0, 1e300] * 20}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("e", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    at = [0.0, 0.1, 0.5, 0.95, 1.0]
    for small in (5, 100, 100_000):
        got = {x.g: x for x in R.exact_quantiles(df, "v", at, "g", small=small).collect()}
        assert set(got) == set(values)
        for k, vs in values.items():
            wanted = np.quantile(vs, at)
            assert all(math.isclose(got[k][f"p{round(100 * q)}"], w, rel_tol=1e-12, abs_tol=1e-12) for q, w in zip(at, wanted, strict=True)), (k, small)
    whole = R.exact_quantiles(df, "v", [0.5], small=50).collect()
    assert len(whole) == 1 and whole[0].p50 == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert R.exact_quantiles(df.where("false"), "v", [0.5]).count() == 0


def test_report_coverage(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("sinus rhythm",), ("sinusrytm",), ("größer",)], "report string")
    x = E.report_coverage(df, "report", T.likely_non_german(F.col("report"))).head()
    assert (x.n, x.n_blank, x.blank_percent, x.median_length, x.median_filled, x.least, x.greatest, x.n_non_german, x.non_german_percent) == (6, 3, 50.0, 4.0, 7.5, 2, 12, 2, 33.33)
    assert [y.v for y in df.select(T.likely_non_german(F.col("report")).alias("v")).collect()] == [False, False, False, True, True, False]


def test_pairs_by_blocks_match_brute_force(spark):
    r = np.random.default_rng(3)
    groups = {"a": r.normal(size=(37, 6)), "b": r.normal(size=(1, 6)), "c": np.repeat(r.normal(size=(1, 6)), 5, axis=0), "z": np.vstack([np.zeros((1, 6)), r.normal(size=(2, 6))])}
    rows = [(g, i, v.tolist()) for g, m in groups.items() for i, v in enumerate(m)] + [("a", None, [0.0] * 6), ("a", 99, None)]
    df = spark.createDataFrame(rows, "g string, i long, embedding array<double>").repartition(3)
    for block in (4, 1000):
        got = {x.g: x for x in D.pair_sums(df, "g", "i", block=block).collect()}
        for g, m in groups.items():
            pairs = list(itertools.combinations(m, 2))
            cosine = sum(max(0.0, 1 - float(a @ b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-8)) for a, b in pairs)
            assert (got[g].pairs if g in got else 0) == len(pairs)
            if pairs:
                assert got[g].cosine == pytest.approx(cosine, abs=1e-9) and got[g].l2 == pytest.approx(sum(np.linalg.norm(a - b) for a, b in pairs), abs=1e-9)
    assert D.pair_sums(df.limit(0), "g", "i").count() == 0


def test_four_spreads_with_nothing_to_compare(spark):
    one = spark.createDataFrame([(1, 1, [3.0, 4.0])], "record long, question long, embedding array<double>")
    rows = {x.over: x for x in D.four_way_spread(one.drop("question"), one, one).collect()}
    assert set(rows) == {"input", "held", "own", "within"} and all(x.pairs == 0 and x.cosine is None and x.l2 is None and x.norm == 5.0 for x in rows.values())
    still = spark.createDataFrame([(r, q, [float(r), 1.0]) for r in (1, 2) for q in (1, 2)], "record long, question long, embedding array<double>")
    held = {x.over: x for x in D.four_way_spread(still.where("question = 1").drop("question"), still, still).collect()}["held"]
    assert held.l2_of_within is None and held.l2_of_input == pytest.approx(1.0)  # nothing moves within a record


@pytest.mark.parametrize(("n", "rate", "wanted"), [(0, 100, 250), (1, 100, 250), (2, 1, 3), (64, 100, 250), (10, 4, 3), (1, 3, 1), (7, 5, 5)])
def test_signals(spark, n, rate, wanted):
    x = [math.sin(3 * i) + i for i in range(n)]
    df = spark.createDataFrame([(x, [5.0] * n, None)], "x array<float>, same array<float>, none array<float>")
    y = G.resampled(F.col("x"), rate, wanted)
    row = df.select(y.alias("y"), G.standardised(y).alias("z"), G.constant_zeroed(F.col("same")).alias("c"), G.standardised(F.col("same")).alias("s"), G.segments(F.col("x"), 3).alias("g"), G.resampled(F.col("none"), 1, 2).alias("nothing"), G.segments(F.col("none"), 3).alias("no_segment")).head()
    m = n * wanted // rate
    expected = np.interp(np.linspace(0, n - 1, m), np.arange(n), np.array(x, np.float32).astype(float)) if m else np.zeros(0)
    assert np.allclose(row.y, expected, atol=1e-9) and len(row.y) == m
    if m and expected.std() > 0:
        assert np.allclose(row.z, (expected - expected.mean()) / expected.std())
    assert row.c == [0.0] * n and row.s == [0.0] * n and row.nothing is None and row.no_segment is None
    assert [len(g) for g in row.g] == [3] * (n // 3) and np.allclose(sum(row.g, []), x[: n // 3 * 3])


def test_a_block_without_conclusion_keeps_what_follows(spark):
    told = "Step 2: As the required answer is Yes, this fits."
    first = "### NORM\nEvidence: 1) a.\nReasoning:\nStep 1: Honest.\n" + told + "\n<END>\n"
    second = "### MI\nEvidence: 1) b. 2) c.\nReasoning:\nStep 1: Plain.\nConclusion: No.\n< END >\n"
    s = T.strip_response(F.col("r"))
    row = spark.createDataFrame([(first + second,)], "r string").select(*[c.alias(k) for k, c in s.items()]).head()
    assert row.content == (first + second).replace(told + "\n", "") and (row.blocks_stripped, row.steps_removed, row.blocks_emptied) == (1, 1, 0)


def test_only_named_shards_are_read(spark, tmp_path, monkeypatch):
    cache = spark.createDataFrame([(i // 3, i % 3, [float(i)]) for i in range(30)], "shard long, row long, embedding array<double>")
    X.write_shards(cache, str(tmp_path / "cache"))
    index = spark.createDataFrame([(100 + i, i // 3, i % 3) for i in range(30)], "id long, shard long, row long")
    ids = spark.createDataFrame([(100,), (107,), (999,), (107,)], "id long")
    found = X.embedding_of(spark, str(tmp_path / "cache"), index, ids)
    assert {x.id: x.embedding for x in found.collect()} == {100: [0.0], 107: [7.0]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "IN (2,0)" in filters or "IN (0,2)" in filters
    monkeypatch.setattr(X, "LISTED_SHARDS", 1)
    assert {x.id for x in X.embedding_of(spark, str(tmp_path / "cache"), index, ids).collect()} == {100, 107}


def test_draws_of_every_mode(spark):
    rows = [(i, c, i % 10 < yes) for c, yes in (("A", 5), ("B", 1), ("C", 0)) for i in range(40)]
    grid = spark.createDataFrame(rows, "ecg_id long, superclass string, label boolean").repartition(3)
    draw = lambda n, mode: [(x.ecg_id, x.superclass, x.label) for x in S.sample(grid, n, mode, ["A", "B", "C"])[0].collect()]
    got = draw(31, "superclass-label")
    cells = {(c, y): sum(1 for x in got if x[1:] == (c, y)) for c in "ABC" for y in (True, False)}
    assert cells == {("A", True): 6, ("A", False): 5, ("B", True): 4, ("B", False): 6, ("C", True): 0, ("C", False): 10}
    short = [tuple(x) for x in S.sample(grid, 31, "superclass-label", ["A", "B", "C"])[1].collect()]
    assert short == [("B label=True", 4, 5), ("C label=True", 0, 5)]
    assert {c: sum(1 for x in draw(31, "superclass") if x[1] == c) for c in "ABC"} == {"A": 11, "B": 10, "C": 10}
    assert len(draw(17, "none")) == 17 and set(draw(5, "none")) < set(draw(17, "none")) and set(draw(6, "superclass")) < set(draw(31, "superclass"))
    assert len(draw(1000, "none")) == 120 and len(S.sample(grid, None, "superclass", ["A", "B", "C"])[0].collect()) == 120
    over = [tuple(x) for x in S.sample(grid, 119, "superclass", ["A", "B", "C", "D"])[1].collect()]
    assert over == [("D", 0, 29)]
    with pytest.raises(ValueError):
        S.sample(grid, 3, "other", ["A"])


def test_named_sets(spark):
    kind = "ecg_id long, validated boolean, report string, noise string, statements array<struct<code: string, diagnostic: boolean, class: string, likelihood: double>>"
    s = lambda code, diagnostic=True, cls=None, likelihood=100.0: (code, diagnostic, cls, likelihood)
    rows = [
        (1, True, None, None, [s("NORM", cls="NORM"), s("SR", False)]), (2, False, "sinusrytm", " ", [s("IMI", cls="MI"), s("LVH", cls="HYP", likelihood=50.0)]),
        (3, None, "the sinus", " , V1", [s("NORM", cls="NORM"), s("SR", False), s("PVC", False)]), (4, True, "überdreht", None, []), (5, True, "", "", [s("NORM", cls="NORM", likelihood=0.0)]),
    ]
    m = spark.createDataFrame(rows, kind)
    sets = lambda df: {(x.stratum, x.ecg_id) for x in df.collect()}
    assert sets(L.pilot_strata(m, ["noise"])) == {
        ("NORM+SR only", 1), ("multi-label abnormal", 2), ("low-likelihood diagnostic", 2), ("signal-quality annotated", 3), ("unvalidated", 2), ("unvalidated", 3), ("swedish report", 2),
        ("non-German (English/Swedish)", 2), ("non-German (English/Swedish)", 3),
    }
    assert sets(L.report_strata(m, ["noise"])) == {
        ("NORM+SR only", 1), ("multi-label abnormal", 2), ("signal-quality annotated", 3), *[("validated_by_human=True", i) for i in (1, 4, 5)], *[("validated_by_human=False", i) for i in (2, 3)],
    }
