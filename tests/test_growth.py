"""Work that must not grow faster than its input: what was made cheaper gives what the plain way gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import rewrite as W
from lumenframe.functions import text as T
from lumenframe.functions import tokens as K
from lumenframe.operators import labels as L
from lumenframe.operators import pairs as D
from lumenframe.operators import sampling as S
from lumenframe.sources import tables as B

SF = "/root/testdata/sf0.001"


def test_each_text_is_reworded_once_and_counted_as_often_as_it_occurs(spark, monkeypatch):
    texts = ["The report does not mention ST changes.", "A block is noted.", None, "plain"] * 5
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for sent in (100, 1):
        monkeypatch.setattr(W, "SENT", sent)
        out = {x.i: x for x in W.rewritten(rows, "t").collect()}
        assert len(out) == 20 and out[0].t == out[4].t == "The listed observations do not include ST changes." and out[2].t == "" and out[3].t == "plain"
    totals = {x.rule: x.rewrites for x in W.rewrite_totals(rows, "t").collect()}
    assert len(totals) == len(W.RULES) and totals["report_active"] == 5 and totals["passive_positive"] == 5 and sum(totals.values()) == 10


def test_labels_by_bits_are_those_of_nested_statements(spark):
    records = spark.createDataFrame([(i, 1) for i in range(1, 7)], "ecg_id long, strat_fold long")
    said = [(1, True, "NORM"), (1, False, "MI"), (2, True, "NORM"), (2, True, "MI"), (3, True, "NORM"), (3, True, "OTHER"), (4, True, None), (4, True, "HYP"), (5, False, "CD")]
    statements = spark.createDataFrame(said, "ecg_id long, diagnostic boolean, class string")
    nested = statements.groupBy("ecg_id").agg(F.collect_list(F.struct("diagnostic", "class")).alias("statements"))
    plain = L.superclass_grid(records.join(nested, "ecg_id", "left").withColumn("statements", F.coalesce("statements", F.array().cast(nested.schema["statements"].dataType))))
    got = L.label_rows(L.class_labels(records, statements))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() == 30


def test_grid_moves_no_description(spark):
    plan = L.label_rows(L.class_labels(B.records(spark, SF), B.statements(spark, SF)))._jdf.queryExecution().executedPlan().toString()
    assert "p_name" not in plan and "l_linenumber" not in plan


@pytest.mark.parametrize("block", [300, D.BLOCK])
def test_pairs_over_several_tiles_match_brute_force(spark, block):
    r = np.random.default_rng(5)
    m = r.normal(size=(1100, 4)).astype(np.float32)
    m[700:720], m[900] = m[:20], m[3] + np.float32(1e-4)  # copies, and one that products alone would round away
    rows = [("g", i, v.tolist()) for i, v in enumerate(m)]
    got = D.pair_sums(spark.createDataFrame(rows, "g string, i long, embedding array<float>"), "g", "i", block=block).head()
    x = m.astype(float)
    i, j = np.triu_indices(len(x), 1)
    cosine = np.maximum(1 - (x[i] * x[j]).sum(1) / (np.linalg.norm(x[i], axis=1) * np.linalg.norm(x[j], axis=1)), 0).sum()
    assert got.pairs == len(i) and got.cosine == pytest.approx(cosine, rel=1e-9) and got.l2 == pytest.approx(np.linalg.norm(x[i] - x[j], axis=1).sum(), rel=1e-9)


def test_a_block_holds_many_rows():
    assert D.BLOCK >= 16384  # each vector is sent once for every block of its group


def test_stripped_steps_and_leaks(spark):
    texts = ["Step 2: a\nStep 9: the LABEL says so\nstep 4: b", "before\nStep 1: fine", "", None, "Step 1: requires a yes", "Step 1: The known Diagnosis"]
    got = [x.s for x in spark.createDataFrame([(t,) for t in texts], "t string").select(T.stripped_steps(F.col("t")).alias("s")).collect()]
    assert [tuple(s) for s in got] == [("Step 1: a\nstep 2: b", 1), ("beforeStep 1: fine".replace("beforeS", "before\nS"), 0), ("", 0), (None, None), ("Step 1: requires a yes", 0), ("", 1)]
    leaks = [x.l for x in spark.createDataFrame([("clean",), (None,), ("x\n The Report y",)], "t string").select(T.leak_lines(F.col("t")).alias("l")).collect()]
    assert leaks[0] == [] and leaks[1] is None and [tuple(x) for x in leaks[2]] == [("the report", "The Report y")]


def test_tokens_may_be_strings(spark):
    rows = spark.createDataFrame([(["a", "\n", "b"],), (["a"],), ([],), (["\n"],), (None,)], "t array<string>")
    assert [x.t for x in rows.select(K.trim_generated(F.col("t"), ["\n"]).alias("t")).collect()] == [["a"], ["a"], [], [], None]


def test_first_by_hash_is_the_head_of_numbered_by_hash(spark):
    rows = spark.createDataFrame([(str(i), "ab"[i % 3 == 0]) for i in range(9000)], "k string, g string").repartition(3)
    wanted = F.when(F.col("g") == "a", 2500).otherwise(7)
    placed = {(x.g, x.k) for x in S.numbered_by_hash(rows, 4, "k", "n", "g").where(F.col("n") < wanted).collect()}
    taken = [(x.g, x.k) for x in S.first_by_hash(rows, 4, "k", wanted, "g").collect()]
    assert len(taken) == 2507 and set(taken) == placed
    assert S.first_by_hash(rows, 4, "k", F.lit(0), "g").count() == 0 and S.first_by_hash(rows, 4, "k", F.lit(9999)).count() == 9000


def test_block_status_finds_mismatches_itself_and_moves_no_text(spark):
    grid = spark.createDataFrame([(i, c, c == "MI") for i in (1, 2) for c in ("NORM", "MI", "CD")], "ecg_id long, superclass string, label boolean")
    taught = spark.createDataFrame([(1, "NORM", "x", True, "r"), (1, "MI", "x", True, "r"), (1, "CD", "\u2003\n", False, "r")], "ecg_id long, superclass string, raw_block string, conclusion boolean, reasoning string")
    blocks = L.block_status(grid, taught)
    assert {(x.ecg_id, x.superclass): x.status for x in blocks.collect()} == {(1, "NORM"): "label_mismatch", (1, "MI"): "kept", (1, "CD"): "parse_failed", (2, "NORM"): "no_answer", (2, "MI"): "no_answer", (2, "CD"): "no_answer"}
    assert {x.status: (x.blocks, x.records) for x in L.exclusion_accounting(blocks).collect()}["no_answer"] == (3, 1)


def test_stripped_response_leaves_what_tells_nothing(spark):
    rows = spark.createDataFrame([("Reasoning: Step 1: a\nStep 2: the answer is affirmative\nConclusion: Yes",), ("Evidence: the label\nReasoning: Step 4: a",), ("plain\u0002",), ("plain",), (None,)], "r string")
    got = [tuple(x.s) for x in rows.select(T.stripped_response(F.col("r")).alias("s")).collect()]
    assert got[0] == ("Reasoning: Step 1: a\nConclusion: Yes", 1, 1, 0)
    assert got[1:] == [("Evidence: the label\nReasoning: Step 4: a", 0, 0, 0), ("plain", 0, 0, 0), ("plain", 0, 0, 0), ("", 0, 0, 0)]
