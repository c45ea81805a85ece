import json

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import prompts as W
from lumenframe.functions import text as T
from lumenframe.operators import guards as G
from lumenframe.operators import metrics as E
from lumenframe.operators import sampling as S
from lumenframe.operators import vectors as V
from lumenframe.sources import files as X


def test_json_lines_last_wins_and_skips_what_it_cannot_read(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "old"}\n\n{"id": 2, "t": "x"}\nnot json\n{"id": 1, "t": "mid"}\n{"t": "no id"}\n')
    (tmp_path / "b.jsonl").write_text('{"id": 3, "t": null}\n{"id": 1, "t": "new"}\n')
    assert sorted(map(tuple, X.json_lines(spark, str(tmp_path), "id long, t string", "id").collect())) == [(1, "new"), (2, "x"), (3, None)]


def test_json_lines_sink_orders_and_refuses(spark, tmp_path):
    rows, path = spark.createDataFrame([(3, None), (1, "ä"), (2, "b")], "id long, t string"), f"{tmp_path}/out"
    X.write_json_lines(rows, path, "id")
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("*.json")) for x in f.read_text().splitlines()]
    assert [x["id"] for x in lines] == [1, 2, 3]
    assert X.json_lines(spark, path, "id long, t string", "id").exceptAll(rows).count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        X.write_json_lines(rows, path, "id")
    X.write_json_lines(rows.limit(0), path, "id", overwrite=True)


def test_csv_literals_and_flags(spark, tmp_path):
    (tmp_path / "book.csv").write_text("code,description,diagnostic,form,rhythm,class\nNORM,normal,1.0,,,NORM\nSR,,,0.0,1.0,\n")
    (tmp_path / "facts.csv").write_text("id,codes\n1,\"{'NORM': 100.0, 'SR': 0.0}\"\n2,{}\n3,\n4,\"{'ZZ': 1.0}\"\n")
    book = X.codebook_csv(spark, f"{tmp_path}/book.csv")
    assert [tuple(r) for r in book.orderBy("code").collect()] == [("NORM", "normal", True, False, False, "NORM"), ("SR", None, False, False, True, None)]
    facts = X.annotations_csv(spark, f"{tmp_path}/facts.csv", "id long, codes string", "codes")
    got = X.coded(facts.where("id < 4"), "id", "codes", book).select("id", "code", "likelihood").collect()
    assert sorted(map(tuple, got)) == [(1, "NORM", 100.0), (1, "SR", 0.0)]
    with pytest.raises(Exception, match="code not in the codebook: ZZ"):
        X.coded(facts, "id", "codes", book).collect()


@pytest.mark.parametrize("written", ["[3, 1, 3]", '{"ecg_ids": [3, 1]}'])
def test_requested_ids(spark, tmp_path, written):
    (tmp_path / "ids.json").write_text(written)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, t string")
    ids = X.id_list(spark, f"{tmp_path}/ids.json")
    assert [r.k for r in X.requested(rows, ids, "k").orderBy("ord").collect()] == [3, 1]
    with pytest.raises(Exception, match="id not in the manifest: 3"):
        X.requested(rows.where("k < 3"), ids, "k").collect()


def test_resume_and_settings(spark, tmp_path):
    (tmp_path / "m").write_bytes(b"abc")
    digest = G.file_digest(spark, f"{tmp_path}/m")
    assert digest == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert not G.may_resume(None, digest) and G.may_resume(digest, digest) and G.may_resume("other", digest, force=True)
    with pytest.raises(G.StaleOutput):
        G.may_resume("other", digest)
    out = G.settle({"stream": "full"}, {"stream": "prompt", "strip": None}, {"strip": False}, {"strip"})
    assert out["stream"]["mismatch"] and out["strip"] == {"value": False, "recorded": False, "was_recorded": False, "mismatch": False}
    with pytest.raises(G.RunMismatch, match="strip: recorded False, now True"):
        G.settle({}, {"strip": True}, {"strip": False}, {"strip"})
    assert G.settle({}, {"strip": True}, {"strip": False}, {"strip"}, {"strip"})["strip"]["mismatch"]


def test_first_divergence(spark):
    rows = [("a", i, i) for i in range(5)] + [("b", i, i if i != 3 else 9) for i in range(5)] + [("c", i, i) for i in range(4)] + [("d", i, i) for i in range(5)]
    got = G.first_divergence(spark.createDataFrame(rows, "c string, ord int, k int"), "c", "ord", "k").collect()
    assert {r.c: (r.n, r.first_divergence) for r in got} == {"a": (5, None), "b": (5, 3), "c": (4, 4), "d": (5, None)}


def test_covering_records_against_brute_force(spark):
    names = ["x", "y", "z"]
    answers = {i: [i % 7 == 0, i % 5 == 0, i % 2 == 0] for i in range(60)}
    grid = spark.createDataFrame([(i, c, v) for i, a in answers.items() for c, v in zip(names, a)] + [(99, "x", True)], "ecg_id long, superclass string, label boolean")
    hashes = spark.range(60).select("id", S.shuffled(F.col("id"), 42).alias("h")).collect()
    left = [r.id for r in sorted(hashes, key=lambda r: (r.h, r.id))]
    short = {(c, v): 3 for c in range(3) for v in (True, False)}
    want = []
    while len(want) < 8:
        best = max(left, key=lambda i: sum(short[c, answers[i][c]] > 0 for c in range(3)))
        left.remove(best)
        want.append(best)
        for c in range(3):
            short[c, answers[best][c]] -= 1
    assert [r.ecg_id for r in S.covering_records(grid, 8, 3, names).orderBy("turn").collect()] == want
    with pytest.raises(ValueError, match="floor not met"):
        S.covering_records(grid, 4, 3, names)
    with pytest.raises(ValueError, match="have all 3"):
        S.covering_records(grid, 61, 3, names)


def test_prompts(spark):
    s = "array(named_struct('code', 'A', 'description', '', 'diagnostic', true, 'form', true, 'rhythm', false, 'likelihood', 12.5D))"
    row = spark.range(1).select(
        W.input_block(F.lit("r"), F.lit(False), F.expr(s), F.lit(None).cast("string"), W.stadium(F.lit(" unknown"), F.lit("II ")), F.array().cast("array<string>"), F.lit(61.0), F.lit(None).cast("string")).alias("b"),
        W.render("Q {question} A {yes_no}\n{input_block}.", F.lit("MI"), F.lit(True), F.lit("{yes_no}")).alias("p"),
    ).collect()[0]
    assert "  - A [class: diagnostic, form; likelihood: 12.5]" in row.b and "Infarction stadium: II\n" in row.b and row.b.endswith("Patient context: age 61, sex not recorded") and W.NO_REPORT in row.b
    assert row.p == "Q Does this ECG show evidence of myocardial infarction? A Yes\n{yes_no}."


def test_scores_of_languages(spark):
    cases = {"": False, "  ": False, None: False, "ECG with the changes": True, "ekg mit the": False, "the with förlopp": True, "the with größe": False, "THE, the. ekg": False}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", T.non_german_by_score(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == cases


def test_losses_and_spread_edges(spark):
    e = spark.createDataFrame([(True, 1.0), (True, None), (None, 5.0)], "label boolean, loss double")
    assert {r.which: (r.n, r.mean) for r in E.mean_by_label(e, "loss").collect()} == {"all": (1, 1.0), "yes": (1, 1.0), "no": (0, None)}
    loss = spark.range(1).select(E.logistic_loss(F.lit(800.0), F.lit(0.0)).alias("a"), E.logistic_loss(F.lit(-800.0), F.lit(1.0), 2.0).alias("b")).collect()[0]
    assert (loss.a, loss.b) == (800.0, 1600.0)
    v = spark.createDataFrame([(0, "g", [1.0, 0.0]), (1, "g", [0.0, 2.0]), (2, "h", [0.0, 0.0])], "vec_id long, k string, embedding array<float>")
    assert {r.k: r.mean_cosine_distance for r in V.cosine_spread(v, "k").collect()} == {"g": 1.0, "h": None}
    assert [(r.rank, r.dim) for r in V.top_dimensions(v.where("vec_id = 2"), "vec_id", 1).collect()] == [(0, 0)]
