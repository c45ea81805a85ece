import json
import os

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import prompts as W
from lumenframe.operators import manifest as M
from lumenframe.operators import metrics as E
from lumenframe.operators import responses as P
from lumenframe.operators import sampling as S
from lumenframe.operators.guards import RunMismatch
from lumenframe.plans import registry
from lumenframe.sources import files as X
from lumenframe.sources import runs as U

BEFORE = {"strip_think": "false", "task_stream": "prompt", "a": "1.0", "b": "0.0"}


@pytest.fixture
def root(spark, tmp_path):
    runs = spark.createDataFrame([("r1", "true", None, "1.0", "0.2"), ("r2", None, "question", "1.0", None), ("r3", "false", "prompt", None, None)], "run string, strip_think string, task_stream string, a string, b string")
    top = str(tmp_path / "runs")
    U.write_settings(runs, top)
    for run in ("r1", "r2", "r3"):
        with open(f"{top}/run={run}/weights.bin", "wb") as f:
            f.write(os.urandom(1 << 12))
    os.mkdir(f"{top}/logs")
    return top


def test_settings_of_runs_beside_other_files(spark, root):
    read = U.run_settings(spark, root, *BEFORE, "never_recorded")
    rows = {r.run: r.asDict() for r in read.collect()}
    assert set(rows) == {"r1", "r2", "r3"} and all(r["never_recorded"] is None for r in rows.values())
    assert rows["r1"]["strip_think"] == "true" and rows["r2"]["strip_think"] is None and rows["r2"]["task_stream"] == "question"
    with open(f"{root}/run=r2/{next(n for n in os.listdir(f'{root}/run=r2') if n.endswith('.json'))}") as f:
        assert "strip_think" not in json.loads(f.readline())


def test_unrecorded_settings_have_the_earlier_value_not_todays(spark, root):
    runs = U.run_settings(spark, root, *BEFORE)
    found = {(r.run, r.setting): r for r in U.settled(runs, {"strip_think": "true"}, BEFORE, fatal={"strip_think"}, together=({"a", "b"},)).collect()}
    assert len(found) == 12
    assert (found["r2", "strip_think"].recorded, found["r2", "strip_think"].was_recorded, found["r2", "strip_think"].refused) == ("false", False, True)
    assert not found["r1", "strip_think"].mismatch and found["r1", "task_stream"].value == "prompt" and not found["r1", "task_stream"].was_recorded
    assert found["r1", "a"].was_recorded and not found["r2", "a"].was_recorded and found["r2", "a"].value == "1.0"


def test_mismatch_is_an_error_unless_allowed_or_not_fatal(spark, root):
    runs = U.run_settings(spark, root, *BEFORE)
    with pytest.raises(RunMismatch, match=r"r2: strip_think was 'false', now 'true'; r3: .*\(2 in all\)"):
        U.require_match(U.settled(runs, {"strip_think": "true"}, BEFORE, fatal={"strip_think"}))
    allowed = U.settled(runs, {"strip_think": "true"}, BEFORE, fatal={"strip_think"}, allowed={"strip_think"})
    U.require_match(allowed)
    assert allowed.where("mismatch").count() == 2
    U.require_match(U.settled(runs, {"task_stream": "none"}, BEFORE, fatal={"strip_think"}))


def test_no_runs_is_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "run string, strip_think string")
    assert U.settled(none, {}, {"strip_think": "false"}).count() == 0


def test_questions_of_all_classes(spark):
    rows = spark.createDataFrame([(["NORM"],), (["MI", "NORM"],), ([],)], "c array<string>").select(W.question_list(W.known_answers(F.col("c"))).alias("q")).collect()
    lines = [r.q.split("\n") for r in rows]
    assert all(len(x) == 5 for x in lines)
    assert lines[0][0] == "  1. NORM - Is this a normal ECG? Known answer: Yes" and lines[1][0].endswith("No") and lines[1][1] == "  2. MI - Does this ECG show evidence of myocardial infarction? Known answer: Yes"
    assert all(x.endswith("Known answer: No") for x in lines[2])


def test_filled_in_braces_stay(spark):
    one = spark.createDataFrame([("a {questions_block} {x}",)], "b string")
    said = one.select(W.render_all("{input_block}|{input_block}", W.known_answers(F.array(F.lit("CD"))), F.col("b")).alias("p")).head().p
    assert said == "a {questions_block} {x}|a {questions_block} {x}"
    assert one.select(W.render_all("none of it {other}", W.known_answers(F.array()), F.col("b")).alias("p")).head().p == "none of it {other}"


STATEMENTS = "array<struct<code: string, description: string, diagnostic: boolean, form: boolean, rhythm: boolean, class: string, likelihood: double>>"


def _view(spark, report, statements, axis, stage, noise, age, sex):
    rows = spark.createDataFrame([(1, report, statements, axis, stage, noise, age, sex)], f"k long, report string, s {STATEMENTS}, axis string, stage string, noise string, age double, sex int")
    v = W.record_view(F.col("k"), F.col("report"), F.col("s"), F.col("axis"), [F.col("stage"), F.lit("Stadium II")], {"static_noise": F.col("noise")}, F.col("age"), F.col("sex"))
    return rows.select(v.alias("v")).head().v


def test_view_of_a_record(spark):
    v = _view(spark, "sinusrhythmus linkstyp 4.46 unbestätigter bericht", [("NORM", None, True, False, False, "NORM", 0.0), ("SR", "sinus", False, False, True, "NORM", 50.0)], " LAD ", "unknown", "alles", 61.0, 1)
    assert v.report_text == "sinusrhythmus linkstyp" and v.has_usable_report and v.report_flags.had_boilerplate and not v.report_flags.had_edit
    assert [(s.code, s.classes, s.diagnostic_superclass, s.likelihood) for s in v.statements] == [("NORM", ["diagnostic"], "NORM", 0.0), ("SR", ["rhythm"], None, 50.0)]
    assert (v.heart_axis, v.infarction_stadium, v.signal_quality, v.age, v.sex, v.sex_code) == ("LAD", ["Stadium II"], ["static noise in all leads"], 61.0, "female", 1)


def test_view_of_a_record_without_anything(spark):
    v = _view(spark, None, None, "  ", None, " ", None, None)
    assert v.report_text == "" and not v.has_usable_report and v.statements == [] and v.heart_axis is None
    assert v.infarction_stadium == ["Stadium II"] and v.signal_quality == [] and v.age is None and v.sex is None and v.sex_code is None


def test_classes_of_records_leave_out_unknown_codes(spark):
    facts = spark.createDataFrame([(1, {"A": 100.0, "B": 0.0, "X": 1.0}), (2, {"F": 1.0}), (3, {}), (4, None), (5, {"C": 1.0, "A": 0.0})], "ecg_id long, codes map<string, double>")
    book = spark.createDataFrame([("A", True, "MI"), ("B", True, "CD"), ("C", True, "MI"), ("D", True, None), ("F", False, "HYP")], "code string, diagnostic boolean, class string")
    found = {r.ecg_id: r.superclass for r in X.record_classes(facts, "ecg_id", "codes", book).collect()}
    assert found == {1: ["CD", "MI"], 2: [], 3: [], 4: [], 5: ["MI"]}


def _manifest(spark, records):
    return spark.createDataFrame(records, f"ecg_id long, strat_fold int, validated boolean, statements {STATEMENTS}")


def test_rhythm_and_form_may_be_two_statements(spark):
    norm, rhythm, form = ("NORM", None, True, False, False, "NORM", 0.0), ("SR", None, False, False, True, None, 0.0), ("LV", None, False, True, False, None, 0.0)
    m = _manifest(spark, [(1, 1, True, [norm, rhythm, form]), (2, 1, True, [rhythm]), (3, 2, False, [("I", None, True, False, False, "MI", 9.0), rhythm]), (4, 2, False, [])])
    assert M.summary(m).head().rhythm_and_form == 1
    assert [(r.codes, r.n) for r in M.accompanying_sets(m).collect()] == [("LV+SR", 1)]
    shares = {r.definition: (r.n, r.percent) for r in M.normality_shares(m, 8).collect()}
    assert shares["diagnostic_norm"] == (1, 12.5) and shares["likely_norm"] == (0, 0.0)


def test_code_sets_count_every_record(spark):
    norm, rhythm = ("NORM", None, True, False, False, "NORM", 0.0), ("SR", None, False, False, True, None, 0.0)
    m = _manifest(spark, [(1, 1, True, [norm, rhythm]), (2, 1, True, [rhythm]), (3, 2, False, [("I", None, True, False, False, "MI", 9.0), rhythm]), (4, 2, False, [])])
    assert [(r.codes, r.n) for r in M.code_sets(m).collect()] == [("SR", 3), ("", 1)]
    assert [(r.codes, r.n) for r in M.accompanying_sets(m).collect()] == [("SR", 1)]


def test_code_sets_query_has_the_records_without_a_normal_class(spark):
    found = registry.QUERIES["accompanying_code_sets"](spark, "/root/testdata/sf0.001").collect()
    assert {r.codes: r.n for r in found}[""] > sum(r.n for r in registry.QUERIES["normal_code_sets"](spark, "/root/testdata/sf0.001").where("codes = ''").collect())


def test_validation_by_fold_and_table(spark):
    r = spark.createDataFrame([(1, 1, True, True), (2, 1, False, None), (3, 3, True, False)], "ecg_id long, strat_fold int, validated boolean, generated boolean")
    by = {x.strat_fold: (x.records, x.validated, x.percent) for x in M.validated_by_fold(r).collect()}
    assert len(by) == 10 and by[1] == (2, 1, 50.0) and by[2] == (0, 0, None) and by[3] == (1, 1, 100.0)
    assert {(x.validated, x.generated): x.n for x in M.validation_table(r, "validated", "generated").collect()} == {(True, True): 1, (True, False): 1, (False, True): 0, (False, False): 1}
    assert [(x.strat_fold, x.n) for x in M.records_per_fold(r).collect()] == [(1, 2), (3, 1)]
    assert {x.n for x in M.validation_table(r.limit(0), "validated", "generated").collect()} == {0}


def _block(name, told, reasoning="Step 1: plain.", evidence="1) rate."):
    return f"### {name}\nEvidence: {evidence}\nReasoning:\n{reasoning}\nConclusion: {told}\n<END>\n"


def test_audit_counts_a_record_with_two_hits_once(spark):
    whole = "".join(_block(c, "No") for c in ("NORM", "MI", "STTC", "CD")) + _block("HYP", "Yes")
    faulty = _block("NORM", "Yes", evidence="1) as annotated", reasoning="The likelihood is high.") + _block("MI", "Maybe", reasoning=" ") + _block("CD", "No", evidence="1) the report, lead type II")
    found = spark.createDataFrame([(1, whole, 100), (2, faulty, 50), (3, "", None), (4, None, 30)], "ecg_id long, content string, n_tokens long")
    known = spark.createDataFrame([(i, c, c == "HYP") for i in (1, 2, 3, 4) for c in ("NORM", "MI", "STTC", "CD", "HYP")], "ecg_id long, superclass string, label boolean")
    r = P.audit_totals(found, known).head()
    assert (r.records, r.blocks, r.expected_blocks, r.mismatched_records, r.failed_records, r.empty_reasonings, r.mean_tokens) == (4, 8, 20, 1, 3, 1, 60.0)
    assert (r.hit_blocks, r.hit_records, r.lead_type_blocks, r.hit_block_percent, r.hit_record_percent) == (2, 1, 1, 25.0, 25.0)
    assert {x.superclass: x.n for x in P.yes_counts(found).collect()} == {"HYP": 1, "NORM": 1}
    none = P.audit_totals(found.limit(0), known).head()
    assert (none.records, none.blocks, none.mean_tokens, none.hit_block_percent) == (0, 0, None, None)


def test_gaps_of_two_rankings(spark):
    left = spark.createDataFrame([("NORM", 0.9, 0.8), ("MI", None, 0.5), ("CD", 0.4, 0.4)], "superclass string, auprc double, auroc double")
    right = spark.createDataFrame([("NORM", 0.7, 0.9), ("MI", 0.2, 0.5), ("HYP", 0.1, 0.1)], "superclass string, auprc double, auroc double")
    assert {r.superclass: r.auprc_gap for r in E.metric_gaps(left, right, "superclass").collect()} == {"NORM": 0.2, "MI": None}


def test_first_examples_and_their_record(spark):
    e = spark.createDataFrame([(3, "A", True), (1, "A", False), (1, "B", True), (2, "A", True)], "ecg_id long, superclass string, label boolean")
    three = S.first_examples(e, 3, "ecg_id", "superclass")
    assert [(r.ecg_id, r.superclass) for r in three.collect()] == [(1, "A"), (1, "B"), (2, "A")]
    assert {r.superclass: (r.yes, r.no, r.records) for r in S.selection_record(three).collect()} == {"A": (1, 1, 2), "B": (1, 0, 1)}
    assert S.first_examples(e, 9, "ecg_id", "superclass").count() == 4 and S.first_examples(e, 0, "ecg_id").count() == 0
