import math
import random

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import text as T
from lumenframe.functions import tokens as K
from lumenframe.operators import checks as C
from lumenframe.operators import labels as L
from lumenframe.operators import metrics as E
from lumenframe.operators import responses as P
from lumenframe.operators import sampling as S
from lumenframe.operators import vectors as V
from lumenframe.sources import files as X
from lumenframe.streaming import requests as Q

GOOD = "### NORM\nEvidence: 1) rate\nReasoning:\nStep 1: look\nStep 2: the known answer is no\nConclusion: No\n<END>\n### MI\nEvidence: as annotated\nReasoning: the required answer\nConclusion: Yes, surely\n<END>"


def values(spark, rows, schema, **columns):
    return spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()


def test_accounting_has_one_reason_a_block(spark):
    grid = spark.createDataFrame([(i, c, False) for i in (1, 2) for c in ("NORM", "MI", "STTC", "CD", "HYP")], "ecg_id long, superclass string, label boolean")
    taught = [(1, "NORM", "x", True, "r", True), (1, "MI", " ", True, "r", True), (1, "STTC", "x", None, "", True), (1, "CD", "x", True, " ", True)]
    blocks = L.block_status(grid, spark.createDataFrame(taught, "ecg_id long, superclass string, raw_block string, conclusion boolean, reasoning string, mismatch boolean"))
    got = {(r.ecg_id, r.superclass): r.status for r in blocks.collect()}
    assert [got[1, c] for c in ("NORM", "MI", "STTC", "CD", "HYP")] == ["label_mismatch", "parse_failed", "parse_failed", "empty_reasoning", "missing"]
    assert got[2, "MI"] == "no_answer" and L.check_accounting(blocks, 1, 2)["no_answer"] == 5
    with pytest.raises(L.AccountingError):
        L.check_accounting(blocks, 2, 2)
    assert L.condition_name(spark.createDataFrame([(True, False), (False, False)], "shuffled boolean, zeroed boolean")).head()[0] == "mixed"
    with pytest.raises(Exception, match="no full label grid: 1"):
        L.label_grid(grid.where("ecg_id = 2 OR superclass <> 'CD'")).collect()


def test_responses(spark):
    found = spark.createDataFrame([(1, GOOD), (2, "a Conclusion: yes <END> b Conclusion: No <end>"), (3, " \n"), (4, "nothing"), (5, None)], "ecg_id long, content string")
    s = {r.ecg_id: r for r in P.response_status(found).collect()}
    assert s[1].split_method == "header" and s[1].missing == ["STTC", "CD", "HYP"] and not s[1].ok and s[1].unparseable == []
    assert s[2].split_method == "end" and s[2].missing == ["STTC", "CD", "HYP"]
    assert s[3].errors == s[5].errors == ["empty content"] and len(s[4].missing) == 5 and s[4].errors[0].startswith("no superclass")
    known = spark.createDataFrame([(1, "NORM", True), (1, "MI", True), (1, "CD", True)], "ecg_id long, superclass string, label boolean")
    assert [tuple(r) for r in P.label_mismatches(found, known).collect()] == [(1, "NORM")]
    leaks = P.leaks(found)
    assert sorted((r.superclass, r.section, r.pattern) for r in leaks.collect()) == [("MI", "evidence", "annotat"), ("NORM", "reasoning", "known answer")]
    assert P.leaked_classes(leaks).count() == 2 and {r.pattern: r.hits for r in P.leak_counts(leaks).collect()} == {"annotat": 1, "known answer": 1}
    assert {r.pattern for r in P.audit(found).collect()} == {"annotat", "known/required answer"}


def test_a_response_keeps_all_but_telling_steps(spark):
    row = spark.createDataFrame([(GOOD,)], "x string").select(*[c.alias(n) for n, c in T.strip_response(F.col("x")).items()]).head()
    assert row.content == GOOD.replace("Step 2: the known answer is no\n", "") and (row.blocks_stripped, row.steps_removed, row.blocks_emptied) == (1, 1, 0)
    one = spark.createDataFrame([("Reasoning: Step 1: the label says so\nConclusion: No",), ("plain",), (None,)], "x string").select(*[c.alias(n) for n, c in T.strip_response(F.col("x")).items()]).collect()
    assert one[1].content == "plain" and one[2].content == "" and one[1].steps_removed == 0


def test_small_text_functions(spark):
    row = values(
        spark, [("alle Abl.", "a. b; c\nd", "a. B; c", 'p <think> \n', '{"choices": []}', float("nan"))], "q string, a string, b string, p string, j string, x double",
        quality=T.quality_phrase("static_noise", F.col("q")), sentences=T.sentences(F.col("a")), changed=T.changed_sentences(F.col("a"), F.col("b")), think=T.strip_think(F.col("p")), content=T.message_content(F.col("j")),
        nan=T.nan_to_null(F.col("x")), leads=T.fix_leads(F.array(F.lit("AVR"), F.lit("V1"))), reasoning=T.reasoning_field(F.lit(""), F.lit("r")), estimate=T.token_estimate(F.lit("")),
        found=T.findings(F.array(F.struct(F.lit("MI").alias("name"), F.lit(0.871).alias("score")))), squeezed=T.squeeze(F.lit("a  b ")), report=T.clean_report(F.lit("sinusrhythmus normal 4.46 unbestößtigter bericht"))["text"],
    )[0]
    assert row.quality == "static noise in all leads" and row.sentences == ["a.", " b;", " c\n", "d"] and row.squeezed == "a b" and row.report == "sinusrhythmus normal"
    assert [tuple(x) for x in row.changed] == [(" b;", " B;"), (" c\n", " c"), ("d", None)]
    assert row.think == "p " and row.content is None and row.nan is None and row.leads == ["aVR", "V1"] and row.reasoning == "r" and row.estimate == 1 and row.found == "MI (0.87)"


def test_token_arrays(spark):
    row = values(
        spark, [([5, 6, 2, 7, 0], [1, 1, 1], [-100, -100, 9])], "ids array<long>, mask array<int>, labels array<long>",
        cut=K.trim_generated(F.col("ids"), [0, 2]), whole=K.trim_generated(F.col("ids"), [99]), left=K.pad(F.col("mask"), 5, 0, True), right=K.attention(F.col("mask"), 4), prompt=K.prompt_mask(F.col("mask"), F.col("labels")),
        none=K.task_stream("none", F.col("ids"), F.col("mask"), F.col("labels"), F.col("ids"), F.col("mask"))[0], labels=K.splice(F.col("mask"), F.col("ids"))["labels"], swapped=F.array(*[K.swapped_answer(F.lit(x)) for x in ("YES", "No", "yes")]),
        p=K.pooled_probability(F.array(F.lit(1000.0), F.lit(999.0)), F.array(F.lit(1000.0))),
    )[0]
    assert row.cut == [5, 6] and row.whole == [5, 6, 2, 7, 0] and row.left == [0, 0, 1, 1, 1] and row.right == [1, 1, 1, 0] and row.prompt == [True, True, False] and row.none == []
    assert row.labels == [-100] * 3 + [5, 6, 2, 7, 0] and row.swapped == ["NO", "Yes", "no"] and abs(row.p - (1 + math.exp(-1)) / (2 + math.exp(-1))) < 1e-9
    with pytest.raises(Exception, match="mask has 1 positions, labels 3"):
        values(spark, [([1], [-100, -100, 9])], "mask array<int>, labels array<long>", m=K.prompt_mask(F.col("mask"), F.col("labels")))
    with pytest.raises(ValueError, match="unknown task stream"):
        K.task_stream("all", *[F.col("x")] * 5)


def test_where_the_answer_is(spark):
    def at(text, cuts):
        offsets = list(zip(cuts[:-1], cuts[1:], strict=True))
        return values(spark, [(text, offsets)], "t string, o array<struct<start: int, stop: int>>", d=K.decision_index(F.col("t"), F.col("o")), c=K.no_context_cut(F.col("t"), F.col("o")), p=K.target_problem(F.col("t"), F.lit(True), F.col("o")))[0]

    text = "x Conclusion: Yes."
    got = at(text, [0, 2, 12, 13, 17, 18])
    assert tuple(got.d) == (3, None) and tuple(got.c) == ("Conclusion: Yes", None) and got.p is None
    assert at(text, [0, 12, 15, 18]).d.why == "a token straddles the end of the marker" and at(text, [0, 13]).d.why == "no token after the marker"
    assert at("Conclusion: Conclusion: No", [0, 26]).d.why.startswith("2 occurrences") and at("x Conclusion: No.", [0, 2, 12, 13, 16, 17]).p == "the answer contradicts the label"
    for pieces, want in [(["Conclusion", ": ", "Yes", "."], (2, "Yes", "clean")), (["so\n", "Conclusion: ", "No,"], (2, "No,", "impure")), (["nothing"], (None, None, "none"))]:
        assert tuple(values(spark, [(pieces,)], "p array<string>", r=K.conclusion_token(F.col("p")))[0].r) == want


def test_metric_rows(spark):
    r = random.Random(4)
    rows = [(i, "AB"[i % 2], r.random() < 0.4, round(r.random(), 2) if i % 5 else None, r.choice([True, False, None]), r.random()) for i in range(80)]
    e = spark.createDataFrame(rows, "ecg_id long, superclass string, label boolean, p_yes double, parsed boolean, loss double")
    m = {x.superclass: x for x in E.metric_block(e, "superclass").collect()}
    both = [x for x in rows if x[1] == "A" and x[3] is not None and x[4] is not None]
    assert m["A"].n_scored == len(both) and m["A"].n_parsed == sum(x[1] == "A" and x[4] is not None for x in rows)
    assert abs(m["A"].lift - m["A"].auprc / (sum(x[2] for x in both) / len(both))) < 1e-4
    assert {x.grp for x in E.with_groups(e, "A").select("grp").distinct().collect()} == {"overall", "A", "B", "normal", "abnormal"}
    fast = E.fast_block(e.where("p_yes IS NOT NULL"), "superclass").collect()
    assert all(x.best_f1 >= x.f1 for x in fast)
    scores = spark.createDataFrame([("a", 1, True, 0.9), ("b", 1, True, 0.5), ("a", 2, False, 0.1), ("b", 2, False, None)], "readout string, k long, label boolean, p_yes double")
    t = {x.readout: x for x in E.readout_table(scores, "b", "k").collect()}
    assert t["a"].n == 1 and abs(t["a"].gap_to_last - 0.4) < 1e-9
    assert E.against_reference(spark.createDataFrame([("x", 1)], "l string, v int"), spark.createDataFrame([("y", 2)], "l string, v int"), "l").head().unknown_label
    stop = E.stop_reached(spark.createDataFrame([(True, 0.25), (True, 0.5)], "label boolean, loss double"), 0.375).head()
    assert stop.stop and E.stop_reached(e.where("false"), 0.3).head().stop is None


@pytest.mark.parametrize(("donors", "passed"), [(8, True), (7, None)])
def test_gate(spark, donors, passed):
    rows = [(y, 0.125, i % 10 != 0 or y, 100, 125, y, 0.0625, 0.0625, 0.5625, y if i >= donors else not y) for y in (True, False) for i in range(20)]
    x = spark.createDataFrame(rows, "label boolean, loss double, closed boolean, n_generated int, n_target int, parsed boolean, decision_loss double, real_loss double, shuffled_loss double, donor_label boolean")
    g = E.gate(x, 0.2)
    assert E.gate_verdict(g, (4,)).head().passed is passed
    assert E.gate_verdict(g, (1, 2, 3)).head().passed  # shares and lengths pass at their bounds
    assert E.gate_verdict(E.gate(x, 0.125), (1,)).head().failed == ["mean loss"]  # a loss at its bound doesn't


def test_samples(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0, i % 2 == 0) for i in range(500)], "ecg_id long, MI boolean, CD boolean")
    small, large = ({x.ecg_id for x in S.exact_sample(rows, n, 3, "ecg_id").collect()} for n in (20, 50))
    assert len(small) == 20 and len(large) == 50 and small < large
    shuffled = S.permuted_labels(rows, 1, "ecg_id", ["MI", "CD"]).collect()
    assert len(shuffled) == 500 and sum(x.MI for x in shuffled) == 167 and sum(x.MI and x.CD for x in shuffled) == 84 and [x.MI for x in sorted(shuffled)] != [i % 3 == 0 for i in range(500)]
    placed = sorted(x.n for x in S.numbered_by_hash(rows, 5, "ecg_id", "n").collect())
    assert placed == list(range(500))
    assert sorted(x.ecg_id for x in S.evenly_spaced(rows, 3, 500, "ecg_id").collect()) == [0, 250, 499]
    assert sorted(x.ecg_id for x in S.one_of_each(rows, "MI", "ecg_id").collect()) == [0, 1]
    members = spark.createDataFrame([("s", i) for i in range(100)] + [("t", i) for i in range(90, 99)], "stratum string, ecg_id long")
    answers = spark.createDataFrame([(i, c, i == 77 if c == "HYP" else i % 2 == 0) for i in range(200) for c in ("MI", "HYP")], "ecg_id long, superclass string, label boolean")
    for target in (6, 30):
        ids = S.pilot(members, {"s": 6, "t": 3}, answers, target, 1)
        assert len(ids) == len(set(ids)) == target and 77 in ids and {i % 2 for i in ids} == {0, 1}
        assert ids == S.pilot(members.repartition(7), {"s": 6, "t": 3}, answers.repartition(3), target, 1)


def test_checks(spark):
    records = spark.createDataFrame([(1,), (2,), (2,)], "ecg_id long")
    blocks = spark.createDataFrame([(1, None, "r", [], False), (1, True, " ", ["x"], True), (2, True, "r", ["y"], None)], "ecg_id long, conclusion boolean, reasoning string, leaks array<string>, mismatch boolean")
    counts = C.final_counts(records, spark.createDataFrame([(2,), (9,)], "ecg_id long"), blocks)
    row = counts.head()
    assert (row.n, row.n_unique, row.n_repeated, row.n_regenerated_absent) == (3, 2, 1, 1) and (row.leaking_blocks, row.leaking_records, row.failed_records) == (2, 2, 1)
    with pytest.raises(C.FailedCheck, match="n_repeated: 1, expected 0"):
        C.assert_final(counts, 2)
    index = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (2, 1, 1), (3, 1, 1)], "id long, shard int, row int")
    assert {r.problem: r.n for r in C.cache_problems(index, spark.createDataFrame([(1,), (5,)], "id long"), 2).collect()} == {"missing ids": 1, "repeated ids": 1, "repeated slots": 1, "rows not contiguous": 1}
    bad = C.vector_problems(spark.createDataFrame([([1.0, 2.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "v array<double>"), "v", 2).head()
    assert (bad.n, bad.wrong_width, bad.not_finite) == (4, 2, 2)
    assert {r.id for r in C.batch_members(index, spark.createDataFrame([(1,)], "id long"), 2).collect()} == {1, 2}
    a, b = (spark.createDataFrame(x, "id long, v array<double>") for x in ([(1, [1.0]), (2, [1.0])], [(1, [1.0]), (2, [1.5]), (3, [0.0])]))
    assert {r.id: r.gap for r in C.rebuilt_differences(a, b, "v").collect()} == {2: 0.5, 3: None}
    d = spark.createDataFrame([(1, 2, [1.0], [1.0]), (2, 2, [1.0], [1.0]), (3, 1, [1.0], [2.0])], "ecg_id long, donor long, own array<double>, given array<double>")
    assert {r.ecg_id: r.why for r in C.derangement_problems(d).collect()} == {1: "donor used twice", 2: "its own donor"}
    assert C.overlap(records, spark.createDataFrame([(2,), (3,)], "ecg_id long"), "ecg_id").count() == 1


def test_vectors(spark):
    r = random.Random(1)
    rows = [(i % 4, i % 3, [r.gauss(0, 1) for _ in range(3)]) for i in range(24)]
    got = {x.over: x for x in V.four_spreads(spark.createDataFrame(rows, "rec int, prompt int, embedding array<double>"), "rec", "prompt").collect()}
    cos = lambda a, b: 1 - sum(x * y for x, y in zip(a, b, strict=True)) / math.dist(a, [0] * 3) / math.dist(b, [0] * 3)
    for name, key in {"all": lambda x: 0, "held prompt": lambda x: x[1], "within record": lambda x: x[0]}.items():
        pairs = [cos(a[2], b[2]) for i, a in enumerate(rows) for b in rows[:i] if key(a) == key(b)]
        assert got[name].pairs == len(pairs) and abs(got[name].mean_cosine_distance - sum(pairs) / len(pairs)) < 1e-4
    ratio = V.norm_ratio(spark.createDataFrame([([3.0, 4.0],)], "embedding array<double>"), spark.createDataFrame([([0.0, 100.0],)], "embedding array<double>")).head()
    assert ratio.verdict == "too short" and ratio.ratio == 0.05
    mean = V.pooled(spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 6.0]]), (2, [])], "id long, t array<array<double>>"), "id", "t").collect()
    assert {x.id: x.embedding for x in mean} == {1: [2.0, 4.0], 2: None}


def test_files_of_records(spark, tmp_path):
    for name in ("records500/00/1_hr.dat", "records500/00/1_hr.hea", "00/2_hr.dat", "00/2_hr.hea", "00/4_hr.dat", "3_hr.dat", "3_hr.hea"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(b"x")
    named = [(1, "records500/00/1_hr", ["MI"]), (2, "records500/00/2_hr", []), (3, "records500/00/3_hr", ["CD"]), (4, "records500/00/4_hr", [])]
    records = spark.createDataFrame(named, "ecg_id long, filename string, superclass array<string>")
    found = X.located(records, X.listing(spark, str(tmp_path)))
    assert {r.ecg_id: r.stem for r in found.collect()} == {1: "records500/00/1_hr", 2: "00/2_hr", 3: None, 4: "00/4_hr"}  # a .dat is enough for a place, not for a whole record
    assert [r.ecg_id for r in X.missing_files(found, "ecg_id").collect()] == [3, 4] and [r.ecg_id for r in X.with_files_and_labels(found, "superclass").collect()] == [1]
    with pytest.raises(KeyError):
        X.record_path(found, 9)
    with pytest.raises(FileNotFoundError):
        X.record_path(found, 3)
    assert {r.ecg_id for r in X.without(records, [2], "ecg_id").collect()} == {1, 3, 4}
    X.write_by_condition(records, str(tmp_path / "c"), "ecg_id")
    assert sorted(p.name for p in (tmp_path / "c").iterdir() if p.is_dir()) == ["ecg_id=1", "ecg_id=2", "ecg_id=3", "ecg_id=4"]
    for k in (1, 2, 3, 4):
        assert X.write_version(records, str(tmp_path / "v"), keep=2, best=1) == k
    assert X.versions(spark, str(tmp_path / "v")) == [1, 3, 4]


def test_requests_are_retried_and_resumed(spark, tmp_path):
    waits = []
    seen = iter([(503, "busy"), (0, ""), (200, "ok")])
    assert Q.with_retry(lambda p: next(seen), "p", 5, waits.append) == (200, "ok", 3) and len(waits) == 2
    assert Q.with_retry(lambda p: (404, "no"), "p", 5, waits.append) == (404, "no", 1) and Q.backoff(10, jitter=lambda: 0.5) == 60.0

    todo = spark.createDataFrame([(1, "a"), (2, "b")], "ecg_id long, prompt string")
    first = Q.resume(todo, str(tmp_path / "log"), lambda p: (200, p) if p == "a" else (400, "x" * 900), 2)
    assert {r.ecg_id: (r.content, r.error and len(r.error)) for r in first.collect()} == {1: ("a", None), 2: (None, 500)}
    again = Q.resume(todo, str(tmp_path / "log"), lambda p: (200, p.upper()), 2)
    assert sorted((r.ecg_id, r.content) for r in again.collect() if r.error is None) == [(1, "a"), (2, "B")]
