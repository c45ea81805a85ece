import random

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import text as T
from lumenframe.operators import metrics as E
from lumenframe.operators import resume as R
from lumenframe.operators import sampling as S
from lumenframe.plans import records, registry, runs  # noqa: F401  records and runs add their queries


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).collect()[0].y


def test_pinned_reports(spark):
    raw = "sinusrhythmus linkstyp sonst normales ekg 4.46     unbestÄtigter bericht Edit: NORM 80, (NORM 100, IVCB)"
    out = spark.createDataFrame([(raw,), (" ",), ("qrs(t) alter unbest. (CRBBB) infarkt",)], "x string").select(*[c.alias(n) for n, c in T.clean_report(F.col("x")).items()]).collect()
    assert out[0].text == "sinusrhythmus linkstyp sonst normales ekg" and out[0].had_boilerplate and out[0].had_edit and out[0].had_labels
    assert out[1].text == "" and not out[1].usable
    assert out[2].text == "qrs(t) alter unbest. infarkt" and not out[2].had_boilerplate


@pytest.mark.parametrize(
    ("field", "raw", "want"),
    [
        ("static_noise", " , I-AVF,  ", "static noise in leads I-aVF"), ("baseline_drift", " , II,III", "baseline drift in leads II, III"), ("electrodes_problems", "V5,V6", "electrode problems in leads V5, V6"),
        ("baseline_drift", " , V1 stark", "baseline drift in leads V1"), ("static_noise", "alles", "static noise in all leads"), ("burst_noise", "?", "burst noise annotated (leads not specified)"), ("static_noise", "  ", None), ("static_noise", None, None),
    ],
)
def test_pinned_quality_fields(spark, field, raw, want):
    assert one(spark, raw, lambda x: T.quality_phrase(field, x)) == want


def test_steps_and_leaks(spark):
    text = "Intro\nStep 1: rate\nStep 2: The REQUIRED answer is yes\n- step 7. axis"
    out, removed = spark.createDataFrame([(text,)], "x string").select(*[c for c in T.strip_steps(F.col("x"))]).collect()[0]
    assert (out, removed) == ("Intro\nStep 1: rate\n- step 2. axis", 1)
    leaks = one(spark, "As annotated by a Cardiologist\nfine", lambda x: T.leak_lines(x))
    assert [(r.pattern, r.line) for r in leaks] == [("annotat", "As annotated by a Cardiologist"), ("cardiologist", "As annotated by a Cardiologist")]
    assert one(spark, "1) a b 2. c", T.evidence_items) == ["a b", "c"]


def test_metrics_against_brute_force(spark):
    r = random.Random(0)
    rows = [(i, "en", r.random() < 0.4, round(r.random(), 1)) for i in range(60)] + [(99, "fr", False, 0.5)]
    e = spark.createDataFrame(rows, "ecg_id long, superclass string, label boolean, p_yes double")
    got = {x.superclass: x for x in E.ranking(e, "superclass").collect()}
    pos, neg = [x[3] for x in rows[:60] if x[2]], [x[3] for x in rows[:60] if not x[2]]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert abs(got["en"].auroc - want) < 1e-6 and got["fr"].auroc is None and got["fr"].auprc is None
    best = E.best_f1(e, "superclass").collect()
    f1 = {t: 2 * sum(p >= t for p in pos) / (sum(x[3] >= t for x in rows[:60]) + len(pos)) for t in {x[3] for x in rows[:60]}}
    top = max(f1.values())
    assert len(best) == 1 and best[0].threshold == max(t for t, v in f1.items() if v == top)


def test_draws_and_cycles(spark):
    grid = spark.createDataFrame([(i, c, i % 5 == 0 and c != "HYP") for i in range(200) for c in ("MI", "HYP")], "ecg_id long, superclass string, label boolean")
    small, large = ({tuple(x) for x in S.stratified_draw(grid, n).collect()} for n in (20, 40))
    assert {x for x in small if x[1] == "MI"} <= {x for x in large if x[1] == "MI"}
    assert sum(x[1] == "MI" and x[2] for x in small) == 10 and sum(x[1] == "HYP" for x in small) == 20
    d = S.derangement(spark.range(50).withColumnRenamed("id", "k"), "k", F.when(F.col("k") == 0, 1).otherwise(0)).collect()
    assert sorted(x.donor for x in d if x.k) == list(range(1, 50)) and all(x.donor != x.k for x in d) and next(x for x in d if x.k == 0).donor is None


def test_overlay_and_sets(spark):
    full, new = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string"), spark.createDataFrame([(2, "B"), (3, "C"), (1, None)], "id long, t string")
    assert sorted(map(tuple, R.overlay(full, new.where("id < 3"), "id").collect())) == [(1, None), (2, "B")]
    with pytest.raises(Exception, match="not in the full set: 3"):
        R.overlay(full, new, "id").collect()
    assert sorted(map(tuple, R.set_difference(full, new, "id").collect())) == [(3, "right")]
    assert not R.multiset_equality(full, new).collect()[0].equal and R.multiset_equality(full, full).collect()[0].equal


def test_every_query_has_a_stable_schema(spark):
    for name in ("superclass_rates", "parsed_responses", "streamed_ingest"):
        out = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert out.count() > 0 and len(set(out.columns)) == len(out.columns)


def test_entry_without_the_corpus_folder(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    top = pathlib.Path(__file__).parent.parent
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    shutil.copytree(top / "lumenframe", tmp_path / "lumenframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[0] == str(len(registry.QUERIES))
