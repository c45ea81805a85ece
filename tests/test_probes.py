import numpy as np

from pyspark.sql import functions as F

from lumenframe.operators import probes as P


def reference(x, y, l2):
    """Newton in numpy, to the end, for one class."""
    w = np.zeros(x.shape[1])
    pen = np.append(np.full(x.shape[1] - 1, 2 * l2), 0.0)
    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ (p - y) / len(y) + pen * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(pen + 1e-12), g) * (1.0 if np.linalg.norm(g) < 0.05 else 0.3)
    return w


def test_all_forms_and_classes_equal_numpy(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 4)) + [0.5, 0, -1, 2]
    truth = np.stack([x[:, 0] + r.normal(size=300) > 0.4, x[:, 2] - x[:, 1] + r.normal(size=300) > -1, np.arange(300) < 0], axis=1)
    rows = [(a.tolist(), t.tolist()) for a, t in zip(x, truth, strict=True)] + [(None, [True] * 3), (x[0].tolist(), None)]
    d = spark.createDataFrame(rows, "embedding array<double>, truth array<boolean>").repartition(5)
    mean, weights, fits = P.fit_probes(d, 3, l2=1e-2)
    assert np.allclose(mean, x.mean(axis=0))
    for f, form in enumerate(P.FORMS):
        for c in (0, 1):
            assert np.allclose(weights[f, c], reference(P.formed(x, x.mean(axis=0), form), truth[:, c].astype(float), 1e-2), atol=1e-6)
    assert fits["converged"].all() and (fits["fit_loss"] < fits["initial_loss"]).all() and (fits["n_train"] == 300).all()
    _, _, short = P.fit_probes(d, 3, l2=1e-2, steps=1)
    assert not short["converged"][0] and np.allclose(short["fit_loss"], np.log(2))
    seen = P.probe_scores(d, mean, weights)
    assert seen.count() == 300 * 9 and seen.where("p_yes IS NULL").count() == 0


def test_reports_without_rows_and_with_one_class_only(spark):
    none = spark.createDataFrame([], "embedding array<float>, truth array<boolean>")
    some = spark.createDataFrame([([1.0, 2.0], [True]), ([2.0, 0.0], [False]), ([0.0, 0.0], [True])], "embedding array<float>, truth array<boolean>")
    out = P.fit_probes(none, 2)
    assert out[1].shape == (3, 2, 1) and out[2]["fit_loss"].isna().all() and not out[2]["converged"].any()
    report = {r["form"]: r for r in P.probe_report(some, none, 1, l2=0.1).collect()}
    assert len(report) == 3 and report["raw"].auprc is None and report["raw"].converged
    report = P.probe_report(some, some.where(F.element_at("truth", 1)), 1, l2=0.1).collect()
    assert all(r.auroc is None and r.auprc == 1.0 and r.lift == 1.0 for r in report)
