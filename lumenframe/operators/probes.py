"""Linear probes: logistic regressions of every class over every form of the vectors, fitted together, one pass over the vectors a step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMS = ("raw", "centered", "centered_l2")
#: A final gradient norm above this means that the fit understates the vectors.
CONVERGED = 1e-2


def mean_vector(vectors: DataFrame) -> np.ndarray:
    """Mean of `embedding`, dimension by dimension; empty without rows."""
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    if not width:
        return np.zeros(0)
    row = vectors.agg(*[F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(f"d{i}") for i in range(width)]).first()
    return np.array(row, np.float64)


def formed(x: np.ndarray, mean: np.ndarray, form: str) -> np.ndarray:
    """Rows as they are, less the teaching rows' mean, or that at unit length; a last column of ones carries the bias."""
    if form != "raw":
        x = x - mean
    if form == "centered_l2":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return np.hstack([x, np.ones((len(x), 1))])


def _sums(vectors: DataFrame, mean: np.ndarray, weights: np.ndarray, forms: tuple[str, ...]) -> np.ndarray:
    """For each form and class, summed over all rows: loss, gradient and the upper half of the curvature. weights: forms x classes x (width + 1).

    A task adds up its own rows; the sums meet cell by cell in a shuffle, so what any task or the driver holds depends on width and classes alone.
    """
    n_forms, n_classes, wide = weights.shape
    upper = np.triu_indices(wide)
    cells = 1 + wide + len(upper[0])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_forms, n_classes, cells))
        for batch in batches:
            if not len(batch):
                continue
            raw, truth = np.stack(batch["embedding"].to_numpy()).astype(np.float64), np.stack(batch["truth"].to_numpy()).astype(np.float64)
            for f, form in enumerate(forms):
                x = formed(raw, mean, form)
                z = x @ weights[f].T
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                total[f, :, 0] += (np.logaddexp(0, z) - truth * z).sum(axis=0)
                total[f, :, 1 : 1 + wide] += (p - truth).T @ x
                for c in range(n_classes):
                    total[f, c, 1 + wide :] += ((x * (p[:, c] * (1 - p[:, c]))[:, None]).T @ x)[upper]
        yield pd.DataFrame({"cell": np.arange(total.size, dtype=np.int64), "s": total.ravel()})

    added = vectors.mapInPandas(part, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros(n_forms * n_classes * cells)
    out[added["cell"].to_numpy()] = added["s"].to_numpy()
    return out.reshape(n_forms, n_classes, cells)


def fit_probes(vectors: DataFrame, n_classes: int, l2: float = 1e-4, steps: int = 50, tolerance: float = 1e-9, forms: tuple[str, ...] = FORMS) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """Mean vector, weights (forms x classes x width + 1, the bias last) and a report of each fit; vectors: embedding, truth (a boolean of each class).

    Minimises mean cross entropy plus l2 times the squared weights, the bias free, by damped Newton steps: a step that doesn't
    lower the loss is halved. The curvature has width squared / 2 cells a fit, fit for some hundred dimensions. Rows with a
    null vector or truth don't count; without rows all weights are 0 and the loss is null.
    """
    rows = vectors.select("embedding", F.transform("truth", lambda t: t.cast("int")).alias("truth")).where("embedding IS NOT NULL AND truth IS NOT NULL")
    mean, n = mean_vector(rows), rows.count()
    wide = len(mean) + 1
    at = np.zeros((len(forms), n_classes, wide))
    loss, first, norm = (np.full(at.shape[:2], np.nan) for _ in range(3))
    if n:
        upper, penalty = np.triu_indices(wide), np.append(np.full(wide - 1, 2 * l2), 0.0)
        best, step, scale = at.copy(), np.zeros_like(at), np.ones(at.shape[:2])
        loss[:] = np.inf
        for k in range(steps):
            trial = best - scale[..., None] * step
            sums = _sums(rows, mean, trial, forms) / n
            for f, c in np.ndindex(*loss.shape):
                w = trial[f, c]
                value = sums[f, c, 0] + (penalty * w * w).sum() / 2
                if k == 0:
                    first[f, c] = value
                if not value <= loss[f, c] + 1e-15:
                    scale[f, c] /= 2
                    continue
                gradient = sums[f, c, 1 : 1 + wide] + penalty * w
                curve = np.zeros((wide, wide))
                curve[upper] = sums[f, c, 1 + wide :]
                curve = np.triu(curve) + np.triu(curve, 1).T + np.diag(penalty + 1e-12)
                best[f, c], loss[f, c], norm[f, c], scale[f, c] = w, value, np.linalg.norm(gradient), 1.0
                step[f, c] = np.linalg.solve(curve, gradient)
            if (norm <= tolerance).all() or (scale < 1e-9).all():
                break
        at = best
    fits = [(form, c, n, loss[f, c], first[f, c], norm[f, c], bool(norm[f, c] <= CONVERGED)) for f, form in enumerate(forms) for c in range(n_classes)]
    return mean, at, pd.DataFrame(fits, columns=["form", "class", "n_train", "fit_loss", "initial_loss", "gradient_norm", "converged"])


def probe_scores(vectors: DataFrame, mean: np.ndarray, weights: np.ndarray, forms: tuple[str, ...] = FORMS) -> DataFrame:
    """form, class, label and p_yes for each vector, form and class; vectors: embedding, truth."""
    n_classes = weights.shape[1]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            raw, truth = np.stack(batch["embedding"].to_numpy()).astype(np.float64), np.stack(batch["truth"].to_numpy()).astype(bool)
            for f, form in enumerate(forms):
                p = 1 / (1 + np.exp(-np.clip(formed(raw, mean, form) @ weights[f].T, -700, 700)))
                for c in range(n_classes):
                    yield pd.DataFrame({"form": form, "class": c, "label": truth[:, c], "p_yes": p[:, c]})

    rows = vectors.select("embedding", F.transform("truth", lambda t: t.cast("int")).alias("truth")).where("embedding IS NOT NULL AND truth IS NOT NULL")
    return rows.mapInPandas(score, "form string, class int, label boolean, p_yes double")


def probe_report(train: DataFrame, test: DataFrame, n_classes: int, l2: float = 1e-4, steps: int = 50) -> DataFrame:
    """A row for each form and class: the fit, and auprc, auroc and the gain over the positive rate on the test vectors."""
    from lumenframe.operators.metrics import ranking

    mean, weights, fits = fit_probes(train, n_classes, l2, steps)
    seen = probe_scores(test, mean, weights)
    rates = seen.groupBy("form", "class").agg(F.count("*").alias("n_test"), F.avg(F.col("label").cast("double")).alias("positive_rate"))
    found = ranking(seen, "form", "class").drop("n").join(rates, ["form", "class"])
    fitted = train.sparkSession.createDataFrame(fits.astype(object).where(fits.notna(), None).values.tolist(), "form string, class int, n_train long, fit_loss double, initial_loss double, gradient_norm double, converged boolean")
    return fitted.join(found, ["form", "class"], "left").withColumn("lift", F.try_divide("auprc", "positive_rate"))
