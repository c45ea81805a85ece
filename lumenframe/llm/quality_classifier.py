"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed byte n-grams, and of two shares of the text
in steps (words that repeat a word just before; distinct among neighbouring
word pairs), which n-grams alone can't show.  Each indicator is scaled by its
log-count ratio between the classes; a linear model with hinge loss is fitted
to the scaled, length-normalised indicators by dual coordinate descent, and
its values are mapped to probabilities by a logistic curve fitted out of fold,
weighted to the share of good labels among all that teach.

The fit uses at most PER_CLASS labelled documents of each class (a documented
bound; the first by hash of doc_id), on the driver; scoring is one pass.

Null and empty texts have no n-grams and get the score of a text without any.
Without labels of both classes the score is the share of good labels (0.5
without labels).  Repeated rows are scored each.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import SPACE, own_columns, word_bounds, word_hashes
from lumenframe.llm.training import byte_ngrams, first_by_doc, held_out, hinge_fit, labelled_sample, out_of_fold, platt, score_texts, sigmoid

ORDERS, BITS, PER_CLASS, THRESHOLD, REJECT_BELOW = (1, 2, 3), 15, 2000, 0.7, 0.5
FOLDS, HELD = 4, 2
_STEPS = 16


def indicators(data: np.ndarray) -> np.ndarray:
    """Sorted numbers of the features that a text has."""
    base = len(ORDERS) << BITS
    flags = np.zeros(base + 3 * _STEPS, bool)
    flags[byte_ngrams(data, ORDERS, BITS)] = True
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), SPACE)
    words = word_hashes(data, starts, ends)
    n = len(words)
    if n > 1:
        pairs = words[1:] ^ (words[:-1] << np.uint64(1))
        flags[base + int(np.mean(words[1:] == words[:-1]) * (_STEPS - 1))] = True
        flags[base + _STEPS + int(len(np.unique(pairs)) / (n - 1) * (_STEPS - 1))] = True
    flags[base + 2 * _STEPS + min(_STEPS - 1, n.bit_length())] = True
    return np.flatnonzero(flags)


WIDTH = (len(ORDERS) << BITS) + 3 * _STEPS


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    good, bad = np.ones(WIDTH), np.ones(WIDTH)
    for at, label in zip(rows, y, strict=True):
        (good if label > 0 else bad)[at] += 1
    return np.log(good / (1 + (y > 0).sum())) - np.log(bad / (1 + (y < 0).sum()))


class Model:
    def __init__(self, weights: np.ndarray, bias: float, curve: tuple[float, float]):
        self.weights, self.bias, self.curve = weights.astype(np.float32), bias, curve

    def score(self, data: np.ndarray, squares: np.ndarray) -> float:
        at = indicators(data)
        norm = np.sqrt(max(float(squares[at].sum()), 1e-12))
        return sigmoid(self.curve[0] * (float(self.weights[at].sum()) / norm + self.bias) + self.curve[1])


def fit(texts: list[str], labels: list[int], prior: float) -> tuple[Model, np.ndarray]:
    """The model, and the squared ratios that normalise a text."""
    y = np.where(np.array(labels, int) > 0, 1, -1) if labels else np.zeros(0, int)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(WIDTH), 0.0, (0.0, float(np.log(prior / (1 - prior))))), np.ones(WIDTH)
    found = [indicators(np.frombuffer((t or "").encode(), np.uint8)) for t in texts]
    ratio = log_count_ratios(found, y)
    rows = []
    for at in found:
        v = ratio[at]
        rows.append((np.append(at, WIDTH), np.append(v / np.sqrt(max(float(v @ v), 1e-12)), 1.0)))
    w = hinge_fit(rows, y, WIDTH + 1)
    curve = platt(out_of_fold(rows, y, WIDTH + 1), y, prior)
    return Model(w[:-1] * ratio, float(w[-1]), curve), ratio**2


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[Model, np.ndarray]:
    sample, counts = labelled_sample(labels, "quality", ~held_out(FOLDS, HELD), per_class)
    total = sum(counts.values())
    prior = min(max(sum(n for v, n in counts.items() if v > 0) / total, 0.01), 0.99) if total else 0.5
    rows = first_by_doc(docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label"), ["text", "label"])
    return fit([r["text"] for r in rows], [r["label"] for r in rows], prior)


def _scorer(model):
    def scorer():
        m, squares = model.value
        return lambda data: (m.score(data, squares),)

    return scorer


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score (1: good) and predicted."""
    docs = own_columns(docs, "doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    scored = score_texts(docs.withColumn("held_out", held_out(FOLDS, HELD)), "score double", _scorer(model))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = REJECT_BELOW) -> DataFrame:
    """docs, with all their columns, without those that are likelier bad than good."""
    model = docs.sparkSession.sparkContext.broadcast(train(own_columns(docs, "doc_id", "text"), labels))
    scored = score_texts(docs, "_quality_score double", _scorer(model), keep_text=True)
    return scored.where(F.col("_quality_score") >= least).select(*docs.columns)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
