"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams are hashed runs of one to three characters of the lower-cased text.
Document frequencies come from every text that may teach (one pass; a vector
of fixed width is added up by Spark).  Weights are fitted by
follow-the-regularised-leader with L1 and L2 penalties on at most PER_CLASS
documents of each language (a documented bound; the first by hash of doc_id),
and a temperature that minimises the log loss of a fifth of the sample, which
the first fit hasn't seen, divides the logits.

Texts that are null or have no letter: `und`, with score 0.  Of equal
probabilities the first language by name is taken.  Null languages
don't teach.  Without any language to learn, every text is `und`.  Repeated
rows are judged each.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import own_columns, text_slices
from lumenframe.llm.training import char_ngrams, first_by_doc, held_out, labelled_sample, score_texts

ORDERS, BITS, PER_CLASS, FOLDS, HELD = (1, 2, 3), 15, 1500, 4, 2
WIDTH = len(ORDERS) << BITS


def has_letter(text: str) -> bool:
    """Unicode letters only: superscripts, fractions and enclosed numbers are none."""
    return any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    return char_ngrams(np.frombuffer(text.lower().encode(), np.uint8), ORDERS, BITS)


def tf_idf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(grams(text), minlength=WIDTH)
    at = np.flatnonzero(counts)
    v = (1 + np.log(counts[at])) * idf[at]
    return at, v / max(float(np.sqrt(v @ v)), 1e-12)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each n-gram is, and how many texts there are."""

    def run(batches):
        total, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in text_slices(batch):
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    flags = np.zeros(WIDTH, bool)
                    flags[grams(data[a:b].tobytes().decode())] = True
                    total += flags
                    n += 1
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(at, WIDTH)), pa.array(np.append(total[at], n))], names=["gram", "n"])

    out = np.zeros(WIDTH + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most WIDTH + 1 rows
        out[r["gram"]] = r["n"]
    return out[:-1], int(out[-1])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, rounds: int = 2, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1) -> np.ndarray:
    """Weights (n-gram, class) and, in the last row, the bias; most are exactly zero."""
    z, n = np.zeros((WIDTH + 1, classes)), np.zeros((WIDTH + 1, classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2))

    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, v = np.append(rows[i][0], WIDTH), np.append(rows[i][1], 1.0)
            w = weights(z[at], n[at])
            logits = v @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = np.outer(v, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(z, n)


def logits_of(w: np.ndarray, at: np.ndarray, v: np.ndarray) -> np.ndarray:
    return v @ w[at] + w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """What divides the logits so that their log loss is least."""
    best, least = 1.0, np.inf
    for t in np.exp(np.linspace(np.log(0.05), np.log(20), 121)):
        x = logits / t
        top = x.max(1, keepdims=True)
        loss = float((np.log(np.exp(x - top).sum(1)) + top[:, 0] - x[np.arange(len(y)), y]).mean())
        if loss < least - 1e-9:
            best, least = float(t), loss
    return best


def fit(texts: list[str], langs: list[str], idf: np.ndarray) -> tuple[list[str], np.ndarray, float]:
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], int)
    rows = [tf_idf(t, idf) for t in texts]
    aside = np.arange(len(rows)) % 5 == 4
    t = 1.0
    if aside.any() and len(names) > 1:
        w = ftrl([r for r, a in zip(rows, aside, strict=True) if not a], y[~aside], len(names))
        t = temperature(np.array([logits_of(w, *r) for r, a in zip(rows, aside, strict=True) if a]), y[aside])
    return names, ftrl(rows, y, len(names)), t


def identify(docs: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, lang_pred and score, the calibrated probability of lang_pred."""
    docs = own_columns(docs, "doc_id", "text", "lang")
    teaches = docs.where(~held_out(FOLDS, HELD) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    frequency, n = document_frequencies(teaches)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    sample, _ = labelled_sample(teaches.select("doc_id", "lang"), "lang", F.lit(True), per_class)
    rows = first_by_doc(teaches.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), ["text"])
    rows = [r for r in rows if has_letter(r["text"])]
    model = docs.sparkSession.sparkContext.broadcast((fit([r["text"] for r in rows], [r["label"] for r in rows], idf), idf) if rows else None)

    def scorer():
        if model.value is None:
            return lambda data: ("und", 0.0)
        (names, w, t), idf = model.value

        def judge(data: np.ndarray) -> tuple[str, float]:
            text = data.tobytes().decode()
            if not has_letter(text):
                return "und", 0.0
            x = logits_of(w, *tf_idf(text, idf)) / t
            p = np.exp(x - x.max())
            best = int(p.argmax())
            return names[best], float(p[best] / p.sum())

        return judge

    return score_texts(docs.drop("lang").withColumn("held_out", held_out(FOLDS, HELD)), "lang_pred string, score double", scorer)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
