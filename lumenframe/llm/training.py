"""What the text classifiers share: folds, bounded labelled samples, hashed n-grams, a dual coordinate descent and Platt scaling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import BYTES, U, all_runs, give_back, own_columns, text_slices


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a document is kept from learning: crc32 of doc_id as text; rows without doc_id aren't, and never teach."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, teaches: Column, per_class: int) -> tuple[DataFrame, dict]:
    """(doc_id, label) of at most per_class documents of each label, the first by hash, and the counts of all labels that teach.

    A document with several labels takes the greatest; null labels and ids don't teach.
    """
    rows = own_columns(labels, "doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    rows = rows.where(teaches)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    parts = [rows.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in sorted(counts)]
    if not parts:
        return rows.limit(0), {}
    sample = parts[0]
    for p in parts[1:]:
        sample = sample.unionAll(p)
    return sample, counts


def first_by_doc(sample: DataFrame, columns: list[str]) -> list:
    """The rows of a bounded sample, one a document, in a fixed order."""
    rows = {}
    for r in sorted(sample.collect(), key=lambda r: (r["doc_id"], *[str(r[c]) for c in columns])):
        rows.setdefault(r["doc_id"], r)
    return list(rows.values())


def byte_ngrams(data: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Hashed byte n-grams of one text, each order in a range of 2**bits of its own, with repeats."""
    sums = np.zeros(len(data) + 1, U)
    up, _ = BYTES.get(len(data) + 1)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    return np.concatenate([(all_runs(sums, n, BYTES) >> U(64 - bits)).astype(np.int64) + (i << bits) for i, n in enumerate(orders)])


def char_ngrams(data: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Hashed n-grams of the characters of one UTF-8 text, each order in a range of 2**bits of its own, with repeats."""
    if not (data & 0x80).any():
        return byte_ngrams(data, orders, bits)
    sums = np.zeros(len(data) + 1, U)
    up, down = BYTES.get(len(data) + 1)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where characters start
    out = []
    for i, n in enumerate(orders):
        start, end = at[: max(0, len(at) - n)], at[n:]
        x = (sums[end] - sums[start]) * down[start] * U(0xBF58476D1CE4E5B9)  # as all_runs does, so that equal n-grams agree
        x ^= x >> U(32)
        out.append(((x * U(0x94D049BB133111EB)) >> U(64 - bits)).astype(np.int64) + (i << bits))
    return np.concatenate(out)


def score_texts(docs: DataFrame, columns: str, scorer: Callable[[], Callable[[np.ndarray], tuple]], keep_text: bool = False) -> DataFrame:
    """docs, without text unless asked for, and what the scorer says of each text's bytes; columns: their DDL."""
    kept = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    names = [f.name for f in kept] + [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        score = scorer()
        for batch in batches:
            out = []
            for _, _, data, offsets in text_slices(batch):
                out += [score(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            found = [pa.array(x) for x in zip(*out, strict=True)]
            if found:
                yield pa.record_batch([*[batch.column(batch.schema.get_field_index(f.name)) for f in kept], *found], names=names)
        give_back()

    return docs.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [columns]))


def hinge_fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, cost: float = 1.0, rounds: int = 25, seed: int = 0) -> np.ndarray:
    """Linear SVM with hinge loss by dual coordinate descent; rows are (indices, values) with the bias among them; y is -1 or 1."""
    w, alpha = np.zeros(width), np.zeros(len(rows))
    square = np.array([float(v @ v) for _, v in rows])
    share = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        change = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            if square[i] == 0:
                continue
            new = min(max(alpha[i] - (y[i] * float(w[at] @ v) - 1) / square[i], 0.0), share[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                change = max(change, abs(new - alpha[i]) * square[i])
                alpha[i] = new
        if change < 1e-3:
            break
    return w


def platt(values: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """(slope, shift) of the logistic curve for decision values, with classes weighted to the given share of positives."""
    positive = y > 0
    if not positive.any() or positive.all():
        return 0.0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    weight = np.where(positive, prior / positive.mean(), (1 - prior) / (1 - positive.mean()))
    target = np.where(positive, (positive.sum() + 1) / (positive.sum() + 2), 1 / ((~positive).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * values + b, -35, 35)))
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-9)
        haa, hab, hbb = (h * values**2).sum() + 1e-6, (h * values).sum(), h.sum() + 1e-6
        ga, gb = (g * values).sum() + 1e-6 * a, g.sum()
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(abs(da), abs(db))
        step = min(1.0, 2.0 / size) if size else 0
        a, b = a - step * da, b - step * db
        if size < 1e-8:
            break
    return float(a), float(b)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def out_of_fold(rows: list, y: np.ndarray, width: int, folds: int = 3, **options) -> np.ndarray:
    """Decision values of each row by models that haven't seen it, for calibration."""
    values = np.zeros(len(rows))
    for f in range(folds):
        test = np.arange(len(rows)) % folds == f
        w = hinge_fit([r for r, t in zip(rows, test, strict=True) if not t], y[~test], width, **options)
        values[test] = [float(w[at] @ v) for (at, v), t in zip(rows, test, strict=True) if t]
    return values


def batches_of(values: list, size: int) -> Iterator[list]:
    for i in range(0, len(values), size):
        yield values[i : i + size]
