"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words is the sum over their common subsequences of three
letters, each weighted by DECAY for every letter it spans, within SPAN
letters: a gap or an inserted letter costs a factor, not the match.  Letters
are compared in lower case, with the usual digits and signs for letters, and
signs between letters don't count, so that "I.d-1ot" is "idiot"; single
letters that stand alone one after the other count as one word.

A document meets each landmark at its best word: the kernel, as a share of the
larger of its own and that of a word of INSERTED fewer letters than the word
has (so that inserted letters cost little, but a long word with letters of
everything doesn't match everything).  A share of NOTHING counts 0, of ALL
counts 1, and between them in proportion: chance overlaps count nothing.
These values, times the inverse root of the landmarks'
kernel matrix (the Nystroem map), go to a linear support vector machine,
fitted by dual coordinate descent, and a logistic curve fitted out of fold and
weighted to the share of toxic labels.  Landmarks are words of labelled
sentences of the fit: those most typical of toxic ones, passing over what a
chosen one covers, and some common words.

The fit uses at most PER_CLASS labelled documents of each class (a documented
bound; the first by hash of doc_id), on the driver; scoring is one pass in
which each task scores each distinct word once.

Null and empty texts: no word, all values 0.  Without labels of both classes
the score is the share of toxic labels (0.5 without labels).  Repeated rows
are scored each.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import BYTES, SPACE, U, own_columns, prefix_sums, spans, text_slices, word_bounds
from lumenframe.llm.training import batches_of, first_by_doc, held_out, hinge_fit, labelled_sample, out_of_fold, platt

DECAY, SPAN, INSERTED, NOTHING, ALL = 0.8, 7, 2, 0.6, 0.85
LANDMARKS, COMMON, COVERED, PER_CLASS, THRESHOLD = 64, 4, 0.75, 2000, 0.7
COST, FLOOR = 1.0, 0.05  # of the support vector machine; least eigenvalue of the landmarks' kernel matrix
FOLDS, HELD = 3, 1
POOLED_BYTES = 1 << 20
LONGEST, STRIDE = 24, 12  # longer words are met in overlapping parts
_NONE = 255
#: Letters by byte: a-z are 0-25, other letters (bytes from 128) share 26-31.
LETTERS = np.full(256, _NONE, np.uint8)
LETTERS[97:123] = LETTERS[65:91] = np.arange(26)
LETTERS[128:] = 26 + np.arange(128) % 6
#: Digits and signs that stand for letters.
for _sign, _letter in zip(b"0134578@$", b"oieastbas", strict=True):
    LETTERS[_sign] = _letter - 97


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, word starts, word ends, words before each row) of a slice; words without letters are left out."""
    codes = LETTERS[data]
    starts, ends, bounds = word_bounds(data, offsets, SPACE)
    before = np.concatenate([[0], np.cumsum(codes != _NONE)])
    first, last = before[starts], before[ends]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    # single letters one after the other, three or more, become one word
    single = last - first == 1
    goes_on = np.concatenate([[False], single[1:] & single[:-1] & (row[1:] == row[:-1])]) if len(single) else single
    head = np.maximum.accumulate(np.where(~goes_on, np.arange(len(goes_on)), 0)) if len(goes_on) else np.zeros(0, np.int64)
    size = np.bincount(head, minlength=len(head)) if len(head) else head
    joined = size[head] >= 3 if len(head) else np.zeros(0, bool)
    keep = ~(joined & goes_on)
    end = last.copy()
    heads = np.flatnonzero(joined & ~goes_on)
    end[heads] = last[heads + size[heads] - 1]
    first, last, row = first[keep], end[keep], row[keep]
    long = last - first > LONGEST
    if long.any():
        parts = np.where(long, -(-(last - first - LONGEST) // STRIDE) + 1, 1)
        inner = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, stop = np.repeat(first, parts) + STRIDE * inner, np.repeat(last, parts)
        first, last, row = begin, np.minimum(stop, np.where(np.repeat(long, parts), begin + LONGEST, stop)), np.repeat(row, parts)
    some = last > first
    first, last, row = first[some], last[some], row[some]
    return codes[codes != _NONE], first, last, np.searchsorted(row, np.arange(len(offsets)))


_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the three-letter subsequences of a word, and their weights."""
    if length not in _TRIPLES:
        at = np.array([c for c in combinations(range(length), 3) if c[2] - c[0] < SPAN], np.int64).reshape(-1, 3)
        _TRIPLES[length] = at, (DECAY ** (at[:, 2] - at[:, 0] - 2)).astype(np.float32) if len(at) else np.zeros(0, np.float32)
    return _TRIPLES[length]


def subsequences(letters: np.ndarray) -> np.ndarray:
    """The kernel's feature vector of one word."""
    at, weight = triples(len(letters))
    code = letters.astype(np.int64)[at]
    return np.bincount((code[:, 0] << 10) + (code[:, 1] << 5) + code[:, 2], weight, 1 << 15) if len(at) else np.zeros(1 << 15)


def self_weight(length: int) -> float:
    """The kernel of a word of so many different letters with itself."""
    return float((triples(length)[1] ** 2).sum())


class Kernel:
    """Kernel values of words with the landmarks, from 0 to 1."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        rows = np.array([subsequences(np.frombuffer(x, np.uint8)) for x in landmarks]).reshape(len(landmarks), 1 << 15)
        self.scale = (rows**2).sum(1)
        self.matrix = rows.T.astype(np.float32).copy()
        self.any = self.matrix.any(1)

    def values(self, letters: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.zeros((len(first), len(self.landmarks)), np.float32)
        size = last - first
        for length in np.unique(size).tolist():
            at, weight = triples(length)
            if not len(at):
                continue
            of = np.flatnonzero(size == length)
            for part in np.array_split(of, max(1, len(of) * len(at) // 400_000)):
                x = letters[first[part][:, None] + np.arange(length)].astype(np.int32)
                code = (x[:, at[:, 0]] << 10) + (x[:, at[:, 1]] << 5) + x[:, at[:, 2]]
                word, triple = np.nonzero(self.any[code])
                if not len(word):
                    continue
                worth = self.matrix[code[word, triple]] * weight[triple][:, None]
                begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                out[part[word[begins]]] = np.add.reduceat(worth, begins) / np.maximum(self.scale, self_weight(length - INSERTED))
        out -= NOTHING
        out /= ALL - NOTHING
        return np.clip(out, 0, 1, out)


class Pool:
    """A task's words: each distinct one meets the landmarks once."""

    def __init__(self, kernel: Kernel, most: int = 150_000):
        self.kernel, self.most = kernel, most
        self.table = np.zeros((most, len(kernel.landmarks)), np.float32)
        self.names, self.places = np.zeros(0, U), np.zeros(0, np.int64)  # sorted by name

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each row of a slice and landmark, the value at the row's best word."""
        letters, first, last, bounds = words_of(data, offsets)
        out = np.zeros((len(offsets) - 1, self.table.shape[1]), np.float32)
        if not len(first):
            return out
        names, some, inverse = np.unique(spans(prefix_sums(letters, BYTES), first, last, BYTES), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.names, names), max(0, len(self.names) - 1))
        new = self.names[at] != names if len(self.names) else np.ones(len(names), bool)
        if len(self.names) + new.sum() > self.most:
            self.names, self.places, new = self.names[:0], self.places[:0], np.ones(len(names), bool)
            if len(names) > self.most:
                self.most = 2 * len(names)
                self.table = np.zeros((self.most, self.table.shape[1]), np.float32)
        known, n = len(self.names), int(new.sum())
        self.table[known : known + n] = self.kernel.values(letters, first[some[new]], last[some[new]])
        every = np.concatenate([self.names, names[new]])
        order = np.argsort(every, kind="stable")
        self.names, self.places = every[order], np.concatenate([self.places, np.arange(known, known + n)])[order]
        place = self.places[np.searchsorted(self.names, names)][inverse]
        full = np.flatnonzero(np.diff(bounds) > 0)
        for r, a, b in zip(full.tolist(), bounds[full].tolist(), bounds[full + 1].tolist(), strict=True):
            out[r] = self.table[place[a:b]].max(0)
        return out


def choose_landmarks(word_sets: list[set[bytes]], toxic: np.ndarray, most: int = LANDMARKS) -> list[bytes]:
    """Words typical of toxic documents, the most typical first, none that one before it covers; and some common words."""
    bad, good = Counter(), Counter()
    for words, t in zip(word_sets, toxic.tolist(), strict=True):
        (bad if t else good).update(words)
    n_bad, n_good = toxic.sum(), (~toxic).sum()
    typical = []
    for w, k in bad.items():
        if k >= 3 and len(w) >= 3:
            worth = np.log((k + 0.5) / (n_bad + 1)) - np.log((good[w] + 0.5) / (n_good + 1))
            if worth > 0:
                typical.append((-worth * np.log(k + 1), w))
    chosen: list[bytes] = []
    rows, scale = np.zeros((most, 1 << 15), np.float32), np.zeros(most)
    for _, w in sorted(typical)[: 40 * most]:
        if len(chosen) >= most - COMMON:
            break
        own = subsequences(np.frombuffer(w, np.uint8))
        at, self_kernel = np.flatnonzero(own), float(own @ own)
        k = len(chosen)
        if not k or float((rows[:k, at] @ own[at] / np.maximum(scale[:k], self_kernel)).max()) < COVERED:
            rows[k], scale[k] = own, self_kernel
            chosen.append(w)
    common = [w for _, w in sorted((-k, w) for w, k in good.items() if len(w) >= 3)]
    return chosen + common[:COMMON]


class Model:
    def __init__(self, kernel: Kernel, root: np.ndarray, weights: np.ndarray, curve: tuple[float, float]):
        self.kernel, self.curve = kernel, curve
        self.direction, self.bias = root @ weights[:-1], float(weights[-1])  # of the linear model, seen from the kernel values

    def scores(self, values: np.ndarray) -> np.ndarray:
        x = self.curve[0] * (values @ self.direction + self.bias) + self.curve[1]
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(texts: list[str], labels: list[int], prior: float) -> Model:
    toxic = np.array(labels, int) > 0
    if not toxic.any() or toxic.all():
        kernel = Kernel([])
        return Model(kernel, np.zeros((0, 0)), np.zeros(1), (0.0, float(np.log(prior / (1 - prior)))))
    word_sets, raws = [], [(t or "").encode() for t in texts]
    for raw in raws:
        letters, first, last, _ = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        whole = letters.tobytes()
        word_sets.append({whole[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)})
    kernel = Kernel(choose_landmarks(word_sets, toxic))
    marks = [np.frombuffer(x, np.uint8) for x in kernel.landmarks]
    ends = np.cumsum([len(x) for x in marks])
    gram = kernel.values(np.concatenate(marks), ends - [len(x) for x in marks], ends).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2 + 1e-3 * np.eye(len(gram)))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, FLOOR))) @ vectors.T
    pool = Pool(kernel)
    seen = np.concatenate([pool.texts(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)])) for part in batches_of(raws, 100)]).astype(float)
    every = np.arange(len(gram) + 1)
    rows = [(every, np.append(z, 1.0)) for z in seen @ root]
    y = np.where(toxic, 1, -1)
    w = hinge_fit(rows, y, len(every), cost=COST)
    return Model(kernel, root, w, platt(out_of_fold(rows, y, len(every), cost=COST), y, prior))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    sample, counts = labelled_sample(labels, "toxic", ~held_out(FOLDS, HELD), per_class)
    total = sum(counts.values())
    prior = min(max(sum(n for v, n in counts.items() if v > 0) / total, 0.01), 0.99) if total else 0.5
    rows = first_by_doc(docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label"), ["text", "label"])
    return fit([r["text"] for r in rows], [r["label"] for r in rows], prior)


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score (1: toxic) and predicted."""
    docs = own_columns(docs, "doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))

    def run(batches):
        pool = Pool(model.value.kernel)
        for batch in batches:
            found = [model.value.scores(pool.texts(data, offsets)) for _, _, data, offsets in text_slices(batch, limit=POOLED_BYTES)]
            if found:
                doc, held = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out"))
                yield pa.record_batch([doc, held, pa.array(np.concatenate(found))], names=["doc_id", "held_out", "score"])

    scored = docs.withColumn("held_out", held_out(FOLDS, HELD)).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
