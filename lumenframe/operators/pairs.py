"""Distances over all pairs of a group, by a triangle of blocks: what sums can't give, and no task holds a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.vectors import norm

#: Rows of a block, each of which is sent to every block of its group, and of a tile, whose pairs are in memory together.
BLOCK, TILE = 16384, 512


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors, in order of the keys, so that a block meets itself in one order."""
    keys = table["_row"].to_numpy()
    order = np.argsort(keys, kind="stable")
    flat = table["embedding"].combine_chunks().flatten().to_numpy().astype(float)
    return keys[order], flat.reshape(len(keys), -1)[order] if len(keys) else np.zeros((0, 0))


def _tile(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, above: bool) -> tuple[float, float]:
    """Sums of both distances over all pairs of a and b, or those above the diagonal. Differences that products would round away are taken anew."""
    dot, size = a @ b.T, la[:, None] ** 2 + lb[None, :] ** 2
    square = size - 2 * dot
    dot /= np.maximum(la[:, None] * lb[None, :], 1e-8)
    cosine = np.maximum(1 - dot, 0, out=dot)
    near = square < 1e-3 * size
    np.sqrt(np.maximum(square, 0, out=square), out=square)
    i, j = np.nonzero(np.triu(near, 1) if above else near)
    for k in range(0, len(i), TILE):
        square[i[k : k + TILE], j[k : k + TILE]] = np.linalg.norm(a[i[k : k + TILE]] - b[j[k : k + TILE]], axis=1)
    return (float(np.triu(cosine, 1).sum()), float(np.triu(square, 1).sum())) if above else (float(cosine.sum()), float(square.sum()))


def _block_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    (_, a), (_, b) = _rows(left), _rows(right)
    same, cosine, l2 = left["_i"][0].as_py() == left["_j"][0].as_py(), 0.0, 0.0
    la, lb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    for i in range(0, len(a), TILE):
        for j in range(i if same else 0, len(b), TILE):
            x, y = _tile(a[i : i + TILE], b[j : j + TILE], la[i : i + TILE], lb[j : j + TILE], same and i == j)
            cosine, l2 = cosine + x, l2 + y
    pairs = len(a) * (len(a) - 1) // 2 if same else len(a) * len(b)
    return pa.table({"_g": left["_g"].slice(0, 1), "pairs": [pairs], "cosine": [cosine], "l2": [l2]})


def pair_sums(vectors: DataFrame, group: str, row: str, block: int = BLOCK) -> DataFrame:
    """group, pairs, and sums of cosine distance (not below 0) and of Euclidean length of the difference over each group's pairs of rows.

    row: a long that names a row within its group; rows without vector or name don't count.
    Rows are dealt over blocks of about `block`; each pair of blocks meets in one task.  Vectors move in their own type and are doubles in the task.
    """
    v = vectors.where(F.col("embedding").isNotNull() & F.col(row).isNotNull()).select(F.col(group).cast("string").alias("_g"), F.col(row).alias("_row"), "embedding")
    blocks = v.groupBy(F.col("_g").alias("_of")).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    dealt = v.join(blocks, F.col("_g").eqNullSafe(F.col("_of"))).select("_g", "_row", "embedding", "_n", F.pmod(F.xxhash64("_row"), F.col("_n")).cast("int").alias("_b"))
    left = dealt.select("_g", F.col("_row").alias("_row"), F.col("embedding").alias("embedding"), F.col("_b").alias("_i"), F.explode(F.sequence("_b", F.col("_n") - 1)).alias("_j"))
    right = dealt.select(F.col("_g").alias("_h"), F.col("_row").alias("_row"), F.col("embedding").alias("embedding"), F.explode(F.sequence(F.lit(0), "_b")).alias("_k"), F.col("_b").alias("_l"))
    met = left.groupBy("_g", "_i", "_j").cogroup(right.groupBy("_h", "_k", "_l")).applyInArrow(_left_only, "_g string, pairs long, cosine double, l2 double")
    return met.groupBy(F.col("_g").alias(group)).agg(F.sum("pairs").alias("pairs"), F.sum("cosine").alias("cosine"), F.sum("l2").alias("l2"))


def _left_only(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows or not right.num_rows:  # a block that no row fell into
        return pa.table({"_g": pa.array([], pa.string()), "pairs": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64()), "l2": pa.array([], pa.float64())})
    return _block_pairs(left, right)


def mean_norm(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.avg(norm(F.col("embedding"))).alias("norm"))


def pooled_spread(vectors: DataFrame, group: str, row: str, name: str, norms: DataFrame) -> DataFrame:
    """One row: name, pairs of all groups, their mean cosine distance, mean length of the difference over the mean norm, and that norm; null without a pair."""
    sums = pair_sums(vectors, group, row).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.sum("cosine").alias("cosine"), F.sum("l2").alias("l2"))
    both = sums.join(norms)  # one row each
    return both.select(F.lit(name).alias("over"), "pairs", F.try_divide("cosine", "pairs").alias("cosine"), F.try_divide(F.try_divide("l2", "pairs"), "norm").alias("l2"), "norm")


def four_way_spread(inputs: DataFrame, outputs: DataFrame, held: DataFrame) -> DataFrame:
    """Spreads of inputs over records; of outputs over records with the prompt held fixed, over records with their own prompts, and within a record over questions; and what the held spread is of the within and of the input spread.

    inputs: record, embedding; outputs and held: record, question (a long), embedding.  A ratio with 0 or nothing below is null.
    """
    in_norm, out_norm = mean_norm(inputs), mean_norm(outputs)
    rows = pooled_spread(inputs.withColumn("_all", F.lit("all")), "_all", "record", "input", in_norm)
    rows = rows.unionByName(pooled_spread(held, "question", "record", "held", out_norm)).unionByName(pooled_spread(outputs, "question", "record", "own", out_norm))
    rows = rows.unionByName(pooled_spread(outputs, "record", "question", "within", out_norm))
    of = lambda name, c: F.max(F.when(F.col("over") == name, F.col(c)))
    base = rows.agg(*[of(n, c).alias(f"_{n}_{c}") for n in ("within", "input") for c in ("cosine", "l2")])
    ratio = lambda n, c: F.when(F.col("over") == "held", F.try_divide(F.col(c), F.col(f"_{n}_{c}"))).alias(f"{c}_of_{n}")
    return rows.join(base).select("over", "pairs", "cosine", "l2", "norm", *[ratio(n, c) for n in ("within", "input") for c in ("cosine", "l2")])  # base: one row
