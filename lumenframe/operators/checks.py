"""Verification of finished outputs: each returns rows of what was counted, or of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FailedCheck(ValueError):
    """A finished output isn't what it must be."""


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def final_counts(records: DataFrame, regenerated: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: records, distinct and repeated ids, regenerated ids that are absent, and, over blocks and over their records, failed, empty, leaking and contradicting ones.

    records: ecg_id; regenerated: ecg_id; blocks: ecg_id, conclusion, reasoning, leaks (array), mismatch.
    """
    ids = records.groupBy("ecg_id").count()
    one = ids.agg(F.sum("count").alias("n"), F.count("*").alias("n_unique"), F.count_if(F.col("count") > 1).alias("n_repeated"))
    absent = regenerated.select("ecg_id").distinct().join(records, "ecg_id", "left_anti").agg(F.count("*").alias("n_regenerated_absent"))
    bad = {"failed": F.col("conclusion").isNull(), "empty": F.trim(F.coalesce("reasoning", F.lit(""))) == "", "leaking": F.size("leaks") > 0, "mismatched": F.coalesce("mismatch", F.lit(False))}
    counts = [x for k, v in bad.items() for x in (F.count_if(v).alias(f"{k}_blocks"), F.count_distinct(F.when(v, F.col("ecg_id"))).alias(f"{k}_records"))]
    return one.crossJoin(F.broadcast(absent)).crossJoin(F.broadcast(blocks.agg(*counts)))  # one row each


def assert_final(counts: DataFrame, n: int) -> None:
    """An error that names every count which isn't as it must be; one row reaches the driver."""
    row = counts.head()
    wrong = [f"{k}: {row[k]}, expected {v}" for k, v in {"n": n, "n_unique": n, "n_repeated": 0, "n_regenerated_absent": 0, "leaking_blocks": 0}.items() if row[k] != v]
    if wrong:
        raise FailedCheck("; ".join(wrong))


def cache_problems(index: DataFrame, wanted: DataFrame, shard_size: int) -> DataFrame:
    """(problem, n) of an index (id, shard, row): ids without a slot, ids and slots that occur twice, shards with gaps or too many rows. Only problems with n > 0."""
    shards = index.groupBy("shard").agg(F.max("row").alias("last"), F.min("row").alias("first"), F.count_distinct("row").alias("rows"))
    parts = {
        "missing ids": wanted.select("id").distinct().join(index, "id", "left_anti"), "repeated ids": duplicates(index, "id"), "repeated slots": duplicates(index, "shard", "row"),
        "rows not contiguous": shards.where((F.col("first") != 0) | (F.col("last") + 1 != F.col("rows"))), "shards too large": shards.where(F.col("rows") > shard_size),
    }
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.unionAll(one)
    return out.where("n > 0")


def vector_problems(vectors: DataFrame, column: str, width: int) -> DataFrame:
    """One row: vectors, those of another width, and those with a NaN, an infinity or a null."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.agg(F.count("*").alias("n"), F.count_if(F.col(column).isNull() | (F.size(column) != width)).alias("wrong_width"), F.count_if(~F.coalesce(finite, F.lit(False))).alias("not_finite"))


def rebuilt_differences(stored: DataFrame, rebuilt: DataFrame, column: str) -> DataFrame:
    """(id, greatest absolute difference) where a rebuilt vector isn't exactly the stored one; an id that only one has, or another width, is null."""
    joined = stored.select("id", F.col(column).alias("a")).join(rebuilt.select("id", F.col(column).alias("b")), "id", "full")
    gap = F.when(F.size("a") == F.size("b"), F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))))
    return joined.select("id", gap.alias("gap")).where("gap IS NULL OR gap > 0")


def batch_of(index: DataFrame, batch_size: int) -> DataFrame:
    """index with the batch that wrote each row: contiguous blocks of a shard."""
    return index.withColumn("batch", F.floor(F.col("row") / batch_size))


def batch_members(index: DataFrame, ids: DataFrame, batch_size: int) -> DataFrame:
    """All rows of the batches that hold the given ids."""
    blocks = batch_of(index, batch_size)
    return blocks.join(blocks.join(ids.select("id").distinct(), "id", "left_semi").select("shard", "batch").distinct(), ["shard", "batch"], "left_semi")


def incomplete_shards(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Shards still to be built: absent, or with another number of rows or width; expected, found: shard, rows, width."""
    return expected.join(found, ["shard", "rows", "width"], "left_anti")


def derangement_problems(donors: DataFrame) -> DataFrame:
    """(ecg_id, why) where an example's donor is itself, is used twice, or has an embedding equal to its own; donors: ecg_id, donor, own, given."""
    used = donors.groupBy("donor").agg(F.count("*").alias("_uses"))
    why = F.when(F.col("ecg_id") == F.col("donor"), "its own donor").when(F.col("_uses") > 1, "donor used twice").when(F.col("own") == F.col("given"), "the donor's embedding is its own")
    return donors.join(used, "donor").select("ecg_id", why.alias("why")).where("why IS NOT NULL")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that both have: none, if the sets are disjoint."""
    return left.select(key).distinct().join(right, key, "left_semi")


def surviving(rows: DataFrame, found: Column, *keys: str) -> DataFrame:
    """Rows in which an array of what must not be there isn't empty."""
    return rows.select(*keys, found.alias("found")).where(F.size("found") > 0)


def not_converged(fits: DataFrame, limit: float = 1e-2) -> DataFrame:
    return fits.withColumn("converged", F.col("gradient_norm") <= limit)
