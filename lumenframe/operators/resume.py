"""Overlay, resume, deduplication and comparison of keyed outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlay(full: DataFrame, regenerated: DataFrame, key: str) -> DataFrame:
    """full with each row replaced that regenerated has; an id that only regenerated has is an error that names it."""
    rest = [c for c in full.columns if c != key]
    new = regenerated.select(key, F.struct(*rest).alias("_new"))
    joined = full.withColumn("_known", F.lit(True)).join(new, key, "full")
    unknown = F.raise_error(F.concat(F.lit("regenerated but not in the full set: "), F.col(key).cast("string"))).cast(full.schema[key].dataType)
    checked = F.when(F.col("_known").isNull(), unknown).otherwise(F.col(key)).alias(key)
    return joined.select(checked, *[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in rest])


def skip_existing(todo: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    return todo.join(done.select(*keys), list(keys), "left_anti")


def last_write_wins(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; a partial aggregate, not a window, so a hot key is combined before it is shuffled."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(key, *[F.col("_row")[c].alias(c) for c in rest])


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values and where each was first seen."""
    return rows.groupBy(value).agg(F.min(order).alias("first"))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, and which."""
    only = lambda a, b, side: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("only", F.lit(side))
    return only(left, right, "left").unionAll(only(right, left, "right"))


def multiset_equality(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: whether both have the same rows equally often, and how many differ each way, from one aggregate of both."""
    both = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    differ = both.groupBy(*left.columns).agg(F.sum("_n").alias("d"))
    out = differ.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("only_right"))
    return out.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def identical_across(outputs: DataFrame, key: str, condition: str, text: str) -> DataFrame:
    """Examples present in every condition, and how many have one and the same text in all."""
    n = outputs.select(condition).distinct().agg(F.count("*").alias("conditions"))
    each = outputs.groupBy(key).agg(F.countDistinct(condition).alias("seen"), F.countDistinct(text).alias("texts"))
    shared = each.join(F.broadcast(n), F.col("seen") == F.col("conditions"))  # n: one row
    return shared.agg(F.count("*").alias("shared"), F.count_if(F.col("texts") == 1).alias("identical"))


def written_of(done: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Requested ids (with their place `ord`) that were written in this run, in the order asked for."""
    return requested.join(done.select(key).distinct(), key, "left_semi").orderBy("ord")
