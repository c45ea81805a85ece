"""Refusals: runs that would mix with another run's outputs, and outputs that can't be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StaleOutput(ValueError):
    """The outputs at hand were made from another input."""


class RunMismatch(ValueError):
    """A run's settings differ from those that were recorded."""


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file, read by an executor."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).head()[0]


def may_resume(stored: str | None, current: str, force: bool = False) -> bool:
    """False: nothing stored, start afresh. True: go on. Other digest and no force: refuse."""
    if stored is not None and stored != current and not force:
        raise StaleOutput(f"outputs come from {stored}, the input is now {current}")
    return stored is not None


def settle(recorded: dict, wanted: dict, before_recorded: dict, fatal: set[str], allowed: frozenset[str] | set[str] = frozenset()) -> dict:
    """The settings a run goes on with, each with what was recorded and whether they differ.

    A setting without a record has the value of before_recorded, never a later
    default.  A wanted value of None takes the recorded one.  A difference in a
    fatal setting is an error naming every such setting, unless it is allowed.
    """
    out, refused = {}, []
    for name in sorted({*recorded, *wanted, *before_recorded}):
        had = recorded.get(name, before_recorded.get(name))
        value = had if wanted.get(name) is None else wanted[name]
        out[name] = {"value": value, "recorded": had, "was_recorded": name in recorded, "mismatch": value != had}
        if value != had and name in fatal and name not in allowed:
            refused.append(f"{name}: recorded {had!r}, now {value!r}")
    if refused:
        raise RunMismatch("; ".join(refused))
    return out


def first_divergence(runs: DataFrame, condition: str, order: str, *keys: str) -> DataFrame:
    """condition, n, and the first place where its examples differ from the first condition's (null: nowhere).

    A place that only one of the two has is a difference.  Conditions are few;
    what is gathered for a place is one entry a condition.
    """
    names = runs.agg(F.array_sort(F.collect_set(condition)).alias("_names"))
    place = runs.groupBy(order).agg(F.map_from_entries(F.collect_list(F.struct(F.col(condition), F.struct(*keys)))).alias("_at"))
    each = place.crossJoin(F.broadcast(names)).withColumn(condition, F.explode("_names"))  # names: one row
    own, reference = F.col("_at")[F.col(condition)], F.col("_at")[F.get("_names", F.lit(0))]
    differs = ~own.eqNullSafe(reference)
    return each.groupBy(condition).agg(F.count(own).alias("n"), F.min(F.when(differs, F.col(order))).alias("first_divergence"))
