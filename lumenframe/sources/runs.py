"""Settings that runs recorded: small files beside large outputs, read as one table without opening the outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.guards import RunMismatch

NAMED = 20  # runs that an error names


def write_settings(runs: DataFrame, root: str) -> None:
    """One folder a run (`run=..`) with its settings as a JSON line; a setting that is null isn't recorded. runs: run and a string column a setting."""
    runs.repartition("run").write.mode("errorifexists").option("ignoreNullFields", "true").partitionBy("run").json(root)


def run_settings(spark: SparkSession, root: str, *settings: str) -> DataFrame:
    """run and each setting as a string, null where the run has no record of it; a setting that no run has is null throughout.

    Only the JSON files of the run folders are opened, whatever else lies beside them.
    """
    schema = ", ".join(["run string", *[f"`{s}` string" for s in settings]])
    read = spark.read.schema(schema).option("pathGlobFilter", "*.json").option("basePath", root).json(f"{root}/run=*")
    return read.groupBy("run").agg(*[F.max(s).alias(s) for s in settings])  # a run's line is one; nulls of a retried empty part don't hide it


def settled(runs: DataFrame, wanted: dict[str, str | None], before: dict[str, str], fatal: set[str] | frozenset[str] = frozenset(), allowed: set[str] | frozenset[str] = frozenset(), together: tuple[set[str], ...] = ()) -> DataFrame:
    """(run, setting, value, recorded, was_recorded, mismatch, refused) of every run and setting of `before`.

    `before` has the value that each setting had before runs recorded it; that, and
    never today's default, stands for one without a record.  A wanted value of None takes the
    recorded one.  A set of `together` counts as recorded only where all of it is.
    Refused: a mismatch in a fatal setting that isn't allowed.
    """

    def one(name: str) -> Column:
        kin = next((s for s in together if name in s), {name})
        known = F.lit(True)
        for other in sorted(kin):
            known = known & F.col(other).isNotNull()
        had = F.coalesce(F.col(name), F.lit(before[name]))
        value = had if wanted.get(name) is None else F.lit(wanted[name])
        differs = ~value.eqNullSafe(had)
        refused = differs & F.lit(name in fatal and name not in allowed)
        return F.struct(F.lit(name).alias("setting"), value.alias("value"), had.alias("recorded"), known.alias("was_recorded"), differs.alias("mismatch"), refused.alias("refused"))

    return runs.select("run", F.explode(F.array(*[one(n) for n in sorted(before)])).alias("s")).select("run", "s.*")


def require_match(found: DataFrame) -> None:
    """RunMismatch if any run is refused: how many settings are, and the first NAMED of them."""
    bad = found.where("refused").orderBy("run", "setting").limit(NAMED).collect()
    if bad:
        raise RunMismatch("; ".join(f"{r['run']}: {r['setting']} was {r['recorded']!r}, now {r['value']!r}" for r in bad) + f" ({found.where('refused').count()} in all)")
