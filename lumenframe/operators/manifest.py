"""Summaries over nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.labels import asserted
from lumenframe.operators.series import numbered


def flags(manifest: DataFrame) -> DataFrame:
    """Per record: number of statements, whether all likelihoods are 0 (and there are any), normality by three definitions."""
    s = F.col("statements")
    diagnostic = lambda x: F.array_distinct(F.transform(F.filter(s, x), lambda y: y["class"]))
    norm_only = lambda a: F.coalesce((F.size(a) == 1) & (F.get(a, F.lit(0)) == "NORM"), F.lit(False))
    return manifest.select(
        "ecg_id", "strat_fold", "validated", F.size(s).alias("n_statements"), ((F.size(s) > 0) & F.forall(s, lambda x: x["likelihood"] == 0)).alias("all_zero"),
        norm_only(F.array_distinct(F.transform(s, lambda x: x["class"]))).alias("only_norm"), norm_only(asserted(s)).alias("diagnostic_norm"),
        norm_only(diagnostic(lambda x: x["diagnostic"] & (x["likelihood"] > 0))).alias("likely_norm"),
        (F.exists(s, lambda x: x["rhythm"]) & F.exists(s, lambda x: x["form"])).alias("rhythm_and_form"), F.exists(s, lambda x: x["diagnostic"] & (x["likelihood"] > 0) & (x["likelihood"] <= 50)).alias("low_likelihood"),
    )


def summary(manifest: DataFrame) -> DataFrame:
    f = flags(manifest)
    return f.agg(
        F.count("*").alias("n"), F.median("n_statements").alias("median_statements"), F.max("n_statements").cast("long").alias("max_statements"), F.count_if("all_zero").alias("all_zero"),
        F.count_if("only_norm").alias("only_norm"), F.count_if("diagnostic_norm").alias("diagnostic_norm"), F.count_if("likely_norm").alias("likely_norm"),
        F.count_if("rhythm_and_form").alias("rhythm_and_form"), F.count_if("low_likelihood").alias("low_likelihood"),
    )


def validation_crosstab(records: DataFrame) -> DataFrame:
    """Folds 1 to 10 by validation; a fold without records has zeros."""
    counts = records.groupBy("strat_fold").agg(F.count_if("validated").alias("validated"), F.count_if(~F.col("validated")).alias("unvalidated"))
    folds = records.sparkSession.range(1, 11).withColumnRenamed("id", "strat_fold")
    return folds.join(counts, "strat_fold", "left").na.fill(0, ["validated", "unvalidated"])


def records_per_fold(records: DataFrame) -> DataFrame:
    """Records of each fold that has any, in order."""
    return records.groupBy("strat_fold").agg(F.count("*").alias("n")).orderBy("strat_fold")


def normality_shares(manifest: DataFrame, total: int) -> DataFrame:
    """(definition, n, percent) of the three definitions of normality; percent is of a stated total, not of the records at hand."""
    names = ["only_norm", "diagnostic_norm", "likely_norm"]
    one = flags(manifest).agg(*[F.count_if(n).alias(n) for n in names])
    each = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("definition"), F.col(n).alias("n")) for n in names])).alias("d")).select("d.*")
    return each.withColumn("percent", F.round(F.try_divide(100 * F.col("n"), F.lit(total)), 2))


def validated_by_fold(records: DataFrame) -> DataFrame:
    """Folds 1 to 10: records, validated ones and their percentage, null in a fold without records."""
    c = validation_crosstab(records).withColumn("records", F.col("validated") + F.col("unvalidated"))
    return c.select("strat_fold", "records", "validated", F.round(F.try_divide(100 * F.col("validated"), F.col("records")), 2).alias("percent"))


def validation_table(records: DataFrame, validated: str, generated: str) -> DataFrame:
    """Two by two: (validated, generated, n), all four cells, zeros too; a null flag counts as false."""
    v, g = F.coalesce(validated, F.lit(False)), F.coalesce(generated, F.lit(False))
    cells = [(a, b) for a in (True, False) for b in (True, False)]
    one = records.agg(*[F.count_if((v == a) & (g == b)).alias(f"_{i}") for i, (a, b) in enumerate(cells)])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("validated"), F.lit(b).alias("generated"), F.col(f"_{i}").alias("n")) for i, (a, b) in enumerate(cells)]))
    return one.select(each.alias("c")).select("c.*")


def top_codes(statements: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent codes; ties go to the smaller code."""
    return statements.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(k)


def code_sets(manifest: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent sets of rhythm or form codes over all records; a record without any has the empty set."""
    codes = F.array_sort(F.transform(F.filter("statements", lambda s: s["rhythm"] | s["form"]), lambda s: s["code"]))
    keyed = manifest.select(F.array_join(F.transform(codes, lambda c: c.cast("string")), "+").alias("codes"))
    return keyed.groupBy("codes").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "codes").limit(k)


def accompanying_sets(manifest: DataFrame, k: int = 10) -> DataFrame:
    """Those sets beside a normal recording (one whose diagnostic classes are NORM alone)."""
    classes = asserted(F.col("statements"))
    return code_sets(manifest.where((F.size(classes) == 1) & F.array_contains(classes, "NORM")), k)


def shard_layout(records: DataFrame, size: int = 2000) -> DataFrame:
    """Shard and row of each record in order of ecg_id, `size` records a shard."""
    n = numbered(records.select("ecg_id"), "_n", "ecg_id")
    return n.select("ecg_id", F.floor(F.col("_n") / size).alias("shard"), (F.col("_n") % size).alias("row"))
