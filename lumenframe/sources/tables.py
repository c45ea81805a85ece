"""Typed bindings of the record model to the star-schema tables; narrow projections, so scans read only what a query uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The classes, in their order.
CLASSES = ["NORM", "MI", "STTC", "CD", "HYP"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ecg_id, strat_fold, validated, patient."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ecg_id"), (F.col("o_orderkey") % 10 + 1).alias("strat_fold"), (F.col("o_orderstatus") == "F").alias("validated"), F.col("o_custkey").alias("patient")
    )


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, description, diagnostic, rhythm, form, class: the dimension that statements name."""
    name = F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("code"), F.col("p_name").alias("description"), F.col("p_type").isin("STANDARD", "ECONOMY", "MEDIUM", "SMALL").alias("diagnostic"),
        (F.col("p_type") == "LARGE").alias("rhythm"), (F.col("p_size") % 3 == 0).alias("form"), name.alias("class"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ecg_id, ord, code, likelihood (0 is a value, not an absence) with the codebook's columns; an unknown code is an error."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ecg_id"), order, F.col("l_partkey").alias("code"), F.round(F.col("l_discount") * 100).alias("likelihood"))
    joined = lines.join(codebook(spark, sf_dir).withColumn("known", F.lit(True)), "code", "left")
    checked = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("code not in the codebook: "), F.col("code").cast("string")))).otherwise(F.col("diagnostic"))
    return joined.withColumn("diagnostic", checked.cast("boolean")).drop("known")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their statements nested in order; a record without statements has an empty list."""
    item = F.struct("ord", "code", "description", "diagnostic", "form", "rhythm", "class", "likelihood")
    nested = statements(spark, sf_dir).groupBy("ecg_id").agg(F.array_sort(F.collect_list(item)).alias("statements"))
    joined = records(spark, sf_dir).join(nested, "ecg_id", "left")
    return joined.withColumn("statements", F.when(F.col("statements").isNull(), F.array().cast(nested.schema["statements"].dataType)).otherwise(F.col("statements")))


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored examples: ecg_id, superclass, label, p_yes (with ties), parsed (null: not parsed), loss, n_tokens."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    e = docs.select("doc_id", "lang", "n_chars").join(labels, "doc_id")
    return e.select(
        F.col("doc_id").alias("ecg_id"), F.col("lang").alias("superclass"), (F.col("quality") == 1).alias("label"), ((F.col("doc_id") * 7919) % 101 / 100.0).alias("p_yes"),
        F.when(F.col("doc_id") % 7 != 0, (F.col("toxic") == 1) | ((F.col("doc_id") * 31) % 3 == 0)).alias("parsed"), (F.col("n_chars") / 1000.0).alias("loss"), F.col("n_chars").alias("n_tokens"),
    )


#: The same bindings in DuckDB SQL, for the oracles.
SQL = """
records AS (SELECT o_orderkey AS ecg_id, o_orderkey % 10 + 1 AS strat_fold, o_orderstatus = 'F' AS validated, o_custkey AS patient FROM orders),
codebook AS (SELECT p_partkey AS code, p_name AS description, p_type IN ('STANDARD', 'ECONOMY', 'MEDIUM', 'SMALL') AS diagnostic, p_type = 'LARGE' AS rhythm, p_size % 3 = 0 AS form,
    (['NORM', 'MI', 'STTC', 'CD', 'HYP'])[p_partkey % 5 + 1] AS class FROM part),
statements AS (SELECT l_orderkey AS ecg_id, l_partkey AS code, round(l_discount * 100) AS likelihood, diagnostic, rhythm, form, class FROM lineitem JOIN codebook ON l_partkey = code),
grid AS (SELECT r.ecg_id, r.strat_fold, c.superclass, c.k, CASE WHEN c.superclass = 'NORM' THEN coalesce(s.n = 1 AND s.norm, false) ELSE coalesce(list_contains(s.classes, c.superclass), false) END AS label
    FROM records r CROSS JOIN (VALUES ('NORM', 1), ('MI', 2), ('STTC', 3), ('CD', 4), ('HYP', 5)) c(superclass, k)
    LEFT JOIN (SELECT ecg_id, list(DISTINCT class) AS classes, count(DISTINCT class) AS n, bool_or(class = 'NORM') AS norm FROM statements WHERE diagnostic GROUP BY ecg_id) s ON s.ecg_id = r.ecg_id),
evals AS (SELECT d.doc_id AS ecg_id, lang AS superclass, quality = 1 AS label, (d.doc_id * 7919) % 101 / 100.0::DOUBLE AS p_yes,
    CASE WHEN d.doc_id % 7 <> 0 THEN toxic = 1 OR (d.doc_id * 31) % 3 = 0 END AS parsed, n_chars / 1000.0::DOUBLE AS loss, n_chars AS n_tokens FROM documents d JOIN labels USING (doc_id))
"""
