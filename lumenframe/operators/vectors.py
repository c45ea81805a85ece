"""Vector statistics, as long rows (id, dimension, value): no dimension or group is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long(vectors: DataFrame, *keys: str) -> DataFrame:
    return vectors.select(*keys, F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def mean_vectors(vectors: DataFrame, *keys: str) -> DataFrame:
    return long(vectors, *keys).groupBy(*keys, "dim").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.try_divide(F.sum("x"), F.count_if(F.col("x") != 0)), 6).alias("nonzero_mean"))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """At least 0; null if one of them has no length."""
    return F.greatest(F.lit(0.0), 1 - F.try_divide(dot(a, b), norm(a) * norm(b)))


def euclidean(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")))


def linear_score(x: Column, weights: list[float], bias: float) -> Column:
    return dot(x, F.array(*map(F.lit, weights))) + bias


def calibrated_gain(target_norm: Column | float, width: Column | int) -> Column:
    """The gain with which a vector of unit entries has the target norm."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return lit(target_norm) / F.sqrt(lit(width))


def pooled(tokens: DataFrame, key: str, column: str) -> DataFrame:
    """Mean over the token vectors of each key, as one vector; tokens: key, array of arrays. Null without tokens."""
    each = tokens.select(key, F.explode(column).alias("_v")).select(key, F.posexplode("_v").alias("dim", "x"))
    means = each.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    one = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("embedding"))  # one entry a dimension
    return tokens.select(key).distinct().join(one, key, "left")


def norm_ratio(latents: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row: mean, least and greatest norm of latent positions, mean norm of real token positions, their ratio, and what it says; both: one vector a row in `embedding`."""
    a = latents.select(norm(F.col("embedding")).alias("v")).agg(F.avg("v").alias("latent_mean"), F.min("v").alias("latent_min"), F.max("v").alias("latent_max"))
    b = tokens.select(norm(F.col("embedding")).alias("v")).agg(F.avg("v").alias("token_mean"))
    r = F.try_divide("latent_mean", "token_mean")
    verdict = F.when(r.isNull(), "undefined").when(F.col("latent_mean") == 0, "zero").when(r < 0.1, "too short").when(r > 10, "too long").otherwise("comparable")
    rounded = [F.round(c, 5).alias(c) for c in ("latent_mean", "latent_min", "latent_max", "token_mean")]
    return a.crossJoin(F.broadcast(b)).select(*rounded, F.round(r, 5).alias("ratio"), verdict.alias("verdict"))  # one row each


def four_spreads(vectors: DataFrame, record: str, prompt: str) -> DataFrame:
    """Pooled mean cosine distance over pairs: of all, under one prompt, of one record; and across / within ratios (null on 0). From sums alone, no pair is formed."""
    names = {"all": F.lit("all"), "held prompt": F.col(prompt).cast("string"), "within record": F.col(record).cast("string")}
    out = None
    for name, key in names.items():
        keyed = unit(vectors).withColumn("_g", key).withColumn("_row", F.monotonically_increasing_id())
        d = keyed.select("_g", "_row", F.posexplode("embedding").alias("dim", "x")).groupBy("_g", "dim").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
        g = d.groupBy("_g").agg(F.max("n").alias("n"), F.sum(F.col("n") * F.col("q") - F.col("s") * F.col("s")).alias("t"))
        one = g.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.greatest(F.sum("t") / 2, F.lit(0.0)).alias("t")).select(F.lit(name).alias("over"), "pairs", F.try_divide("t", "pairs").alias("d"))
        out = one if out is None else out.unionAll(one)
    within = out.where("over = 'within record'").select(F.col("d").alias("w"))
    return out.crossJoin(F.broadcast(within)).select("over", F.col("pairs").cast("long").alias("pairs"), F.round("d", 5).alias("mean_cosine_distance"), F.round(F.try_divide(F.col("d"), F.when(F.col("w") > 1e-9, F.col("w"))), 3).alias("over_within"))  # within: one row


def centred_norms(vectors: DataFrame, training: Column) -> DataFrame:
    """Norm of each vector before and after the training rows' mean is taken off."""
    means = long(vectors.where(training), "vec_id").groupBy("dim").agg(F.avg("x").alias("m"))
    centre = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centre"))
    v = vectors.crossJoin(F.broadcast(centre))  # one row
    raw = F.transform("embedding", lambda x: x.cast("double"))
    return v.select("vec_id", F.round(norm(raw), 5).alias("norm"), F.round(norm(F.zip_with(raw, F.col("centre"), lambda x, m: x - m)), 5).alias("centred_norm"))


def spread(vectors: DataFrame, group: str) -> DataFrame:
    """Mean squared distance over the pairs of a group, from sums alone: no pair is formed."""
    d = long(vectors, group, "vec_id").groupBy(group, "dim").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    pairs = F.max("n") * (F.max("n") - 1) / 2
    total = F.sum(F.col("n") * F.col("q") - F.col("s") * F.col("s"))
    return d.groupBy(group).agg(F.max("n").alias("n"), F.round(F.when(F.max("n") > 1, F.greatest(total / pairs, F.lit(0.0))), 5).alias("mean_square_distance"))


def unit(vectors: DataFrame) -> DataFrame:
    """Embeddings as doubles of length one; a length below 1e-12 counts as 1e-12."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    norm = F.greatest(F.sqrt(F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v)), F.lit(1e-12))
    return vectors.withColumn("_norm", norm).withColumn("embedding", F.transform(x, lambda v: v / F.col("_norm"))).drop("_norm")


def cosine_spread(vectors: DataFrame, group: str) -> DataFrame:
    """Mean cosine distance over the pairs of a group: half the mean squared distance of unit vectors."""
    half = F.round(F.col("mean_square_distance") / 2, 4).alias("mean_cosine_distance")
    return spread(unit(vectors), group).select(group, "n", half)


def top_dimensions(vectors: DataFrame, key: str, k: int) -> DataFrame:
    """The k greatest dimensions of each vector by logistic probability, ties in their order."""
    p = F.transform("embedding", lambda x, i: F.struct((-x).alias("x"), i.alias("dim")))
    top = F.slice(F.array_sort(p), 1, k)
    each = vectors.select(key, F.posexplode(top).alias("rank", "d"))
    return each.select(key, "rank", F.col("d.dim").alias("dim"), F.round(1 / (1 + F.exp(F.col("d.x").cast("double"))), 6).alias("p"))
