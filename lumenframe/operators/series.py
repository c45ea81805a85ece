"""Whole tables in one order: places, running means, windows of rows, and exact quantiles, none of them through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.sources.scratch import keep

BLOCK, BINS, SMALL = 100_000, 1024, 100_000


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with their place (from 0) in the given order, which should be unique.

    Rows are dealt by ranges and kept; each range is numbered by itself, behind the
    counts of the ranges before, of which there are as many as partitions.
    """
    dealt = keep(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before, total = [], 0
    for r in sorted(dealt.groupBy("_part").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_part"]):
        before.append((r["_part"], total))
        total += r["n"]
    first = rows.sparkSession.createDataFrame(before, "_part int, _before long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(first), "_part").withColumn(name, own + F.col("_before")).drop("_part", "_before")


def running_means(rows: DataFrame, value: str, width: int, *order: str, block: int = BLOCK) -> DataFrame:
    """rows with `running`, the mean of the last `width` values up to each row; the first rows have fewer.

    Numbered rows fall into blocks of `block`; the last width - 1 rows of a block are copied to the next, so that every window is within one.
    """
    block = max(block, width)
    n = numbered(rows, "_n", *order)
    own = F.floor(F.col("_n") / block)
    late = F.pmod("_n", F.lit(block)) >= block - (width - 1)
    each = n.withColumn("_block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    last = Window.partitionBy("_block").orderBy("_n").rowsBetween(1 - width, 0)
    return each.withColumn("running", F.avg(value).over(last)).where(F.col("_block") == own).drop("_n", "_block")


def window_terms(batches: DataFrame, width: int, *order: str) -> DataFrame:
    """Each window of `width` batches reduced: llm and linear are means over its batches, consistency and gap over the rows they were taken on (n_consistency; null: none).

    batches: llm, linear, consistency, gap (null where nothing was taken), n_consistency, n_skipped.  Also the mean loss up to the window's end.
    """
    n = numbered(batches, "_n", *order).withColumn("window", F.floor(F.col("_n") / width))
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("n_consistency")), F.sum("n_consistency")).alias(c)
    return n.groupBy("window").agg(
        F.count("*").alias("batches"), F.avg("llm").alias("llm"), F.avg("linear").alias("linear"), weighted("consistency"), weighted("gap"),
        F.sum("n_consistency").alias("n_consistency"), F.sum("n_skipped").alias("n_skipped"),
    )


def exact_quantiles(rows: DataFrame, value: str, at: list[float], *keys: str, small: int = SMALL) -> DataFrame:
    """keys and p10, p50, .. (for at = 0.1, 0.5, ..): quantiles of a group's values, interpolated between neighbours; nulls don't count, values are finite.

    The two values around each quantile are found by their ranks.  A range that
    holds more than `small` rows is cut into BINS equal parts, the part with the
    wanted rank is the next range, from its least to its greatest value; what is
    left then, at most `small` rows, is sorted.  A group of equal values needs no
    pass.  No group's values are ever held together.
    """
    ks = [f"_{k}" for k in keys]
    v = rows.where(F.col(value).isNotNull()).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).cast("double").alias("_v"))
    sizes = keep(v.groupBy(*ks).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).where("n > 0"))
    place = F.array(*[F.lit(q) * (F.col("n") - 1) for q in at])
    ranks = F.array_distinct(F.flatten(F.transform(place, lambda p: F.array(F.floor(p), F.ceil(p)))))
    state = sizes.select(*ks, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("m"))
    wide = (F.col("lo") < F.col("hi")) & (F.col("m") > small)
    while not state.where(wide).isEmpty():
        wanted = state.where(wide)
        spans = wanted.select(*[F.col(k).alias(f"{k}_") for k in ks], "lo", "hi", "before").distinct()
        inside = _all_same(ks) & F.col("_v").between(F.col("lo"), F.col("hi"))
        part = F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        binned = v.join(spans, inside).groupBy(*ks, "before", part.alias("bin")).agg(F.count("*").alias("m"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        up_to = F.sum("m").over(Window.partitionBy(*ks, "before").orderBy("bin"))  # at most BINS rows
        end = F.col("before") + up_to
        binned = binned.select(*[F.col(k).alias(f"{k}_") for k in ks], F.col("before").alias("_range"), (end - F.col("m")).alias("start"), end.alias("end"), "m", "lo", "hi")
        hit = _all_same(ks) & (F.col("_range") == F.col("before")) & (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("end"))
        narrower = wanted.select(*ks, "rank", "before").join(binned, hit).select(*ks, "rank", "lo", "hi", F.col("start").alias("before"), "m")
        state = keep(state.where(~wide).unionByName(narrower))
    spans = state.where("lo < hi").select(*[F.col(k).alias(f"{k}_") for k in ks], "lo", "hi", "before").distinct()
    inside = _all_same(ks) & F.col("_v").between(F.col("lo"), F.col("hi"))
    listed = v.join(spans, inside).groupBy(*ks, "before").agg(F.array_sort(F.collect_list("_v")).alias("_all"))  # at most `small` values
    found = state.join(listed.select(*[F.col(k).alias(f"{k}_") for k in ks], F.col("before").alias("_range"), "_all"), _all_same(ks) & (F.col("_range") == F.col("before")), "left")
    one = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.get("_all", (F.col("rank") - F.col("before")).cast("int")))
    values = found.groupBy(*ks).agg(F.map_from_entries(F.collect_list(F.struct("rank", one.alias("x")))).alias("_by_rank"))  # two ranks a quantile
    both = sizes.select(*[F.col(k).alias(f"{k}_") for k in ks], "n").join(values, _all_same(ks))

    def quantile(q: float) -> Column:
        p = F.lit(q) * (F.col("n") - 1)
        low, high = F.element_at("_by_rank", F.floor(p)), F.element_at("_by_rank", F.ceil(p))
        return (low + (high - low) * (p - F.floor(p))).alias(f"p{round(100 * q)}")

    return both.select(*[F.col(f"_{k}").alias(k) for k in keys], *[quantile(q) for q in at])


def _all_same(ks: list[str]) -> Column:
    out = F.lit(True)
    for k in ks:
        out = out & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return out
