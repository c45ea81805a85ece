"""Deterministic draws by hash order, the same on any partitioning."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"_{seed}")))


def stratified_draw(grid: DataFrame, per_class: int, seed: int = 42) -> DataFrame:
    """Half yes and half no of each class; what one half lacks the other fills. A smaller draw is within a larger one of even halves."""
    cell = Window.partitionBy("superclass", "label").orderBy("h", "ecg_id")
    ranked = grid.withColumn("h", shuffled(F.col("ecg_id"), seed)).withColumn("rank", F.row_number().over(cell)).where(F.col("rank") <= per_class)
    sizes = ranked.groupBy("superclass").agg(F.count_if("label").alias("yes"), F.count_if(~F.col("label")).alias("no"))
    half = per_class // 2
    quota = F.when(F.col("label"), half + F.greatest(per_class - half - F.col("no"), F.lit(0))).otherwise(per_class - half + F.greatest(half - F.col("yes"), F.lit(0)))
    return ranked.join(F.broadcast(sizes), "superclass").where(F.col("rank") <= quota).select("ecg_id", "superclass", "label")  # sizes: one row a class


MODES = ("none", "superclass", "superclass-label")


def quotas(n: int, cells: int) -> list[int]:
    """n over the cells as evenly as whole numbers allow, the first ones taking what is left over."""
    return [n // cells + (i < n % cells) for i in range(cells)]


def wanted_counts(n: int, mode: str, classes: list[str], there: dict[tuple[str, bool], int]) -> tuple[dict[tuple, int], list[tuple[str, int, int]]]:
    """How many to draw of each cell, and (cell, there, wanted) of those that run short: a label takes what its sibling lacks."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; have {MODES}")
    if mode == "none":
        return {(): n}, []
    take, short = {}, []
    for name, quota in zip(classes, quotas(n, len(classes)), strict=True):
        have = {label: there.get((name, label), 0) for label in (True, False)}
        if mode == "superclass":
            take[name,] = quota
        else:
            even = dict(zip((True, False), quotas(quota, 2), strict=True))
            lack = {label: max(0, even[label] - have[label]) for label in even}
            short += [(f"{name} label={label}", have[label], even[label]) for label in even if lack[label]]
            take |= {(name, label): even[label] - lack[label] + lack[not label] for label in even}
        if sum(have.values()) < quota:
            short.append((name, sum(have.values()), quota))
    return take, short


def sample(grid: DataFrame, n: int | None, mode: str, classes: list[str], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """n examples (ecg_id, superclass, label) in all, by mode: of all rows, evenly over the classes, or also half yes and half no of each; and the shortfalls (cell, there, wanted).

    Cells are in a fixed order by hash, so a smaller draw is within a larger one where no cell runs short.  n null, or no less than there is, takes every row.
    """
    spark, rows = grid.sparkSession, grid.select("ecg_id", "superclass", "label")
    there = {(r["superclass"], r["label"]): r["n"] for r in rows.groupBy("superclass", "label").agg(F.count("*").alias("n")).collect()}
    kind = "cell string, there long, wanted long"
    if n is None or n >= sum(there.values()):
        return rows, spark.createDataFrame([], kind)
    take, short = wanted_counts(n, mode, classes, there)
    cell = ["superclass", "label"][: len(next(iter(take)))]
    keyed = rows.withColumn("_key", F.concat_ws("|", F.col("ecg_id").cast("string"), "superclass"))
    wanted = F.lit(n) if not cell else F.lit(0)
    for values, k in take.items() if cell else ():
        same = F.lit(True)
        for c, v in zip(cell, values, strict=True):
            same = same & (F.col(c) == v)
        wanted = F.when(same, F.lit(k)).otherwise(wanted)
    return first_by_hash(keyed, seed, "_key", wanted, *cell).select("ecg_id", "superclass", "label"), spark.createDataFrame(short, kind)


RANGES = 4096


def numbered_by_hash(rows: DataFrame, seed: int, key: str, name: str, *group: str) -> DataFrame:
    """rows with their place (from 0) in a group, in the order of a seeded hash of a unique key.

    Numbered in RANGES ranges of the hash, after counts of the ranges before, so that a group of all rows isn't numbered by one task.
    """
    dealt = rows.withColumn("_hash", shuffled(F.col(key), seed)).withColumn("_range", F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"))
    before = F.sum("_count").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_count")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_count")  # at most RANGES rows a group
    place = F.row_number().over(Window.partitionBy(*group, "_range").orderBy("_hash", key)) - 1
    return dealt.withColumn("_place", place).join(counts, [*group, "_range"]).withColumn(name, F.col("_place") + F.col("_before")).drop("_hash", "_range", "_place", "_before")


def first_by_hash(rows: DataFrame, seed: int, key: str, wanted: Column, *group: str) -> DataFrame:
    """The rows of each group whose place by numbered_by_hash is below `wanted` (of the group's columns).

    Counts of the ranges name the one range a group in which its draw ends.  Rows of the ranges before it are all taken and those after it
    left where they are; only the one range's rows are moved and numbered.
    """
    of_all, each = F.lit(0).alias("_of"), [*group]
    dealt = rows.withColumn("_hash", shuffled(F.col(key), seed)).withColumn("_range", F.substring("_hash", 1, 3)).select("*", of_all)
    counts = dealt.groupBy("_of", *each, "_range").agg(F.count("*").alias("_count"))  # at most RANGES rows a group
    before = F.coalesce(F.sum("_count").over(Window.partitionBy("_of", *each).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = counts.withColumn("_before", before).where(F.col("_before") < wanted)
    ends = reached.groupBy("_of", *each).agg(F.max("_range").alias("_last"), F.max("_before").alias("_before"))  # one row a group
    near = dealt.join(F.broadcast(ends), ["_of", *each]).where(F.col("_range") <= F.col("_last"))
    place = F.row_number().over(Window.partitionBy("_of", *each).orderBy("_hash", key)) - 1 + F.col("_before")
    last = near.where(F.col("_range") == F.col("_last")).withColumn("_place", place).where(F.col("_place") < wanted)
    return near.where(F.col("_range") < F.col("_last")).select(*rows.columns).unionByName(last.select(*rows.columns))


def derangement(keys: DataFrame, key: str, group: Column, seed: int = 7) -> DataFrame:
    """donor: another key of the same group, each key once, in one cycle by hash order; a group of one has no donor (null)."""
    cycle = numbered_by_hash(keys.select(key, group.alias("g")), seed, key, "_n", "g")
    sizes = cycle.groupBy("g").agg(F.count("*").alias("_size"))
    wanted = cycle.join(sizes, "g").withColumn("_n", (F.col("_n") + 1) % F.col("_size"))
    donors = cycle.select("g", "_n", F.col(key).alias("donor"))
    return wanted.join(donors, ["g", "_n"]).select(key, "g", F.when(F.col("donor") != F.col(key), F.col("donor")).alias("donor"))


def round_robin(rows: DataFrame, bucket: str, order: str, n: int) -> DataFrame:
    """The first n rows taken in turn from each bucket."""
    turn = F.row_number().over(Window.partitionBy(bucket).orderBy(order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", bucket).limit(n)


def covering_records(grid: DataFrame, n: int, floor: int, classes: list[str], seed: int = 42) -> DataFrame:
    """turn and ecg_id of n records, each the one that answers most of what is still short of floor yes and floor no a class.

    Records without an answer to every class aren't candidates; ties go by hash
    order.  Records with the same answers are alike but for that order, so no more
    than n of each pattern of answers can be chosen: the driver gets at most n
    rows for each of 2 ** len(classes) patterns.  Raises ValueError if there are
    too few candidates or the floor isn't met.
    """
    bit = F.sum(F.when(F.col("label"), F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, 1 << i)]), F.col("superclass"))).otherwise(0))
    whole = grid.groupBy("ecg_id").agg(bit.alias("pattern"), F.countDistinct("superclass").alias("k")).where(F.col("k") == len(classes))
    ranked = whole.withColumn("h", shuffled(F.col("ecg_id"), seed)).withColumn("rank", F.row_number().over(Window.partitionBy("pattern").orderBy("h", "ecg_id")))
    queues: dict[int, list] = {}
    for row in ranked.where(F.col("rank") <= n).orderBy("pattern", "rank").collect():
        queues.setdefault(row.pattern, []).append((row.h, row.ecg_id))
    if sum(map(len, queues.values())) < n:
        raise ValueError(f"{n} records asked for, {sum(map(len, queues.values()))} have all {len(classes)} answers")
    short = {(i, yes): floor for i in range(len(classes)) for yes in (0, 1)}
    chosen = []
    while len(chosen) < n:
        gain = {p: sum(short[i, p >> i & 1] > 0 for i in range(len(classes))) for p, q in queues.items() if q}
        best = min(gain, key=lambda p: (-gain[p], queues[p][0]))
        chosen.append((len(chosen), queues[best].pop(0)[1]))
        for i in range(len(classes)):
            short[i, best >> i & 1] -= 1
    missing = [f"{classes[i]} {'yes' if yes else 'no'} has {floor - left}" for (i, yes), left in short.items() if left > 0]
    if missing:
        raise ValueError("floor not met: " + ", ".join(missing))
    return grid.sparkSession.createDataFrame(chosen, "turn int, ecg_id long")


def exact_sample(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """Exactly n rows (all, if there are fewer), the first by hash of seed and keys: a smaller sample is part of a larger one."""
    order = shuffled(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), seed)
    return rows.orderBy(order, *keys).limit(n)


def permuted_labels(rows: DataFrame, seed: int, key: str, labels: list[str]) -> DataFrame:
    """Each key with the labels of another row: a permutation of whole rows, so that every column's positive rate stays exact."""
    keys = numbered_by_hash(rows.select(key), seed, key, "_n")
    given = numbered_by_hash(rows.select(key, *labels), seed + 1, key, "_n").drop(key)
    return keys.join(given, "_n").drop("_n")


def evenly_spaced(rows: DataFrame, n: int, total: int, place: str) -> DataFrame:
    """n rows at even steps from the first to the last of `total` places."""
    wanted = rows.sparkSession.createDataFrame([(round(i * (total - 1) / max(1, n - 1)),) for i in range(min(n, total))], f"{place} long").distinct()
    return rows.join(F.broadcast(wanted), place, "left_semi")  # n rows


def one_of_each(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """The first row of each group."""
    first = rows.groupBy(group).agg(F.min_by(F.struct(*[c for c in rows.columns if c != group]), F.struct(*order)).alias("_r"))
    return first.select(group, "_r.*")


def chosen_examples(examples: DataFrame, ids: DataFrame) -> DataFrame:
    """All examples of the chosen records, in the order of the records."""
    return examples.join(ids.select("ecg_id").distinct(), "ecg_id", "left_semi").orderBy("ecg_id", "superclass")


def first_examples(examples: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n examples in order, or all if there are fewer."""
    return examples.orderBy(*order).limit(n)


def selection_record(selected: DataFrame) -> DataFrame:
    """(superclass, yes, no, records): what a run notes about its draw."""
    return selected.groupBy("superclass").agg(F.count_if("label").alias("yes"), F.count_if(~F.col("label")).alias("no"), F.count_distinct("ecg_id").alias("records"))


def pilot(members: DataFrame, quotas: dict[str, int], answers: DataFrame, target: int, seed: int) -> list[int]:
    """At most `target` record ids: so many of each stratum, each record once, then one yes and one no for each class, trimmed from the end where coverage allows, padded by hash.

    members: stratum, ecg_id; answers: ecg_id, superclass, label.  Spark ranks; the driver gets at most the quotas, ten
    records for coverage, `target` for padding, and the answers of those: bounded by the arguments.
    """
    by_hash = shuffled(F.concat_ws("|", "stratum", F.col("ecg_id").cast("string")), seed)
    drawn = [r["ecg_id"] for stratum, quota in quotas.items() for r in members.where(F.col("stratum") == stratum).orderBy(by_hash, "ecg_id").limit(quota).collect()]
    selected = list(dict.fromkeys(drawn))
    key = shuffled(F.col("ecg_id"), seed)
    of_cells = {(r["superclass"], r["label"]): r["e"] for r in answers.groupBy("superclass", "label").agg(F.min_by("ecg_id", key).alias("e")).collect()}
    padding = [r["ecg_id"] for r in answers.select("ecg_id").distinct().orderBy(key, "ecg_id").limit(target + len(selected)).collect()]
    pool = answers.sparkSession.createDataFrame([(e,) for e in {*selected, *padding, *of_cells.values()}], "ecg_id long")
    has: dict[int, set] = {}
    for r in answers.join(F.broadcast(pool), "ecg_id", "left_semi").collect():
        has.setdefault(r["ecg_id"], set()).add((r["superclass"], r["label"]))
    for cell, e in sorted(of_cells.items()):
        if not any(cell in has.get(x, ()) for x in selected):
            selected.append(e)
    times = Counter(cell for e in selected for cell in has.get(e, ()))
    spare = len(selected) - target
    for e in selected[::-1]:
        if spare > 0 and all(times[cell] > 1 for cell in has.get(e, ())):
            times.subtract(has.get(e, ()))
            selected.remove(e)
            spare -= 1
    selected = selected[:target]
    return selected + [e for e in padding if e not in set(selected)][: target - len(selected)]
