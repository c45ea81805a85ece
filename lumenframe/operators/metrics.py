"""Ranking, loss and agreement metrics. Ranks are taken over distinct scores of a group, never over its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.series import exact_quantiles


def with_groups(evals: DataFrame, normal: str = "NORM") -> DataFrame:
    """Each row once for every group it is in: overall, its class, and normal or abnormal. The normal class is in both of its own."""
    names = F.array(F.lit("overall"), F.col("superclass"), F.when(F.col("superclass") == normal, "normal").otherwise("abnormal"))
    return evals.withColumn("grp", F.explode(F.array_compact(names)))


def prf1(tp: Column, predicted: Column, positive: Column) -> list[Column]:
    """Precision is 0 if nothing is predicted; recall and F1 are null without positives."""
    p = F.when(predicted == 0, 0.0).otherwise(tp / predicted)
    r = F.when(positive > 0, tp / positive)
    f = F.when(positive > 0, F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))
    return [F.round(x, 6).alias(n) for x, n in ((p, "precision"), (r, "recall"), (f, "f1"))]


def confusion(evals: DataFrame, predicted: Column, *keys: str) -> DataFrame:
    """Over the rows where the prediction isn't null."""
    e = evals.withColumn("_p", predicted).where(F.col("_p").isNotNull())
    c = e.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("_p") & F.col("label")).alias("tp"), F.count_if(F.col("_p")).alias("n_predicted"), F.count_if("label").alias("n_positive")
    )
    return c.select(*keys, "n", "n_positive", "n_predicted", *prf1(F.col("tp"), F.col("n_predicted"), F.col("n_positive")))


SLOTS = 1024


def by_score(evals: DataFrame, *keys: str) -> DataFrame:
    """Positives and negatives of each distinct score, and those above it.

    Scores from 0 to 1 are dealt over SLOTS ranges (others go to the ends): sums
    run over the ranges of a group, then within each, so that a group of all rows is not one task's.
    """
    slot = F.floor(F.least(F.greatest(F.col("p_yes").cast("double"), F.lit(0.0)), F.lit(1.0)) * SLOTS)
    s = evals.where(F.col("p_yes").isNotNull()).groupBy(*keys, "p_yes").agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg")).withColumn("_slot", slot)
    slots = s.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_slot").alias("_at")).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    group = Window.partitionBy(*[f"_{k}" for k in keys])
    above = group.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    slots = slots.select(*[f"_{k}" for k in keys], "_at", zero(F.sum("_p").over(above)).alias("_tp"), zero(F.sum("_n").over(above)).alias("_fp"), F.sum("_p").over(group).alias("P"), F.sum("_n").over(group).alias("N"))
    same = F.col("_slot") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    down = Window.partitionBy(*keys, "_slot").orderBy(F.desc("p_yes"))
    tp, fp = F.col("_tp") + F.sum("pos").over(down), F.col("_fp") + F.sum("neg").over(down)
    return s.join(slots, same).select(*keys, "p_yes", "pos", "neg", tp.alias("tp"), (tp + fp).alias("taken"), "P", "N", fp.alias("fp"))


def ranking(evals: DataFrame, *keys: str) -> DataFrame:
    """auroc (ties count half) and auprc (ties are one threshold); null if a class is empty."""
    s = by_score(evals, *keys)
    won = F.sum(F.col("pos") * (F.col("N") - F.col("fp") + F.col("neg") / 2))
    area = F.sum(F.col("pos") * F.col("tp") / F.col("taken"))
    out = s.groupBy(*keys).agg(F.max("P").alias("P"), F.max("N").alias("N"), won.alias("won"), area.alias("area"))
    auroc, auprc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("won") / F.col("P") / F.col("N")), F.when(F.col("P") > 0, F.col("area") / F.col("P"))
    return out.select(*keys, (F.col("P") + F.col("N")).alias("n"), F.round(auroc, 6).alias("auroc"), F.round(auprc, 6).alias("auprc"))


def best_f1(evals: DataFrame, *keys: str) -> DataFrame:
    """The threshold of the greatest F1, the highest among equals; none without positives."""
    f1 = F.round(2 * F.col("tp") / (F.col("taken") + F.col("P")), 9)
    best = by_score(evals, *keys).where("P > 0").groupBy(*keys).agg(F.max(F.struct(f1.alias("f1"), F.col("p_yes").alias("threshold"))).alias("b"))
    return best.select(*keys, F.col("b.threshold").alias("threshold"), F.round("b.f1", 6).alias("f1"))


def agreement(evals: DataFrame) -> DataFrame:
    """Fast score against parsed answer: 0.5 counts as yes."""
    yes = F.col("p_yes") >= 0.5
    return evals.agg(
        F.count("*").alias("shared"), F.count_if(F.col("parsed").isNull()).alias("unparsed"), F.count("parsed").alias("n"), F.count_if(yes == F.col("parsed")).alias("agree"),
        F.count_if(yes & F.col("parsed")).alias("both_yes"), F.count_if(~yes & ~F.col("parsed")).alias("both_no"),
    )


#: The position buckets, from, before and name.
BUCKETS = [(0, 10, "0-9"), (10, 25, "10-24"), (25, 50, "25-49"), (50, 100, "50-99"), (100, None, "100+")]


def bucket(position: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high, name in BUCKETS:
        out = F.when((position >= low) & ((position < high) if high else F.lit(True)), name).otherwise(out)
    return out


def position_means(losses: DataFrame) -> DataFrame:
    """Mean loss of every bucket, pooled over (example, position) pairs, and how many examples reach it (an empty one: 0, null); losses: key, position, loss."""
    b = losses.groupBy(bucket(F.col("position")).alias("bucket"), "key").agg(F.sum("loss").alias("s"), F.count("loss").alias("k"))
    found = b.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("k").alias("k"), F.count("*").alias("e"))
    names = losses.sparkSession.createDataFrame([(n,) for _, _, n in BUCKETS], "bucket string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return names.join(found, "bucket", "left").select("bucket", F.round(F.try_divide("s", "k"), 6).alias("mean_loss"), zero("k").alias("n_positions"), zero("e").alias("n_examples"))


def against_reference(measured: DataFrame, reference: DataFrame, label: str) -> DataFrame:
    """Measured rows beside the reference's of the same label; one that the reference doesn't have is kept and marked."""
    known = reference.select(label, *[F.col(c).alias(f"reference_{c}") for c in reference.columns if c != label], F.lit(True).alias("_known"))
    return measured.join(known, label, "left").withColumn("unknown_label", F.col("_known").isNull()).drop("_known")


def metric_gaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rankings of one set of scores beside those of another, and left's AUPRC less right's (null where either has none); a key that only one side has is left out. left, right: key, auprc, auroc."""
    side = lambda m, name: m.select(key, F.col("auprc").alias(f"{name}_auprc"), F.col("auroc").alias(f"{name}_auroc"))
    both = side(left, "left").join(side(right, "right"), key)
    return both.withColumn("auprc_gap", F.round(F.col("left_auprc") - F.col("right_auprc"), 6))


def metric_block(evals: DataFrame, *keys: str) -> DataFrame:
    """Counts; precision, recall and F1 over parsed rows; AUPRC and AUROC over rows both parsed and scored, and lift: AUPRC over that subset's positive rate."""
    both = evals.where(F.col("parsed").isNotNull() & F.col("p_yes").isNotNull())
    counts = evals.groupBy(*keys).agg(F.count("*").alias("n"), F.count("parsed").alias("n_parsed"), F.count_if(F.col("parsed").isNotNull() & F.col("p_yes").isNotNull()).alias("n_scored"))
    rate = both.groupBy(*keys).agg(F.avg(F.col("label").cast("int")).alias("_rate"))
    scores = ranking(both, *keys).select(*keys, "auroc", "auprc")
    found = counts.join(confusion(evals, F.col("parsed"), *keys).select(*keys, "precision", "recall", "f1"), list(keys), "left").join(scores, list(keys), "left").join(rate, list(keys), "left")
    return found.withColumn("lift", F.round(F.try_divide("auprc", "_rate"), 6)).drop("_rate")


def fast_block(evals: DataFrame, *keys: str) -> DataFrame:
    """Every row is scored: P, R and F1 at 0.5 (which counts as yes), the best F1 with its threshold, ranking, and mean loss over rows that have one."""
    at_half = confusion(evals, F.col("p_yes") >= 0.5, *keys)
    best = best_f1(evals, *keys).withColumnRenamed("f1", "best_f1")
    loss = evals.groupBy(*keys).agg(F.round(F.avg("loss"), 6).alias("mean_loss"))
    return at_half.join(ranking(evals, *keys).drop("n"), list(keys), "left").join(best, list(keys), "left").join(loss, list(keys), "left")


def run_summary(runs: DataFrame, *keys: str) -> DataFrame:
    """Generated tokens (mean, p50, p95, max), and shares of runs that closed, weren't parsed, or decided in a merged token; runs: n_tokens, closed, parsed, status."""
    share = lambda c: F.round(100 * F.avg(c.cast("int")), 6)
    s = runs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg("n_tokens"), 6).alias("mean_tokens"), F.max("n_tokens").alias("max_tokens"),
        share(F.col("closed")).alias("closed_percent"), share(F.col("parsed").isNull()).alias("unparsed_percent"), F.count_if(F.col("status") == "impure").alias("impure"),
    )
    s = _beside(s, exact_quantiles(runs, "n_tokens", [0.5, 0.95], *keys), keys)
    return s.select(*keys, "n", "mean_tokens", F.round("p50", 6).alias("p50_tokens"), F.round("p95", 6).alias("p95_tokens"), "max_tokens", "closed_percent", "unparsed_percent", "impure")


def condition_summary(runs: DataFrame, conditions: DataFrame) -> DataFrame:
    """A row for each condition: yes rate over parsed rows (null without any), unparsed, and mean tokens (0.0 without rows); runs: condition, parsed, n_tokens."""
    s = runs.groupBy("condition").agg(F.count("*").alias("c"), F.count("parsed").alias("k"), F.count_if("parsed").alias("y"), F.avg("n_tokens").alias("m"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return conditions.select("condition").distinct().join(s, "condition", "left").select(
        "condition", zero("c").alias("n"), (zero("c") - zero("k")).alias("unparsed"), F.round(F.try_divide("y", "k"), 6).alias("yes_rate"), F.round(F.coalesce("m", F.lit(0.0)), 6).alias("mean_tokens")
    )


def readout_table(scores: DataFrame, last: str, *keys: str) -> DataFrame:
    """For each readout, over the examples that all readouts score: n, AUPRC, AUROC and the mean absolute gap to the last; scores: readout, keys, label, p_yes."""
    names = scores.agg(F.count_distinct("readout").alias("_all"))
    whole = scores.where(F.col("p_yes").isNotNull()).groupBy(*keys, "label").agg(F.map_from_entries(F.collect_set(F.struct("readout", "p_yes"))).alias("_of"))
    whole = whole.crossJoin(F.broadcast(names)).where(F.size("_of") == F.col("_all"))  # names: one row; an example has one score a readout
    each = whole.select("label", F.col("_of")[last].alias("_last"), F.explode("_of").alias("readout", "p_yes"))
    gap = each.groupBy("readout").agg(F.round(F.avg(F.abs(F.col("p_yes") - F.col("_last"))), 6).alias("gap_to_last"))
    return ranking(each, "readout").join(gap, "readout")


def control_gaps(losses: DataFrame, *keys: str, real: str = "real") -> DataFrame:
    """For each condition but the real one: its mean loss beside the real one's on the same examples, the gap in nats and in percent; losses: condition, loss."""
    means = losses.groupBy(*keys, "condition").agg(F.avg("loss").alias("m"))
    base = means.where(F.col("condition") == real).select(*keys, F.col("m").alias("r"))
    others = means.where(F.col("condition") != real)
    joined = others.join(base, list(keys)) if keys else others.crossJoin(F.broadcast(base))  # one row without keys
    return joined.select(*keys, "condition", F.round("r", 6).alias("real"), F.round("m", 6).alias("mean"), F.round(F.col("m") - F.col("r"), 6).alias("gap"), percent_gap(F.col("r"), F.col("m")).alias("gap_percent"))


def decision_controls(losses: DataFrame) -> DataFrame:
    """Mean loss of each condition over overlapping subsets: all, each label, and each label where the donor answers otherwise; losses: condition, label, donor_label, loss."""
    word = F.when(F.col("label"), "yes").otherwise("no")
    opposite = F.when(F.col("label") != F.col("donor_label"), F.concat(word, F.lit(", donor opposite")))
    each = losses.withColumn("subset", F.explode(F.array_compact(F.array(F.lit("all"), word, opposite))))
    return each.groupBy("condition", "subset").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("mean_loss"))


#: Thresholds of the gate.
END_RATE, LENGTH_TOLERANCE, MATCH_RATE, DECISION_LOSS, SHUFFLE_GAP, LEAST_DONOR_ROWS = 0.90, 0.25, 0.90, 0.1, 0.5, 8


def gate(examples: DataFrame, threshold: float) -> DataFrame:
    """The gate's rows (condition, what, n, measured, ok): bounds of shares, lengths and gaps are met at the bound, losses must be below.

    examples: label, loss, closed, n_generated, n_target, parsed, decision_loss, real_loss, shuffled_loss, donor_label.
    1 mean loss below threshold, every example scored.  2 closed, lengths, answers.  3 decision loss of each label.
    4 real loss of each label without context, and what shuffling adds where the donor answers otherwise: null (not
    judged) with fewer than LEAST_DONOR_ROWS examples.  A subset without examples fails.
    """
    yes, no = F.col("label"), ~F.col("label")
    differs = F.coalesce(F.col("label") != F.col("donor_label"), F.lit(False))
    of = lambda c, which: F.avg(F.when(which, F.col(c)))
    matched = F.coalesce(F.col("parsed") == F.col("label"), F.lit(False))
    closed = F.coalesce(F.col("closed"), F.lit(False))
    rows = [(1, "mean loss", F.count("*"), F.avg("loss"), lambda m, n, full: (m < threshold) & full), (2, "closed", F.count("*"), F.avg(closed.cast("int")), lambda m, n, full: m >= END_RATE),
            (2, "length", F.count("*"), F.abs(F.avg("n_generated") - F.avg("n_target")) / F.avg("n_target"), lambda m, n, full: m <= LENGTH_TOLERANCE), (2, "matches label", F.count("*"), F.avg(matched.cast("int")), lambda m, n, full: m >= MATCH_RATE)]
    for name, which in (("yes", yes), ("no", no)):
        rows.append((3, f"decision loss, {name}", F.count_if(which), of("decision_loss", which), lambda m, n, full: m < DECISION_LOSS))
        rows.append((4, f"real loss, {name}", F.count_if(which), of("real_loss", which), lambda m, n, full: m < DECISION_LOSS))
        rows.append((4, f"shuffled gap, {name}", F.count_if(which & differs), of("shuffled_loss", which & differs) - of("real_loss", which & differs), lambda m, n, full: F.when(n >= LEAST_DONOR_ROWS, m >= SHUFFLE_GAP)))
    one = examples.agg(F.count("*").alias("_n"), F.count("loss").alias("_scored"), *[F.struct(n.alias("n"), m.cast("double").alias("m")).alias(f"_{i}") for i, (_, _, n, m, _) in enumerate(rows)])
    made = [
        F.struct(F.lit(c).alias("condition"), F.lit(what).alias("what"), F.col(f"_{i}.n").alias("n"), F.round(f"_{i}.m", 6).alias("measured"), _judged(judge, i, what).alias("ok"))
        for i, (c, what, _, _, judge) in enumerate(rows)
    ]
    return one.select(F.explode(F.array(*made)).alias("r")).select("r.*")


def _judged(judge, i: int, what: str) -> Column:
    ok = judge(F.col(f"_{i}.m"), F.col(f"_{i}.n"), F.col("_scored") == F.col("_n"))
    return ok if what.startswith("shuffled") else F.coalesce(ok, F.lit(False))


def gate_verdict(rows: DataFrame, judged: tuple[int, ...]) -> DataFrame:
    """One row: whether the judged conditions passed, null if one of their rows is not judged; and which rows failed."""
    mine = F.col("condition").isin(list(judged))
    v = rows.agg(F.count_if(mine & F.col("ok").isNull()).alias("thin"), F.array_sort(F.collect_list(F.when(mine & ~F.col("ok"), F.col("what")))).alias("failed"))
    return v.select(F.when(F.col("thin") == 0, F.size("failed") == 0).alias("passed"), "failed")


def macro_mean(metrics: DataFrame, column: str) -> DataFrame:
    """Mean over classes; classes without the metric don't count."""
    return metrics.agg(F.count(column).alias("n"), F.round(F.avg(column), 6).alias("macro"))


def null_control(metrics: DataFrame, tolerance: float) -> DataFrame:
    """Whether shuffled labels score no better than chance: macro AUPRC above the mean positive rate by at most tolerance; metrics: auprc, positive_rate."""
    m = metrics.agg(F.avg("auprc").alias("a"), F.avg(F.when(F.col("auprc").isNotNull(), F.col("positive_rate"))).alias("r"))
    return m.select(F.round("a", 6).alias("macro_auprc"), F.round("r", 6).alias("positive_rate"), F.round(F.col("a") - F.col("r"), 6).alias("excess"), (F.col("a") - F.col("r") <= tolerance).alias("ok"))


def stop_reached(losses: DataFrame, target: float) -> DataFrame:
    """Whether the worse label's mean is at the target or below; a label without rows can't hold it open, no rows at all do (null)."""
    m = losses.agg(F.avg(F.when(F.col("label"), F.col("loss"))).alias("y"), F.avg(F.when(~F.col("label"), F.col("loss"))).alias("n"))
    worse = F.greatest("y", "n")
    return m.select(F.round(worse, 6).alias("worse_mean"), (worse <= target).alias("stop"))


def term_means(batches: DataFrame, term: str, rows: str) -> DataFrame:
    """A loss term's mean over batches, and over rows (each batch weighted by its rows)."""
    return batches.agg(F.round(F.avg(term), 6).alias("batch_mean"), F.round(F.try_divide(F.sum(F.col(term) * F.col(rows)), F.sum(F.when(F.col(term).isNotNull(), F.col(rows)))), 6).alias("row_mean"))


def distinct_outputs(runs: DataFrame, *keys: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("text").alias("distinct_texts"))


def prompt_cost(samples: DataFrame, total: Column | int) -> DataFrame:
    """Mean tokens of each mode in a sample, scaled to the whole, and the ratio to the cheapest; samples: mode, n_tokens."""
    m = samples.groupBy("mode").agg(F.count("*").alias("n"), F.avg("n_tokens").alias("m"))
    least = m.agg(F.min("m").alias("least"))
    scale = total if isinstance(total, Column) else F.lit(total)
    return m.crossJoin(F.broadcast(least)).select("mode", "n", F.round("m", 6).alias("mean_tokens"), F.round(F.col("m") * scale, 3).alias("total_tokens"), F.round(F.try_divide("m", "least"), 6).alias("ratio"))  # least: one row


def loss_summary(evals: DataFrame, *keys: str) -> DataFrame:
    weighted = F.sum(F.col("loss") * F.col("n_tokens")) / F.sum("n_tokens")
    sums = evals.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("mean_loss"), F.round(weighted, 6).alias("token_mean"), F.count_if(F.col("loss") < 0.1).alias("near_zero"))
    found = _beside(sums, exact_quantiles(evals, "loss", [0.5], *keys), keys)
    return found.select(*keys, "n", "mean_loss", "token_mean", F.round("p50", 6).alias("median_loss"), "near_zero")


def _beside(sums: DataFrame, quantiles: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Sums of each group with its quantiles, null where it has no values."""
    right = quantiles.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)  # without keys both are one row
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return sums.join(right, same, "left").drop(*[f"_{k}" for k in keys])


def percent_gap(real: Column, other: Column) -> Column:
    """Null where real is null or 0."""
    return F.round(F.try_divide(100 * (other - real), real), 6)


def token_percentiles(values: DataFrame, column: str, limit: int) -> DataFrame:
    at = [0.5, 0.9, 0.95, 0.99]
    sums = values.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.round(F.avg(column), 6).alias("mean"), F.count_if(F.col(column) > limit).alias("over"))
    return _beside(sums, exact_quantiles(values, column, at), ()).select("min", "max", "mean", "over", *[F.round(f"p{round(100 * q)}", 6).alias(f"p{round(100 * q)}") for q in at])


def loss_deciles(evals: DataFrame, group: str, near: float) -> DataFrame:
    """p10 to p90 in steps of twenty, the greatest loss, and how many are below near; null losses don't count."""
    at = [0.1, 0.3, 0.5, 0.7, 0.9]
    there = evals.where(F.col("loss").isNotNull())
    sums = there.groupBy(group).agg(F.max("loss").alias("top"), F.count_if(F.col("loss") < near).alias("near_zero"))
    found = _beside(sums, exact_quantiles(there, "loss", at, group), (group,))
    return found.select(group, *[F.round(f"p{round(100 * q)}", 6).alias(f"p{round(100 * q)}") for q in at], F.round("top", 6).alias("max"), "near_zero")


def mean_by_label(evals: DataFrame, value: str) -> DataFrame:
    """Mean for all, yes and no rows, always three rows; null where there are none."""
    kinds = evals.sparkSession.createDataFrame([("all",), ("yes",), ("no",)], "which string")
    rows = evals.where("label IS NOT NULL").groupBy("label").agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    part = F.when(F.col("which") == "all", True).otherwise(F.col("label") == (F.col("which") == "yes"))
    joined = kinds.join(F.broadcast(rows), part, "left")  # rows: at most two
    return joined.groupBy("which").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.round(F.try_divide(F.sum("s"), F.sum("c")), 6).alias("mean"))


def logistic_loss(logit: Column, target: Column, positive_weight: Column | float = 1.0) -> Column:
    """Cross-entropy of a logit against a target from 0 to 1, stable for large logits; the weight scales the target's share."""
    w = positive_weight if isinstance(positive_weight, Column) else F.lit(float(positive_weight))
    rest = F.log1p(F.exp(-F.abs(logit)))
    return target * w * (rest + F.greatest(-logit, F.lit(0.0))) + (1 - target) * (rest + F.greatest(logit, F.lit(0.0)))


def report_coverage(reports: DataFrame, report: str, non_german: Column) -> DataFrame:
    """One row: records, blank reports and their percentage, median length of all and of non-blank reports, least and greatest non-blank length, and reports that seem not to be German; null is blank, of length 0."""
    text = F.coalesce(report, F.lit(""))
    r = reports.select(F.length(text).alias("length"), (F.regexp_replace(text, r"(?U)\s+", "") == "").alias("blank"), F.coalesce(non_german, F.lit(False)).alias("other"))
    r = r.withColumn("filled", F.when(F.col("length") > 0, F.col("length")))
    sums = r.agg(F.count("*").alias("n"), F.count_if("blank").alias("n_blank"), F.min("filled").alias("least"), F.max("filled").alias("greatest"), F.count_if("other").alias("n_non_german"))
    every = exact_quantiles(r, "length", [0.5]).withColumnRenamed("p50", "median_length")
    filled = exact_quantiles(r, "filled", [0.5]).withColumnRenamed("p50", "median_filled")
    percent = lambda c: F.round(F.try_divide(100 * F.col(c), F.col("n")), 2)
    found = _beside(_beside(sums, every, ()), filled, ())
    return found.select("n", "n_blank", percent("n_blank").alias("blank_percent"), "median_length", "median_filled", "least", "greatest", "n_non_german", percent("n_non_german").alias("non_german_percent"))
