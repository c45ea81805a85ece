"""Structured responses parsed back: blocks, sections, answers, errors, leaks, and reasoning without steps that tell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import text as T
from lumenframe.sources.tables import CLASSES


def sections(found: DataFrame) -> DataFrame:
    """One row a record and class, in one projection: the block (null if missing) and its parts; found: ecg_id, content."""
    split = found.select("ecg_id", T.response_blocks(F.col("content")).alias("_r"))
    each = split.select("ecg_id", "_r.method", F.explode(F.array(*map(F.lit, CLASSES))).alias("superclass"), F.col("_r.blocks").alias("_b"))
    each = each.select("ecg_id", "superclass", "method", T.body_of(F.col("_b"), F.col("superclass")).alias("body"))
    return each.select("*", T.evidence(F.col("body")).alias("evidence"), T.reasoning(F.col("body")).alias("full_reasoning"), T.conclusion(F.col("body")).alias("conclusion"), T.conclusion_text(F.col("body")).alias("conclusion_text"))


def parsed(found: DataFrame) -> DataFrame:
    """One row a record and class: what its block says, or what is wrong with it."""
    status = F.when(F.col("body").isNull(), "missing").when(F.col("conclusion").isNull(), "unparseable").otherwise("ok")
    return sections(found).withColumn("_s", T.stripped_steps(F.col("full_reasoning"))).select(
        "ecg_id", "superclass", status.alias("status"), "conclusion", F.size(T.leak_lines(F.col("evidence"))).cast("long").alias("evidence_leaks"),
        F.size(T.evidence_items(F.col("evidence"))).cast("long").alias("evidence_items"), F.col("_s.text").alias("reasoning"), F.col("_s.removed").cast("long").alias("removed_steps"),
    )


def response_status(found: DataFrame) -> DataFrame:
    """One row a record: how it was split, its errors, the classes missing and those without a readable answer, and ok (none of these)."""
    split = found.select("ecg_id", T.response_blocks(F.col("content")).alias("_r"), (T.squeeze(F.coalesce("content", F.lit(""))) == "").alias("_empty"))
    every = F.array(*map(F.lit, CLASSES))
    there = F.transform(F.col("_r.blocks"), lambda b: b["superclass"])
    missing = F.filter(every, lambda c: ~F.array_contains(there, c))
    unread = F.filter(every, lambda c: F.array_contains(there, c) & T.conclusion(T.body_of(F.col("_r.blocks"), c)).isNull())
    errors = F.when(F.col("_empty"), F.array(F.lit("empty content"))).when(F.col("_r.method").isNull(), F.array(F.lit("no superclass headers or <END> markers found"))).otherwise(F.array().cast("array<string>"))
    out = split.select("ecg_id", F.col("_r.method").alias("split_method"), errors.alias("errors"), missing.alias("missing"), unread.alias("unparseable"))
    return out.withColumn("ok", (F.size("errors") + F.size("missing") + F.size("unparseable")) == 0)


def label_mismatches(found: DataFrame, known: DataFrame) -> DataFrame:
    """(ecg_id, superclass) whose readable answer contradicts the known label; missing and unreadable blocks don't count. known: ecg_id, superclass, label."""
    return sections(found).select("ecg_id", "superclass", "conclusion").join(known, ["ecg_id", "superclass"]).where(F.col("conclusion") != F.col("label")).select("ecg_id", "superclass")


def leaks(found: DataFrame) -> DataFrame:
    """(ecg_id, superclass, section, pattern, line): each cited source in evidence, reasoning and conclusion."""
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.col(c).alias("text")) for n, c in (("evidence", "evidence"), ("reasoning", "full_reasoning"), ("conclusion", "conclusion_text"))]))
    each = sections(found).select("ecg_id", "superclass", parts.alias("p")).select("ecg_id", "superclass", "p.section", F.explode(T.leak_lines(F.col("p.text"))).alias("x"))
    return each.select("ecg_id", "superclass", "section", "x.pattern", "x.line")


def leaked_classes(found_leaks: DataFrame) -> DataFrame:
    return found_leaks.select("ecg_id", "superclass").distinct()


def leak_counts(found_leaks: DataFrame) -> DataFrame:
    return found_leaks.groupBy("pattern").agg(F.count("*").alias("hits"), F.count_distinct("ecg_id", "superclass").alias("blocks"), F.count_distinct("ecg_id").alias("records"))


def audit(found: DataFrame) -> DataFrame:
    """(pattern, blocks, records) of the audit's patterns over whole blocks."""
    each = sections(found).where(F.col("body").isNotNull()).select("ecg_id", F.explode(T.audit_hits(F.col("body"))).alias("pattern"))
    return each.groupBy("pattern").agg(F.count("*").alias("blocks"), F.count_distinct("ecg_id").alias("records"))


def audit_blocks(found: DataFrame) -> DataFrame:
    """One row a record and class that has a block: its answer, whether its reasoning is blank, which audit patterns it has, and whether it names a lead's type."""
    there = sections(found).where(F.col("body").isNotNull())
    blank = T.strip(F.coalesce("full_reasoning", F.lit(""))) == ""
    return there.select("ecg_id", "superclass", "conclusion", blank.alias("empty"), F.size(T.audit_hits(F.col("body"))).alias("hits"), T.has_lead_type(F.col("body")).alias("lead_type"))


def audit_totals(found: DataFrame, known: DataFrame) -> DataFrame:
    """One row over all records of found (ecg_id, content, n_tokens; each id once): records, blocks and how many there should be, records with a mismatch and records that aren't ok, blank
    reasonings, mean tokens, blocks and records with any audit pattern with their percentages, and blocks that name a lead's type. known: ecg_id, superclass, label.

    Blocks are summed to one row a record first, so a record with hits in several blocks counts once.
    """
    wrong = F.col("conclusion") != F.col("label")
    each = audit_blocks(found).join(known, ["ecg_id", "superclass"], "left")
    record = each.groupBy("ecg_id").agg(
        F.count("*").alias("b"), F.count_if("empty").alias("e"), F.count_if(F.col("hits") > 0).alias("h"), F.count_if("lead_type").alias("t"),
        F.coalesce(F.bool_or(wrong), F.lit(False)).alias("w"), F.count("conclusion").alias("c"),
    )
    whole = found.select("ecg_id", "n_tokens").join(record, "ecg_id", "left")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = whole.agg(
        F.count("*").alias("records"), n("b").alias("blocks"), (F.count("*") * len(CLASSES)).alias("expected_blocks"), F.count_if("w").alias("mismatched_records"),
        F.count_if(F.coalesce("c", F.lit(0)) < len(CLASSES)).alias("failed_records"), n("e").alias("empty_reasonings"), F.round(F.avg("n_tokens"), 6).alias("mean_tokens"),
        n("h").alias("hit_blocks"), F.count_if(F.col("h") > 0).alias("hit_records"), n("t").alias("lead_type_blocks"),
    )
    share = lambda a, b: F.round(F.try_divide(100 * F.col(a), F.col(b)), 1)
    return sums.withColumns({"hit_block_percent": share("hit_blocks", "blocks"), "hit_record_percent": share("hit_records", "records")})


def yes_counts(found: DataFrame) -> DataFrame:
    """(superclass, n): blocks of each class that say yes; a class without any isn't listed."""
    return audit_blocks(found).where("conclusion").groupBy("superclass").agg(F.count("*").alias("n"))
