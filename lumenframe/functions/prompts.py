"""Prompt texts as column expressions over a record with nested statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.text import clean_report, quality_phrase, question, strip
from lumenframe.operators.labels import sex_label
from lumenframe.sources.tables import CLASSES

#: What stands for a part that isn't there.
NO_REPORT = "(no usable free-text report; rely on the annotated findings below)"
NOT_ANNOTATED = "not annotated"
STADIUM_DROP = ["", "unknown"]


def plain_number(x: Column) -> Column:
    """Whole numbers without decimals."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def stadium(*slots: Column) -> Column:
    """The stadium slots that say something, in order."""
    return F.filter(F.transform(F.array(*slots), lambda s: F.trim(s)), lambda s: s.isNotNull() & ~s.isin(STADIUM_DROP))


def statement_line(s: Column) -> Column:
    """One finding: its description (else its code), its classes in the order diagnostic, form, rhythm, and its likelihood."""
    named = F.array_compact(F.array(*[F.when(s[c], F.lit(c)) for c in ("diagnostic", "form", "rhythm")]))
    classes = F.when(F.size(named) > 0, F.array_join(named, ", ")).otherwise("unclassified")
    name = F.coalesce(F.nullif(s["description"], F.lit("")), s["code"].cast("string"))
    return F.concat(F.lit("  - "), name, F.lit(" [class: "), classes, F.lit("; likelihood: "), plain_number(s["likelihood"]), F.lit("]"))


def input_block(report: Column, usable: Column, statements: Column, axis: Column, stages: Column, quality: Column, age: Column, sex: Column) -> Column:
    """What a prompt shows of a record. statements, stages and quality are arrays; null or empty ones read as absent."""
    joined = lambda a, sep, other: F.coalesce(F.nullif(F.array_join(a, sep), F.lit("")), F.lit(other))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Clinical report: "), F.when(usable, report).otherwise(NO_REPORT)),
        F.lit("Annotated findings:"),
        joined(F.transform(statements, statement_line), "\n", "  - none"),
        F.lit("Recording properties:"),
        F.concat(F.lit("  Heart axis: "), F.coalesce(F.nullif(axis, F.lit("")), F.lit(NOT_ANNOTATED))),
        F.concat(F.lit("  Infarction stadium: "), joined(stages, ", ", NOT_ANNOTATED)),
        F.concat(F.lit("  Signal quality: "), joined(quality, "; ", "none annotated")),
        F.concat(F.lit("Patient context: age "), F.coalesce(plain_number(age), F.lit("not recorded")), F.lit(", sex "), F.coalesce(sex, F.lit("not recorded"))),
    )


def _filled(template: str, parts: dict[str, Column]) -> Column:
    """A template with each {name} of parts filled in; what is filled in isn't read as a template again."""
    out, rest = [], template
    while rest:
        at = min(((rest.find("{%s}" % n), n) for n in parts if "{%s}" % n in rest), default=None)
        if at is None:
            out.append(F.lit(rest))
            break
        out += [F.lit(rest[: at[0]]), parts[at[1]]]
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*out) if out else F.lit("")


def yes_no(label: Column) -> Column:
    return F.when(label, "Yes").otherwise("No")


def render(template: str, superclass: Column, label: Column, block: Column) -> Column:
    """A template with {question}, {yes_no} and {input_block} filled in."""
    return _filled(template, {"question": question(superclass), "yes_no": yes_no(label), "input_block": block})


def known_answers(classes: Column) -> Column:
    """(superclass, label) of all classes in their order, from those asserted: NORM holds if it is the only one."""
    only_norm = (F.size(classes) == 1) & F.array_contains(classes, "NORM")
    return F.array(*[F.struct(F.lit(c).alias("superclass"), (only_norm if c == "NORM" else F.array_contains(classes, c)).alias("label")) for c in CLASSES])


def question_list(answers: Column) -> Column:
    """A numbered line for each (superclass, label), in order: class, question and known answer."""
    line = lambda a, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), a["superclass"], F.lit(" - "), question(a["superclass"]), F.lit(" Known answer: "), yes_no(a["label"]))
    return F.array_join(F.transform(answers, line), "\n")


def render_all(template: str, answers: Column, block: Column) -> Column:
    """One prompt for all classes of a record: a template with {questions_block} and {input_block} filled in."""
    return _filled(template, {"questions_block": question_list(answers), "input_block": block})


def statement_views(statements: Column) -> Column:
    """Of each statement: code, description, its classes in order, its superclass if it is diagnostic, and its likelihood."""

    def one(s: Column) -> Column:
        classes = F.array_compact(F.array(*[F.when(s[c], F.lit(c)) for c in ("diagnostic", "form", "rhythm")]))
        return F.struct(s["code"].alias("code"), s["description"].alias("description"), classes.alias("classes"), F.when(s["diagnostic"], s["class"]).alias("diagnostic_superclass"), s["likelihood"].cast("double").alias("likelihood"))

    return F.transform(statements, one)


def record_view(key: Column, report: Column, statements: Column, axis: Column, stages: list[Column], quality: dict[str, Column], age: Column, sex_code: Column) -> Column:
    """All that a prompt is made from, as one struct; a null list of statements is an empty one.

    The report is cleaned (empty if nothing usable is left, with flags of what was found), blank axes are null, stages and
    recording-quality fields that say something are listed in order, sex is named where its code is known.
    """
    c = clean_report(report)
    flags = F.struct(*[c[n].alias(n) for n in ("had_boilerplate", "had_labels", "had_edit")])
    views = statement_views(statements)
    phrases = F.array_compact(F.array(*[quality_phrase(n, v) for n, v in quality.items()]))
    return F.struct(
        key.alias("ecg_id"), c["text"].alias("report_text"), c["usable"].alias("has_usable_report"), flags.alias("report_flags"), F.when(statements.isNull(), F.array()).otherwise(views).alias("statements"),
        F.nullif(strip(axis), F.lit("")).alias("heart_axis"), stadium(*stages).alias("infarction_stadium"), phrases.alias("signal_quality"), age.cast("double").alias("age"), sex_label(sex_code).alias("sex"), sex_code.cast("int").alias("sex_code"),
    )


def paraphrase(key: Column, bank: list[str]) -> Column:
    """One of the bank, always the same for a key."""
    return F.element_at(F.array(*map(F.lit, bank)), (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % len(bank) + 1).cast("int"))
