"""Text rules as column expressions: each rule table is data, folded in order into built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.sources.tables import CLASSES

#: Whitespace and word characters are Unicode's throughout.
WS = r"(?U)\s+"

#: What a cleaned report loses, in order.
BOILERPLATE = r"(?iU)\s*(?:\d+(?:[.,]\d+)?\s+)?unbest\w*tigter\s+bericht"
PAREN_LABEL = r"(?U)\s*\([^)]*[A-Z]{2,}[^)]*\)"
EDIT_TAIL = r"(?isU)\s*\bEdit:.*$"
REPORT_FLOOR = 15
#: Substrings that cite the annotation channel, and step texts that cite the known answer.
LEAKS = ["annotat", "likelihood", "cardiologist", "diagnostic finding", "diagnostic statement", "not annotated", "heart axis", "infarction stadium", "form statement", "known answer", "correct answer", "the report", "written interpretation", "is reported", "not described"]
TELLS = ["required answer", "known answer", "correct answer", "answer is affirmative", "answer is negative", "requires? an? (?:positive|negative|affirmative)", "must be (?:yes|no|affirmative|negative)", "the label", "as (?:given|specified|stated) (?:in the )?(?:label|answer)", "known diagnosis", "answer must reflect"]
#: Every match of TELLS holds one of these.
TELL_WORDS = ["answer", "require", "must be", "label", "diagnosis"]
#: Anchors of the language guess.
ENGLISH = ["the", "and", "with", "without", "sinus", "rhythm", "normal", "wave", "waves", "changes", "consistent", "possible"]
SWEDISH = ["sinusrytm", "avvikande", "förändringar", "vänster", "höger", "ospecifika", "förlopp"]
UMLAUTS = "[äöüßÄÖÜ]"
#: Labels of the four recording-quality fields, and leads by their lower-case names.
QUALITY = {"baseline_drift": "baseline drift", "static_noise": "static noise", "burst_noise": "burst noise", "electrodes_problems": "electrode problems"}
LIMB_LEADS = {"i": "I", "ii": "II", "iii": "III", "avr": "aVR", "avl": "aVL", "avf": "aVF"}
ALL_LEADS = ["alles", "alle", "alle abl.", "alle abl", "all"]
#: What each class is called in a question.
NAMES = {"MI": "myocardial infarction", "STTC": "ST/T change", "CD": "conduction disturbance", "HYP": "hypertrophy"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _any_of(text: Column, words: list[str]) -> Column:
    """Whether any of the words (small letters) is in the text, whatever its case."""
    low, found = F.lower(text), F.lit(False)
    for w in words:
        found = found | F.contains(low, F.lit(w))
    return found


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WS, " "))


def strip(text: Column) -> Column:
    """Without Unicode whitespace at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_report(report: Column) -> dict[str, Column]:
    """text, flags of what was found at each stage, and usable: texts below the floor become empty."""
    a = F.coalesce(report, F.lit(""))
    b = F.regexp_replace(a, BOILERPLATE, "")
    c = F.regexp_replace(b, PAREN_LABEL, "")
    d = squeeze(F.regexp_replace(c, EDIT_TAIL, ""))
    usable = F.length(d) >= REPORT_FLOOR
    return {
        "text": F.when(usable, d).otherwise(""), "usable": usable, "had_boilerplate": F.regexp_like(a, F.lit(BOILERPLATE)), "had_labels": F.regexp_like(b, F.lit(PAREN_LABEL)), "had_edit": F.regexp_like(c, F.lit(EDIT_TAIL))
    }


def _has_token(report: Column, words: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.translate(F.lower(report), ",.", "  "), WS), F.array(*map(F.lit, words)))


def has_swedish(report: Column) -> Column:
    """Whether a Swedish anchor is among the words; null and blank reports have none."""
    return F.coalesce(_has_token(report, SWEDISH), F.lit(False))


def likely_non_german(report: Column) -> Column:
    """A Swedish anchor says yes, else an umlaut no, else an English anchor yes; null and blank reports no."""
    blank = strip(F.coalesce(report, F.lit(""))) == ""
    return F.when(blank, False).when(has_swedish(report), True).when(report.rlike(UMLAUTS), False).otherwise(_has_token(report, ENGLISH))


#: Anchors of the guess by score.
GERMAN_SCORED = [
    "sinusrhythmus", "sinusbradykardie", "sinustachykardie", "ekg", "lagetyp", "linkstyp", "rechtstyp", "steiltyp", "sonst", "und", "mit", "ohne", "kein", "keine", "nicht", "verdacht", "auf", "wahrscheinlich",
    "niederspannung", "unbestätigter", "unbestaetigter", "bericht", "abnorm", "alter", "unbest", "ueberdrehter", "überdrehter", "amplitudenkriterien", "linkshypertrophie", "extrasystole", "extrasystolen",
    "vorhofflimmern", "vorhofflattern", "linksschenkelblock", "rechtsschenkelblock", "myokardschaden", "normales", "mässige", "mäßige", "ableitungen", "verschoben", "hebung", "unauffällig",
]
ENGLISH_SCORED = [
    "the", "and", "with", "without", "are", "is", "this", "of", "to", "no", "due", "may", "be", "there", "otherwise", "consistent", "suggests", "possible", "probably", "waves", "wave", "segment", "segments", "seen",
    "best", "evident", "changes", "definite", "pathology", "ecg", "helpful", "apparently", "failure", "commonly", "disease", "deviation", "elevated", "depressed", "inverted", "slightly", "flat", "low", "strain", "drug",
]
SWEDISH_SCORED = ["sinusrytm", "avvikande", "bör", "övervägas", "förlopp", "vänster", "höger", "förändringar", "ospecifika"]


def non_german_by_score(report: Column) -> Column:
    """A Swedish anchor says yes, else an umlaut no, else more distinct English than German anchors; null and blank reports no."""
    low = F.lower(F.coalesce(report, F.lit("")))
    tokens = F.split(F.translate(low, ",.", "  "), WS)
    has = lambda words: F.size(F.array_intersect(tokens, F.array(*map(F.lit, words))))
    return F.when(squeeze(low) == "", False).when(has(SWEDISH_SCORED) > 0, True).when(low.rlike("[äöüß]"), False).otherwise(has(ENGLISH_SCORED) > has(GERMAN_SCORED))


def lead(token: Column) -> Column:
    """Standard name of one lead, or null."""
    t = F.trim(F.lower(F.regexp_replace(F.trim(token), r"^[?!.]+|[?!.]+$", "")))
    limb = F.element_at(F.create_map(*[F.lit(x) for kv in LIMB_LEADS.items() for x in kv]), t)
    return F.coalesce(limb, F.when(t.rlike(r"^(v\s*)?[1-9]$"), F.concat(F.lit("V"), F.right(t, F.lit(1)))))


def lead_entry(entry: Column) -> Column:
    """One lead, or a range of exactly two."""
    parts = F.split(F.trim(entry), r"\s*-+\s*")
    return F.when(~entry.contains("-"), lead(entry)).when(F.size(parts) == 2, F.nullif(F.concat(lead(F.get(parts, F.lit(0))), F.lit("-"), lead(F.get(parts, F.lit(1)))), F.lit("")))


def quality_phrase(field: str, raw: Column) -> Column:
    """The field in words: its leads in order, all leads, or leads not given; null if blank."""
    parts = F.filter(F.transform(F.split(raw, "[;,]"), lambda s: F.trim(s)), lambda s: s != "")
    everywhere = F.exists(parts, lambda s: F.lower(s).isin(ALL_LEADS))
    named = F.filter(parts, lambda s: ~F.lower(s).isin(ALL_LEADS))
    found = F.flatten(F.transform(named, lambda s: F.when(lead_entry(s).isNotNull(), F.array(lead_entry(s))).otherwise(F.transform(F.split(s, WS), lead_entry))))
    leads = F.array_distinct(F.array_compact(found))
    label = QUALITY.get(field, field)
    return F.when(F.trim(raw) == "", None).when(F.size(leads) > 0, F.concat(F.lit(f"{label} in leads "), F.array_join(leads, ", "))).when(everywhere, f"{label} in all leads").when(raw.isNotNull(), f"{label} annotated (leads not specified)")


def question(superclass: Column) -> Column:
    out = F.when(superclass == "NORM", "Is this a normal ECG?")
    for k, name in NAMES.items():
        out = out.when(superclass == k, f"Does this ECG show evidence of {name}?")
    return out


# --- structured responses ---------------------------------------------------------------------------------------

#: Patterns of headers, sections, conclusions, steps and items (all from HEADER on to the end of this file).
HEADER = r"(?im)^[ \t>*#\-]*(" + "|".join(CLASSES) + r")\b[ \t:*—.\-]*$"
_MARK, _END = "\u0001", "\u0002"


def blocks(response: Column) -> Column:
    """Array of (superclass, body) at class headers, in order; fewer than two headers: none."""
    parts = F.filter(F.split(F.regexp_replace(response, HEADER, f"{_MARK}$1{_END}"), _MARK), lambda p: p.contains(_END))
    cut = F.transform(parts, lambda p: F.struct(F.upper(F.substring_index(p, _END, 1)).alias("superclass"), F.substring_index(p, _END, -1).alias("body")))
    return let(cut, lambda c: F.when(F.size(c) >= 2, c).otherwise(F.slice(c, 1, 0)))


def response_blocks(response: Column) -> Column:
    """(method, blocks): split at headers; else at <END>, the parts that aren't blank taken for the classes in order, if there are two or more; else (null, none)."""
    def chosen(by_header: Column) -> Column:
        parts = F.filter(F.split(response, r"(?i)<\s*END\s*>"), lambda p: strip(p) != "")
        taken = F.slice(parts, 1, len(CLASSES))
        by_end = F.transform(taken, lambda p, i: F.struct(F.get(F.array(*map(F.lit, CLASSES)), i).alias("superclass"), p.alias("body")))
        none = F.slice(by_header, 1, 0)
        return F.when(F.size(by_header) > 0, F.struct(F.lit("header").alias("method"), by_header.alias("blocks"))).when(F.size(parts) >= 2, F.struct(F.lit("end").alias("method"), by_end.alias("blocks"))).otherwise(F.struct(F.lit(None).cast("string").alias("method"), F.coalesce(none, F.array().cast("array<struct<superclass:string,body:string>>")).alias("blocks")))

    return let(blocks(response), chosen)


def body_of(all_blocks: Column, superclass: Column) -> Column:
    """The first block of a class, or null."""
    return F.get(F.filter(all_blocks, lambda b: b["superclass"] == superclass), F.lit(0))["body"]


def section(body: Column, pattern: str) -> Column:
    unmarked = lambda x: F.when(F.contains(x, F.lit("<")), F.regexp_replace(x, r"(?i)<\s*END\s*>", "")).otherwise(x)
    return F.nullif(F.regexp_replace(let(F.regexp_extract(body, pattern, 1), unmarked), r"^\s+|\s+$", ""), F.lit(""))


def evidence(body: Column) -> Column:
    return section(body, r"(?is)\bevidence\b[ \t:*\-—]*(.*?)(?=\breasoning\b|\bconclusion\b|\z)")


def reasoning(body: Column) -> Column:
    return section(body, r"(?is)\breasoning\b[ \t:*\-—]*(.*?)(?=\bconclusion\b|<\s*END\s*>|\z)")


def conclusion(body: Column) -> Column:
    """Yes or no of the conclusion line, or null."""
    word = F.lower(F.regexp_extract(body, r"(?im)^[ \t>*#\-]*conclusion\b[ \t:*\-—]*(yes|no)\b", 1))
    return F.when(word == "yes", True).when(word == "no", False)


def conclusion_text(body: Column) -> Column:
    """From the conclusion's label on, or null."""
    return section(body, r"(?is)\bconclusion\b[ \t:*\-—]*(.*)\z")


def leak_lines(text: Column) -> Column:
    """(pattern, line) for each line and leak it has."""
    of = lambda x: F.transform(F.filter(F.array(*map(F.lit, LEAKS)), lambda p: F.contains(F.lower(x), p)), lambda p: F.struct(p.alias("pattern"), F.trim(x).alias("line")))
    found = F.flatten(F.transform(F.split(text, "\n"), of))
    return F.when(_any_of(text, LEAKS), found).when(text.isNotNull(), F.array().cast("array<struct<pattern:string,line:string>>"))  # most texts have none


def steps(text: Column) -> Column:
    """Steps of a reasoning, each with its header, after a first part that may be empty."""
    return F.split(text, r"(?im)(?=^[ \t>*#\-]*step\s*\d+)")


def _is_step(s: Column) -> Column:
    return s.rlike(r"(?i)^[ \t>*#\-]*step\s*\d+")


def stripped_steps(text: Column) -> Column:
    """(text, removed): the reasoning without steps that tell the answer, renumbered, and how many were removed."""
    tells = "(?i)" + "|".join(TELLS)
    told = lambda s: _any_of(s, TELL_WORDS) & s.rlike(tells)
    found = F.transform(steps(text), lambda s: F.struct(s.alias("s"), F.when(~_is_step(s), 0).when(told(s), 2).otherwise(1).alias("kind")))
    of = lambda f, kind: F.transform(F.filter(f, lambda x: x["kind"] == kind), lambda x: x["s"])
    number = lambda s, i: F.regexp_replace(s, F.lit(r"(?i)^([ \t>*#\-]*step\s*)\d+"), F.concat(F.lit("$1"), (i + 1).cast("string")))
    return let(found, lambda f: F.struct(F.concat(F.array_join(of(f, 0), ""), F.array_join(F.transform(of(f, 1), number), "")).alias("text"), F.size(of(f, 2)).alias("removed")))


def strip_steps(text: Column) -> tuple[Column, Column]:
    """Both parts of stripped_steps; who needs both in one projection takes the struct, which is computed once."""
    both = stripped_steps(text)
    return both["text"], both["removed"]


def evidence_items(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?:^|\s)\d+\s*[\).]"), lambda s: F.trim(s)), lambda x: x != "")


REASONING_SECTION = r"(?is)(\breasoning\b[ \t:*\-—]*)(.*?)(?=\bconclusion\b|<\s*END\s*>|\z)"


STRIP_FIELDS = ("content", "blocks_stripped", "steps_removed", "blocks_emptied")


def strip_response(response: Column) -> dict[str, Column]:
    """The fields of stripped_response; who needs several in one projection takes the struct, which is computed once."""
    whole = stripped_response(response)
    return {name: whole[name] for name in STRIP_FIELDS}


def stripped_response(response: Column) -> Column:
    """content: the response with each reasoning without its telling steps, all else as it was; and blocks stripped, steps removed, blocks emptied.

    The text is cut at each reasoning label and at what ends its section, so that parts alternate. A response without a telling word isn't cut at all.
    """
    text = F.coalesce(response, F.lit(""))
    marked = F.regexp_replace(text, REASONING_SECTION, f"{_MARK}$1{_END}$2{_MARK}")
    parts = F.split(marked, _MARK)
    inner = F.transform(parts, lambda p: F.struct(F.when(p.contains(_END), F.substring_index(p, _END, 1)).alias("label"), F.substring_index(p, _END, -1).alias("text")))

    def done(p: Column, s: Column) -> Column:
        changed = F.coalesce(s["removed"] > 0, F.lit(False))
        emptied = changed & (strip(s["text"]) == "")
        return F.struct(
            F.when(changed, F.concat(p["label"], s["text"])).otherwise(F.concat(F.coalesce(p["label"], F.lit("")), p["text"])).alias("text"), F.when(changed, s["removed"]).otherwise(0).alias("removed"),
            changed.cast("int").alias("stripped"), emptied.cast("int").alias("emptied"),
        )

    results = F.transform(inner, lambda p: let(F.when(p["label"].isNotNull() & _any_of(p["text"], TELL_WORDS), stripped_steps(p["text"])), lambda s: done(p, s)))
    total = lambda r, name: F.aggregate(r, F.lit(0), lambda a, x: a + x[name])
    cut = let(results, lambda r: F.struct(F.array_join(F.transform(r, lambda x: x["text"]), "").alias("content"), total(r, "stripped").alias("blocks_stripped"), total(r, "removed").alias("steps_removed"), total(r, "emptied").alias("blocks_emptied")))
    whole = F.struct(text.alias("content"), *[F.lit(0).alias(name) for name in STRIP_FIELDS[1:]])
    return F.when(_any_of(text, [*TELL_WORDS, _MARK, _END]), cut).otherwise(whole)


def telling_steps(text: Column) -> Column:
    """Steps that tell the answer: none may be left in a stripped text."""
    return F.transform(F.filter(steps(text), lambda s: _is_step(s) & s.rlike("(?i)" + "|".join(TELLS))), strip)


def has_lead_type(text: Column) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit("lead type"))


#: The audit's patterns by name.
AUDIT = {
    "the report": r"\bthe report\b", "is reported": r"\bis reported\b|\bare reported\b", "annotat": r"annotat",
    "known/required answer": r"known answer|required answer|correct answer|answer is affirmative|known diagnosis|answer must reflect|the required",
    "not described": r"not described|no description", "diagnostic statement": r"diagnostic statement", "likelihood": r"likelihood", "diagnostic finding": r"diagnostic finding",
    "form statement": r"form statement", "written interpretation": r"written (?:report|interpretation)|not captured in", "cardiologist": r"cardiologist",
}


def audit_hits(text: Column) -> Column:
    """Names of the audit's patterns that a text has."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(n)) for n, p in AUDIT.items()]))


def sentences(text: Column) -> Column:
    """Sentences, each with the dot, semicolon or newline that ends it."""
    return F.filter(F.split(text, r"(?<=[.;\n])"), lambda s: s != "")


def changed_sentences(before: Column, after: Column) -> Column:
    """(before, after) of the sentences that differ, place by place; a place that only one has is paired with null."""
    pairs = F.arrays_zip(sentences(before).alias("before"), sentences(after).alias("after"))
    return F.filter(pairs, lambda p: ~p["before"].eqNullSafe(p["after"]))


def strip_think(prompt: Column) -> Column:
    """Without an opening <think> at the very end."""
    return F.regexp_replace(prompt, r"(?U)<think>\s*\z", "")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4))


def fix_leads(names: Column) -> Column:
    """Lead names in their usual spelling; others as they are."""
    usual = F.create_map(*[F.lit(x) for k, v in LIMB_LEADS.items() if k.startswith("av") for x in (k.upper(), v)])
    return F.transform(names, lambda n: F.coalesce(F.try_element_at(usual, n), n))


def findings(found: Column) -> Column:
    """`name (0.87)` of each (name, score), comma-joined."""
    return F.array_join(F.transform(found, lambda f: F.format_string("%s (%.2f)", f["name"], f["score"])), ", ")


def error_text(body: Column) -> Column:
    return F.left(body, F.lit(500))


def reasoning_field(first: Column, second: Column) -> Column:
    """The reasoning under either of two keys; blank is none."""
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))


def message_content(response: Column) -> Column:
    """choices[0].message.content of a JSON answer; null where any part is missing."""
    return F.get(F.from_json(response, "choices array<struct<message: struct<content: string>>>")["choices"], F.lit(0))["message"]["content"]


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
