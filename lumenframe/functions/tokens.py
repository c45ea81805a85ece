"""Token arrays as column expressions: trimming, padding, masks, stream choice, and where the answer's token is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100
MODES = ("prompt", "prompt-and-target", "question", "none")
MARKER = "Conclusion:"


def trim_generated(ids: Column, ends: list[int] | list[str]) -> Column:
    """Up to the first end or padding id, which is not kept; whole without one. Tokens may be ids or strings."""
    at = F.array_min(F.array_compact(F.array(*[F.nullif(F.array_position(ids, e), F.lit(0)) for e in ends])))
    return F.slice(ids, F.lit(1), F.coalesce((at - 1).cast("int"), F.size(ids)))


def pad(ids: Column, width: Column | int, filler: int, left: bool = False) -> Column:
    """ids filled up to width at one side; longer ones stay as they are."""
    w = width if isinstance(width, Column) else F.lit(width)
    more = F.array_repeat(F.lit(filler), F.greatest(w - F.size(ids), F.lit(0)).cast("int"))
    more = more.cast("array<bigint>")
    return F.concat(more, ids.cast("array<bigint>")) if left else F.concat(ids.cast("array<bigint>"), more)


def attention(ids: Column, width: Column | int, left: bool = False) -> Column:
    """1 for each id, 0 for each filler."""
    return pad(F.transform(ids, lambda _: F.lit(1).cast("bigint")), width, 0, left)


def splice(prompt: Column, target: Column) -> dict[str, Column]:
    """input_ids: prompt and target; labels: IGNORED over the prompt, the target's ids after it."""
    hidden = F.transform(prompt, lambda _: F.lit(IGNORED).cast("bigint"))
    return {"input_ids": F.concat(prompt.cast("array<bigint>"), target.cast("array<bigint>")), "labels": F.concat(hidden, target.cast("array<bigint>"))}


def prompt_mask(mask: Column, labels: Column) -> Column:
    """Positions that are attended to and not supervised; arrays of different sizes are an error."""
    both = F.zip_with(mask, labels, lambda a, x: (a == 1) & (x == IGNORED))
    wrong = F.raise_error(F.format_string("mask has %d positions, labels %d", F.size(mask), F.size(labels))).cast("array<boolean>")
    return F.when(F.size(mask) == F.size(labels), both).otherwise(wrong)


def task_stream(mode: str, ids: Column, mask: Column, labels: Column, question_ids: Column, question_mask: Column) -> tuple[Column, Column]:
    """(ids, mask) that a mode reads; labels may be null (nothing is supervised yet): then the prompt is all there is."""
    if mode not in MODES:
        raise ValueError(f"unknown task stream {mode!r}; have {MODES}")
    whole = F.transform(mask, lambda a: a == 1)
    if mode == "question":
        return question_ids, F.transform(question_mask, lambda a: a == 1)
    if mode == "none":
        return F.slice(ids, 1, 0), F.slice(whole, 1, 0)
    return (ids, F.when(labels.isNull(), whole).otherwise(prompt_mask(mask, labels))) if mode == "prompt" else (ids, whole)


def _first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def decision_index(text: Column, offsets: Column) -> Column:
    """(index, why): the first token after the one marker of the text, or why there is none; offsets: (start, stop) of each token."""
    times = F.size(F.split(text, MARKER)) - 1
    end = F.instr(text, MARKER) - 1 + len(MARKER)
    after = _first(F.filter(F.transform(offsets, lambda o, i: F.struct(i.alias("i"), o["start"].alias("start"), o["stop"].alias("stop"))), lambda o: o["stop"] > end))
    why = (
        F.when(times != 1, F.format_string("%d occurrences of '" + MARKER + "'", times)).when(after.isNull(), "no token after the marker").when(after["start"] < end, "a token straddles the end of the marker")
    )
    return F.struct(F.when(why.isNull(), after["i"]).alias("index"), why.alias("why"))


def conclusion_token(pieces: Column) -> Column:
    """(index, token, status) of the generated token that spells the conclusion's yes or no.

    clean: the token is just that word; impure: more is glued to it; none: no readable conclusion, or its word begins inside another token.
    """
    text = F.array_join(pieces, "")
    before = F.regexp_extract(text, r"(?is)\A(.*?^[ \t>*#\-]*conclusion\b[ \t:*\-—]*)(?=(?:yes|no)\b)".replace("(?is)", "(?ism)"), 1)
    lengths = F.transform(pieces, F.length)
    starts = F.transform(lengths, lambda _, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    index = F.size(F.filter(starts, lambda s: s <= F.length(before))) - 1
    token = F.get(pieces, index)
    word = F.lower(F.regexp_replace(token, r"(?U)^\s+", ""))
    rest = F.when(word.startswith("yes"), F.substring(word, 4, 1 << 30)).when(word.startswith("no"), F.substring(word, 3, 1 << 30))
    found = F.length(before) > 0
    status = F.when(~found | rest.isNull(), "none").when(F.trim(rest) == "", "clean").otherwise("impure")
    return F.struct(F.when(found & rest.isNotNull(), index).alias("index"), F.when(found, token).alias("token"), status.alias("status"))


def swapped_answer(word: Column) -> Column:
    """Yes for No and No for Yes, in the case of the word; others are null."""
    low = F.lower(word)
    other = F.when(low == "yes", "no").when(low == "no", "yes")
    return F.when(word == F.upper(word), F.upper(other)).when(word == F.initcap(word), F.initcap(other)).otherwise(other)


def no_context_cut(text: Column, offsets: Column) -> Column:
    """(cut, why): from the marker to the end of the token after it, which is all that is trained on."""
    k = decision_index(text, offsets)
    stop = F.get(offsets, k["index"])["stop"]
    start = F.instr(text, MARKER)
    return F.struct(F.when(k["why"].isNull(), F.substring(text, start, stop - start + 1)).alias("cut"), k["why"].alias("why"))


def target_problem(text: Column, label: Column, offsets: Column) -> Column:
    """Why a target can't be swapped (null: it can): one marker, a token of its own that says yes or no, as the label does."""
    k = decision_index(text, offsets)
    at = F.get(offsets, k["index"])
    word = F.trim(F.substring(text, at["start"] + 1, at["stop"] - at["start"]))
    return F.coalesce(k["why"], F.when(~F.lower(word).isin("yes", "no"), F.concat(F.lit("not an answer: "), word)).when((F.lower(word) == "yes") != label, "the answer contradicts the label"))


def loss_at(losses: Column, index: Column) -> Column:
    """The loss of a position, or null where there is none."""
    return F.get(losses, index)


def length_problem(rebuilt: Column, recorded: Column, losses: Column) -> Column:
    """Why the lengths of one example don't agree, or null."""
    return F.when((rebuilt != recorded) | (recorded != F.size(losses)), F.format_string("rebuilt %d, recorded %d, losses %d", rebuilt, recorded, F.size(losses)))


def pooled_probability(yes: Column, no: Column) -> Column:
    """P(yes) from the logits of yes tokens and of no tokens: softmax over the two log-sum-exps, safe for large logits."""
    return 1 / (1 + F.exp(log_sum_exp(no) - log_sum_exp(yes)))


def log_sum_exp(logits: Column) -> Column:
    most = F.array_max(logits)
    return most + F.log(F.aggregate(logits, F.lit(0.0), lambda t, x: t + F.exp(x - most)))


def log_odds(yes: Column, no: Column) -> Column:
    return log_sum_exp(yes) - log_sum_exp(no)
