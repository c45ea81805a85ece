"""Quality rules whose cutoffs limit false rejection, in DataFrame functions only.

Base rules are fixed (too few words, mostly repeated three-word windows).
Beyond them, each rule compares one share of a text with a cutoff, and a
document goes if any rule rejects it.  Cutoffs are learned per stratum, from
the labelled documents that pass the base rules, in two parts that crc32 of
doc_id keeps apart:

- The tuning third fixes a short chain of cutoff vectors (CHAIN), from loose
  to strict.  A vector takes, for each rule, the lowest cutoff that rejects at
  most `share` of `limit` of the stratum's good tuning documents, or the one
  `margin` steps looser.
- The other two thirds are held out and certify.  Where a vector's verdict, all
  rules together, rejects k of the n good documents held out, it is certified
  if the exact binomial tail P(Bin(n, limit) <= k) is at most delta / strata,
  the Bonferroni correction over the strata tested.  Within a stratum vectors
  are tested in the order of the chain, each only if all before it passed, and
  such a fixed sequence needs no further correction.

Then, with probability 1 - delta, in every stratum the verdict rejects at most
`limit` of the good documents that pass the base rules.  Of the certified
vectors, the one is used for which rejected bad documents less MIN_BAD_PER_GOOD
times the rejected good ones are most, the loosest among equals, if that is
above 0; a stratum without one keeps all.  With the default limit and four
strata, about 150 good documents held out of which none is rejected certify.

Null or empty text: no words, base_failed.  Null strata are one stratum of
their own, apart from the empty string's.  A document with several labels is
good only if all say so; labels without a document, and null labels, are
ignored.  Repeated rows of a document count once in n and k (once in each
stratum they are in), as rejected if any of them is; verdicts are for each row.  Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import own_columns, save

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
LIMIT, DELTA, MIN_BAD_PER_GOOD = 0.03, 0.05, 9
#: The chain of cutoff vectors: the share of the limit that each rule may reject when tuned, and how many cutoffs looser it then is.
CHAIN = [(0.0, 4), (0.0, 2), (0.0, 1), (0.0, 0), (0.125, 0), (0.25, 0)]
TUNING = "crc32(CAST(doc_id AS STRING)) % 3 = 0"
#: Shares that a rule rejects if they are above its cutoff, and the cutoffs tried.
RULES = {"symbols": "n_symbols / greatest(word_chars, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "capitals": "n_capitals / greatest(word_chars, 1)"}
CUTOFFS = [0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8]
_SPACES, _SYMBOLS, _CAPITALS = " \t\n\x0b\x0c\r", "#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lost(text: str, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(F.col(text), chars, ""))


def features(docs: DataFrame, stratum: str) -> DataFrame:
    """doc_id, stratum and the counts that rules use, from one pass and no shuffle. Windows are named by 64-bit hashes within a text."""
    d = docs.select(F.col("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    d = d.withColumn("w", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), ""))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(
        "doc_id", "stratum", F.size("w").alias("n_words"), F.length(F.translate(F.col("t"), _SPACES, "")).alias("word_chars"),
        _lost("t", _SYMBOLS).alias("n_symbols"), _lost("t", _CAPITALS).alias("n_capitals"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
    )
    three = F.when(
        F.size("h") >= 3, F.transform(F.sequence(F.lit(0), F.size("h") - 3), lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("g", three)
    # most texts repeat no window: only the others pay for a sort with places
    d = d.withColumn("repeats", F.size(F.array_distinct("g")) < F.size("g"))
    d = d.withColumn("s", F.when(F.col("repeats"), F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twice = F.filter(
        F.transform("s", lambda p, j: F.when((p["x"] == F.get("s", j - 1)["x"]) | (p["x"] == F.get("s", j + 1)["x"]), p["i"])), lambda i: i.isNotNull()
    )
    d = d.withColumn("q", F.when(F.col("repeats"), F.sort_array(twice)))
    covered = F.aggregate(F.transform("q", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("q", j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    kept = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines"]
    return d.select("doc_id", "stratum", *[F.col(c).cast("long") for c in kept], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly (in logarithms); 1 where k is not below the mean, as no bound is wanted there."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] + odds + F.log((n - j + 1) / j)
        high, low = F.greatest(a["total"], term), F.least(a["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k < n * p, F.exp(F.aggregate(steps, start, step, lambda a: a["total"]))).otherwise(1.0)


def labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each labelled document of a stratum that passes the base rules: stratum, good, tuning, and its share for each rule."""
    named = own_columns(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"))
    shares = [F.max(F.expr(e)).alias(r) for r, e in RULES.items()]  # of a document's rows, the one that is rejected first counts
    held = found.where(~base_failed()).join(named, "doc_id").groupBy("stratum", "doc_id").agg(F.first("q").alias("q"), *shares)
    return held.select("stratum", (F.col("q") == 1).alias("good"), F.expr(TUNING).alias("tuning"), *RULES)


def cutoff_chains(tuning: DataFrame, limit: float) -> DataFrame:
    """(stratum, chain): for each step of CHAIN in turn the cutoff of each rule, null where the rule is off; tuning: labelled() rows."""
    tried = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("share")) for r in RULES])
    each = tuning.where("good").select("stratum", F.explode(tried).alias("x")).select("stratum", "x.*")
    at = each.select("stratum", "rule", "share", F.explode(F.array(*map(F.lit, CUTOFFS))).alias("cutoff"))
    counts = at.groupBy("stratum", "rule", "cutoff").agg(F.count("*").alias("n"), F.count_if(F.col("share") > F.col("cutoff")).alias("k"))
    # k falls as cutoffs rise: those over the budget are the lowest ones
    over = [F.count_if(F.col("k") > share * limit * F.col("n")) + margin for share, margin in CHAIN]
    steps = counts.groupBy("stratum", "rule").agg(F.array(*over).alias("places"))
    cutoffs = F.array(*map(F.lit, CUTOFFS))
    steps = steps.select("stratum", "rule", F.posexplode(F.transform("places", lambda i: F.get(cutoffs, i.cast("int")))).alias("step", "cutoff"))
    vectors = steps.groupBy("stratum", "step").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))  # one a rule
    return vectors.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("step", F.map_entries("cutoffs").alias("entries")))).alias("chain"))


def rejecting(cutoffs: Column, shares: dict[str, Column]) -> Column:
    """Names of the rules that reject."""
    return F.array_compact(F.array(*[F.when(share > cutoffs[r], F.lit(r)) for r, share in shares.items()]))


def certified_cutoffs(found: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """(stratum, cutoffs): the certified cutoff of each rule, by name; found: features()."""
    rows = save(labelled(found, labels), "labelled")
    chains = cutoff_chains(rows.where("tuning"), limit).withColumnRenamed("stratum", "of")
    held = rows.where("NOT tuning").join(chains, F.col("stratum").eqNullSafe(F.col("of")))
    held = held.select("stratum", "good", *RULES, F.explode("chain").alias("c")).withColumn("cutoffs", F.map_from_entries("c.entries"))
    rejected = F.size(rejecting(F.col("cutoffs"), {r: F.col(r) for r in RULES})) > 0
    counts = held.groupBy("stratum", F.col("c.step").alias("step")).agg(
        F.count_if("good").alias("n"), F.count_if(F.col("good") & rejected).alias("k"), F.count_if(~F.col("good") & rejected).alias("bad"), F.first("c.entries").alias("entries")
    )
    strata = counts.agg(F.countDistinct(F.struct("stratum")).alias("strata"))
    tested = counts.crossJoin(F.broadcast(strata)).withColumn("passes", binomial_tail(F.col("k"), F.col("n"), limit) <= delta / F.col("strata"))  # strata: one row
    so_far = Window.partitionBy("stratum").orderBy("step")  # a stratum has len(CHAIN) rows
    worth = tested.withColumn("certified", F.min("passes").over(so_far)).withColumn("worth", F.col("bad") - MIN_BAD_PER_GOOD * F.col("k")).where("certified AND worth > 0")
    return worth.groupBy("stratum").agg(F.map_from_entries(F.max_by("entries", F.struct("worth", -F.col("step")))).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """The features of each document, base_failed, kept, and the rules that rejected it."""
    found = save(features(own_columns(docs, *dict.fromkeys(["doc_id", "text", stratum])), stratum), "features")
    certified = certified_cutoffs(found, labels, limit, delta).withColumnRenamed("stratum", "of")
    judged = found.join(certified, F.col("stratum").eqNullSafe(F.col("of")), "left").drop("of")
    failed = rejecting(F.col("cutoffs"), {r: F.expr(e) for r, e in RULES.items()})
    judged = judged.withColumn("base_failed", base_failed()).withColumn("rejected_by", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("cutoffs")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))
