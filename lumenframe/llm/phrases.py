"""Phrase collocations by language: generalised suffix automata per shard, counts reduced by Spark.

A shard is some text of one language: its distinct words and its words' places.
Counts that matter are found in three rounds, each pruned by the one before,
so that what is shuffled is never all substrings of the corpus:

1. words are counted in each shard and summed; those that reach the least
   count are numbered, so that a pair of words is one exact long;
2. a depth-2 automaton of each shard, cut at words below the least count, gives
   its word pairs with endpos counts; a window over each pair sums them beside
   the shards' rows, and rows of rarer pairs end there;
3. a depth-4 automaton, cut also between pairs below the least count,
   enumerates the phrases of four words, and those of three where no fourth
   follows; they are summed exactly, a phrase of three from all that begin with
   it.  Words are put for numbers in what is left.

A phrase's suffix link leads to the phrase without its first word; the same
link in reverse to the one without its last.  What a longer phrase takes from
the phrases inside it goes along these links one word at a time, as a phrase
two words longer can't be more frequent than the one between.

Every shard gets only its own words and pairs back, grouped by shard.  The
global list of frequent words is broadcast only if it has at most BROADCAST
rows, and joined by a shuffle beyond; there is no list of frequent pairs.

Null texts hold nothing; null languages are `und`.  Repeated rows count each.
A text of any length is cut nowhere.  No texts give no rows.  Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.automaton import SuffixAutomaton
from lumenframe.llm.common import LOWER, byte_set, give_back, own_columns, save, text_slices, word_bounds

LEAST, LONGEST, SHARE, TOP = 30, 4, 80, 2000
SHARD_BYTES, BROADCAST, SALTS = 6 << 20, 1_000_000, 64
HALF = 31  # bits of a word's number; 0 is no word
_GAP = byte_set(b" \t.,;:!?\n\x0b\x0c\r")
_PIECE_END = byte_set(b".,;:!?\n\x0b\x0c\r")
_SHARD = "shard long, lang string, words array<string>, times array<long>, places binary"


def words_of(batch: pa.RecordBatch):
    """(words, whether a piece begins at each word) of slices of a batch of one language."""
    for _, _, data, offsets in text_slices(batch, limit=1 << 22):
        data = LOWER[data]
        starts, ends, bounds = word_bounds(data, offsets, _GAP)
        cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(_PIECE_END[data])])[starts]
        begins = np.zeros(len(starts) + 1, bool)
        begins[1:-1] = cuts[1:] != cuts[:-1]
        begins[bounds[:-1]] = True
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
        each = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.tobytes()), pa.py_buffer(data[~_GAP[data]].tobytes()))
        yield each.dictionary_encode(), begins[: len(starts)]


def shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows of at most about `shard_bytes` of text of one language: distinct words, their counts, and the word at each place (-1: a piece ends), packed."""

    def run(batches):
        held, size, number = {}, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            rows = []
            for lang, parts in sorted(held.items()):
                one = pa.chunked_array([w for w, _ in parts]).unify_dictionaries()
                dictionary = one.chunk(0).dictionary
                codes = np.concatenate([c.indices.to_numpy() for c in one.chunks])
                begins = np.concatenate([b for _, b in parts])
                places = np.full(len(codes) + int(begins.sum()), -1, np.int32)
                places[np.arange(len(codes)) + np.cumsum(begins)] = codes
                rows.append((TaskContext.get().partitionId() << 32 | number, lang, dictionary, np.bincount(codes, minlength=len(dictionary)), pa.compress(places.tobytes(), "zstd", asbytes=True)))
                number += 1
            held.clear()
            shard, lang, words, times, packed = zip(*rows, strict=True)
            lists = lambda parts, kind: pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), pa.concat_arrays([p.cast(kind) for p in parts]))
            columns = [pa.array(shard, pa.int64()), pa.array(lang, pa.string()), lists(words, pa.string()), lists([pa.array(t) for t in times], pa.int64()), pa.array(packed, pa.binary())]
            return pa.record_batch(columns, ["shard", "lang", "words", "times", "places"])

        for batch in batches:
            langs = batch.column(batch.schema.get_field_index("lang"))
            for lang in langs.unique().to_pylist():
                for words, begins in words_of(batch.filter(pc.equal(langs, lang))):
                    if len(words):
                        held.setdefault(lang, []).append((words, begins))
                        size += len(words) * 7
                    if size >= shard_bytes:
                        yield flush()
                        give_back()
                        size = 0
        if held:
            yield flush()

    rows = own_columns(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return rows.mapInArrow(run, _SHARD)


def _small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it is saved and small by count, else as it is."""
    return F.broadcast(table) if table.count() <= BROADCAST else table


def _numbered(words: DataFrame) -> DataFrame:
    """The rows with an id each, from 1 without gaps: saved first, as an id may not change when a task runs again."""
    held = save(words.withColumn("at", F.monotonically_increasing_id()), "phrase-word-counts")
    held = held.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.expr(f"at & {(1 << 33) - 1}L"))
    sizes = held.groupBy("part").agg(F.count("*").alias("size"))  # a row for each task
    starts = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))
    return save(held.join(F.broadcast(starts), "part").select("lang", "phrase", "a", (F.col("start") + F.col("at") + 1).alias("id")), "phrase-words")


def _places(shard: pa.Table, known: pa.Table) -> np.ndarray:
    """The number of the word at each place, -1 for other words and ends of pieces."""
    import zstandard

    packed = shard["places"][0].as_py()
    places = np.frombuffer(pa.Codec("zstd").decompress(packed, asbytes=True, decompressed_size=zstandard.frame_content_size(packed)), np.int32)
    ids = np.full(len(shard["words"].combine_chunks().flatten()) + 1, -1, np.int64)  # the last one stands for -1
    ids[known["k"].to_numpy()] = known["value"].to_numpy()
    return ids[places]


def _word_pairs(shard: pa.Table, known: pa.Table) -> pa.Table:
    sequence = _places(shard, known)
    _, end, count = SuffixAutomaton(sequence, 2).substrings(2)
    return pa.table({"shard": np.full(len(end), shard["shard"][0].as_py()), "pair": sequence[end - 1] << HALF | sequence[end], "times": count})


def _phrases(shard: pa.Table, known: pa.Table) -> pa.Table:
    """Phrases of four words with their counts in the shard, those of three that no fourth word follows, and pairs counted already that fall to it."""
    of_word = pc.greater_equal(known["k"], 0)
    places, pairs = _places(shard, known.filter(of_word)), known.filter(pc.invert(of_word))
    there = np.flatnonzero((places[1:] >= 0) & (places[:-1] >= 0)) if len(places) else np.zeros(0, np.int64)
    linked = np.zeros(len(places) + 1, bool)  # between this place and the one before
    linked[there + 1] = np.isin(places[there] << HALF | places[there + 1], pairs["value"].to_numpy())
    used = linked[:-1] | linked[1:]  # a word with a frequent pair on either side
    breaks = used & ~linked[:-1]
    sequence = np.full(int(used.sum() + breaks.sum()), -1, np.int64)
    sequence[np.arange(int(used.sum())) + np.cumsum(breaks[used])] = places[used]
    length, end, count = SuffixAutomaton(sequence, LONGEST).substrings(3)
    start, four = end - length + 1, length == LONGEST
    head, third = sequence[start] << HALF | sequence[start + 1], sequence[start + 2]
    three = pa.table({"head": head, "third": third, "times": np.where(four, -count, count)}).group_by(["head", "third"]).aggregate([("times", "sum")])
    three = three.filter(pc.greater(three["times_sum"], 0))
    mine = pairs.filter(pc.greater(pairs["a"], 0))
    none = np.zeros(len(mine) + len(three), np.int64)
    return pa.table(
        {
            "head": np.concatenate([mine["value"].to_numpy(), three["head"].to_numpy(), head[four]]),
            "third": np.concatenate([none[: len(mine)], three["third"].to_numpy(), third[four]]),
            "fourth": np.concatenate([none, sequence[end[four]]]),
            "times": np.concatenate([mine["a"].to_numpy(), three["times_sum"].to_numpy(), count[four]]),
        }
    )


def _freed(work):
    """The work on one shard, before which the worker gives back what the last one left."""

    def run(shard: pa.Table, known: pa.Table) -> pa.Table:
        give_back()
        return work(shard, known)

    return run


def counted(docs: DataFrame, least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of phrases of one to four words with a >= least, and (lang, n) of all words."""
    held = save(shards(docs, shard_bytes), "phrase-shards")
    totals = held.groupBy("lang").agg(F.sum(F.aggregate("times", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n"))
    each = held.select("shard", "lang", F.explode(F.arrays_zip("words", "times")).alias("x")).select("lang", F.col("x.words").alias("phrase"), F.col("x.times").alias("times"))
    words = _numbered(each.groupBy("lang", "phrase").agg(F.sum("times").alias("a")).where(F.col("a") >= least))
    listed = _small(words.select("lang", "phrase", "id"))
    known = held.select("shard", "lang", F.posexplode("words").alias("k", "phrase")).join(listed, ["lang", "phrase"]).select(F.col("shard").alias("of"), "k", F.col("id").alias("value"))
    by_shard, same = held.groupBy("shard"), Window.partitionBy("pair")  # a pair has a row a shard at most
    pairs = by_shard.cogroup(known.groupBy("of")).applyInArrow(_freed(_word_pairs), "shard long, pair long, times long")
    summed = pairs.select("shard", "pair", F.sum("times").over(same).alias("a"), F.min("shard").over(same).alias("first")).where(F.col("a") >= least)
    linked = summed.select(F.col("shard").alias("of"), F.lit(-1).alias("k"), F.col("pair").alias("value"), F.when(F.col("shard") == F.col("first"), F.col("a")).otherwise(0).alias("a"))
    both = known.withColumn("a", F.lit(0).cast("long")).unionByName(linked.sortWithinPartitions("of", "value"))  # a shard's pairs together are smaller in a shuffle
    found = by_shard.cogroup(both.groupBy("of")).applyInArrow(_freed(_phrases), "head long, third long, fourth long, times long")
    fours = found.repartition("head", "third").groupBy("head", "third", "fourth").agg(F.sum("times").alias("a"))
    fours = fours.withColumn("three", F.sum("a").over(Window.partitionBy("head", "third"))).where(F.col("three") >= least)
    threes = F.struct(F.lit(0).cast("long").alias("fourth"), F.col("three").alias("a"))
    longer = fours.select("head", "third", F.explode(F.array(threes, F.struct("fourth", "a"))).alias("x")).select("head", "third", "x.fourth", "x.a")
    longer = longer.where("fourth = 0 OR a >= " + str(least)).groupBy("head", "third", "fourth").agg(F.max("a").alias("a"))  # a three's own sum is its largest
    for i, number in enumerate((f"head >> {HALF}", f"head & {(1 << HALF) - 1}L", "third", "fourth")):
        of = listed.select("id", F.col("phrase").alias(f"w{i}"), *["lang"][i:])
        longer = longer.withColumn("id", F.expr(number)).join(of, "id", "left").drop("id")
    longer = longer.select("lang", F.concat_ws(" ", "w0", "w1", "w2", "w3").alias("phrase"), F.expr("2 + int(w2 IS NOT NULL) + int(w3 IS NOT NULL)").alias("size"), "a")
    return save(words.select("lang", "phrase", F.lit(1).alias("size"), "a").unionByName(longer), "phrases"), totals


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases that no longer one stands for."""
    phrases, totals = counted(docs, least, shard_bytes)
    candidates = phrases.where("size > 1")
    parts = phrases.where(F.col("size") < LONGEST).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("part", F.expr("substring_index(phrase, ' ', k)")).join(parts.withColumnRenamed("f", "l"), ["lang", "part"])
    cuts = cuts.withColumn("part", F.expr("substring_index(phrase, ' ', k - size)")).join(parts.withColumnRenamed("f", "r"), ["lang", "part"])
    score = F.expr("CAST((CAST(a AS DECIMAL(19, 0)) * 2000000) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0))) AS LONG)")
    least_cut = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "size", "a").agg(least_cut).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    links = F.array(F.expr("substring_index(phrase, ' ', 1 - size)"), F.expr("substring_index(phrase, ' ', size - 1)"))
    taken = candidates.where("size > 2").select("lang", F.explode(links).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    standing = scored.join(taken, ["lang", "phrase"], "left").where(
        F.expr(f"longer IS NULL OR CAST(longer AS DECIMAL(19, 0)) * 100 < CAST(a AS DECIMAL(19, 0)) * {share}")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = standing.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)  # at most SALTS * top rows of a language
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w
    FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), occurrences AS (
    SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM pieces, range(1, 5) t(k) WHERE len(w) >= k)
), counts AS (
    SELECT lang, k, phrase, count(*) AS a FROM occurrences GROUP BY ALL HAVING count(*) >= 30
), totals AS (
    SELECT lang, count(*) AS n FROM occurrences WHERE k = 1 GROUP BY lang
), parted AS (
    SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM counts WHERE k > 1
), scored AS (
    SELECT p.lang, p.k, p.phrase, p.a, p.w, p.cut, l.a AS l, r.a AS r, CAST((2000000::HUGEINT * p.a) // (l.a + r.a) AS BIGINT) AS score
    FROM parted p
    JOIN counts l ON l.lang = p.lang AND l.phrase = array_to_string(p.w[1:p.cut], ' ')
    JOIN counts r ON r.lang = p.lang AND r.phrase = array_to_string(p.w[p.cut + 1:], ' ')
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_phrases AS (
    SELECT lang, a AS longer, array_to_string(w[s:s + m - 1], ' ') AS phrase
    FROM (SELECT lang, a, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM (SELECT DISTINCT lang, a, w FROM parted) x, range(2, 4) t(m) WHERE len(w) > m)
), taken AS (
    SELECT lang, phrase, max(longer) AS longer FROM inner_phrases GROUP BY ALL
), standing AS (
    SELECT s.* FROM lowest s LEFT JOIN taken t USING (lang, phrase) WHERE t.longer IS NULL OR 100::HUGEINT * t.longer < 80::HUGEINT * s.a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM standing
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
