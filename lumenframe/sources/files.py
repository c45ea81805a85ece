"""Files of the record model: CSV dimension and facts, JSON lines, id lists; and the ordered JSON-lines sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODEBOOK = "code string, description string, diagnostic string, form string, rhythm string, class string"


def flag(text: Column) -> Column:
    """1.0 is true, all else, blank and null too, false."""
    return F.coalesce(F.try_to_number(text, F.lit("9.9")) == 1, F.lit(False))


def codebook_csv(spark: SparkSession, path: str) -> DataFrame:
    """Codes with their flags as booleans; blank fields are null."""
    raw = spark.read.csv(path, schema=CODEBOOK, header=True, nullValue="")
    return raw.select("code", "description", *[flag(F.col(c)).alias(c) for c in ("diagnostic", "form", "rhythm")], "class")


def annotations_csv(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """Facts of which one field is a literal like {'NORM': 100.0}: read into a map; an unreadable literal is an error, null or blank an empty map."""
    raw = spark.read.csv(path, schema=schema, header=True, escape='"')
    read = F.from_json(F.coalesce(field, F.lit("{}")), T.MapType(T.StringType(), T.DoubleType()), {"allowSingleQuotes": "true", "mode": "FAILFAST"})
    return raw.withColumn(field, read)


def coded(facts: DataFrame, key: str, field: str, codes: DataFrame) -> DataFrame:
    """One row a record and code of its map, with the codebook's columns; a code that isn't in the codebook is an error."""
    each = facts.select(key, F.explode(field).alias("code", "likelihood"))
    joined = each.join(codes.withColumn("_known", F.lit(True)), "code", "left")
    unknown = F.raise_error(F.concat(F.lit("code not in the codebook: "), F.col("code")))
    return joined.withColumn("diagnostic", F.when(F.col("_known").isNull(), unknown.cast("boolean")).otherwise(F.col("diagnostic"))).drop("_known")


def json_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last line of each key, files in order of their paths; blank and unreadable lines are left out.

    A line's place is its file, the block read, and the row number that grows within the block.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    row = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    rows = lines.select(row.alias("r"), place.alias("place")).where(F.col("r._corrupt").isNull() & F.col(f"r.{key}").isNotNull())
    last = rows.groupBy(F.col(f"r.{key}").alias("_key")).agg(F.max_by("r", "place").alias("r"))
    return last.select("r.*").drop("_corrupt")


def id_list(spark: SparkSession, path: str, field: str = "ecg_ids") -> DataFrame:
    """ord and id of a JSON file that is a list of ids, or an object that holds the list under a field; an id listed twice keeps its first place."""
    whole = spark.read.text(path, wholetext=True)
    ids = F.coalesce(F.from_json("value", "array<bigint>"), F.from_json("value", f"{field} array<bigint>")[field])
    return whole.select(F.posexplode(ids).alias("ord", "id")).groupBy("id").agg(F.min("ord").alias("ord")).where(F.col("id").isNotNull())


def requested(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of the listed ids with their place in the list; an id without a row is an error that names it."""
    joined = ids.join(rows.withColumn("_known", F.lit(True)), F.col("id") == F.col(key), "left")
    unknown = F.raise_error(F.concat(F.lit("id not in the manifest: "), F.col("id").cast("string"))).cast("bigint")
    return joined.withColumn(key, F.when(F.col("_known").isNull(), unknown).otherwise(F.col(key))).drop("_known", "id")


def write_json_lines(rows: DataFrame, path: str, key: str, overwrite: bool = False) -> None:
    """Lines in order of the key over all files of the folder, by range and not through one task; refuses a folder that exists unless told to overwrite."""
    ordered = rows.repartitionByRange(key).sortWithinPartitions(key)
    ordered.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


# --- waveform files, label names, metrics -------------------------------------------------------------------------

#: The folder that the second layout leaves out (500 and 100 samples a second), and what a record needs.
FOLDERS, PARTS = {"hr": "records500/", "lr": "records100/"}, [".dat", ".hea"]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Paths (below root, without their last suffix) and suffixes of all files; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + root.rstrip("/").replace(".", r"\\.") + "/", "")
    return files.select(F.regexp_replace(below, r"\.[^./]*$", "").alias("stem"), F.regexp_extract(below, r"(\.[^./]*)$", 1).alias("suffix"))


def candidate_stems(filename: Column, rate: str = "hr") -> Column:
    """Both places of a record under the root: as named without its last suffix, and the same without the rate's folder."""
    stem = F.regexp_replace(filename, r"(?<=[^/])\.[^./]*$", "")
    return F.array(stem, F.replace(stem, F.lit(FOLDERS[rate])))


def located(records: DataFrame, files: DataFrame, rate: str = "hr") -> DataFrame:
    """records (ecg_id, filename, ..) with `stem`, the first of its two places that has a .dat (null: neither), and `complete`: one of them has both PARTS."""
    there = files.where(F.col("suffix").isin(PARTS)).groupBy("stem").agg(F.bool_or(F.col("suffix") == PARTS[0]).alias("_dat"), (F.count_distinct("suffix") == len(PARTS)).alias("_both"))
    out = records.withColumn("_at", candidate_stems(F.col("filename"), rate))
    for i in (0, 1):
        side = there.select(F.col("stem").alias(f"_stem{i}"), F.col("_dat").alias(f"_dat{i}"), F.col("_both").alias(f"_both{i}"))
        out = out.join(side, F.get("_at", F.lit(i)) == F.col(f"_stem{i}"), "left")
    stem = F.coalesce(F.when(F.col("_dat0"), F.col("_stem0")), F.when(F.col("_dat1"), F.col("_stem1")))
    complete = F.coalesce("_both0", F.lit(False)) | F.coalesce("_both1", F.lit(False))
    return out.select(*records.columns, stem.alias("stem"), complete.alias("complete"))


def missing_files(found: DataFrame, order: str) -> DataFrame:
    """Every record without both of its files in one place, in input order."""
    return found.where(~F.col("complete")).drop("stem", "complete").orderBy(order)


def with_files_and_labels(found: DataFrame, labels: str) -> DataFrame:
    return found.where(F.col("stem").isNotNull() & (F.size(labels) > 0))


def record_path(found: DataFrame, ecg_id: int) -> str:
    """The stem of one record; KeyError if there is no such record, FileNotFoundError if it has no files."""
    row = found.where(F.col("ecg_id") == ecg_id).select("stem").head()
    if row is None:
        raise KeyError(ecg_id)
    if row["stem"] is None:
        raise FileNotFoundError(f"record {ecg_id} has no files")
    return row["stem"]


def label_names(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(ord, name): names of a small CSV in file order, numbered from 0. One file, read in one task."""
    lines = spark.read.csv(path, header=True).select(F.col(column).alias("name"), F.monotonically_increasing_id().alias("_at"))
    return lines.coalesce(1).select(F.monotonically_increasing_id().cast("int").alias("ord"), "name")


def without(rows: DataFrame, ids: list[int], key: str) -> DataFrame:
    """rows without the listed ids (a short list, a literal of the plan); rows without a key stay."""
    return rows.where(F.coalesce(~F.col(key).isin(ids), F.lit(True)))


def write_shards(cache: DataFrame, path: str) -> None:
    """The cache (shard, row, embedding) as one folder a shard, so that a reader of some shards opens no other's files."""
    cache.repartition("shard").write.partitionBy("shard").parquet(path)


LISTED_SHARDS = 1000


def embedding_of(spark: SparkSession, path: str, index: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, embedding) of the ids that have a slot in a cache of write_shards; only the shards that they name are read.

    Up to LISTED_SHARDS shards are a literal partition filter; more are left to dynamic pruning by the join.
    """
    slots = index.join(ids.select("id").distinct(), "id", "left_semi")
    named = [r["shard"] for r in slots.select("shard").distinct().limit(LISTED_SHARDS + 1).collect()]
    cache = spark.read.parquet(path)
    if len(named) <= LISTED_SHARDS:
        cache = cache.where(F.col("shard").isin(named))
    return cache.join(slots, ["shard", "row"]).select("id", "embedding")


def inner_codes(facts: DataFrame, key: str, field: str, codes: DataFrame) -> DataFrame:
    """One row a record and code of its map that the codebook has; other codes are left out."""
    return facts.select(key, F.explode(field).alias("code", "likelihood")).join(codes, "code")


def record_classes(facts: DataFrame, key: str, field: str, codes: DataFrame) -> DataFrame:
    """Each record with `superclass`, the sorted distinct classes of its diagnostic codes; codes that the codebook hasn't, and those without a class, are left out, and a record without any has an empty list.

    facts: key and a map from code to likelihood, null or empty for none; codes: code, diagnostic, class.
    """
    known = codes.where(F.col("diagnostic") & F.col("class").isNotNull()).select("code", "class")
    found = inner_codes(facts, key, field, known).groupBy(key).agg(F.array_sort(F.collect_set("class")).alias("superclass"))
    return facts.join(found, key, "left").withColumn("superclass", F.coalesce("superclass", F.array().cast("array<string>")))


def write_metrics(rows: DataFrame, path: str) -> None:
    """A summary as JSON lines, nulls kept; the folder must be new."""
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_by_condition(rows: DataFrame, path: str, *conditions: str) -> None:
    """A folder for each combination of conditions, so that no two share a file; a null condition is an error."""
    filled = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null")).cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in conditions]
    others = [c for c in rows.columns if c not in conditions]
    rows.select(*others, *filled).write.mode("errorifexists").partitionBy(*conditions).parquet(path)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions (those with _SUCCESS) under root, ascending."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS")))


def write_version(rows: DataFrame, root: str, keep: int = 2, best: int | None = None) -> int:
    """Writes the next version and prunes all but the newest `keep` and the best; returns its number. A version counts only when it is whole."""
    spark = rows.sparkSession
    have = versions(spark, root)
    new = (have[-1] if have else 0) + 1
    rows.write.mode("overwrite").parquet(f"{root}/v{new}")
    jvm = spark.sparkContext._jvm
    for v in [*have, new][:-keep]:
        if v != best:
            path = jvm.org.apache.hadoop.fs.Path(f"{root}/v{v}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return new
