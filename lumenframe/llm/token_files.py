"""Token-id files of directly addressable codes, in document order, written and read by Spark.

Documents are dealt and sorted by doc_id (rows with one doc_id by a hash of the
text and the text), encoded in Arrow batches, and gathered into files of at
least SHARD ids that end with a document.  A file goes through Spark's own text
writer as one record (its raw bytes and a closing line feed), so that it lands
on whatever file system spark.checkpoint.dir names and through Spark's commit
protocol: a lost executor's half-written file never counts.  Each task knows
the ids before each file in its own partition; the partitions' totals, as many
rows as there are partitions, give the rest.

Null texts are empty: only the end id.  Null doc_ids come first and stay null.
Repeated rows are written each.  A long text is one document in one file.  No
documents, no files.  Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.addressable import MAGIC, Reader, encode
from lumenframe.llm.chunks import ByteLevel, gather, split
from lumenframe.llm.common import own_columns, scratch_dir, text_slices

END, SHARD, SLICE = 0, 1 << 22, 1 << 24


def encoded(batch: pa.RecordBatch, tokens: ByteLevel, end: int):
    """(doc_ids, ids, number of ids up to each document's end) of slices of a batch, each document's ids with the end id."""
    texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string()).fill_null("")
    docs = batch.column(batch.schema.get_field_index("doc_id"))
    for i, j, _, _ in text_slices(batch, limit=SLICE):
        chunks, codes, bounds = split(pc.take(texts, pa.array(np.arange(i, j))))
        ids, ends = gather(*tokens.many(chunks), codes)
        n = j - i
        after = ends[bounds[1:]]
        yield docs.slice(i, n).to_pylist(), np.insert(ids, after, end).astype(np.uint32), after + np.arange(1, n + 1)


def write_token_files(docs: DataFrame, path: str, end: int = END, shard: int = SHARD) -> None:
    """Files of directly addressable codes of all documents in ascending doc_id, in the new folder `path`."""

    def run(batches):
        tokens, partition = ByteLevel(), TaskContext.get().partitionId()
        names, ids, sizes, number, before = [], np.zeros(0, np.uint32), np.zeros(0, np.int64), 0, 0

        def file(n: int) -> pa.RecordBatch:
            ends = np.cumsum(sizes[:n])
            return pa.record_batch([pa.array([encode(names[:n], ends, ids[: ends[-1]], partition, number, before)], pa.binary())], ["file"])

        for batch in batches:
            for more_names, more_ids, ends in encoded(batch, tokens, end):
                names, ids, sizes = names + more_names, np.concatenate([ids, more_ids]), np.concatenate([sizes, np.diff(ends, prepend=0)])
                while len(ids) >= shard:
                    n = int(np.searchsorted(np.cumsum(sizes), shard)) + 1
                    yield file(n)
                    size = int(sizes[:n].sum())
                    names, ids, sizes, number, before = names[n:], ids[size:], sizes[n:], number + 1, before + size
        if names:
            yield file(len(names))

    rows = own_columns(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    ordered.mapInArrow(run, "file binary").select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, read back from the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    field = lambda k: F.conv(F.hex(F.substring("content", len(MAGIC) + 8 * k + 1, 8)), 16, 10).cast("long")
    totals = {r["p"]: r["n"] for r in files.select(field(0).alias("p"), field(3).alias("n")).groupBy("p").agg(F.sum("n").alias("n")).collect()}  # as many as partitions
    before, base = {}, 0
    for p in sorted(totals):
        before[p] = base
        base += totals[p]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                file = Reader(content.as_buffer())
                base = before[file.partition] + file.before
                rows = [(doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, start, ids in file.documents()]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, path)
