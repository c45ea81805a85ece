"""Texts that stand under several doc_ids: passes that compare texts see each once, under its least doc_id.

Exact copies are found by narrow rows (doc_id and 128 bits of the text's
hash).  A task drops them by a table of bits (sketch.py), so no text is
shuffled; the few rows that the table drops beside them come back from a list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import U, is_crowded, join_unique, longs, mix, save
from lumenframe.llm.sketch import present, releasing

KEY, _OTHER, _STAYS = "_text_key", "_text_key_2", "_stays"


def text_key() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64("text")


def _names(batch: pa.RecordBatch) -> np.ndarray:
    return mix(longs(batch, "doc_id").view(U) ^ mix(longs(batch, KEY).view(U)))


def once(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame | None, Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """docs with KEY, the copies (doc_id, KEY), and what takes them from a batch of the former. docs: doc_id (not null) and text.

    A copy's text stands under a smaller doc_id too; rows equal in doc_id and text all stay. No copies: None.
    """
    docs = docs.withColumn(KEY, text_key())
    named = save(docs.where("text IS NOT NULL").select("doc_id", KEY, F.xxhash64(F.lit(1), "text").alias(_OTHER)), "texts")
    groups = named.groupBy(KEY, _OTHER).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("rows"))
    several = save(groups.where("first < last"), "several-texts")
    if several.isEmpty():
        return docs, None, lambda batch: batch
    met = join_unique(named, several.drop("last", "rows"), [KEY, _OTHER], crowded=is_crowded(several, "rows"))
    copies = save(met.where("doc_id > first").select("doc_id", KEY).distinct(), "copies")

    def each(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield _names(batch)

    dropped = present(copies, each, bits - 3)

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(dropped(_names(batch))))

    beside = save(named.select("doc_id", KEY).mapInArrow(releasing(taken), f"doc_id long, {KEY} long").join(copies, ["doc_id", KEY], "left_anti").distinct(), "beside-copies")
    every = docs.withColumn(_STAYS, F.lit(False))
    if not beside.isEmpty():
        every = every.unionByName(docs.join(beside, ["doc_id", KEY], "left_semi").withColumn(_STAYS, F.lit(True)))

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        stays = batch.column(batch.schema.get_field_index(_STAYS)).to_numpy(zero_copy_only=False) | ~dropped(_names(batch))
        return batch if stays.all() else batch.filter(pa.array(stays))

    return every, copies, kept
