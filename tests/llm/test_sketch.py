import os
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumenframe.llm import ngram_join as J
from lumenframe.llm import suffix_dedup as X
from lumenframe.llm.common import save
from lumenframe.llm.copies import KEY, once
from lumenframe.llm.repeats import WHOLE
from lumenframe.llm.sketch import counted, present


def fingerprints(n):
    values = np.random.default_rng(7).integers(0, 2**63, n).astype(np.uint64)

    def of(batch):
        yield values[batch.column(0).to_numpy(zero_copy_only=False)]

    return values, of


def test_what_stands_once_does_not_fill_the_table(spark):
    """Eight times as many different fingerprints as the table has bits in a half: those seen once stay out all the same."""
    n, bits = 1 << 19, 16
    values, of = fingerprints(n)
    ids = spark.range(n).unionAll(spark.range(500)).unionAll(spark.range(40)).repartition(6)
    twice, thrice = counted(ids, of, ((2, bits), (3, bits - 4)))
    assert twice(values[:500]).all() and thrice(values[:40]).all()
    assert twice(values[500:]).mean() < 0.01 and thrice(values[40:]).mean() < 0.01
    some = present(spark.range(300), of, bits)
    assert some(values[:300]).all() and some(values[300:]).mean() < 0.01


def test_a_saved_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum(f.startswith("shuffle_") and f.endswith(".data") for d in disk.localDirsString() for _, _, names in os.walk(d) for f in names)
    before = files()
    saved = save(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "groups")
    for _ in range(40):
        if files() <= before:
            break
        time.sleep(0.25)
    assert files() <= before
    assert saved.count() == 7


def test_copies_of_a_text_take_no_part(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(i, text) for i in (5, 3, 9, 3)] + [(9, "other " + text[:90]), (4, None), (6, None), (7, "short"), (8, "short")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    seen, copies, kept = once(df, 14)
    assert sorted(r.doc_id for r in copies.collect()) == [5, 8, 9]
    left = seen.mapInArrow(lambda batches: (kept(b).select(["doc_id", "text"]) for b in batches), "doc_id long, text string").collect()
    assert sorted((r.doc_id, r.text or "") for r in left if r.text) == sorted([(3, text), (3, text), (7, "short"), (9, "other " + text[:90])])
    assert J.prefix_rows(spark.createDataFrame([(i, text) for i in range(50)], "doc_id long, text string"), 4, 85, 14).count() == 0
    runs = X.find_repeats(spark.createDataFrame([(i, text) for i in range(50)], "doc_id long, text string"), bits=14).collect()
    assert sorted((r.doc, r.start, r.n) for r in runs) == [(i, 0, WHOLE) for i in range(1, 50)]


def test_rows_that_the_table_of_copies_drops_by_chance_come_back(spark):
    rows = [(i, f"text {i // 2}") for i in range(6000)] + [(10_000 + i, f"single {i}") for i in range(6000)]
    seen, copies, kept = once(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 14)  # a table of 4,096 bits for 3,000 copies
    assert copies.count() == 3000 and KEY in seen.columns
    left = seen.mapInArrow(lambda batches: (pa.record_batch([kept(b).column(0)], names=["doc_id"]) for b in batches), "doc_id long").collect()
    assert sorted(r.doc_id for r in left) == sorted([i for i in range(0, 6000, 2)] + [10_000 + i for i in range(6000)])


def test_unique_shingles_are_not_sent_however_many(spark):
    """20,000 shingles of one document each and a table of 8,192 bits: only prefixes of the near copies are rows."""
    docs = [(i, " ".join(f"d{i}w{j}" for j in range(103))) for i in range(200)]
    docs += [(1000 + i, " ".join(f"n{j}" for j in range(60)) + f" end{i}") for i in range(3)]
    rows = J.prefix_rows(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 4, 85, 12)
    assert {r.doc for r in rows.select("doc").collect()} == {1000, 1001, 1002}
