import time

import pytest
from pyspark.sql import functions as F

from lumenframe.streaming import requests as Q


def put(spark, folder, rows):
    spark.createDataFrame(rows, "ecg_id long, prompt string").coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema("ecg_id long, prompt string").option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_killed_stream_logs_each_answer_once_and_tries_errors_again(spark, tmp_path):
    asked, log = str(tmp_path / "asked"), str(tmp_path / "log")
    put(spark, asked, [(1, "a"), (2, "bad"), (2, "bad")])
    put(spark, asked, [(3, "c"), (1, "a"), (4, "dies")])

    def first(prompt):
        if prompt == "dies":
            raise RuntimeError("killed")
        return (400, "no") if prompt == "bad" else (200, prompt)

    with pytest.raises(Exception, match="killed"):
        Q.answer_stream(stream(spark, asked), log, first, 2)
    second = lambda p: (200, p.upper())
    put(spark, asked, [(5, "e"), (3, "c")])
    out = Q.answer_stream(stream(spark, asked), log, second, 2)
    answers = sorted((r.ecg_id, r.content) for r in out.where("error IS NULL").collect())
    assert [k for k, _ in answers] == [1, 2, 3, 4, 5]  # each once
    assert dict(answers) == {1: "a", 2: "BAD", 3: "C", 4: "DIES", 5: "E"}
    assert [(r.ecg_id, r.status) for r in out.where("error IS NOT NULL").collect()] == [(2, 400)]
    assert Q.answer_stream(stream(spark, asked), log, first, 2).count() == out.count()  # nothing is left to do


def test_progress_over_a_stream(spark, tmp_path):
    asked, told = str(tmp_path / "asked"), []
    for k in range(3):
        put(spark, asked, [(10 * k + i, "p") for i in range(4)])
    listener = Q.Progress("asked", 12, every=8, tell=told.append)
    spark.streams.addListener(listener)
    try:
        out = Q.answer_stream(stream(spark, asked), str(tmp_path / "log"), lambda p: (200, p), 2, name="asked")
        assert out.agg(F.count_distinct("ecg_id")).first()[0] == 12
        for _ in range(100):  # listeners hear of a batch some time after it
            if told and told[-1]["done"] == 12:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [t["done"] for t in told] == [8, 12] and told[-1]["left"] == 0 and told[0]["rate"] > 0 and told[0]["left"] > 0
