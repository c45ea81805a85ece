"""Calls to a service over a stream of requests: resumed by what is done, retried with backoff, errors kept apart and tried again."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

ANSWERS = "ecg_id long, content string, error string, status int, attempts int"
RETRYABLE = {429, *range(500, 600)}


def backoff(attempt: int, base: float = 2.0, cap: float = 60.0, jitter: Callable[[], float] = random.random) -> float:
    """Seconds before the next attempt: base ** attempt up to cap, times 0.5 to 1.5."""
    return min(cap, base**attempt) * (0.5 + jitter())


def with_retry(call: Callable[[str], tuple[int, str]], prompt: str, attempts: int, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str, int]:
    """(status, text, attempts made): 429, 5xx and lost connections (status 0) are tried again, other statuses are final."""
    for k in range(attempts):
        try:
            status, text = call(prompt)
        except OSError as lost:
            status, text = 0, str(lost)
        if status == 200 or (status and status not in RETRYABLE) or k == attempts - 1:
            break
        sleep(backoff(k))
    return status, text, k + 1


def answer_all(requests: DataFrame, call: Callable[[str], tuple[int, str]], parallel: int, attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """One row a request (ecg_id, prompt): content, or error (500 characters) and status. At most `parallel` calls at once: one a partition."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for ecg_id, prompt in zip(part["ecg_id"], part["prompt"], strict=True):
                status, text, made = with_retry(call, prompt, attempts, sleep)
                rows.append((ecg_id, text if status == 200 else None, None if status == 200 else text[:500], status, made))
            yield pd.DataFrame(rows, columns=["ecg_id", "content", "error", "status", "attempts"])

    return requests.select("ecg_id", "prompt").repartition(parallel).mapInPandas(run, ANSWERS)


def pending(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests without a recorded answer; errors aren't answers, so they are tried again."""
    return requests.join(log.where(F.col("error").isNull()).select("ecg_id"), "ecg_id", "left_anti")


def resume(requests: DataFrame, log_path: str, call: Callable[[str], tuple[int, str]], parallel: int, **options) -> DataFrame:
    """Answers what is pending and appends it to the log; returns the log."""
    spark = requests.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(log_path)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    todo = pending(requests, spark.read.schema(ANSWERS).parquet(log_path)) if there else requests
    answer_all(todo, call, parallel, **options).write.mode("append").parquet(log_path)
    return spark.read.schema(ANSWERS).parquet(log_path)


def _there(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def logged(spark: SparkSession, folder: str) -> DataFrame:
    """All answers below folder, with the batch that wrote them."""
    schema = ANSWERS + ", batch string"
    name = f"{folder}/answers"
    return spark.read.schema(schema).parquet(name) if _there(spark, name) else spark.createDataFrame([], schema)


def answer_stream(requests: DataFrame, folder: str, call: Callable[[str], tuple[int, str]], parallel: int, name: str | None = None, **options) -> DataFrame:
    """Answers a stream of requests (ecg_id, prompt) batch by batch; returns the log below folder once all that is there is read.

    Each batch writes its requests, then the answers to those that no other batch has answered, to folders named by its
    number: a batch that is run again replaces itself, so each answer is logged once. (A call whose task is lost is
    made again.) A run begins with what earlier ones left without an answer, errors among it, under a name of its own.
    """
    spark = requests.sparkSession

    def settle(asked: DataFrame, batch: str) -> None:
        others = logged(spark, folder).where(F.col("batch") != batch)
        answer_all(pending(asked.dropDuplicates(["ecg_id"]), others), call, parallel, **options).write.mode("overwrite").parquet(f"{folder}/answers/batch={batch}")

    def run(batch: DataFrame, number: int) -> None:
        own = f"{folder}/requests/batch={number}"
        batch.select("ecg_id", "prompt").write.mode("overwrite").parquet(own)
        settle(spark.read.schema("ecg_id long, prompt string").parquet(own), str(number))

    if _there(spark, f"{folder}/requests"):
        left = pending(spark.read.schema("ecg_id long, prompt string, batch string").parquet(f"{folder}/requests").drop("batch"), logged(spark, folder))
        if not left.isEmpty():
            settle(left, "again-" + str(logged(spark, folder).where("batch LIKE 'again-%'").select("batch").distinct().count()))
    stream = requests.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    (stream.queryName(name) if name else stream).start().awaitTermination()
    return logged(spark, folder)


class Progress(StreamingQueryListener):
    """Tells rows done, rows a second and seconds left of the stream called `name`, whenever another `every` rows are done and at the last."""

    def __init__(self, name: str, total: int, every: int = 1000, tell: Callable[[dict], None] = print, clock: Callable[[], float] = time.monotonic):
        self.name, self.total, self.every, self.tell, self.clock = name, total, every, tell, clock
        self.done, self.began, self.told = 0, clock(), -1

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.done, self.began, self.told = 0, self.clock(), -1

    def onQueryProgress(self, event) -> None:
        if event.progress.name != self.name or not event.progress.numInputRows:
            return
        self.done += event.progress.numInputRows
        if self.done // self.every > max(self.told, 0) or self.done >= self.total:
            self.told = self.done // self.every
            seconds = self.clock() - self.began
            rate = self.done / seconds if seconds > 0 else 0.0
            self.tell({"done": self.done, "total": self.total, "rate": rate, "left": max(self.total - self.done, 0) / rate if rate else None})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
