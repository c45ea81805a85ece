"""Incremental ingest: a file stream, each batch routed to an accepted and a rejected table, exactly once by checkpoint."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder where all executors can write: below spark.checkpoint.dir or the checkpoint folder set, or, with a local master only, a temporary one."""
    sc = spark.sparkContext
    set_already = sc._jsc.sc().getCheckpointDir()
    top = sc.getConf().get("spark.checkpoint.dir", None) or (set_already.get() if set_already.isDefined() else None)
    if not top:
        if sc.master.split("[")[0] != "local":
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.gettempdir()
    return f"{top.rstrip('/')}/ingest-{uuid.uuid4().hex}"


def ingest(spark: SparkSession, source: str, accept: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Read all there is as a stream; rows for which accept holds and the others. A rerun on the same folder adds only new files."""
    schema = spark.read.parquet(source).schema

    def route(batch: DataFrame, number: int) -> None:
        held = batch.withColumn("accepted", F.coalesce(F.expr(accept), F.lit(False)))
        held.write.mode("overwrite").partitionBy("accepted").parquet(f"{folder}/rows/batch={number}")  # a repeated batch replaces itself

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    folder_given = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema)
    if not folder_given:  # a stream watches a folder: of this one, the named file
        reader, source = reader.option("pathGlobFilter", path.getName()).option("recursiveFileLookup", "true"), path.getParent().toString()
    stream = reader.parquet(source).writeStream.foreachBatch(route)
    stream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.where("accepted = 'true'").drop("accepted", "batch"), rows.where("accepted = 'false'").drop("accepted", "batch")
