"""Incremental re-indexing: a stream of changed source files keeps a project's graph up to date.

An extension beyond the batch operators: a Structured Streaming file source of Parquet or JSON rows ``project_id,
source_file, text``; each micro-batch replaces what its files gave before. A batch that is run again after a failure
gives the same graph, since files replace themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.graph import first_wins
from weftgraph.store import GraphStore

SCHEMA = "project_id string, source_file string, text string, scanned_at timestamp"


def changes(spark: SparkSession, folder: str, fmt: str = "parquet", files_per_batch: int = 1_000) -> DataFrame:
    """The stream of changed files."""
    return spark.readStream.format(fmt).schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(folder)


def keep_indexed(store: GraphStore, stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Start the query; of several versions of a file in one batch the latest counts."""

    def batch(df: DataFrame, _: int) -> None:
        df = df.withColumn("__at", -F.unix_micros("scanned_at"))
        latest = first_wins(df, ["project_id", "source_file"], ["__at"]).drop("__at", "scanned_at")
        for (project,) in latest.select("project_id").distinct().collect():  # projects of one batch
            store.add_files(project, latest.where(F.col("project_id") == project))

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def rates(stream: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Changed files per project and window of scan time; later rows than ``late`` are dropped."""
    w = stream.withWatermark("scanned_at", late)
    return w.groupBy(F.window("scanned_at", window), "project_id").agg(F.count(F.lit(1)).alias("files"))
