"""Incremental ingestion of a folder (an extension: the batch flow over files as they come)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tamis.functions.text import file_name


def ingest(spark: SparkSession, path: str, checkpoint: str, each: Callable[[DataFrame, int], None], pattern: str = "*.json") -> StreamingQuery:
    """Run ``each`` over ``file_name, raw`` of the files that are new since the last run, then stop.

    The checkpoint remembers which files were seen, so a file is handed on once, and again only after a failed batch.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).schema("value string").load(path)
    named = files.select(file_name(F.col("_metadata.file_path")).alias("file_name"), F.col("value").alias("raw"))
    return named.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
