"""Logs that are still being written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.logs import parse_commands


def commands(spark: SparkSession, folder: str) -> DataFrame:
    """Commands of log lines ``id<TAB>line`` in files that arrive in ``folder``; ids come with the data, as files arrive in any order."""
    raw = spark.readStream.text(folder)
    return parse_commands(raw.select(F.substring_index("value", "\t", 1).cast("bigint").alias("id"), F.expr("substring(value, instr(value, '\t') + 1)").alias("line")))


def append(stream: DataFrame, table: str, checkpoint: str, once: bool = True):
    """Append a stream to a Parquet folder; files of a batch that is run again are written once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", table)
    return (writer.trigger(availableNow=True) if once else writer).start()
