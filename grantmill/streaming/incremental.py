"""Resumable steps as streams over files: what a checkpoint has seen is not read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def run_available(source: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, partition: str | None = None) -> None:
    """Append what has come since the last run to a Parquet table, then stop."""
    rows = source if transform is None else transform(source)
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.partitionBy(partition) if partition else writer).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def stream_parquet(spark: SparkSession, path: str, schema: StructType, glob: str | None = None, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    for name, value in (("pathGlobFilter", glob), ("maxFilesPerTrigger", files)):
        reader = reader.option(name, value) if value is not None else reader
    return reader.parquet(path)


def stream_archives(spark: SparkSession, path: str) -> DataFrame:
    """New archives under a path, with their content."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)


def unpack_available(spark: SparkSession, archives: str, target: str, checkpoint: str) -> None:
    """Unpack archives that have come since the last run; one that can't be read is a row with status false."""
    from ..sources.tables import unpack

    run_available(stream_archives(spark, archives), target, checkpoint, unpack)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and type; works on streams (late rows beyond the watermark are dropped) and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
