"""Incremental ingest of stored pages: the checkpoint takes the place of the paging cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from reviewscope import schema
from reviewscope.sources.readers import flatten_review_pages


def stream_pages(
    spark: SparkSession, path: str, columns: T.StructType = schema.REVIEW_PAGE, files_per_batch: int = 1000
) -> DataFrame:
    """Pages dropped into a folder, as a stream; failed and empty pages yield no rows."""
    pages = spark.readStream.schema(columns).option("maxFilesPerTrigger", files_per_batch).json(path)
    return flatten_review_pages(pages)


def ingest_pages(spark: SparkSession, path: str, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Append all pages not seen before to a review table (exactly once), then stop."""
    return (
        stream_pages(spark, path, **options)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
