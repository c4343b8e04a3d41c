"""Structured Streaming over document pairs as they arrive: an extension, the comparison itself is a batch operator.

Comparing a pair needs nothing but the pair, so rows of the comparison are a stateless projection of
the stream; summaries aggregate one pair and are made per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foliospark.operators import compare
from foliospark.sources import docx

PAIRS = "a long, b long, units_a array<string>, units_b array<string>"


def pairs(spark: SparkSession, path: str, schema: str = PAIRS) -> DataFrame:
    """New Parquet files of pairs under a path."""
    return spark.readStream.schema(schema).parquet(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """New Word documents under a path, parsed."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return docx.parse(files)


def rows(stream: DataFrame, ignore_case: bool = False) -> DataFrame:
    """The rows of each pair's comparison, as a stream."""
    return compare.compare(stream, ignore_case)


def summaries(stream: DataFrame, path: str, checkpoint: str, ignore_case: bool = False, count_numbering: bool = True) -> StreamingQuery:
    """Start writing a summary of each pair to Parquet, a folder per micro-batch, so that a retried batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        compare.summary(compare.compare(batch, ignore_case), count_numbering).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
