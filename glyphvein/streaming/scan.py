"""Runs in a stream of whole values: each micro-batch is scanned as a table and appended to a sink."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from glyphvein import encodings
from glyphvein.operators.scan import scan


def binary_files(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """New files of a folder as (path, bytes)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).load(path).selectExpr("path", "content AS bytes")


def scan_stream(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, encodings_: str | Iterable[str] = encodings.DEFAULT, filters_: str | Iterable[str] = "ascii", min_length: int = 4) -> DataStreamWriter:
    """A writer that gives sink the runs of each micro-batch and its number; exactly once if sink overwrites by number."""

    def each(batch: DataFrame, number: int) -> None:
        sink(scan(batch, encodings_, filters_, min_length), number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
