"""Runs of text in binary values.

scan() takes whole values: a row is an input. One narrow pass over each value finds the runs of all encodings
asked for, with their offsets and texts; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphvein import encodings
from glyphvein.functions import filters
from glyphvein.operators.runs import RUN_FIELDS, RUN_SCHEMA, Scanner, run_batches, scanner

OUTPUT = ("path", *RUN_FIELDS)
OUTPUT_SCHEMA = f"path string, {RUN_SCHEMA}"
Coded = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def asked(encodings_: str | Iterable[str], filters_: str | Iterable[str], min_length: int) -> list[tuple[str, tuple[str, ...], int]]:
    """What makes each scanner, checked on the driver."""
    if min_length < 1:
        raise ValueError("min-length must be at least 1")
    names = filters.chosen(filters_)
    return [(e.name, names, min_length) for e in encodings.chosen(encodings_)]


def scanners(wanted: list[tuple[str, tuple[str, ...], int]]) -> list[Scanner]:
    """The scanners, made once in each worker."""
    return [scanner(*w) for w in wanted]


def scan(df: DataFrame, encodings_: str | Iterable[str] = encodings.DEFAULT, filters_: str | Iterable[str] = "ascii", min_length: int = 4, coded: Coded | None = None) -> DataFrame:
    """Runs in df (path, bytes), one row of output columns each. Inputs with null bytes have none.

    coded: makes (path, bytes) of df's first two columns, in the same pass.
    """
    wanted = asked(encodings_, filters_, min_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanners(wanted)
        for batch in batches if coded is None else coded(batches):
            yield from run_batches(own, batch.column(1), {"path": batch.column(0)})

    return (df.select("path", "bytes") if coded is None else df).mapInArrow(run, OUTPUT_SCHEMA)


def merged(runs: DataFrame) -> DataFrame:
    """Output order: by offset, then encoding code; runs of different encodings at one offset all stay."""
    return runs.orderBy("path", "offset", "encoding_code")


def counted(runs: DataFrame) -> DataFrame:
    """How many runs each encoding has: the same for any chunk size."""
    return runs.groupBy("encoding_code", "encoding").agg(F.count("*").alias("found"), F.sum("cb").alias("bytes"), F.max("cch").alias("longest"))
