"""How many characters of a text each filter admits, by table: a code point is looked up once for all filters."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphvein.functions import filters

#: Bytes of text looked up together.
PORTION = 4 << 20


@functools.lru_cache(maxsize=8)
def classes(names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point of planes 0 to 3 (the last entry, class 0, stands for all others), and which filters admit each class: classes x filters."""
    bits = np.zeros((1 << 18) + 1, np.uint32)
    for k, name in enumerate(names):
        bits[:-1] |= filters.table((name,)).astype(np.uint32) << np.uint32(k)
    kinds, own = np.unique(bits, return_inverse=True)  # points that the same filters admit are one class; that of none comes first
    return own.astype(np.int32), (kinds[:, None] >> np.arange(len(names), dtype=np.uint32) & 1).astype(np.int64)


def counts(texts: pa.Array, names: tuple[str, ...]) -> np.ndarray:
    """texts x filters; null texts have none."""
    size = np.asarray(pc.utf8_length(texts).fill_null(0), np.int64)
    own, admits = classes(names)
    points = np.frombuffer("".join(t for t in texts.to_pylist() if t).encode("utf-32-le"), np.uint32)
    cell = own[np.minimum(points, 1 << 18)]
    cell += np.repeat(np.arange(len(size), dtype=np.int32) * np.int32(len(admits)), size)
    return np.bincount(cell, minlength=len(size) * len(admits)).reshape(len(size), -1) @ admits


def class_counts(df: DataFrame, column: str, names: Iterable[str] = filters.NAMES) -> DataFrame:
    """df without `column`, but with a count for each filter, named like it. A narrow pass; null texts count 0."""
    names = filters.chosen(names)
    fields = [T.StructField(n.replace("-", "_"), T.LongType()) for n in names]
    kept = df.drop(column, *(f.name for f in fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, PORTION * batch.num_rows // max(batch.column(0).nbytes, 1))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *map(pa.array, counts(part.column(0), names).T.copy())], [*part.schema.names[1:], *(f.name for f in fields)])

    return df.select(F.col(column).cast("string"), *kept.columns).mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))
