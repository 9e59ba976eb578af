"""The scan as a table function, for SQL.

    register(spark)
    SELECT * FROM text_runs(TABLE(files), 'ascii,utf8', 'ascii', min_length => 6)

`files` has columns path and bytes; encodings, filters and min_length are constants and may be left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import SelectedColumn, udtf
from pyspark.sql.types import LongType, ShortType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from glyphvein import encodings
from glyphvein.operators.runs import SLAB, run_batches
from glyphvein.operators.scan import OUTPUT, asked, scanners

#: The scan's schema; where a call is analyzed there is no session to read it from text.
KINDS = (StringType(), LongType(), ShortType(), StringType(), LongType(), LongType(), StringType())
SCHEMA = StructType([StructField(n, k) for n, k in zip(OUTPUT, KINDS, strict=True)])


@dataclass
class Plan(AnalyzeResult):
    """What is known before rows come: the scanners asked for."""

    wanted: list = field(default_factory=list)


class TextRuns:
    """Gathers values up to about a slab, and scans them together."""

    def __init__(self, plan: Plan):
        self.wanted, self.rows, self.size = plan.wanted, [], 0

    @staticmethod
    def analyze(files: AnalyzeArgument, encodings_: AnalyzeArgument | None = None, filters_: AnalyzeArgument | None = None, min_length: AnalyzeArgument | None = None, **named: AnalyzeArgument) -> Plan:
        if not files.isTable or not {"path", "bytes"} <= {f.name for f in files.dataType.fields}:
            raise ValueError("text_runs takes a table with columns path and bytes")
        given = {"encodings": encodings_, "filters": filters_, "min_length": min_length} | named
        values = {k: v.value for k, v in given.items() if v is not None}
        if set(values) - {"encodings", "filters", "min_length"} or any(v is None for v in values.values()):
            raise ValueError("text_runs takes constants encodings, filters and min_length")
        wanted = asked(values.get("encodings", encodings.DEFAULT), values.get("filters", "ascii"), int(values.get("min_length", 4)))
        return Plan(schema=SCHEMA, select=[SelectedColumn("path"), SelectedColumn("bytes")], wanted=wanted)

    def eval(self, files: Row, *_, **__) -> Iterator[tuple]:
        self.rows.append((files["path"], files["bytes"]))
        self.size += len(files["bytes"] or b"")
        if self.size >= SLAB:
            yield from self._scanned()

    def terminate(self) -> Iterator[tuple]:
        yield from self._scanned()

    def _scanned(self) -> Iterator[tuple]:
        if self.rows:
            path, values = zip(*self.rows, strict=True)
            for batch in run_batches(scanners(self.wanted), pa.array(values, pa.binary()), {"path": pa.array(path, pa.string())}):
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
        self.rows, self.size = [], 0


def register(spark: SparkSession, name: str = "text_runs") -> None:
    spark.udtf.register(name, udtf(TextRuns, useArrow=True))
