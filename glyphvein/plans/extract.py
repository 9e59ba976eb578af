"""An extraction over files, as options and one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from glyphvein import encodings
from glyphvein.functions import filters
from glyphvein.functions.expressions import parse_size
from glyphvein.operators.scan import asked, counted, merged
from glyphvein.operators.stitch import HEAD, RUNS, TAIL, WHOLE, parts, scan_chunks
from glyphvein.sources.chunks import byte_ranges, ranged, text_lines, text_runs
from glyphvein.sources.lines import lines
from glyphvein.sources.stores import store_chunks

#: Default chunk for packed files in stores that only Spark's readers open.
CHUNK = "16M"
found = counted


@dataclass(frozen=True)
class Options:
    """What to extract; checked when made."""

    encodings: tuple[str, ...] = encodings.DEFAULT
    filters: tuple[str, ...] = ("ascii",)
    min_length: int = 4
    jobs: int = 0
    chunk_size: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "encodings", tuple(e.name for e in encodings.chosen(self.encodings)))
        object.__setattr__(self, "filters", filters.chosen(self.filters))
        if self.min_length < 1:
            raise ValueError("min-length must be at least 1")
        if self.jobs < 0:
            raise ValueError("jobs must be at least 1")
        if self.chunk_size is not None and parse_size(self.chunk_size) < 2:
            raise ValueError("chunk size must be at least 2")
        if self.chunk_size is not None and parse_size(self.chunk_size) % 2 and "utf16le" in self.encodings:
            raise ValueError("chunk size must be even where utf16le is asked for")


def chunks(spark: SparkSession, path: str, options: Options) -> DataFrame:
    """Ranges of files in stores that tasks read by range; of other stores, lines that Spark reads, strung together."""
    if ranged(path):
        return byte_ranges(spark, path, options.chunk_size, options.jobs or None)
    return store_chunks(spark, path, parse_size(options.chunk_size or CHUNK))


def unordered(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """All runs in the files at path. Files read by range are scanned where they are read, without a shuffle."""
    if ranged(path):
        return text_runs(spark, path, options.encodings, options.filters, options.min_length, options.chunk_size, options.jobs or None)
    return scan_chunks(chunks(spark, path, options), options.encodings, options.filters, options.min_length)


def extract(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """All runs in the files at path, in output order. Ranges that tasks read give them so; others are sorted."""
    runs = unordered(spark, path, options)
    return runs if ranged(path) else merged(runs)


@dataclass(frozen=True)
class Told:
    """What became known of an extraction while its output was written."""

    found: dict[str, int]
    scanned: dict[str, int]
    seconds: dict[str, float]
    size: int
    chunks: int


def told_lines(spark: SparkSession, path: str, options: Options, string_only: bool = False, eol: str = "\n") -> tuple[DataFrame, Callable[[], Told]]:
    """The output as one column, and a function that tells, once it was written, what the tasks counted: the input is read once.

    Inputs that are not read by range have no chunks to count; their runs are sorted, and found is all that is told.
    """
    names = options.encodings
    seen = Observation()
    if not ranged(path):
        runs = extract(spark, path, options)
        per = [F.count(F.when(F.col("encoding_code") == e.code, 1)).alias(e.name) for e in encodings.chosen(names)]
        texts = lines(runs.observe(seen, *per), string_only).select("line")
        return texts, lambda: Told({n: seen.get[n] for n in names}, {}, {}, 0, 0)
    rows = text_lines(spark, path, names, options.filters, options.min_length, options.chunk_size, options.jobs or None, string_only, eol)
    kinds = ("found", "scanned", "seconds")
    per = [F.sum(F.get(kind, k)).alias(f"{kind}-{n}") for kind in kinds for k, n in enumerate(names)]
    rows = rows.observe(seen, *per, F.sum("size").alias("size"), F.count(F.when(F.col("size") > 0, 1)).alias("chunks"))

    def told() -> Told:
        got = seen.get
        return Told(*({n: got[f"{kind}-{n}"] or 0 for n in names} for kind in kinds), got["size"] or 0, got["chunks"])

    return rows.where("block IS NOT NULL").select("block"), told


def shuffled(chunk_rows: DataFrame, options: Options) -> DataFrame:
    """How many pieces at chunk edges each encoding sends to be joined: grows as chunks shrink, but for chunks that follow each other in a task."""
    wanted = asked(options.encodings, options.filters, options.min_length)
    return parts(chunk_rows, wanted).where(F.col("kind").isin(HEAD, TAIL, WHOLE)).groupBy("encoding_code").agg(F.count("*").alias("pieces"))


def scanned(chunk_rows: DataFrame, options: Options) -> DataFrame:
    """How many records each encoding has before joining: runs inside chunks, and pieces at their edges."""
    wanted = asked(options.encodings, options.filters, options.min_length)
    own = F.when(F.col("kind") == RUNS, F.col("n")).otherwise(F.lit(1))
    return parts(chunk_rows, wanted).groupBy("encoding_code").agg(F.sum(own).alias("scanned"))
