"""Sources: whole files, values of a column, byte ranges of large files, and the runs in such ranges."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from glyphvein.encodings import ENCODINGS
from glyphvein.functions.expressions import auto_chunk_size, parse_size
from glyphvein.operators.runs import RUN_FIELDS, Scanner
from glyphvein.operators.scan import OUTPUT_SCHEMA, asked, scanners
from glyphvein.operators.stitch import MOST, _offsets

LOOKAHEAD = 3
#: Bytes read at once before and after a range, to find the cuts beside it.
BESIDE = 1 << 16
#: Bytes of text that are put into a charset at once.
PORTION = 1 << 18
CHUNK_SCHEMA = "path string, chunk_off long, bytes binary, lookahead binary, file_len long"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes of whole files, from any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("bytes"))


def column_values(df: DataFrame, key: str, column: str, charset: str = "UTF-8") -> DataFrame:
    """path, bytes of a text column, encoded."""
    return df.select(F.col(key).cast("string").alias("path"), F.encode(column, charset).alias("bytes"))


def charset_points(letters: str, to: str, own: str) -> np.ndarray:
    """What each code point is shown as: tab, line feed and printable ASCII with `letters` replaced by `to`, and those of `own`; 0 where it is left out."""
    points = np.zeros(0x110000, np.uint32)
    for c in map(ord, ["\t", "\n", *map(chr, range(0x20, 0x7F)), *own]):
        points[c] = c
    points[list(map(ord, letters[: len(to)]))] = list(map(ord, to))
    points[list(map(ord, letters[len(to) :]))] = 0
    return points


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut between rows after about PORTION bytes of text (one row at least), the bytes, and where each text begins."""
    for batch in batches:
        data, at = _offsets(batch.column("text").fill_null(""))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + PORTION, "right")) - 1)
            yield batch.slice(begin, end - begin), data[at[begin] : at[end]], at[begin : end + 1] - at[begin]
            begin = end


def charset(codec: str, letters: str = "", to: str = "", own: str | None = None):
    """What makes (path, bytes) of batches of (path, text) in a charset that Python has and Spark has not; what it lacks is left out.

    own: if given, texts are shown by charset_points() first. Texts are taken PORTION bytes at a time, and so sent on: what
    a worker holds does not grow with the rows that come at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = None if own is None else charset_points(letters, to, own)
        for batch, data, at in _portions(batches):
            text = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
            upto = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])[at]
            if points is not None:
                text = points[text]
                kept = text > 0
                text, upto = text[kept], np.concatenate([[0], np.cumsum(kept)])[upto]
            shown = text.tobytes().decode("utf-32-le")
            coded = [shown[i:j].encode(codec, "ignore") for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
            absent = np.asarray(batch.column("text").is_null())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(coded, pa.binary(), mask=absent)], ["path", "bytes"])

    return run


def texts(df: DataFrame, key: str, column: str) -> DataFrame:
    """path, text of a text column."""
    return df.select(F.col(key).cast("string").alias("path"), F.col(column).cast("string").alias("text"))


def charset_values(df: DataFrame, key: str, column: str, codec: str, letters: str = "", to: str = "", own: str | None = None) -> DataFrame:
    """path, bytes of a text column by charset()."""
    return texts(df, key, column).mapInArrow(charset(codec, letters, to, own), "path string, bytes binary")


def cut(df: DataFrame, chunk_size: int) -> DataFrame:
    """Rows of (path, bytes) cut into chunks of an even size."""
    chunk_size -= chunk_size % 2
    if chunk_size <= 0:
        raise ValueError("chunk size must be at least 2")
    size = F.length("bytes").cast("long")
    rows = df.where(F.length("bytes") > 0).withColumn("file_len", size)
    rows = rows.withColumn("chunk_off", F.explode(F.sequence(F.lit(0).cast("long"), F.col("file_len") - 1, F.lit(chunk_size).cast("long"))))
    part = lambda at, n: F.substring(F.col("bytes"), at.cast("int"), F.lit(n))
    return rows.select("path", "chunk_off", part(F.col("chunk_off") + 1, chunk_size).alias("bytes"), part(F.col("chunk_off") + 1 + chunk_size, LOOKAHEAD).alias("lookahead"), "file_len")


class ByteRange(InputPartition):
    def __init__(self, path: str, offset: int, size: int, total: int):
        self.path, self.offset, self.size, self.total = path, offset, size, total


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path or URI names, and the path in it. Raises for those that only Spark opens."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def ranged(path: str) -> bool:
    """Whether tasks can read ranges of the files there, without Spark's readers."""
    try:
        return store(path)[0].get_file_info(store(path)[1]).type != fs.FileType.NotFound
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def input_files(path: str) -> list[tuple[str, int]]:
    """The file at path, or those of the folder, with their sizes; none may be empty or no regular file."""
    system, inner = store(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    found = sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda f: f.path) if info.type == fs.FileType.Directory else [info]
    for f in found:
        if f.type != fs.FileType.File:
            raise ValueError(f"not a regular file: {f.path}")
        if not f.size:
            raise ValueError(f"empty file: {f.path}")
    return [(prefix + f.path, f.size) for f in found]


def range_size(total: int, chunk_size: str | None, jobs: int) -> int:
    """Bytes of each range of a file but the last: even, at most the file's length."""
    asked_size = parse_size(chunk_size) if chunk_size else 0
    if chunk_size and asked_size <= 0:
        raise ValueError("chunk size must be greater than zero")
    size = max(2, min(asked_size or auto_chunk_size(total, jobs), total + total % 2))
    return size - size % 2


class _Ranges(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.ranges = []
        for name, total in input_files(options["path"]):
            size = range_size(total, options.get("chunk_size"), int(options.get("jobs", "8")))
            self.ranges += [ByteRange(name, at, min(size, total - at), total) for at in range(0, total, size)]

    def partitions(self) -> list[ByteRange]:
        return self.ranges

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        with _opened(partition) as file:
            data = _exactly(file, partition, partition.offset, partition.size)
            ahead = file.read_at(min(LOOKAHEAD, partition.total - partition.offset - partition.size), partition.offset + partition.size)
        yield partition.path, partition.offset, bytes(data), bytes(ahead), partition.total


def _opened(partition: ByteRange):
    system, inner = store(partition.path)
    return system.open_input_file(inner)


def _exactly(file, partition: ByteRange, offset: int, size: int) -> pa.Buffer:
    data = file.read_buffer(size) if file.seek(offset) == offset else b""
    if len(data) < size:
        raise EOFError(f"{partition.path} is shorter than it was")
    return data


class _Around:
    """The bytes of a range and some beside it; more are read where a scanner finds no cut there."""

    def __init__(self, file, partition: ByteRange):
        self.file, self.partition = file, partition
        self.offset, self.end, self.total = partition.offset, partition.offset + partition.size, partition.total
        self.begin = max(self.offset - BESIDE, 0)
        self.data = self._read(self.begin, min(self.end + BESIDE, self.total))

    def _read(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(_exactly(self.file, self.partition, begin, end - begin), np.uint8)

    def bytes(self, begin: int, end: int) -> np.ndarray:
        if self.begin <= begin and end <= self.begin + len(self.data):
            return self.data[begin - self.begin : end - self.begin]
        return self._read(begin, end)

    def section(self, s: Scanner) -> tuple[np.ndarray, int]:
        """Bytes from the last cut at or before the range on to the first at or after its end, and where they begin: all runs that begin in the range, whole."""
        first, look = 0 if self.offset == 0 else None, BESIDE
        while first is None:
            begin = max(self.offset - look, 0)
            found = s.last_cut(self.bytes(begin, min(self.offset + (2 if s.wide else 1), self.total)))
            first = begin + found if found is not None else 0 if begin == 0 else None
            look *= 4
            if look > 4 * MOST:
                raise ValueError("a run spans more than 1 GiB")
        last, look = self.total if self.end == self.total else None, BESIDE
        while last is None:
            upto = min(self.end + look, self.total)
            found = s.next_cut(self.bytes(self.end - 1, upto), 1)
            last = self.end - 1 + found if found is not None else upto if upto == self.total else None
            look *= 4
            if look > 4 * MOST:
                raise ValueError("a run spans more than 1 GiB")
        return self.bytes(first, last), first


LABELS, CODES = pa.array([e.label for e in ENCODINGS], pa.string()), {e.name: e.code for e in ENCODINGS}


class Counters:
    """What a range's scanners did: records seen, records that begin in the range, and seconds, for each."""

    def __init__(self, n: int):
        self.scanned, self.found, self.seconds = [0] * n, [0] * n, [0.0] * n


@dataclass
class _Part:
    """Runs in order of their offsets."""

    offset: np.ndarray
    code: np.ndarray
    cb: np.ndarray
    cch: np.ndarray
    text: pa.Array

    @staticmethod
    def joined(parts: list[_Part]) -> _Part:
        """In order of offset, then code."""
        if len(parts) == 1:
            return parts[0]
        out = _Part(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("offset", "code", "cb", "cch")), pa.concat_arrays([p.text for p in parts]))
        return out.taken(np.argsort(out.offset << 4 | out.code, kind="stable"))

    def taken(self, rows: np.ndarray) -> _Part:
        return _Part(self.offset[rows], self.code[rows], self.cb[rows], self.cch[rows], self.text.take(pa.array(rows)))

    def split(self, limit: int) -> tuple[_Part, _Part]:
        n = int(np.searchsorted(self.offset, limit))
        cut = lambda a, b: _Part(self.offset[a:b], self.code[a:b], self.cb[a:b], self.cch[a:b], self.text.slice(a, b - a))
        return cut(0, n), cut(n, len(self.offset))


def _scanned(around: _Around, s: Scanner, counters: Counters, k: int) -> Iterator[tuple[int, _Part]]:
    """Runs of one scanner that begin in the range, a slab at a time, and up to where all are known."""
    data, base = around.section(s)
    for slab in s.slabs(data, base, around.total):
        began = time.perf_counter()
        row, begin, cb, cch, text = s.runs(slab)
        offset = slab.base[row] + begin
        part = _Part(offset, np.full(len(offset), s.encoding.code, np.int64), cb.astype(np.int64), cch.astype(np.int64), text)
        if (offset[1:] < offset[:-1]).any():
            part = part.taken(np.argsort(offset, kind="stable"))
        part = part.split(around.offset)[1].split(around.end)[0]
        counters.scanned[k] += len(offset)
        counters.found[k] += len(part.offset)
        counters.seconds[k] += time.perf_counter() - began
        yield int(slab.base[0]) + len(slab.data), part


def range_runs(file, partition: ByteRange, own: list[Scanner], counters: Counters) -> Iterator[_Part]:
    """Runs that begin in a range, of all scanners, in output order: a range needs nothing of the others.

    Scanners advance slab by slab, the one that is furthest back first; what lies before the least of their places
    is merged and handed on, so that no more than about a slab's runs of each are held.
    """
    around = _Around(file, partition)
    streams = [_scanned(around, s, counters, k) for k, s in enumerate(own)]
    upto, held = [partition.offset] * len(own), [[] for _ in own]
    while any(u is not None for u in upto):
        k = min((k for k, u in enumerate(upto) if u is not None), key=lambda k: upto[k])
        upto[k], part = next(streams[k], (None, None))
        if part is not None and len(part.offset):
            held[k].append(part)
        limit = min((u for u in upto if u is not None), default=around.end)
        ready = []
        for k, parts in enumerate(held):
            if parts:
                done, rest = (_Part.joined(parts) if len(parts) > 1 else parts[0]).split(limit)
                held[k] = [rest] if len(rest.offset) else []
                ready += [done] if len(done.offset) else []
        if ready:
            yield _Part.joined(ready)


class _Runs(_Ranges):
    """Each range gives the runs that begin in it, in output order: ranges need be neither joined nor sorted."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.wanted = asked(options["encodings"], options["filters"], int(options["min_length"]))

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        own = scanners(self.wanted)
        with _opened(partition) as file:
            for p in range_runs(file, partition, own, Counters(len(own))):
                path = pa.repeat(pa.scalar(partition.path), len(p.offset))
                yield pa.RecordBatch.from_arrays([path, pa.array(p.offset), pa.array(p.code.astype(np.int16)), LABELS.take(pa.array(p.code)), pa.array(p.cb), pa.array(p.cch), p.text], ["path", *RUN_FIELDS])


#: Runs whose lines are one block of text.
BLOCK = 1 << 16
LINES_SCHEMA = "path string, chunk_off long, size long, block string, found array<long>, scanned array<long>, seconds array<double>"


class _Lines(_Runs):
    """Each range gives its output lines, many in a block (without the end of the last), then a row that tells what was done for it."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.string_only, self.eol = options.get("string_only") == "true", options.get("eol", "\n")

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        own = scanners(self.wanted)
        counters = Counters(len(own))
        with _opened(partition) as file:
            for p in range_runs(file, partition, own, counters):
                for at in range(0, len(p.offset), BLOCK):
                    rows = slice(at, at + BLOCK)
                    text = p.text.slice(at, BLOCK)
                    if not self.string_only:
                        text = pc.binary_join_element_wise(pc.utf8_lpad(pc.cast(pa.array(p.offset[rows]), pa.string()), 20, "0"), LABELS.take(pa.array(p.code[rows])), text, "\t")
                    block = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(text)], pa.int32()), text), self.eol)
                    yield self._row(partition, 0, block, [[]] * 3)
        yield self._row(partition, partition.size, pa.nulls(1, pa.string()), [counters.found, counters.scanned, counters.seconds])

    @staticmethod
    def _row(partition: ByteRange, size: int, block: pa.Array, told: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.float64())
        counts = [pa.array([v], pa.list_(t)) for v, t in zip(told, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([partition.offset]), pa.array([size]), block, *counts], ["path", "chunk_off", "size", "block", "found", "scanned", "seconds"])


class ByteRanges(DataSource):
    """spark.read.format("byte_ranges").option("chunk_size", "16M").load(path): a partition for each range of a file that all executors can open."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return CHUNK_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Ranges(self.options)


class TextRuns(DataSource):
    """spark.read.format("text_runs"): the runs in byte ranges, found where they are read and in output order; options encodings, filters, min_length beside those of byte_ranges."""

    @classmethod
    def name(cls) -> str:
        return "text_runs"

    def schema(self) -> str:
        return OUTPUT_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Runs({**DEFAULTS, **self.options})


class TextLines(DataSource):
    """spark.read.format("text_lines"): the output lines of byte ranges in blocks, and counters; options string_only and eol beside those of text_runs."""

    @classmethod
    def name(cls) -> str:
        return "text_lines"

    def schema(self) -> str:
        return LINES_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Lines({**DEFAULTS, **self.options})


DEFAULTS = {"encodings": "ascii,utf16le-ascii", "filters": "ascii", "min_length": "4"}


def _reader(spark: SparkSession, source: type[DataSource], path: str, chunk_size: str | None, jobs: int | None, **options: str):
    input_files(path)
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("jobs", str(jobs or spark.sparkContext.defaultParallelism))
    for name, value in {**options, **({"chunk_size": chunk_size} if chunk_size else {})}.items():
        reader = reader.option(name, value)
    return reader


def byte_ranges(spark: SparkSession, path: str, chunk_size: str | None = None, jobs: int | None = None) -> DataFrame:
    return _reader(spark, ByteRanges, path, chunk_size, jobs).load(path)


def text_runs(spark: SparkSession, path: str, encodings_: tuple[str, ...], filters_: tuple[str, ...], min_length: int = 4, chunk_size: str | None = None, jobs: int | None = None) -> DataFrame:
    """Runs in output order."""
    wanted = {"encodings": ",".join(encodings_), "filters": ",".join(filters_), "min_length": str(min_length)}
    return _reader(spark, TextRuns, path, chunk_size, jobs, **wanted).load(path)


def text_lines(spark: SparkSession, path: str, encodings_: tuple[str, ...], filters_: tuple[str, ...], min_length: int = 4, chunk_size: str | None = None, jobs: int | None = None, string_only: bool = False, eol: str = "\n") -> DataFrame:
    """Blocks of output lines in output order. found, scanned and seconds have an entry for each encoding asked for, by code."""
    wanted = {"encodings": ",".join(encodings_), "filters": ",".join(filters_), "min_length": str(min_length), "string_only": str(string_only).lower(), "eol": eol}
    return _reader(spark, TextLines, path, chunk_size, jobs, **wanted).load(path)
