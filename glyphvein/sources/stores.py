"""Chunks of files in stores that only Spark's readers open, of any length.

Spark's text reader deals a file to tasks by ranges and gives lines as they are in the file, byte by byte; ranges meet at
line feeds. So bytes are lines with their line feeds put back, and a line's place is what all lines before it add up to: a
sum for each range (in the JVM, without the lines themselves leaving it), sums over ranges, and the place within the range.
The reader drops a byte order mark at a file's beginning, which shows in the sum, and it would unpack files whose names say
that they are compressed: those come whole, by Spark's binaryFile, up to its 2 GiB. So long may a single line be, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphvein.sources.chunks import cut, read_files

#: Endings of names that Hadoop's codecs go by.
PACKED = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst", ".lzo", ".passthrough")
#: Most rows of range sums to be sent to every task, at about a hundred bytes.
FEW_RANGES = 100_000
_MARK = b"\xef\xbb\xbf"
CHUNKS = "path string, range long, inside long, file_len long, bytes binary"


def _lines(spark: SparkSession, path: str, names: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").option("pathGlobFilter", names).text(path)
    meta = F.col("_metadata")
    return rows.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("range"), meta["file_size"].alias("file_len"), F.col("value").cast("binary").alias("line"))


def _strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a range that come in one batch, as one value, and how many bytes of the range come before it."""
    last, inside = None, 0
    for batch in batches:
        path, start = np.asarray(batch.column("path").dictionary_encode().indices), np.asarray(batch.column("range"), np.int64)
        fresh = np.ones(len(start), bool)
        fresh[1:] = (path[1:] != path[:-1]) | (start[1:] != start[:-1])
        bounds = np.append(np.flatnonzero(fresh), len(start)).tolist()
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            own = (batch.column("path")[i].as_py(), int(start[i]))
            if own != last:
                last, inside = own, 0
            lines = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column("line").slice(i, j - i))
            said = pc.binary_join(lines, pa.scalar(b"\n"))[0].as_py() + b"\n"
            yield pa.RecordBatch.from_arrays([pa.array([own[0]]), pa.array([own[1]]), pa.array([inside]), batch.column("file_len").slice(i, 1), pa.array([said], pa.binary())], ["path", "range", "inside", "file_len", "bytes"])
            inside += len(said)


def line_chunks(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """path, chunk_off, bytes, file_len of the files at path whose names match; none may be packed."""
    lines = _lines(spark, path, names)
    sums = lines.groupBy("path", "file_len", "range").agg(F.sum(F.octet_length("line") + 1).alias("size"))
    of_file = Window.partitionBy("path")
    before = of_file.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    marked = F.sum("size").over(of_file) < F.col("file_len")  # but for a mark, lines make up the file, or a line feed more
    first = F.row_number().over(of_file.orderBy("range")) == 1
    sums = sums.select("path", "range", (F.coalesce(F.sum("size").over(before), F.lit(0)) + F.when(marked, len(_MARK)).otherwise(0)).alias("base"), (marked & first).alias("marked"))
    few = lines.select("path", "range").distinct().limit(FEW_RANGES + 1).count() <= FEW_RANGES
    strung = lines.mapInArrow(_strung, CHUNKS)
    rows = strung.join(F.broadcast(sums) if few else sums.hint("merge"), ["path", "range"])
    with_mark = F.col("marked") & (F.col("inside") == 0)
    start = F.when(with_mark, F.lit(0)).otherwise(F.col("base") + F.col("inside")).cast("long")
    whole = F.when(with_mark, F.concat(F.lit(_MARK), F.col("bytes"))).otherwise(F.col("bytes"))
    rows = rows.select("path", start.alias("chunk_off"), whole.alias("bytes"), "file_len")
    left = F.col("file_len") - F.col("chunk_off")  # the last line may have no line feed
    kept = F.when(F.octet_length("bytes") > left, F.substring(F.col("bytes"), F.lit(1), left.cast("int"))).otherwise(F.col("bytes"))
    # a file that is a mark and nothing else has no lines at all
    bare = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).where((F.col("length") == len(_MARK)) & (F.col("content") == F.lit(_MARK)))
    bare = bare.select("path", F.lit(0).cast("long").alias("chunk_off"), F.col("content").alias("bytes"), F.col("length").alias("file_len"))
    return rows.select("path", "chunk_off", kept.alias("bytes"), "file_len").unionByName(bare)


def checked(spark: SparkSession, path: str) -> bool:
    """Whether any file at path is packed by its name; empty files are an error. Contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    packed = F.lit(False)
    for ending in PACKED:
        packed = packed | F.lower("path").endswith(ending)
    told = files.agg(F.max(packed).alias("packed"), F.count("*").alias("n")).first()
    listed = files.inputFiles()  # readers leave out files without bytes; the listing does not
    if told.n < len(listed):
        raise ValueError(f"empty file: {min(set(listed) - {r.path for r in files.select('path').collect()}, default=path)}")
    return told.packed


def store_chunks(spark: SparkSession, path: str, chunk_size: int) -> DataFrame:
    """Chunks of all files at path: lines strung together, or, where packed files are among them, files read whole and cut."""
    return cut(read_files(spark, path), chunk_size).drop("lookahead") if checked(spark, path) else line_chunks(spark, path)
