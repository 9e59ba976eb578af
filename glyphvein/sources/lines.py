"""Output lines, as a text sink and as one ordered file. Runs come in output order; lines are written by the tasks."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphvein.functions.expressions import line
from glyphvein.sources.chunks import ranged, store

#: Bytes copied at a time.
COPY = 1 << 22


def lines(runs: DataFrame, string_only: bool = False) -> DataFrame:
    """path, offset, encoding_code and the line of each run."""
    text = F.col("text") if string_only else line(F.col("offset"), F.col("encoding"), F.col("text"))
    return runs.select("path", "offset", "encoding_code", text.alias("line"))


def write_lines(texts: DataFrame, path: str, eol: str = "\n") -> None:
    """A folder of text files from a DataFrame of one column, a line or a block of lines a row, in its order."""
    texts.write.mode("overwrite").option("lineSep", eol).text(path)


def shared_folder(spark: SparkSession, near: str | None = None) -> str:
    """The folder that driver and tasks share, from spark.checkpoint.dir; on one machine, where that is unset, beside the output."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = os.path.dirname(os.path.abspath(near)) if near else tempfile.mkdtemp(prefix="spark-")
    return shared.rstrip("/")


def join_parts(spark: SparkSession, folder: str, out: BinaryIO) -> None:
    """The files of a folder that write_lines() made, byte by byte one after another."""
    if ranged(folder):
        system, inner = store(folder)
        found = sorted(f.path for f in _listed(system, inner) if f.base_name.startswith("part-"))
        for name in found:
            with system.open_input_stream(name) as part:
                shutil.copyfileobj(part, out, COPY)
        return
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    for name in sorted(r.path for r in parts.select("path").collect()):  # a part at a time; as many as the input has ranges
        out.write(parts.where(F.col("path") == name).first().content)


def _listed(system, inner: str):
    from pyarrow import fs

    return system.get_file_info(fs.FileSelector(inner))


def write_file(texts: DataFrame, out: BinaryIO, near: str | None = None, eol: str = "\n") -> None:
    """One file, open on the driver: tasks write their parts of it, which are joined as bytes."""
    spark = texts.sparkSession
    folder = f"{shared_folder(spark, near)}/lines-{uuid.uuid4().hex}"
    try:
        write_lines(texts, folder, eol)
        join_parts(spark, folder, out)
    finally:
        if ranged(folder):
            system, inner = store(folder)
            system.delete_dir(inner)
