"""Runs in a stream of chunks: in any order, over any number of micro-batches, the runs of the whole inputs.

Chunks are scanned where they come in. A piece at a chunk's edge that finds not all it needs beside it is state, by input and place, until the pieces that
adjoin it are there: a string begins with what a chunk has after its last cut, goes on through chunks without a cut,
and ends with what a chunk has before its first. Then it is scanned, and forgotten. Runs found in place pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from glyphvein import encodings
from glyphvein.operators.runs import run_batches
from glyphvein.operators.scan import OUTPUT, OUTPUT_SCHEMA, asked, scanners
from glyphvein.operators.stitch import HEAD, MARK, MOST, RUNS, TAIL, parts

#: The state store that keyed state of this kind needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Inputs are dealt to so many keys, each of which takes the pieces of all its inputs together.
SLOTS = 1024

Piece = tuple[int, int, bytes]


def strung(rows: pd.DataFrame) -> Iterator[tuple[str, int, int, Piece]]:
    """Path, start, input's length and (kind, size, data) of pieces, those that adjoin put together; HEAD at the end of one that began with TAIL: MARK."""
    rows = rows.sort_values(["path", "start", "kind"], kind="stable")
    path, start, total, held, stop = None, 0, 0, None, -1
    for p, kind, at, size, length, data in zip(rows["path"], rows["kind"].tolist(), rows["start"].tolist(), rows["size"].tolist(), rows["file_len"].tolist(), rows["data"], strict=True):
        if held and (p != path or at != stop or kind == TAIL or held[-1][0] == HEAD):
            yield path, start, total, _one(held)
            held = None
        if not held:
            path, start, total, held = p, at, length, []
        held.append((kind, size, data))
        stop = at + size
    if held:
        yield path, start, total, _one(held)


def _one(held: list[Piece]) -> Piece:
    first, last = held[0][0], held[-1][0]
    kind = (MARK if last == HEAD else TAIL) if first == TAIL else last
    return kind, sum(size for _, size, _ in held), b"".join(bytes(data) for _, _, data in held)


class Strings(StatefulProcessor):
    """Pieces of the inputs of a slot under one encoding, until they make a string. What is whole within the rows at hand never becomes state."""

    def __init__(self, wanted: list[tuple]):
        self.wanted = wanted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scanners = {s.encoding.code: s for s in scanners(self.wanted)}
        #: Heads and whole chunks by where they begin, and tails and whole chunks by where they end.
        self.onward = handle.getMapState("onward", "path string, start long", "kind int, size long, data binary")
        self.backward = handle.getMapState("backward", "path string, stop long", "kind int, size long, data binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        scanner = self.scanners[int(key[1])]
        for batch in rows:
            runs = batch["kind"] == RUNS
            for data in batch.loc[runs, "data"]:
                for found in pa.ipc.open_stream(data):
                    yield found.to_pandas()[list(OUTPUT)]
            met = [m for path, start, total, piece in strung(batch[~runs]) if (m := self._string(path, start, total, piece))]
            if met:
                path, start, total, values = zip(*met, strict=True)
                keys = {"path": pa.array(path, pa.string())}
                for found in run_batches([scanner], pa.array(values, pa.large_binary()), keys, np.array(start), np.array(total)):
                    yield found.to_pandas()[list(OUTPUT)]

    def _string(self, path: str, start: int, total: int, piece: Piece) -> tuple[str, int, int, bytes] | None:
        """The string that a piece completes, whose other pieces are state no more; if there is none, the piece becomes state."""
        kind, size, data = piece
        first, last, said, used = start, start + size, [data], []
        missing = False
        back = kind in (TAIL, MARK)
        while not back and not missing:
            before = self.backward.getValue((path, first))
            if before is None:
                missing = True
            else:
                used.append((before[0], first - before[1], first))
                said.insert(0, before[2])
                first, back = first - before[1], before[0] == TAIL
        ahead = kind in (HEAD, MARK)
        while not ahead and not missing:
            after = self.onward.getValue((path, last))
            if after is None:
                missing = True
            else:
                used.append((after[0], last, last + after[1]))
                said.append(after[2])
                last, ahead = last + after[1], after[0] == HEAD
        if missing:
            if kind != TAIL:
                self.onward.updateValue((path, start), piece)
            if kind != HEAD:
                self.backward.updateValue((path, start + size), piece)
            return None
        if last - first > MOST:
            raise ValueError("a run spans more than 1 GiB")
        for kind, begin, end in used:
            if kind != TAIL:
                self.onward.removeKey((path, begin))
            if kind != HEAD:
                self.backward.removeKey((path, end))
        return path, first, total, b"".join(map(bytes, said))

    def close(self) -> None:
        pass


def scan_chunk_stream(spark: SparkSession, stream: DataFrame, encodings_: str | Iterable[str] = encodings.DEFAULT, filters_: str | Iterable[str] = "ascii", min_length: int = 4) -> DataFrame:
    """Runs of a stream of chunks (path, chunk_off, bytes, file_len), each of which comes once; in append mode."""
    wanted = asked(encodings_, filters_, min_length)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    sent = parts(stream, wanted, most=1 << 60, closing=True)  # one stretch: pieces come in no copies
    keyed = sent.withColumn("slot", F.pmod(F.xxhash64("path", "bucket"), F.lit(SLOTS))).groupBy("slot", "encoding_code")
    return keyed.transformWithStateInPandas(statefulProcessor=Strings(wanted), outputStructType=StructType.fromDDL(OUTPUT_SCHEMA), outputMode="Append", timeMode="None").select(*OUTPUT)
