"""Scanning of inputs that come in chunks, with the results of a scan of the whole.

At a cut (a byte that cannot belong to any run) nothing is open under any reading. Chunks that follow each other within a
batch are strung together where they lie, without a copy. What lies between the first and the last cut of such a
stretch is scanned in place; the pieces before and after are sent to where they meet the pieces of the next, and scanned
then: one pass over the input, one exchange. Runs found in place go along in blocks, which nothing looks into.

Pieces are dealt by stretches of the input (BUCKETS times MOST bytes), so that no step takes all pieces of an input into
one task. A string of pieces is no longer than MOST bytes: those that begin near the end of a stretch find what follows
them there, in copies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphvein import encodings
from glyphvein.operators.runs import Scanner, run_batches
from glyphvein.operators.scan import OUTPUT, OUTPUT_SCHEMA, asked, scanners

#: Most bytes of a joined piece, as a Spark value holds no more than twice that; how many of them make a stretch of the input.
MOST, BUCKETS = 1 << 30, 4
#: Kinds of rows: a block of runs; what a chunk has before its first cut and after its last, or the whole of it; the last piece of the stretch before, without its bytes.
RUNS, HEAD, TAIL, WHOLE, MARK = -1, 0, 1, 2, 3
PARTS_SCHEMA = "path string, encoding_code short, bucket long, kind int, start long, size long, file_len long, n long, data binary"
_PARTS = pa.schema([("path", pa.string()), ("encoding_code", pa.int16()), ("bucket", pa.int64()), ("kind", pa.int32()), ("start", pa.int64()), ("size", pa.int64()), ("file_len", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])


def _offsets(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array, and where each value begins and the last ends."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, kind)[values.offset : values.offset + len(values) + 1].astype(np.int64) if len(values) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _fresh(path: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which rows do not go on from the one before."""
    fresh = np.ones(len(start), bool)
    fresh[1:] = (path[1:] != path[:-1]) | (start[1:] != start[:-1] + size[:-1])
    return fresh


def _codes(paths: pa.Array) -> np.ndarray:
    return np.asarray(paths.dictionary_encode().indices.fill_null(-1))


def _bounds(s: Scanner, data: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last cut of each stretch of data (bounds at); the input's own starts and ends count as cuts. The first is above the last where there is none."""
    begin, end = at[:-1].copy(), at[1:].copy()
    if starts.all() and ends.all():
        return begin, end
    cuts = s.all_cuts(data)
    # a cut between units takes a byte before and two after it
    first = np.searchsorted(cuts, begin + (1 if s.wide else 0))
    last = np.searchsorted(cuts, end - (1 if s.wide else 0)) - 1
    some = first <= last
    cut = lambda i: cuts[np.clip(i, 0, max(len(cuts) - 1, 0))] if len(cuts) else np.zeros(len(i), np.int64)
    inner_begin, inner_end = np.where(starts, begin, np.where(some, cut(first), end)), np.where(ends, end, np.where(some, cut(last), begin))
    none = ~some & ~starts & ~ends
    inner_begin[none], inner_end[none] = end[none], begin[none]
    # with one end of the input and no cut: what is there goes on beyond the other end
    inner_begin = np.where(~some & ends & ~starts, end, inner_begin)
    inner_end = np.where(~some & starts & ~ends, begin, inner_end)
    return inner_begin, inner_end


def parted(batches: Iterable[pa.RecordBatch], own: list[Scanner], task: int, most: int = MOST, closing: bool = False) -> Iterator[pa.RecordBatch]:
    """Of each batch of chunks (path, chunk_off, bytes, file_len): blocks of runs, and pieces at the edges of what is contiguous.

    closing: heads come even where they are empty, so that each string ends with one.
    """
    number = task << 32
    for batch in batches:
        data, row_at = _offsets(batch.column("bytes"))
        off, total, path = np.asarray(batch.column("chunk_off"), np.int64), np.asarray(batch.column("file_len"), np.int64), batch.column("path")
        first = np.flatnonzero(_fresh(_codes(path), off, np.diff(row_at)))
        if not len(first):
            continue
        at = np.append(row_at[first], row_at[-1])
        base, total, path, size = off[first], total[first], path.take(pa.array(first)), np.diff(at)
        for s in own:
            begin, end = _bounds(s, data, at, base == 0, base + size == total)
            inner = np.flatnonzero(begin < end)
            if len(inner):
                whole = (begin[inner] == at[inner]).all() and (end[inner] == at[inner + 1]).all() and len(inner) == len(size)
                cut_at = np.concatenate([[0], np.cumsum(end[inner] - begin[inner])])
                values = _binary(data, at) if whole else _binary(np.concatenate([data[i:j] for i, j in zip(begin[inner].tolist(), end[inner].tolist(), strict=True)]), cut_at)
                for found in run_batches([s], values, {"path": path.take(pa.array(inner))}, (base + begin - at[:-1])[inner], total[inner]):
                    yield _block(found, s.encoding.code, number)
                    number += 1
            yield from _edges(s, data, at, begin, end, base, total, path, most, closing)


def parts(chunks: DataFrame, wanted: list[tuple], most: int = MOST, closing: bool = False) -> DataFrame:
    """parted() by the tasks: one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return parted(batches, scanners(wanted), TaskContext.get().partitionId(), most, closing)

    return chunks.select("path", "chunk_off", "bytes", "file_len").where(F.length("bytes") > 0).mapInArrow(run, PARTS_SCHEMA)


def _block(found: pa.RecordBatch, code: int, number: int) -> pa.RecordBatch:
    """Runs as one row, whose bucket is a number of its own so that blocks are spread."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as out:
        out.write_batch(found)
    return pa.RecordBatch.from_pylist([{"path": None, "encoding_code": code, "bucket": number, "kind": RUNS, "start": 0, "size": 0, "file_len": 0, "n": found.num_rows, "data": sink.getvalue().to_pybytes()}], _PARTS)


def _edges(s: Scanner, data: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, base: np.ndarray, total: np.ndarray, path: pa.Array, most: int, closing: bool) -> Iterator[pa.RecordBatch]:
    bucket = BUCKETS * most
    none = begin > end
    lo = np.concatenate([at[:-1][none], at[:-1][~none], end[~none]])
    hi = np.concatenate([at[1:][none], begin[~none], at[1:][~none]])
    row = np.concatenate([np.flatnonzero(none), np.flatnonzero(~none), np.flatnonzero(~none)])
    kind = np.repeat([WHOLE, HEAD, TAIL], [none.sum(), (~none).sum(), (~none).sum()])
    some = np.flatnonzero((lo < hi) | closing & (kind == HEAD) & (base[row] > 0))
    if not len(some):
        return
    lo, hi, row, kind = lo[some], hi[some], row[some], kind[some]
    start, size = base[row] + lo - at[row], hi - lo
    own = start // bucket
    back = (own > 0) & (kind != TAIL) & (start - own * bucket < most)
    ahead = (kind != HEAD) & (start + size >= (own + 1) * bucket)
    which = np.concatenate([np.arange(len(row)), np.flatnonzero(back), np.flatnonzero(ahead)])
    buckets = np.concatenate([own, own[back] - 1, own[ahead] + 1])
    bytes_ = [data[i:j].tobytes() for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
    kinds = np.concatenate([kind, kind[back], np.full(ahead.sum(), MARK)])
    values = [b"" if k == MARK else bytes_[i] for i, k in zip(which.tolist(), kinds.tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays(
        [
            path.take(pa.array(row[which])), pa.array(np.full(len(which), s.encoding.code, np.int16)), pa.array(buckets), pa.array(kinds.astype(np.int32)), pa.array(start[which]), pa.array(size[which]),
            pa.array(total[row[which]]), pa.array(np.zeros(len(which), np.int64)), pa.array(values, pa.binary()),
        ],
        schema=_PARTS,
    )


def joined(rows: pa.RecordBatch, most: int) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces in order, strung together where they adjoin: code, path, bytes, start and input's length of each string that begins in the rows' own stretch."""
    code, kind, start, size, own = (np.asarray(rows.column(c), np.int64) for c in ("encoding_code", "kind", "start", "size", "bucket"))
    fresh = _begins(_codes(rows.column("path")), code, own, kind, start, size)
    first = np.flatnonzero(fresh)
    data, at = _offsets(rows.column("data"))
    values = _binary(data, np.append(at[first], at[-1]))
    if len(first) and np.diff(np.append(at[first], at[-1])).max() > most:
        raise ValueError("a run spans more than 1 GiB")
    here = (kind[first] != MARK) & (start[first] // (BUCKETS * most) == own[first])
    kept = first[here]
    return code[kept], rows.column("path").take(pa.array(kept)), values.take(pa.array(np.flatnonzero(here))), start[kept], np.asarray(rows.column("file_len"), np.int64)[kept]


def _begins(path, code, own, kind, start, size) -> np.ndarray:
    """Which pieces begin a string: those that nothing adjoins, tails, and what follows a head."""
    fresh = _fresh(path, start, size) | (kind == TAIL)
    fresh[1:] |= (code[1:] != code[:-1]) | (own[1:] != own[:-1]) | (kind[:-1] == HEAD)
    return fresh


def stitched(batches: Iterable[pa.RecordBatch], own: list[Scanner], most: int = MOST) -> Iterator[pa.RecordBatch]:
    """Runs of parts that come sorted by path, encoding, bucket and start. A string that a batch leaves open is held until it ends."""
    held: list[pa.RecordBatch] = []
    by_code = {s.encoding.code: s for s in own}

    def scanned() -> Iterator[pa.RecordBatch]:
        if held:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            code, path, values, start, total = joined(rows, most)
            for c in np.unique(code).tolist():
                mine = np.flatnonzero(code == c)
                yield from run_batches([by_code[c]], values.take(pa.array(mine)), {"path": path.take(pa.array(mine))}, start[mine], total[mine])

    for batch in batches:
        kind = np.asarray(batch.column("kind"))
        for k in np.flatnonzero(kind == RUNS).tolist():
            yield from pa.ipc.open_stream(batch.column("data")[k].as_buffer())
        rows = batch.filter(pa.array(kind != RUNS))
        if not rows.num_rows:
            continue
        rows = rows.set_column(rows.schema.get_field_index("data"), "data", rows.column("data").cast(pa.large_binary()))
        edge = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), rows]).drop_columns("data").combine_chunks() if held else pa.Table.from_batches([rows])
        codes = _codes(edge.column("path").combine_chunks())
        begins = np.flatnonzero(_begins(codes, *(np.asarray(edge.column(c), np.int64) for c in ("encoding_code", "bucket", "kind", "start", "size")))[1 if held else 0 :])
        if held and len(begins):
            last = int(begins[-1])
            held.append(rows.slice(0, last))
            yield from scanned()
            held[:] = [rows.slice(last)]
        elif not held and len(begins) > 1:
            held[:] = [rows.slice(0, int(begins[-1]))]
            yield from scanned()
            held[:] = [rows.slice(int(begins[-1]))]
        else:
            held.append(rows)
    yield from scanned()


def scan_chunks(chunks: DataFrame, encodings_: str | Iterable[str] = encodings.DEFAULT, filters_: str | Iterable[str] = "ascii", min_length: int = 4, most: int = MOST) -> DataFrame:
    """Runs of inputs in chunks (path, chunk_off, bytes, file_len), in any order, equal to those of the whole inputs."""
    wanted = asked(encodings_, filters_, min_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return stitched(batches, scanners(wanted), most)

    keys = ("path", "encoding_code", "bucket")
    met = parts(chunks, wanted, most).repartition(*keys).sortWithinPartitions(*keys, "start")
    return met.mapInArrow(run, OUTPUT_SCHEMA).select(*OUTPUT)
