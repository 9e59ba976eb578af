"""Byte-level BPE encoding and decoding of whole texts with the tiktoken library.

encode_texts() appends `ids` (array of int) and decode_ids() appends `decoded` (binary).
Null texts count as empty and give no ids; null id lists decode to no bytes; repeated rows
give equal results; an empty table gives an empty result; columns whose names clash with new ones are replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphvein.llm.common import portions, table

#: Texts above so many characters are encoded in pieces of about that length.
LONG_TEXT = 1 << 16

#: No match of the splitting pattern goes on from a character that is no white space to one that is,
#: so a text may be cut there. ASCII white space after a character that no library takes for space.
_BOUNDARY = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \t\n\r])")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = LONG_TEXT) -> Iterator[str]:
    """text in parts, each cut at the first safe boundary after `most` characters."""
    begin = 0
    while len(text) - begin > most:
        cut = _BOUNDARY.search(text, begin + most)
        if not cut:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:] if begin else text


def encoded(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    if len(text) <= LONG_TEXT:
        return np.asarray(enc.encode_ordinary(text), np.uint32)
    return np.concatenate([np.asarray(enc.encode_ordinary(part), np.uint32) for part in pieces(text)])


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode_texts(df: DataFrame, rank_file: str, pattern: str, column: str = "text", into: str = "ids") -> DataFrame:
    """df with the token ids of each whole text."""
    df = df.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in portions(batches, column):
            ids = [encoded(enc, t or "") for t in batch.column(column).to_pylist()]
            at = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=at[1:])
            yield _with(batch, into, pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids).astype(np.int32))))

    return df.mapInArrow(run, _schema(df, into, T.ArrayType(T.IntegerType())))


def decode_ids(df: DataFrame, rank_file: str, pattern: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the raw bytes that each list of ids stands for."""
    df = df.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            yield _with(batch, into, pa.array([enc.decode_bytes(x or []) for x in batch.column(column).to_pylist()], pa.binary()))

    return df.mapInArrow(run, _schema(df, into, T.BinaryType()))


def digests(df: DataFrame, rank_file: str, pattern: str, column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256.

    Encodes and decodes each text in one pass, so that no list of ids leaves the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in portions(batches, column):
            counts, hashes, back = [], [], []
            for text in batch.column(column).to_pylist():
                ids = encoded(enc, text or "")
                counts.append(len(ids))
                hashes.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(enc.decode_bytes(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(back)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(F.col("doc_id").cast("long"), F.col(column)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
