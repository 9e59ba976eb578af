"""BPE encoding and decoding by the tokenizers library, with chunks that texts share encoded once.

A text is cut where a rolling hash of its last WINDOW bytes says so: passages that texts share are cut alike. A
distinct chunk is encoded once while a worker remembers it, whatever text it comes from. A chunk alone need not be encoded as
within its text: only what lies between its first and its last safe place is, a safe place being one that no match of the
tokenizer's splitting pattern runs across, and that its encoding has a token boundary at. Each join of chunks is
repaired by encoding anew what lies between the safe places around it; while a chunk has none that agrees, the stretch goes on into the
next. So ids equal those of the whole text. Joins, too, are encoded once each while remembered. What is new goes to the
library by way of the token file's store of short units.

Tokenizers may have added tokens, whose strings become one token wherever they stand, as in the library; texts that hold one
that takes white space with it are encoded whole. Byte-level tokenizers without normalizer are taken, others are an error.

encode_texts() appends `ids` (array of int) and decode_ids() appends `decoded`. Null texts count as empty and give no
ids; null id lists decode to empty texts; repeated rows give equal results; columns whose names clash with new ones are
replaced; an empty table gives an empty result. Very long texts are cut like others; one that is never cut is one chunk.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphvein.llm.common import mixed, portions, table, utf8
from glyphvein.llm.tokenfile import Units

#: Bytes of the rolling hash (a power of two, 32 at most), and of a chunk on average.
WINDOW, CHUNK = 32, 256
#: Bytes of chunks and joins that a worker remembers: what was met last, up to twice so many.
REMEMBERED = 24 << 20
#: Bytes of texts worked off together.
BATCH = 4 << 20

#: No match of the splitting pattern goes on from a character that is no white space to ASCII white space. Of such characters
#: those that bytes show are taken: visible ASCII, and characters of two bytes that begin with C3 to DF.
_SPACE, _VISIBLE, _LEAD = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]], _VISIBLE[0x21:0x7F], _LEAD[0xC3:0xE0] = True, True, True
_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def cuts(data: np.ndarray, at: np.ndarray, average: int = CHUNK) -> np.ndarray:
    """Where the chunks of the texts (bounds at) begin: text starts, and characters after a window whose hash has its upper bits 0."""
    if not len(data):
        return np.zeros(0, np.int64)
    h, span = _GEAR[data], 1
    while span < WINDOW:  # a sum over twice as many bytes from sums over so many
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    spot = np.flatnonzero(h < np.uint32((1 << 32) // average)) + 1
    bounds = np.append(at, len(data))
    begin = bounds[np.searchsorted(bounds, spot, "right") - 1]
    spot = spot[(spot - begin >= WINDOW) & (spot < len(data))]  # the whole window is the text's own
    for _ in range(3):  # on to the next character
        inside = data[np.minimum(spot, len(data) - 1)] & 0xC0 == 0x80
        spot = spot + inside
    spot = spot[spot < len(data)]
    return np.unique(np.concatenate([at[:-1][at[:-1] < at[1:]], spot]))


class Memory:
    """Values by key. Beyond REMEMBERED bytes of keys those not met for longest go, about half of all at a time."""

    def __init__(self, most: int = REMEMBERED):
        self.young: dict = {}
        self.old: dict = {}
        self.most, self.size = most, 0

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[key] = value
        self.size += len(key)


def safe_places(data: np.ndarray) -> np.ndarray:
    """Where bytes begin that no match runs across from those before."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    before = _VISIBLE[data[:-1]]
    before[1:] |= (data[1:-1] >= 0x80) & _LEAD[data[:-2]]
    return np.flatnonzero(_SPACE[data[1:]] & before) + 1


class Chunk(NamedTuple):
    """A chunk's bytes, ids, and its safe places: how many ids come before the first (-1: there is none) and the last, and the bytes before and after them."""

    raw: bytes
    ids: np.ndarray
    first: int
    last: int
    head: bytes
    tail: bytes


class Encoder:
    """Encodes texts as the tokenizers library does, by chunks. encoded: how many chunks and joins were encoded, and their characters."""

    def __init__(self, path: str, average: int = CHUNK, most: int = REMEMBERED):
        self.units = Units(path)
        self.library = self.units.library
        self.library.no_truncation()
        self.library.no_padding()
        said = json.loads(self.library.to_str())
        if said["normalizer"] is not None or (said["pre_tokenizer"] or {}).get("type") != "ByteLevel" or said["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("chunks need a byte-level tokenizer without normalizer and prefix space")
        added = self.library.get_added_tokens_decoder()
        spread = [re.escape(t.content) for t in added.values() if t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content)]
        self.stays_whole = re.compile("|".join(spread)) if spread else None
        vocabulary = self.library.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for name, token in vocabulary.items():
            self.sizes[token] = len(added[token].content.encode()) if token in added else len(name)
        self.average, self.chunks, self.joins = average, Memory(most), Memory(most // 4)
        self.encoded, self.encoded_bytes = 0, 0

    def _each(self, texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Ids of all texts, and where those of each begin and the last end."""
        self.encoded += len(texts)
        self.encoded_bytes += sum(map(len, texts))
        ids, counts = self.units.encode(pa.array(texts, pa.string()))
        return ids.astype(np.uint32), [0, *np.cumsum(counts).tolist()]

    def _chunks(self, fresh: list[bytes]) -> Iterator[Chunk]:
        """Chunks that are new, encoded alone. A safe place counts where its encoding agrees: a token begins there."""
        ids, at = self._each(fresh)
        data, upto = np.frombuffer(b"".join(fresh), np.uint8), np.concatenate([[0], np.cumsum(self.sizes[ids])])
        begin = np.concatenate([[0], np.cumsum([len(f) for f in fresh])])
        safe = safe_places(data)
        safe = safe[upto[np.searchsorted(upto, safe)] == safe]
        i, j = np.searchsorted(safe, begin[:-1], "right"), np.searchsorted(safe, begin[1:]) - 1
        some = (i <= j).tolist()
        places = [safe[np.clip(k, 0, max(len(safe) - 1, 0))] if len(safe) else begin[:-1] for k in (i, j)]
        tokens = [(np.searchsorted(upto, p) - at[:-1]).tolist() for p in places]
        first, last = ((p - begin[:-1]).tolist() for p in places)
        for k, raw in enumerate(fresh):
            own = ids[at[k] : at[k + 1]].copy()
            yield Chunk(raw, own, tokens[0][k], tokens[1][k], raw[: first[k]], raw[last[k] :]) if some[k] else Chunk(raw, own, -1, -1, b"", b"")

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        data, at = utf8(texts)
        begin = cuts(data, at, self.average)
        if self.stays_whole:
            whole = np.array([k for k, t in enumerate(texts.to_pylist()) if t and self.stays_whole.search(t)], np.int64)
            own = np.searchsorted(at, begin, "right") - 1
            begin = begin[~np.isin(own, whole) | np.isin(begin, at[whole])]
        raw, ends = data.tobytes(), np.append(begin[1:], len(data))[: len(begin)].tolist()
        keys = [raw[i:j] for i, j in zip(begin.tolist(), ends, strict=True)]
        found, fresh = {}, []
        for key in keys:
            if key not in found:
                found[key] = known = self.chunks.get(key)
                if known is None:
                    fresh.append(key)
        for chunk in self._chunks(fresh) if fresh else ():
            found[chunk.raw] = chunk
            self.chunks.put(chunk.raw, chunk)
        bounds = np.searchsorted(begin, at).tolist()
        parts: list[list] = [self._parts([found[k] for k in keys[i:j]]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        repaired = self._repaired({p for own in parts for p in own if isinstance(p, bytes)})
        return [np.concatenate([repaired[p] if isinstance(p, bytes) else p for p in own]) if own else np.zeros(0, np.uint32) for own in parts]

    @staticmethod
    def _parts(chunks: list[Chunk]) -> list:
        """What makes the ids of a text: ids of chunks between their safe places, and stretches to be encoded anew."""
        out: list = []
        held, start = b"", True  # the stretch that is open, and whether it is the text's beginning
        for k, c in enumerate(chunks):
            final = k == len(chunks) - 1
            if c.first < 0:
                if final and not held:
                    out.append(c.ids)
                else:
                    held += c.raw
                    if final:
                        out.append(held)
                continue
            if start and not held:
                out.append(c.ids if final else c.ids[: c.last])
            else:
                out += [held + c.head, c.ids[c.first :] if final else c.ids[c.first : c.last]]
            held, start = c.tail, False
        return out

    def _repaired(self, stretches: set[bytes]) -> dict[bytes, np.ndarray]:
        known = {s: self.joins.get(s) for s in stretches}
        fresh = [s for s, ids in known.items() if ids is None]
        if fresh:
            ids, at = self._each(fresh)
            for k, s in enumerate(fresh):
                known[s] = ids[at[k] : at[k + 1]].copy()
                self.joins.put(s, known[s])
        return known

    @functools.cached_property
    def token_bytes(self) -> list[bytes]:
        """The bytes of each token: of added ones their strings, of others a byte for each character of their names."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        out = [b""] * len(self.sizes)
        for name, token in self.library.get_vocab().items():
            out[token] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, as UTF-8; ids that are no token are left out, bytes that are no character replaced."""
        known = self.token_bytes
        raw = b"".join([known[i] for i in ids.tolist() if 0 <= i < len(known)])
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


@functools.lru_cache(maxsize=2)
def encoder(path: str, average: int = CHUNK) -> Encoder:
    """The worker's own, which lives from task to task."""
    return Encoder(path, average)


def encode_texts(df: DataFrame, tokenizer_path: str, column: str = "text", into: str = "ids") -> DataFrame:
    """df with the token ids of each whole text."""
    df = df.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, column, BATCH):
            ids = encoder(tokenizer_path).encode(batch.column(column))
            at = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=at[1:])
            flat = np.concatenate(ids) if ids else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(np.int32)))], [*batch.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def decode_ids(df: DataFrame, tokenizer_path: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the text that each list of ids stands for, special tokens included."""
    df = df.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [encoder(tokenizer_path).decode(np.array(x or [], np.int64)).decode() for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.StringType())]))


def digests(df: DataFrame, tokenizer_path: str, column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 of each row.

    Encodes and decodes each text in one pass, so that no list of ids leaves the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, column, BATCH):
            own = encoder(tokenizer_path)
            ids = own.encode(batch.column(column))
            said = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
            back = [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias(column)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
