"""Token ids of a corpus as files of independently decodable blocks.

Documents are dealt to partitions by ranges of doc_id and tokenized in order; consecutive whole
documents make blocks. Ids are coded by a static range asymmetric numeral system under one
frequency table counted over the whole corpus: a block interleaves lanes over one stream of
32-bit words and keeps checkpoints (place in the stream and all states), from each of which
decoding can start, so that its segments decode side by side. Checksums cover each block's
bytes and its ids.

A file is Parquet with a row (part, blk, payload) per block, beside the table of frequencies and
an index of blocks with their first token's number. Rows without doc_id come first; equal
doc_ids stand side by side, ordered by a hash of the text. Null texts count as empty: just the
end id. An empty table gives files without blocks. Only doc_id and text are looked at, whatever other columns are named.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphvein.llm.common import portions, released, shared_folder, stored, table, utf8, word_hashes

#: Tokens of a block (more if its last document is longer), lanes, steps between checkpoints, bits of frequencies.
BLOCK, LANES, SEGMENT, SCALE = 1 << 18, 1024, 128, 20
LOW = np.uint64(1 << 31)
MAGIC = b"GVT1"
_HEAD = struct.Struct("<4sIQIIII")

# ---------------------------------------------------------------- tokenizing

#: Texts are cut into units such that no match of the tokenizer's splitting pattern goes on from one to the next, so
#: that each encodes alone: no match goes on from a character that is no white space to a space or line break, nor
#: between letters and marks (the apostrophe aside, which joins letters). Texts with other white space, or with an added token's string, stay whole.
_OTHER_SPACE = re.compile(r"[^\S \n]")
_BREAK, _LETTER, _MARK = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 10]] = _BREAK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[b for b in range(33, 127) if _KIND[b] == 0 and not 48 <= b <= 57 and b != 39]] = _MARK
#: Second bytes, after 0xC3, of the letters of Latin-1.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def unit_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the units of the texts begin."""
    kind = _KIND[data]
    pair = np.flatnonzero((data[:-1] == 0xC3) & _LATIN[data[1:]])
    kind[pair] = kind[pair + 1] = _LETTER
    cut = np.zeros(len(data), bool)
    before, here = kind[:-1], kind[1:]
    cut[1:] = (here == _BREAK) & (before != _BREAK) | (before == _LETTER) & (here == _MARK) | (before == _MARK) & (here == _LETTER)
    cut[at[:-1][at[:-1] < at[1:]]] = True
    return np.flatnonzero(cut)


#: Units remembered by a worker at most.
REMEMBERED = 2_000_000


class Units:
    """Encodes texts with the tokenizers library, each distinct unit once while it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: Strings that the library takes as one token wherever they stand: texts that hold one stay whole.
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.stays_whole = re.compile("|".join([_OTHER_SPACE.pattern, *map(re.escape, added)]))
        self.joins = not any(re.search(r"\s", t) for t in added)
        vocabulary = self.library.get_vocab()
        #: How many bytes a token stands for: a character of its name each.
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for name, token in vocabulary.items():
            self.bytes_of[token] = len(name)
        self.forget()

    def forget(self) -> None:
        #: Hashes of known units, ascending, with the place of each unit's ids.
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.at, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remembers the ids of new units."""
        end, n = self.at[self.n], self.n + len(sizes)
        while len(self.flat) < end + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.at) <= n:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[end : end + len(ids)] = ids
        self.at[self.n + 1 : n + 1] = end + np.cumsum(sizes)
        self.n = n

    def _learn(self, fresh: list[bytes]) -> np.ndarray:
        """Encodes new units; where their ids are. Those that begin with white space and end without go in strings of many: all cuts between them are safe."""
        places = np.zeros(len(fresh), np.int32)
        inner = np.array([self.joins and u[0] in b" \n" and u[-1] not in b" \n" for u in fresh], bool)
        many, single = np.flatnonzero(inner), np.flatnonzero(~inner)
        for begin in range(0, len(many), 4096):
            part = many[begin : begin + 4096]
            own = [fresh[i] for i in part]
            ids = np.asarray(self.library.encode_batch_fast([b"".join(own).decode()], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(u) for u in own])) + 1
            places[part] = np.arange(self.n, self.n + len(part))
            self._append(ids, np.diff(np.concatenate([[0], cuts])))
        if len(single):
            places[single] = np.arange(self.n, self.n + len(single))
            self._append(*self._each([fresh[i].decode() for i in single]))
        return places

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        new = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.asarray(x, np.int32) for x in new]), np.array([len(x) for x in new], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        if self.n > REMEMBERED:
            self.forget()
        data, bounds = utf8(texts)
        n = len(bounds) - 1
        whole = [k for k, t in enumerate(texts.to_pylist()) if t and self.stays_whole.search(t)]
        starts = unit_starts(data, bounds)
        if whole:
            row = np.searchsorted(bounds, starts, "right") - 1
            starts = starts[~np.isin(row, whole) | np.isin(starts, bounds[whole])]
        ends = np.append(starts[1:], len(data))[: len(starts)]
        own, place, which = np.unique(word_hashes(data, starts, ends, 5), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, own)
        known = spot < len(self.keys)
        known[known] = self.keys[spot[known]] == own[known]
        places = np.zeros(len(own), np.int32)
        places[known] = self.places[spot[known]]
        fresh = np.flatnonzero(~known)
        is_whole = np.isin(starts, bounds[whole]) if whole else np.zeros(len(starts), bool)
        fresh = fresh[~is_whole[place[fresh]]]
        if len(fresh):
            raw = data.tobytes()
            places[fresh] = self._learn([raw[i:j] for i, j in zip(starts[place[fresh]].tolist(), ends[place[fresh]].tolist(), strict=True)])
            self.places = np.insert(self.places, spot[fresh], places[fresh])
            self.keys = np.insert(self.keys, spot[fresh], own[fresh])
        which = places[which]
        flat, begin, size = self.flat, self.at[which], self.at[which + 1] - self.at[which]
        if whole:
            ids, sizes = self._each([texts[k].as_py() for k in whole])
            begin[is_whole], size[is_whole] = len(flat) + np.cumsum(sizes) - sizes, sizes
            flat = np.concatenate([flat, ids])
        upto = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(begin - upto[:-1], size)
        at += np.arange(upto[-1])
        return flat[at].astype(np.int64), np.diff(upto[np.searchsorted(starts, bounds)]) if n else np.zeros(0, np.int64)


@functools.lru_cache(maxsize=2)
def _units(path: str) -> Units:
    return Units(path)


def _packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes() if len(ids) and ids.max() > 0xFFFF else b"\x00" + ids.astype("<u2").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return (np.frombuffer(raw, "<u2", offset=1) if len(raw) % 2 else np.frombuffer(raw, "<u4")).astype(np.int64)


def token_blocks(docs: DataFrame, tokenizer_path: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """part, blk, n_tokens, doc_ids, sizes, ids: runs of whole documents in ascending doc_id."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows of one doc_id, or without, are dealt to ranges by their texts, and equal ones by their numbers: no key has to be in one task
    ordered = ordered.withColumn("hash", F.xxhash64("text")).withColumn("number", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange("doc_id", "hash", "number").sortWithinPartitions("doc_id", "hash", "number").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, part, blk = _units(tokenizer_path), TaskContext.get().partitionId(), 0
        held_docs, held_sizes, held_ids, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([blk], pa.int32()), pa.array([held], pa.int64()), pa.array([held_docs], pa.list_(pa.int64())), pa.array([held_sizes], pa.list_(pa.int64())), pa.array([_packed(np.concatenate(held_ids))], pa.binary())],
                ["part", "blk", "n_tokens", "doc_ids", "sizes", "ids"],
            )

        for batch in portions(batches, "text", 2 << 20):
            ids, counts = units.encode(batch.column("text"))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            sizes = counts + 1
            ends = np.cumsum(sizes)
            begin = 0
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                held_docs.append(doc)
                held_sizes.append(int(sizes[k]))
                held += int(sizes[k])
                if held >= block:
                    held_ids.append(ids[begin : ends[k]])
                    begin = int(ends[k])
                    yield out()
                    held_docs, held_sizes, held_ids, held, blk = [], [], [], 0, blk + 1
            held_ids.append(ids[begin:])
        if held_docs:
            yield out()

    return ordered.mapInArrow(run, "part int, blk int, n_tokens long, doc_ids array<long>, sizes array<long>, ids binary")


# ---------------------------------------------------------------- coding


@dataclass
class Frequencies:
    """Shares of 2**SCALE for the tokens that occur, in ascending order of token."""

    tokens: np.ndarray
    share: np.ndarray

    @staticmethod
    def of(tokens: np.ndarray, counts: np.ndarray) -> Frequencies:
        order = np.argsort(tokens)
        tokens, counts = np.asarray(tokens, np.int64)[order], np.asarray(counts, np.float64)[order]
        if not len(tokens):
            return Frequencies(tokens, np.zeros(0, np.int64))
        whole = 1 << SCALE
        share = np.maximum(1, np.floor(counts / counts.sum() * (whole - len(tokens)))).astype(np.int64)
        share[np.argmax(share)] += whole - share.sum()
        return Frequencies(tokens, share)

    def __post_init__(self):
        self.start = np.cumsum(self.share) - self.share
        self.places = None
        size = int(self.tokens.max(initial=-1)) + 1
        self.share_of, self.start_of = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.share_of[self.tokens], self.start_of[self.tokens] = self.share, self.start

    def lookup(self) -> np.ndarray:
        if self.places is None:
            self.places = np.repeat(np.arange(len(self.share), dtype=np.int32), self.share)
        return self.places


def encode_block(ids: np.ndarray, frequencies: Frequencies) -> bytes:
    """Lanes' tokens are ids[lane], ids[lane + LANES], ...; the last step may leave lanes out."""
    share, start = frequencies.share_of[ids], frequencies.start_of[ids]
    steps = -(-len(ids) // LANES)
    states = np.full(LANES, LOW)
    words, marks, written = [], [], 0
    limit = np.uint64(((1 << 31) >> SCALE) << 32)
    for step in range(steps - 1, -1, -1):
        part = slice(step * LANES, min(len(ids), (step + 1) * LANES))
        f, s, x = share[part], start[part], states[: part.stop - part.start]
        full = x >= limit * f
        out = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
        x = np.where(full, x >> np.uint64(32), x)
        words.append(out)
        written += len(out)
        q = x // f
        states[: len(f)] = (q << np.uint64(SCALE)) + (x - q * f) + s
        if step % SEGMENT == 0:
            marks.append((written, states.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    marks.reverse()
    places = np.array([written - w for w, _ in marks], "<u4")
    held = np.stack([s for _, s in marks]).astype("<u8") if marks else np.zeros((0, LANES), "<u8")
    body = places.tobytes() + held.tobytes() + stream.tobytes()
    return _HEAD.pack(MAGIC, LANES, len(ids), len(marks), len(stream), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode_block(payload: bytes, frequencies: Frequencies) -> np.ndarray:
    """The ids of a block; all segments between checkpoints are decoded side by side."""
    magic, lanes, n, n_marks, n_words, ids_crc, body_crc = _HEAD.unpack_from(payload)
    body = payload[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != body_crc:
        raise ValueError("a block of token ids is damaged")
    at = 4 * n_marks
    places = np.frombuffer(body, "<u4", n_marks).astype(np.int64)
    states = np.frombuffer(body, "<u8", n_marks * lanes, at).reshape(n_marks, lanes).astype(np.uint64)
    stream = np.frombuffer(body, "<u4", n_words, at + 8 * n_marks * lanes)
    stream = np.append(stream, np.zeros(1, "<u4")).astype(np.uint64)
    lookup, share, start = frequencies.lookup(), frequencies.share.astype(np.uint64), frequencies.start.astype(np.uint64)
    found = np.zeros((n_marks, SEGMENT, lanes), np.int32)
    last = np.full((n_marks, 1), SEGMENT * lanes)
    if n_marks:
        last[-1] = n - (n_marks - 1) * SEGMENT * lanes
    lane = np.arange(lanes)[None]
    for step in range(min(SEGMENT, -(-n // lanes))):
        live = step * lanes + lane < last
        slot = states & np.uint64((1 << SCALE) - 1)
        symbol = lookup[slot.astype(np.int64)]
        found[:, step] = symbol
        x = share[symbol] * (states >> np.uint64(SCALE)) + slot - start[symbol]
        need = (x < LOW) & live
        rank = np.cumsum(need, 1)
        word = stream[np.minimum(places[:, None] + rank - 1, n_words)]
        x = np.where(need, x << np.uint64(32) | word, x)
        states = np.where(live, x, states)
        places = places + rank[:, -1]
    ids = frequencies.tokens[found.reshape(-1)[:n]] if n else np.zeros(0, np.int64)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("a block of token ids decodes to other ids")
    return ids


# ---------------------------------------------------------------- files


def counted(blocks: DataFrame) -> DataFrame:
    """token, n over all blocks: as many rows as tokens occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("ids"):
                own = np.bincount(_unpacked(raw.as_py()))
                if len(own) > len(total):
                    own[: len(total)] += total
                    total = own
                else:
                    total[: len(own)] += own
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["token", "n"])

    return blocks.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def block_index(blocks: DataFrame) -> DataFrame:
    """part, blk, n_tokens, start: how many tokens all blocks before hold. Prefix sums by part, then over parts."""
    size = blocks.select("part", "blk", "n_tokens")
    parts = size.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = parts.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    own = size.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return own.join(parts, "part").select("part", "blk", "n_tokens", (F.col("ahead") + F.col("inside")).alias("start"))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, block: int = BLOCK) -> None:
    """Writes path/blocks, path/frequencies and path/index."""
    spark = docs.sparkSession
    blocks = stored(token_blocks(docs, tokenizer_path, end_id, block), "token-blocks")
    counted(blocks).coalesce(1).write.parquet(f"{path}/frequencies")
    block_index(blocks).write.parquet(f"{path}/index")
    frequencies = _frequencies(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                coded = encode_block(_unpacked(batch.column("ids")[k].as_py()), frequencies)
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([row.column("part"), row.column("blk"), row.column("doc_ids"), row.column("sizes"), pa.array([coded], pa.binary())], ["part", "blk", "doc_ids", "sizes", "payload"])

    coded = blocks.select("part", "blk", "doc_ids", "sizes", "ids").mapInArrow(run, "part int, blk int, doc_ids array<long>, sizes array<long>, payload binary")
    coded.write.parquet(f"{path}/blocks")
    released(blocks)


def _frequencies(spark: SparkSession, path: str) -> Frequencies:
    rows = spark.read.schema("token long, n long").parquet(f"{path}/frequencies").collect()  # no more than the vocabulary
    return Frequencies.of(np.array([r.token for r in rows], np.int64), np.array([r.n for r in rows]))


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (array) of each document, or ids_crc32 in their stead."""
    frequencies = _frequencies(spark, path)
    kind = pa.int64() if digest else pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = decode_block(batch.column("payload")[k].as_py(), frequencies)
                sizes = np.array(batch.column("sizes")[k].as_py(), np.int64)
                ends = np.cumsum(sizes)
                own = [ids[e - s : e] for s, e in zip(sizes, ends, strict=True)]
                values = [zlib.crc32(x.astype("<u4").tobytes()) for x in own] if digest else [x.astype(np.int32) for x in own]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("part")[k].as_py()] * n, pa.int32()), pa.array([batch.column("blk")[k].as_py()] * n, pa.int32()), pa.array(batch.column("doc_ids")[k].as_py(), pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(values, kind)],
                    ["part", "blk", "doc_id", "inside", "n_tokens", "ids"],
                )

    blocks = spark.read.schema("part int, blk int, doc_ids array<long>, sizes array<long>, payload binary").parquet(f"{path}/blocks")
    docs = blocks.mapInArrow(run, f"part int, blk int, doc_id long, inside long, n_tokens long, ids {'long' if digest else 'array<int>'}")
    index = spark.read.schema("part int, blk int, n_tokens long, start long").parquet(f"{path}/index").drop("n_tokens")
    rows = docs.join(index, ["part", "blk"])
    return rows.select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", F.col("ids").alias("ids_crc32" if digest else "ids"))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_tokens(spark, path, digest=True)
