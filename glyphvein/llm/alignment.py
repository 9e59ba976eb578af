"""Alignment of two tokenizers over a corpus, and how often each pair of their tokens is linked.

Both tokenizers encode the same bytes (a space and the text); places where tokens of both end cut them into groups, and
each two tokens whose byte ranges overlap are a link. The ids are stored once, packed, with the pairs that a task meets
for the first time. The distinct pairs, by shards of a hash, get a minimal perfect hash (bit levels: a key that is alone
at its bit is placed, the others go one level on), so that counts are a dense vector: tasks count links into a vector each, and
vectors are summed as a tree. A second pass aligns the stored ids again and looks up each link's count. The key that an index
belongs to is kept beside it and compared at every look-up.

A round takes shards of at most MOST_PAIRS pairs, which bounds what is broadcast and held; corpora with more distinct pairs
take several rounds, whose sums add up. The highest count of a B id is kept for each id of its vocabulary.

Null and empty texts, and texts that either tokenizer does not give back byte by byte (U+2581 is a space to the second),
have no tokens: zeros and an empty string. Strings of special tokens are plain text. Very long texts are one row of work;
repeated rows each count; an empty table gives an empty result. Only doc_id and text are looked at, whatever else there is.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphvein.llm.common import mixed, portions, released, stored, table, utf8
from glyphvein.llm.tokenfile import _OTHER_SPACE, Units

#: Bytes of text aligned together, and units of text that a worker remembers at most.
BATCH, REMEMBERED = 1 << 20, 1_000_000
#: Distinct pairs of a shard on average, and of a round at most (one shard at least).
SHARD, MOST_PAIRS = 1 << 17, 1 << 22
#: Bits for each key that is left, at each level; levels at most.
GAMMA, LEVELS = 2, 64
#: Counts in a row of a vector, and rows that one task adds up.
STRETCH, FAN_IN = 1 << 16, 64
#: New pairs that a task remembers before it starts afresh.
SEEN = 1 << 21
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

# ---------------------------------------------------------------- tokenizers


def _flat(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the values, where each begins, and its size."""
    size = np.array([len(v) for v in values], np.int64)
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(size) - size, size


class Merged(Units):
    """A: byte-level BPE of the tokenizers library, special tokens' strings being plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        self.stays_whole, self.joins = _OTHER_SPACE, True
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        names = [b""] * len(self.bytes_of)
        for name, token in self.library.get_vocab().items():
            names[token] = bytes(byte[c] for c in name if c in byte)
        self.spelled = _flat(names)


class Pieces:
    """B: sentencepiece BPE with byte fallback, which puts a space before the text. Texts come with that space.

    No piece has a space after another character, so a text may be cut before each space that follows one: each
    distinct unit is encoded once while it is remembered. With other models a text is one unit.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.spelled = _flat([bytes([int(n[1:-1], 16)]) if self.library.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])
        self.cut = not any("▁" in n.lstrip("▁") for n in names)
        self.space = np.array([self.library.piece_to_id("▁")], "<i4").tobytes()
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        data, at = utf8(texts)
        begins = np.zeros(len(data), bool)
        begins[at[:-1][at[:-1] < at[1:]]] = True
        if self.cut:
            begins[1:] |= (data[1:] == 32) & (data[:-1] != 32)
        begin = np.flatnonzero(begins)
        raw = data.tobytes()
        units = [raw[i:j] for i, j in zip(begin.tolist(), np.append(begin[1:], len(data))[: len(begin)].tolist(), strict=True)]
        fresh = [u for u in dict.fromkeys(units) if u not in self.known]
        if fresh:
            for unit, ids in zip(fresh, self.library.encode([u[1:].decode() for u in fresh], num_threads=1), strict=True):
                self.known[unit] = np.array(ids, "<i4").tobytes() if len(unit) > 1 else self.space
        found = [self.known[u] for u in units]
        size = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int64)
        return np.frombuffer(b"".join(found), "<i4").astype(np.int64), np.diff(size[np.searchsorted(begin, at)])


@functools.lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> tuple[Merged, Pieces]:
    """The worker's own."""
    return Merged(path_a), Pieces(path_b)


def spell(ids: np.ndarray, spelled: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The bytes of ids, joined."""
    data, begin, size = spelled
    n = size[ids]
    upto = np.cumsum(n)
    return data[np.repeat(begin[ids] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of stretches of so many values each."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return upto[ends] - upto[ends - counts]


def both(texts: pa.Array, a: Merged, b: Pieces) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of each text by both tokenizers; none where they do not give it back."""
    empty = np.zeros(0, np.int64)
    out_a, out_b = [empty] * len(texts), [empty] * len(texts)
    rows = np.flatnonzero(np.asarray(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)))
    if not len(rows):
        return out_a, out_b
    spaced = pc.binary_join_element_wise(pa.scalar(" "), texts.take(pa.array(rows)).cast(pa.string()), pa.scalar(""))
    data, at = utf8(spaced)
    sides = []
    good = np.ones(len(rows), bool)
    for own in (a, b):
        ids, counts = own.encode(spaced)
        ids = ids.astype(np.int64)
        good &= _sums(own.spelled[2][ids], counts) == np.diff(at)
        sides.append((own, ids, np.cumsum(counts) - counts, counts))
    for own, ids, begin, counts in sides:
        kept = np.flatnonzero(good)
        said = spell(ids[np.repeat(good, counts)], own.spelled)
        there = data[np.repeat(good, np.diff(at))]
        wrong = np.unique(np.repeat(kept, np.diff(at)[kept])[said != there])
        good[wrong] = False
    for out, (_, ids, begin, counts) in zip((out_a, out_b), sides, strict=True):
        for k in np.flatnonzero(good):
            out[rows[k]] = ids[begin[k] : begin[k] + counts[k]]
    return out_a, out_b


def _packed(ids: np.ndarray) -> bytes:
    """Ids as planes of bytes, compressed; with their number before them."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(ids).to_bytes(4, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(ids) else b"")


def _unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(raw[4:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


# ---------------------------------------------------------------- alignment


@dataclass
class Aligned:
    """Texts one after another: links (places in a and b), and of each text how many links and groups it has; ends: where each token ends; common: which tokens end a group."""

    a: np.ndarray
    b: np.ndarray
    links: np.ndarray
    groups: np.ndarray
    ends: tuple[np.ndarray, np.ndarray]
    common: tuple[np.ndarray, np.ndarray]


def aligned(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    """a, b: ids of all texts; n_a: how many of a each text has."""
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    every = np.concatenate([end_a, end_b])
    every.sort(kind="stable")
    twice = every[1:] == every[:-1]
    place = every[np.concatenate([[True], ~twice])] if len(every) else every  # each stretch between ends is one link
    common = every[1:][twice]
    text_ends = np.concatenate([[0], end_a])[np.cumsum(n_a)]
    count = lambda ends: np.diff(np.concatenate([[0], np.searchsorted(ends, text_ends, "right")]))
    at_a, at_b = np.searchsorted(end_a, place), np.searchsorted(end_b, place)
    ends_group = lambda end: np.isin(end, common, assume_unique=True) if len(common) else np.zeros(len(end), bool)
    return Aligned(at_a, at_b, count(place), count(common), (end_a, end_b), (ends_group(end_a), ends_group(end_b)))


@functools.lru_cache(maxsize=4)
def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of each number below size, with room for a separator, and how many it has."""
    width = len(str(max(size - 1, 0)))
    shown = np.zeros((size, width + 1), np.uint8)
    n = np.array([len(str(k)) for k in range(size)], np.int64)
    for k in range(size):
        shown[k, : n[k]] = np.frombuffer(str(k).encode(), np.uint8)
    return shown, n


def group_texts(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, common: tuple[np.ndarray, np.ndarray], size: int) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each text. size: above every id."""
    ends_a, ends_b = common
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    of_a, of_b = np.bincount(group_a, minlength=1), np.bincount(group_b, minlength=1)
    place_a = np.arange(len(a)) + (np.cumsum(of_b) - of_b)[group_a]  # after the b of all groups before
    place_b = np.arange(len(b)) + np.cumsum(of_a)[group_b]
    token, mark = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.uint8)
    token[place_a], token[place_b] = a, b
    mark[place_a], mark[place_b] = np.where(ends_a, ord("|"), ord(",")), np.where(ends_b, ord(";"), ord(","))
    shown, digits = _digits(size)
    cells, n = shown[token], digits[token]
    cells[np.arange(len(token)), n] = mark
    said = cells[np.arange(cells.shape[1]) <= n[:, None]].tobytes()
    upto = np.concatenate([[0], np.cumsum(n + 1)])
    stop = np.cumsum(n_a + n_b)
    return [said[i : j - 1] if j > i else b"" for i, j in zip(upto[stop - n_a - n_b].tolist(), upto[stop].tolist(), strict=True)]


# ---------------------------------------------------------------- minimal perfect hash

_ODD = mixed(np.arange(1, LEVELS + 1, dtype=np.uint64)) | np.uint64(1)


def _hash(keys: np.ndarray) -> np.ndarray:
    return mixed(keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % shards


def _place(h: np.ndarray, level: int, size) -> np.ndarray:
    """A place below size (up to 2**32) for each hash, another at each level."""
    return ((h * _ODD[level] >> np.uint64(32)) * np.asarray(size, np.uint64) >> np.uint64(32)).astype(np.int64)


def levels_of(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes in bits of the levels, all their bits as 64-bit words, and the keys in the order of their indexes."""
    left, sizes, words, ordered = keys, [], [], []
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("keys are not distinct")
        size = -(-GAMMA * len(left) // 64) * 64
        place = _place(_hash(left), len(sizes), size)
        alone = np.bincount(place, minlength=size)[place] == 1
        bits = np.zeros(size, bool)
        bits[place[alone]] = True
        ordered.append(left[alone][np.argsort(place[alone])])
        words.append(np.packbits(bits, bitorder="little").view("<u8"))
        sizes.append(size)
        left = left[~alone]
    return sizes, np.concatenate(words) if words else np.zeros(0, "<u8"), np.concatenate(ordered) if ordered else keys


@dataclass
class Perfect:
    """The hash of a round. shard: where in it a shard stands, -1 for those of other rounds; size, first: bits of each level of each shard and where they begin; before: bits set before each word; keys: by index."""

    shards: int
    shard: np.ndarray
    size: np.ndarray
    first: np.ndarray
    words: np.ndarray
    before: np.ndarray
    keys: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, list[int], np.ndarray, np.ndarray]], shards: int) -> Perfect:
        """rows: shard, sizes of its levels, words, keys."""
        shard, n = np.full(shards, -1, np.int64), max((len(r[1]) for r in rows), default=0)
        size, first, at = np.zeros((len(rows), n), np.int64), np.zeros((len(rows), n), np.int64), 0
        for k, (own, sizes, words, _) in enumerate(rows):
            shard[own] = k
            size[k, : len(sizes)] = sizes
            first[k, : len(sizes)] = at + np.cumsum(sizes) - sizes
            at += 64 * len(words)
        words = np.concatenate([np.zeros(0, np.uint64), *(r[2].astype(np.uint64) for r in rows)])
        set_ = np.bitwise_count(words).astype(np.int64)
        return Perfect(shards, shard, size, first, words, np.cumsum(set_) - set_, np.concatenate([np.zeros(0, np.int64), *(r[3] for r in rows)]))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, verified; -1 for keys of other rounds. A key that no round has is an error where its shard is here."""
        h = _hash(keys)
        own = self.shard[shard_of(h, self.shards)]
        out, live = np.full(len(keys), -1, np.int64), np.flatnonzero(own >= 0)
        for level in range(self.size.shape[1]):
            if not len(live):
                break
            size = self.size[own[live], level]
            place = self.first[own[live], level] + _place(h[live], level, size)
            word, bit = self.words[np.minimum(place >> 6, len(self.words) - 1)], (place & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1) != 0) & (size > 0)
            low = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[live[hit]] = self.before[place[hit] >> 6] + np.bitwise_count(low)
            live = live[~hit]
        mine = np.flatnonzero(own >= 0)
        if len(live) or (self.keys[out[mine]] != keys[mine]).any():
            raise ValueError("a pair of tokens is not among those counted")
        return out


# ---------------------------------------------------------------- jobs


def tokenized(df: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """row, doc_id, a, b (packed ids), fresh: pairs (a * size of b's vocabulary + b) that no earlier row of the task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers(path_a, path_b)
        seen, row = np.zeros(0, np.int64), TaskContext.get().partitionId() << 33
        for batch in portions(batches, "text", BATCH):
            ids_a, ids_b = both(batch.column("text"), a, b)
            flat_a, flat_b = np.concatenate(ids_a), np.concatenate(ids_b)
            links = aligned(flat_a, flat_b, np.array([len(x) for x in ids_a]), a.spelled[2], b.spelled[2])
            pairs = np.unique(flat_a[links.a] * len(b.spelled[2]) + flat_b[links.b])
            spot = np.minimum(np.searchsorted(seen, pairs), max(len(seen) - 1, 0))
            pairs = pairs[seen[spot] != pairs] if len(seen) else pairs
            seen = np.sort(np.concatenate([seen, pairs]), kind="stable") if len(seen) < SEEN else pairs
            n = batch.num_rows
            at = np.concatenate([[0], np.full(n, len(pairs))]).astype(np.int32)  # with the first row of the batch
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column("doc_id"), pa.array([_packed(x) for x in ids_a], pa.binary()), pa.array([_packed(x) for x in ids_b], pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(pairs))],
                ["row", "doc_id", "a", "b", "fresh"],
            )
            row += n

    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "row long, doc_id long, a binary, b binary, fresh array<long>")


def perfect_hashes(pairs: DataFrame, shards: int) -> DataFrame:
    """shard, n, sizes, words, keys of the hash over the distinct pairs, a row for each shard."""

    def build(rows: pa.Table) -> pa.Table:
        keys = np.asarray(rows.column("pair"), np.int64)
        sizes, words, keys = levels_of(keys)
        own = int(shard_of(_hash(keys[:1]), shards)[0])
        return pa.table([pa.array([own], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([sizes], pa.list_(pa.int64())), pa.array([words.tobytes()], pa.binary()), pa.array([keys.astype("<i8").tobytes()], pa.binary())], ["shard", "n", "sizes", "words", "keys"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("pair"), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("pair"), pa.array(shard_of(_hash(keys), shards).astype(np.int32))], ["pair", "shard"])

    return pairs.mapInArrow(dealt, "pair long, shard int").groupBy("shard").applyInArrow(build, "shard int, n long, sizes array<long>, words binary, keys binary")


def link_counts(ids: DataFrame, shared, sizes) -> DataFrame:
    """stretch, counts: how many links each pair of a round has, STRETCH indexes a row. Vectors of the tasks are added by stages, no more than FAN_IN at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perfect, (size_a, size_b) = shared.value, sizes.value
        total = np.zeros(len(perfect.keys), np.int64)
        for a, b, links, _ in _realigned(batches, size_a, size_b):
            index = perfect.index(a[links.a] * len(size_b) + b[links.b])
            np.add.at(total, index[index >= 0], 1)
        for at in range(0, len(total), STRETCH):
            part = total[at : at + STRETCH]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // STRETCH], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_packed_counts(part)], pa.binary())], ["stretch", "task", "counts"])

    def added(rows: pa.Table) -> pa.Table:
        total = functools.reduce(np.add, (_unpacked_counts(x.as_py()) for x in rows.column("counts")))
        return pa.table([rows.column("stretch").slice(0, 1), rows.column("task").slice(0, 1), pa.array([_packed_counts(total)], pa.binary())], ["stretch", "task", "counts"])

    schema = "stretch int, task long, counts binary"
    partial = ids.select("a", "b").mapInArrow(run, schema)
    n = max(1, ids.rdd.getNumPartitions())
    while True:
        n = -(-n // FAN_IN)
        partial = partial.withColumn("task", F.floor(F.col("task") / FAN_IN) if n > 1 else F.lit(0).cast("long")).groupBy("stretch", "task").applyInArrow(added, schema)
        if n == 1:
            return partial.drop("task")


def _packed_counts(counts: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(counts).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked_counts(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(pa.decompress(raw[4:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def _realigned(batches: Iterator[pa.RecordBatch], size_a: np.ndarray, size_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Aligned, tuple]]:
    """Stored ids aligned again, some rows at a time: a, b, the alignment, and (batch of rows, numbers of a, of b)."""
    for batch in portions(batches, "a", BATCH):
        for part in portions(iter([batch]), "b", BATCH):
            ids_a, ids_b = ([_unpacked(x.as_py()) for x in part.column(c)] for c in ("a", "b"))
            a, b = np.concatenate(ids_a), np.concatenate(ids_b)
            n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
            yield a, b, aligned(a, b, n_a, size_a, size_b), (part, n_a, n_b)


def looked_up(ids: DataFrame, shared, sizes) -> DataFrame:
    """row and the columns of RESULT, with n_best and count_sum of the links of one round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perfect, counts, best = shared.value
        size_a, size_b = sizes.value
        for a, b, links, (part, n_a, n_b) in _realigned(batches, size_a, size_b):
            own = b[links.b]
            index = perfect.index(a[links.a] * len(size_b) + own)
            n = np.where(index >= 0, counts[index] if len(counts) else 0, 0)
            highest = (index >= 0) & (n == best[own])
            texts = group_texts(a, b, n_a, n_b, links.common, max(len(size_a), len(size_b)))
            said = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
            columns = [part.column("row"), part.column("doc_id"), n_a, n_b, links.groups, links.links, _sums(highest.astype(np.int64), links.links), _sums(n, links.links), pa.array(said, pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return ids.select("row", "doc_id", "a", "b").mapInArrow(run, f"row long, {RESULT}")


def rounds_of(sizes: list[tuple[int, int]], most: int = MOST_PAIRS) -> list[list[int]]:
    """Shards (number, pairs) in rounds of at most so many pairs, one shard at least."""
    out, held = [], 0
    for shard, n in sorted(sizes):
        if not out or held + n > most:
            out.append([])
            held = 0
        out[-1].append(shard)
        held += n
    return out


def align(df: DataFrame, path_a: str, path_b: str, shard: int = SHARD, most: int = MOST_PAIRS) -> DataFrame:
    """The columns of RESULT for each row of df (doc_id, text)."""
    spark = df.sparkSession
    ids = stored(tokenized(df, path_a, path_b), "aligned-ids")
    pairs = stored(ids.select(F.explode("fresh").alias("pair")).distinct(), "aligned-pairs")
    shards = max(1, -(-pairs.count() // shard))
    hashes = stored(perfect_hashes(pairs, shards), "aligned-hashes")
    rounds = rounds_of([(r.shard, r.n) for r in hashes.select("shard", "n").collect()], most) or [[]]  # a row for each shard
    a, b = tokenizers(path_a, path_b)
    sizes = spark.sparkContext.broadcast((a.spelled[2], b.spelled[2]))
    best = np.zeros(len(b.spelled[2]), np.int64)
    counts = []
    for own in rounds:  # no more pairs than `most` are here at a time
        perfect = _perfect(hashes, own, shards)
        shared = spark.sparkContext.broadcast(perfect)
        counts.append(stored(link_counts(ids, shared, sizes), "aligned-counts"))
        shared.unpersist()
        np.maximum.at(best, perfect.keys % len(best), _vector(counts[-1], len(perfect.keys)))
    parts = []
    for own, vectors in zip(rounds, counts, strict=True):
        perfect = _perfect(hashes, own, shards)
        shared = spark.sparkContext.broadcast((perfect, _vector(vectors, len(perfect.keys)), best))
        parts.append(stored(looked_up(ids, shared, sizes), "aligned"))
        shared.unpersist()
    released(ids, pairs, hashes, *counts)
    if len(parts) == 1:
        return parts[0].drop("row")
    every = functools.reduce(DataFrame.unionByName, parts)
    same = [F.first(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return every.groupBy("row").agg(*same, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.first("groups_sha256").alias("groups_sha256")).drop("row")


def _perfect(hashes: DataFrame, own: list[int], shards: int) -> Perfect:
    rows = hashes.where(F.col("shard").isin(own)).orderBy("shard").collect() if own else []
    return Perfect.of([(r.shard, r.sizes, np.frombuffer(bytes(r.words), "<u8"), np.frombuffer(bytes(r["keys"]), "<i8")) for r in rows], shards)


def _vector(counts: DataFrame, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for r in counts.toLocalIterator():
        part = _unpacked_counts(bytes(r["counts"]))
        out[r.stretch * STRETCH : r.stretch * STRETCH + len(part)] = part
    return out


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
