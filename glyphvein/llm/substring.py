"""Substring dedup by fixed-block anchors.

A window of W words holds, whatever its offset, one of its document's non-overlapping blocks of
(W + 1) // 2 words. So every repeated window holds a block that some rolling window elsewhere
equals. Blocks are the index, rolling windows the probes; where a block is hit, the windows
around it are extended to W words and compared by hashes of about 94 bits. Neighbouring repeated windows
make up a maximal exact repeat, and all its words go.

Documents are dealt once to segments of a few MB by a hash of the row. A segment sends each of
its distinct hashes once, packed and sorted, to the bucket that the hash names; a bucket answers
each segment with one bit per hash. So a passage shared by many documents costs its bucket one
entry per segment, and nothing is paired. A segment sends to FAN buckets at most: where there are more
segments, relays merge the hashes of FAN segments and send them on by the next digits of the hash, as
often as needed, so that rows grow in proportion to the corpus.

Null texts have no words. Of equal rows each is elsewhere for the others. Texts shorter than a
window stay. An empty table gives an empty result. Columns of the names of new ones are replaced; other names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphvein.llm.common import mixed, stored, table, unused, utf8, word_hashes, words_of

WINDOW = 35
#: Bytes of text in a segment, about.
SEGMENT_BYTES = 6 << 20
#: Buckets that a segment or relay sends to at most, and segments that a relay merges: 2**DIGIT.
DIGIT = 8
_LOW40 = np.uint64((1 << 40) - 1)


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of each `width` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor, inverse = np.full(len(hashes), base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    factor[0] = inverse[0] = 1
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * np.cumprod(factor), out=total[1:])
    return mixed((total[width:] - total[:-width]) * np.cumprod(inverse))


class Words:
    """Word hashes of the texts of a segment, and where windows of a width begin."""

    def __init__(self, texts: pa.Array):
        self.data, self.at = utf8(texts)
        self.begin, self.end, self.upto = words_of(self.data, self.at)
        self.row = np.repeat(np.arange(len(self.at) - 1), np.diff(self.upto))
        self.hashes = word_hashes(self.data, self.begin, self.end)

    def starts(self, width: int) -> np.ndarray:
        """Words at which a window of the width begins that ends in the same text."""
        n = max(len(self.row) - width + 1, 0)
        return np.flatnonzero(self.row[:n] == self.row[width - 1 :][:n]) if n else np.zeros(0, np.int64)


def _place(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket above 40 more bits of the hash."""
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40) | (hashes & _LOW40)


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the keys, where each distinct key begins in it, and how often each occurs."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in keys:
        s = k[order]
        fresh[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(fresh)
    return order, first, np.diff(np.append(first, len(order)))


def _pack(values: np.ndarray) -> bytes:
    """Ascending values below 2**40."""
    gaps = np.diff(values, prepend=np.uint64(0))
    return b"\x04" + gaps.astype("<u4").tobytes() if not len(gaps) or gaps.max() < 1 << 32 else b"\x08" + gaps.astype("<u8").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u4" if raw[0] == 4 else "<u8", offset=1).astype(np.uint64), dtype=np.uint64)


def _pack48(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8").astype(np.uint64)


_SENT = "path long, bucket int, seg int, packed binary, extra binary, several binary, aligned binary"


def _sent(seg: int, place: np.ndarray, extra: np.ndarray | None, several: np.ndarray, aligned: np.ndarray | None, path: int = 0) -> pa.Table:
    """A row for each bucket; place is ascending. path: the digits by which relays have sent so far."""
    bucket = (place >> np.uint64(40)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    bounds = list(zip(cuts, np.append(cuts[1:], len(bucket)), strict=True))
    low = place & _LOW40
    bits = lambda x: [b"" if x is None else np.packbits(x[i:j]).tobytes() for i, j in bounds]
    return pa.table(
        [
            pa.array([path] * len(cuts), pa.int64()), pa.array(bucket[cuts].astype(np.int32)), pa.array([seg] * len(cuts), pa.int32()), pa.array([_pack(low[i:j]) for i, j in bounds], pa.binary()),
            pa.array([b"" if extra is None else _pack48(extra[i:j]) for i, j in bounds], pa.binary()), pa.array(bits(several), pa.binary()), pa.array(bits(aligned), pa.binary()),
        ],
        ["path", "bucket", "seg", "packed", "extra", "several", "aligned"],
    )


_ANSWER = "path long, seg int, stage int, bucket int, bits binary"


class Merged:
    """What several senders have for one bucket: each distinct hash once, and whether it occurs twice or more, and in the block index."""

    def __init__(self, stage: int, rows: pa.Table):
        self.rows, self.stage = rows, stage
        values = [_unpack(x.as_py()) for x in rows.column("packed")]
        self.size = [len(v) for v in values]
        keys = [np.concatenate(values)]
        if stage == 2:
            keys.append(np.concatenate([_unpack48(x.as_py()) for x in rows.column("extra")]))
        self.order, self.first, self.count = _grouped(*keys)
        self.low, self.extra = keys[0][self.order][self.first], keys[1][self.order][self.first] if stage == 2 else None
        self.several = (self.count > 1) | self._any("several")
        self.aligned = self._any("aligned") if stage == 1 else None

    def _any(self, name: str) -> np.ndarray:
        bits = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8))[:n] for x, n in zip(self.rows.column(name), self.size, strict=True)]).astype(bool)
        return np.logical_or.reduceat(bits[self.order], self.first)

    def answers(self, hit: np.ndarray) -> pa.Table:
        """For each sender one bit per hash that it sent."""
        found = np.empty(len(self.order), bool)
        found[self.order] = np.repeat(hit, self.count)
        bits = [np.packbits(found[e - n : e]).tobytes() for n, e in zip(self.size, np.cumsum(self.size), strict=True)]
        return pa.table([self.rows.column("path"), self.rows.column("seg"), pa.array([self.stage] * len(bits), pa.int32()), self.rows.column("bucket"), pa.array(bits, pa.binary())], ["path", "seg", "stage", "bucket", "bits"])

    def places(self, depth: int, digit_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """An order by the next digit of the hash, and the places in it."""
        digit = self.low >> np.uint64(digit_bits * depth) & np.uint64((1 << digit_bits) - 1)
        order = np.argsort(digit, kind="stable")
        return order, (digit << np.uint64(40) | self.low)[order]


def _answered(stage: int, rows: pa.Table) -> pa.Table:
    """For each sender's hashes in this bucket, whether they occur twice or more over all (and, of anchors, in the block index)."""
    m = Merged(stage, rows)
    return m.answers(m.several & m.aligned if stage == 1 else m.several)


def exchanged(sent: DataFrame, stage: int, senders: int, depth: int = 0) -> DataFrame:
    """The answers to all that is sent. Above 2**DIGIT senders, relays merge what so many of them sent."""
    if senders <= 1 << DIGIT:
        return sent.groupBy("path", "bucket").applyInArrow(lambda rows: _answered(stage, rows), _ANSWER)
    digit_bits, relay = DIGIT, F.shiftright("seg", DIGIT)

    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        path, bucket, own = (k.as_py() for k in key)
        m = Merged(stage, rows)
        order, place = m.places(depth, digit_bits)
        return _sent(own, place, None if m.extra is None else m.extra[order], m.several[order], None if m.aligned is None else m.aligned[order], path << digit_bits | bucket)

    def told(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        m = Merged(stage, rows)
        order, place = m.places(depth, digit_bits)
        hit = np.empty(len(order), bool)
        hit[order] = Segment._told(place, dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True)))
        return m.answers(hit)

    groups = sent.withColumn("relay", relay)
    inner = exchanged(groups.groupBy("path", "bucket", "relay").applyInArrow(merged, _SENT), stage, (senders + (1 << DIGIT) - 1) >> DIGIT, depth + 1)
    back = inner.select(F.shiftright("path", DIGIT).alias("to"), F.col("path").bitwiseAND((1 << DIGIT) - 1).cast("int").alias("at"), F.col("seg").alias("relay"), "bucket", "bits")
    return groups.groupBy("path", "bucket", "relay").cogroup(back.groupBy("to", "at", "relay")).applyInArrow(told, _ANSWER)


class Segment:
    """What each round computes anew from a segment's texts."""

    def __init__(self, texts: pa.Array, window: int, buckets: int):
        self.words, self.window, self.buckets = Words(texts), window, buckets
        self.anchor = (window + 1) // 2
        w = self.words
        self.at18 = w.starts(self.anchor)
        place = _place(rolling(w.hashes, self.anchor, 0x9E3779B97F4A7C15)[self.at18], buckets)
        self.order, self.first, self.count = _grouped(place)
        self.place = place[self.order][self.first]

    def anchors(self, seg: int) -> pa.Table:
        aligned = (self.at18 - self.words.upto[self.words.row[self.at18]]) % self.anchor == 0 if len(self.at18) else np.zeros(0, bool)
        return _sent(seg, self.place, None, self.count > 1, np.logical_or.reduceat(aligned[self.order], self.first) if len(self.first) else aligned)

    @staticmethod
    def _told(place: np.ndarray, answer: dict[int, bytes]) -> np.ndarray:
        bucket = (place >> np.uint64(40)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        parts = [np.unpackbits(np.frombuffer(answer[int(bucket[i])], np.uint8))[: j - i] for i, j in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True)]
        return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)

    def extended(self, answer: dict[int, bytes]) -> None:
        """Windows whose own block is hit, and their hashes."""
        w = self.words
        hit = np.zeros(len(w.row) + 1, bool)
        told = np.empty(len(self.order), bool)
        told[self.order] = np.repeat(self._told(self.place, answer), self.count)
        hit[self.at18] = told
        starts = w.starts(self.window)
        from_text = starts - w.upto[w.row[starts]] if len(starts) else starts
        self.starts = starts[hit[starts + (-from_text) % self.anchor]]
        place = _place(rolling(w.hashes, self.window, 0xD1342543DE82EF95)[self.starts], self.buckets)
        more = rolling(w.hashes, self.window, 0xAF251AF3B0F025B5)[self.starts] >> np.uint64(16)
        self.order2, self.first2, self.count2 = _grouped(place, more)
        self.place2, self.more2 = place[self.order2][self.first2], more[self.order2][self.first2]

    def windows(self, seg: int) -> pa.Table:
        return _sent(seg, self.place2, self.more2, self.count2 > 1, None)

    def removed(self, answer: dict[int, bytes]) -> np.ndarray:
        """For each word, whether a repeated window covers it."""
        repeated = np.empty(len(self.order2), bool)
        repeated[self.order2] = np.repeat(self._told(self.place2, answer), self.count2)
        edges = np.zeros(len(self.words.row) + 1, np.int64)
        starts = self.starts[repeated]
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + self.window, -1)
        return np.cumsum(edges[:-1]) > 0


def _answers(rows: pa.Table, stage: int) -> dict[int, bytes]:
    return {b: x for s, b, x in zip(rows.column("stage").to_pylist(), rows.column("bucket").to_pylist(), rows.column("bits").to_pylist(), strict=True) if s == stage}


def repeats_removed(df: DataFrame, window: int = WINDOW, column: str = "text", digest: bool = False) -> DataFrame:
    """df's other columns with n_words, n_removed and kept_text (kept words joined by one space; its SHA-256 as kept_sha256 if digest)."""
    new = ["n_words", "n_removed", "kept_sha256" if digest else "kept_text"]
    kept = [c for c in df.columns if c not in (column, *new)]
    size = df.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0
    segments = max(1, -(-size // SEGMENT_BYTES))
    buckets = min(segments, 1 << DIGIT)
    seg = F.pmod(F.xxhash64(*kept, column), F.lit(segments)).cast("int")
    seg_name = unused(df, "seg")
    # One exchange by segment serves all three rounds.
    docs = df.select(*kept, F.col(column).cast("string").alias(column), seg.alias(seg_name))
    anchors_of = docs.groupBy(seg_name)

    def probes(key: tuple, rows: pa.Table) -> pa.Table:
        return Segment(rows.column(column), window, buckets).anchors(key[0].as_py())

    hits = exchanged(anchors_of.applyInArrow(probes, _SENT), 1, segments)

    def extension(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        seg = key[0].as_py()
        own = Segment(rows.column(column), window, buckets)
        answer = _answers(answers, 1)
        own.extended(answer)
        sent = own.windows(seg)
        # the first round's answer goes on to the last, by a bucket of its own
        n = len(answer)
        passed = pa.table(
            [pa.array([0] * n, pa.int64()), pa.array([-1 - seg] * n, pa.int32()), pa.array(list(answer), pa.int32()), pa.array(list(answer.values()), pa.binary()), *[pa.array([b""] * n, pa.binary())] * 3], sent.column_names
        )
        return pa.concat_tables([sent, passed])

    def compared(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = key[1].as_py()
        if bucket >= 0:
            return _answered(2, rows)
        n = rows.num_rows
        return pa.table([rows.column("path"), pa.array([-1 - bucket] * n, pa.int32()), pa.array([1] * n, pa.int32()), rows.column("seg"), rows.column("packed")], ["path", "seg", "stage", "bucket", "bits"])

    extended = docs.groupBy(seg_name).cogroup(hits.groupBy("seg")).applyInArrow(extension, _SENT)
    if segments <= 1 << DIGIT:
        found = extended.groupBy("path", "bucket").applyInArrow(compared, _ANSWER)
    else:
        extended = stored(extended, "substring-windows")
        passed = extended.where("bucket < 0").select("path", (-1 - F.col("bucket")).alias("seg"), F.lit(1).alias("stage"), F.col("seg").alias("bucket"), F.col("packed").alias("bits"))
        found = exchanged(extended.where("bucket >= 0"), 2, segments).unionByName(passed)
    last = T.StringType()
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(new[2], last)])

    def result(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        own = Segment(rows.column(column), window, buckets)
        own.extended(_answers(answers, 1))
        gone = own.removed(_answers(answers, 2))
        w = own.words
        n_words = np.diff(w.upto)
        n_removed = np.bincount(w.row, gone, len(n_words)).astype(np.int64)
        texts = []
        raw = w.data.tobytes()
        for k in range(len(n_words)):
            split = raw[w.at[k] : w.at[k + 1]].split()
            if n_removed[k]:
                split = [x for x, g in zip(split, gone[w.upto[k] : w.upto[k + 1]], strict=True) if not g]
            text = b" ".join(split)
            texts.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
        return pa.table([*(rows.column(c) for c in kept), pa.array(n_words), pa.array(n_removed), pa.array(texts, pa.string())], [*kept, *new])

    return docs.groupBy(seg_name).cogroup(found.groupBy("seg")).applyInArrow(result, schema)


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return repeats_removed(docs, digest=True)
