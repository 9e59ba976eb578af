"""Language-model scores by online logistic context mixing.

A text, its A-Z lower-cased, is a sequence of symbols: a word that the corpus repeats is one symbol,
any other is spelled byte by byte (so that what is learned of rare words serves those never seen), white space is coded byte by byte, and an end follows. A single
space is left out where a frequent word stands at either side: there it is understood. Each symbol is
coded along the branches of a Huffman tree of the corpus; each branch is a bit. Predictors for contexts
of several orders, and for the word spelled so far, keep counts of both outcomes in hashed tables, gathered over all training documents;
one more input is the branch's own frequency. A bit's probability is the logistic mix of their log odds
under weights that the tree's node gates; weights are fitted on every bit of all training documents, each predicted
by counts that leave that bit out, then refined within each document block by block: a block is predicted with what
the blocks before it taught. Summed, the code lengths are the text's log probability.

Texts are turned into symbols once and kept so for the passes that count, fit and score. Branches go by groups of four:
where a group ends tells the way there, so it is counted once, and its slots are fetched together.

What is gathered grows with the corpus: words, their tree, and the tables' slots, about one for SLOT_BYTES
bytes of text up to 2**MOST_BITS a predictor, which bounds what a task holds. Texts are scored whole: blocks
follow each other to the text's end, with all that was learned before.

The base score is that of single words with additive smoothing; its counts are exact. Words that
make up at least one in 2**20 training tokens (no more than 2**20 of them) are looked up in the
tasks; all others are joined.

Null texts count as empty: one end token. Repeated rows get equal scores. A null doc_id hashes as
the empty string. An empty table gives an empty result; other columns are not looked at. Without training
documents the base score is 0 and each bit costs one bit.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphvein.llm.common import mixed, portions, released, row_key, settled, stored, table, utf8, word_hashes, words_of

#: Symbols before each one that its contexts take, by how far back they are; one context more is what is spelled of a word so far.
CONTEXTS = ((1,), (1, 2), (1, 2, 3))
N_TABLES = len(CONTEXTS) + 1
#: Inputs of the mix: tables, the branch's own frequency, and a constant.
N_INPUTS = N_TABLES + 2
#: log2 of the slots of a table at least and at most; bytes of training text to a slot.
LEAST_BITS, MOST_BITS, SLOT_BYTES = 16, 22, 0.5
#: Symbols: bytes, the end of a text, then words that come REPEATED times or more and make up one in VOCABULARY training tokens or more, the MOST_WORDS most frequent at most.
END, WORDS, REPEATED, VOCABULARY, MOST_WORDS = 256, 257, 2, 1 << 20, 1 << 17
#: Symbols of a text's first block and of a later one at most (each is twice the one before), and bytes of a batch.
BLOCK, MOST_BLOCK, BATCH = 64, 2048, 1 << 19
#: Symbols counted and scored at a time, so that what is made for them stays near the processor.
CACHED, SCORED = 1 << 13, 1 << 16
#: Branches of a group, whose counts lie together.
GROUP = 4
#: Log odds to which the tables' inputs are rounded where bits are counted for the weights; how strongly weights are drawn to where they begin, in bits.
LEVELS, RIDGE = np.array([-5.5, -3.5, -1.8, -0.6, 0.6, 1.8, 3.5, 5.5]), 20.0
#: Sets of weights: one for each of the heaviest nodes, the rest by depth.
GATES, OWN_GATES = 256, 192
#: Steps of the log odds, in which tables are kept.
STEP = 1 / 15.5
RATE = 1.5
HOT = 1 << 20
#: Partial tables that one task adds up.
FAN_IN = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Groups:
    """Groups of each symbol's branches.

    symbol: how many branches, where they begin, how many groups, and where these begin in the next arrays. salt: of each
    group; last: place and turn of its last branch, which tell those before. way: of each branch, the group of its
    symbol << 16 and what the tree has packed.
    """

    symbol: np.ndarray
    salt: np.ndarray
    last: np.ndarray
    way: np.ndarray


@dataclass
class Tree:
    """Codes of the symbols: for each, how many branches and where its way begins in the other arrays.

    Of each branch there: its turn, its node's log odds of turn 1 and gate, and where a table has it: four branches
    make a group, with a hash (salt) of its first node, and a place among the group's fifteen nodes.
    """

    length: np.ndarray
    first: np.ndarray
    prior: np.ndarray
    salt: np.ndarray
    #: gate << 5 | place in the group << 1 | turn
    packed: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Tree:
        n = len(counts)
        weight = np.r_[np.asarray(counts, np.float64) + 1, np.zeros(n - 1)]
        parent, turn = np.full(2 * n - 1, -1), np.zeros(2 * n - 1, np.int8)
        prior = np.zeros(n - 1, np.float32)
        heap = [(w, s) for s, w in enumerate(weight[:n].tolist())]
        heapq.heapify(heap)
        for made in range(n, 2 * n - 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x] = parent[y] = made
            turn[y] = 1
            weight[made], prior[made - n] = a + b, np.log(b / a)
            heapq.heappush(heap, (a + b, made))
        depth = np.zeros(2 * n - 1, np.int64)
        for made in range(2 * n - 3, -1, -1):  # a parent's number is above its children's
            depth[made] = depth[parent[made]] + 1
        length = depth[:n]
        order = np.argsort(length, kind="stable")  # ways that are often gone lie together
        first = np.zeros(n, np.int64)
        first[order[1:]] = np.cumsum(length[order])[:-1]
        nodes, turns = np.zeros(length.sum(), np.int32), np.zeros(length.sum(), np.int8)
        at, alive, place = np.arange(n), np.arange(n)[length > 0], first + length - 1
        while len(alive):  # from the leaves up, all symbols together
            here = at[alive]
            turns[place[alive]], nodes[place[alive]] = turn[here], parent[here] - n
            at[alive] = parent[here]
            place[alive] -= 1
            alive = alive[place[alive] >= first[alive]]
        gate = OWN_GATES + np.minimum(depth[n:], GATES - OWN_GATES - 1)
        heaviest = np.argsort(-weight[n:], kind="stable")[:OWN_GATES]
        gate[heaviest] = np.arange(len(heaviest))
        step = np.arange(len(nodes)) - np.repeat(first[order], length[order])
        inner, root = np.ones(len(nodes), np.int64), nodes.copy()
        for k in range(1, 4):
            here = np.flatnonzero(step % GROUP == k)
            inner[here] = 2 * inner[here - 1] + turns[here - 1]
            root[here] = root[here - 1]
        packed = (gate[nodes] << 5 | inner << 1 | turns).astype(np.uint16)
        return Tree(length, first, prior[nodes], root.astype(np.uint32) * np.uint32(0x9E3779B1), packed)

    @functools.cached_property
    def prior_steps(self) -> np.ndarray:
        return np.rint(self.prior / STEP).astype(np.int16)

    @functools.cached_property
    def groups(self) -> Groups:
        n = -(-self.length // GROUP)
        order = np.argsort(self.first, kind="stable")
        first = np.zeros(len(n), np.int64)
        first[order[1:]] = np.cumsum(n[order])[:-1]
        step = np.arange(len(self.packed)) - np.repeat(self.first[order], self.length[order])
        last = step % GROUP == GROUP - 1
        last[self.first + self.length - 1] = True
        way = (step // GROUP << 16 | self.packed).astype(np.uint32)
        symbol = np.stack([self.length, self.first, n, first], axis=1).astype(np.int32)
        return Groups(symbol, self.salt[step % GROUP == 0], (self.packed[last] & 31).astype(np.uint32), way)


def symbols_of(data: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, upto: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each followed by END, and their bounds. data: lower-cased; word: the symbol of each word, below 0 where it is spelled."""
    known = word >= 0
    edges = np.zeros(len(data) + 1, np.int8)
    edges[begin[known]] += 1
    edges[end[known]] -= 1
    said = np.cumsum(edges[:-1], dtype=np.int8) == 0
    said[begin[known]] = True
    if len(begin) > 1:
        row = np.repeat(np.arange(len(at) - 1), np.diff(upto))
        near = np.flatnonzero((end[:-1] + 1 == begin[1:]) & (row[:-1] == row[1:]) & (known[:-1] | known[1:]))
        said[end[near][data[end[near]] == 32]] = False
    value = data.astype(np.int32)
    value[begin[known]] = word[known]
    n = len(at) - 1
    counts = np.diff(np.r_[0, np.cumsum(said, dtype=np.int64)][at])
    found = value[said]
    symbols = np.full(len(found) + n, END, np.int32)
    symbols[np.arange(len(found)) + np.repeat(np.arange(n), counts)] = found
    return symbols, np.r_[0, np.cumsum(counts + 1)]


def kept_symbols(symbols: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Symbols of each text as two columns, low (two bytes each) and high (one byte each)."""
    low, high = symbols.astype("<u2"), (symbols >> 16).astype(np.uint8)
    binary = lambda data, at: pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    return [binary(low, 2 * bounds), binary(high, bounds)]


def symbols_in(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their bounds from the columns of kept_symbols()."""
    (low, at), (high, _) = utf8(batch.column("low")), utf8(batch.column("high"))
    symbols = np.frombuffer(low.tobytes(), "<u2").astype(np.int32)
    symbols |= high.astype(np.int32) << 16
    return symbols, at // 2


@functools.lru_cache(maxsize=2)
def _powers(bits: int, base: int) -> np.ndarray:
    """The first 2**bits powers."""
    powers = np.full(1 << bits, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def spelled(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol whether a byte of a word that is being spelled comes before it, and a hash of what is spelled so far. starts: of the texts."""
    n = len(symbols)
    inside = np.zeros(n, bool)
    inside[1:] = ((symbols < END) & ~_SPACE[symbols & 0xFF])[:-1]
    inside[starts] = False
    bits = max(16, (n - 1).bit_length())
    rolled = np.zeros(n + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * _powers(bits, _BASE)[:n], out=rolled[1:])
    since = np.maximum.accumulate(np.where(inside, 0, np.arange(n)))
    so_far = (rolled[:-1] - rolled[since]) * _powers(bits, _INVERSE)[since]
    return inside, (mixed(so_far) >> np.uint64(32)).astype(np.uint32)


def contexts(symbols: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """A 32-bit hash for each symbol and table, from the symbols before it in its text (0: none)."""
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    before, last = {}, symbols.astype(np.uint32) + np.uint32(1)
    for k in range(1, max(map(max, CONTEXTS)) + 1):
        shifted = np.zeros(len(symbols), np.uint32)
        shifted[1:] = last[:-1]
        shifted[starts] = 0
        before[k] = last = shifted
    out = []
    for places in CONTEXTS:
        h = np.full(len(symbols), 0x2545F491 + len(places), np.uint32)
        for k in places:
            h += before[k] * np.uint32(0x9E3779B1 + 2 * k * 0x01000193 & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
        out.append(h)
    inside, so_far = spelled(symbols, starts)
    out.append(np.where(inside, so_far, out[0]))  # between words, the symbol before
    return out


def branches(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from each first one on, as many as its length; and how many come before each first one."""
    upto = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=upto[1:])
    at = np.repeat(first - upto[:-1], length)
    at += np.arange(upto[-1])
    return at, upto


def rows_of(symbol: np.ndarray, found: list[np.ndarray], groups: Groups, bits: int) -> tuple[Iterator[np.ndarray], np.ndarray, np.ndarray]:
    """For each table the sixteen slots of each group of branches, by the context's hash and the group's salt together; which group it is, and how many come before each symbol."""
    n = symbol[:, 2]
    which, upto = branches(symbol[:, 3], n)
    salt = np.take(groups.salt, which, mode="clip")

    def rows() -> Iterator[np.ndarray]:
        for context in found:
            mix = np.repeat(context, n)
            mix += salt
            mix >>= np.uint32(36 - bits)
            yield mix

    return rows(), which, upto


def gathered(tables: np.ndarray, symbols: np.ndarray, found: list[np.ndarray], groups: Groups, bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """What each table of bytes has for each bit; where the tree has the bits, what it packed, and how many come before each symbol. A group's slots are fetched together."""
    symbol = np.take(groups.symbol, symbols, axis=0, mode="clip")
    rows, _, groups_upto = rows_of(symbol, found, groups, bits)
    at, upto = branches(symbol[:, 1], symbol[:, 0])
    way = np.take(groups.way, at, mode="clip")
    spot = np.repeat(16 * groups_upto[:-1], symbol[:, 0])
    packed = way.astype(np.uint16)
    way >>= np.uint32(16)
    way <<= np.uint32(4)
    way |= packed >> 1 & 15
    spot += way
    near = (np.take(t.view("V16"), row.astype(np.intp), mode="clip").view(t.dtype) for t, row in zip(tables, rows, strict=True))
    return [np.take(x, spot, mode="clip") for x in near], at, packed, upto


def in_wide_pages(tables: np.ndarray) -> np.ndarray:
    """A copy that numpy asks wide pages for, which random places are found faster in."""
    out = np.empty_like(tables)
    out[...] = tables
    return out


@dataclass
class Model:
    """words: hashes of known words, ascending, and their symbols; tables: N_TABLES x slots, log odds in steps; weights: N_INPUTS x GATES."""

    words: np.ndarray
    symbol: np.ndarray
    tree: Tree
    bits: int
    tables: np.ndarray
    weights: np.ndarray

    def coded(self, data: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, upto: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their bounds of lower-cased texts."""
        return symbols_of(data, at, begin, end, upto, self.symbols_by(hashes))

    def symbols_by(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), -1, np.int32)
        spot = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[spot] == hashes, self.symbol[spot], np.int32(-1))

    def inputs(self, symbols: np.ndarray, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of each bit (without the constant), its gate and turn, and how many bits come before each symbol."""
        steps, at, packed, upto = gathered(self.tables, symbols, found, self.tree.groups, self.bits)
        x = np.empty((N_INPUTS - 1, len(at)), np.float32)
        for k, step in enumerate(steps):
            np.multiply(step, np.float32(STEP), out=x[k])
        np.take(self.tree.prior, at, out=x[N_TABLES], mode="clip")
        return x, (packed >> 5).astype(np.intp), packed & 1, upto

    def mix(self, x: np.ndarray, gate: np.ndarray, learned: np.ndarray | None = None, n: np.ndarray | None = None) -> np.ndarray:
        """Log odds of turn 1; learned: what each text adds to the weights, n: its bits."""
        z = np.take(self.weights[-1], gate, mode="clip")
        weights = self.weights
        if learned is not None:  # each text has weights of its own
            weights = weights[:-1, None] + learned[:, :, None]
            gate = gate + np.repeat(np.arange(0, GATES * len(n), GATES), n)
        for k in range(N_INPUTS - 1):
            w = np.take(weights[k], gate, mode="clip")
            w *= x[k]
            z += w
        return z

    def code_lengths(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of each text. Texts of like size advance together, a block at a time; what a block needs is made for it alone."""
        found = contexts(symbols, bounds)
        size = np.diff(bounds)
        total = np.zeros(len(size))
        order = np.argsort(-size, kind="stable")[: np.count_nonzero(size)]
        upto = np.cumsum(size[order])
        while len(order):
            some = max(1, int(np.searchsorted(upto, upto[0] - size[order[0]] + SCORED, "right")))
            total[order[:some]] = self._together(symbols, found, bounds[order[:some]], size[order[:some]])
            order, upto = order[some:], upto[some:]
        return total / np.log(2)

    def _together(self, symbols: np.ndarray, found: list[np.ndarray], begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Code lengths of the texts that begin there, the longest first."""
        total, learned = np.zeros(len(size)), np.zeros((N_INPUTS - 1, len(size)), np.float32)
        done, block, live = 0, BLOCK, len(size)
        while live:
            take = np.minimum(size[:live] - done, block)
            upto = np.r_[0, np.cumsum(take)]
            at = np.arange(upto[-1]) + np.repeat(begin[:live] + done - upto[:-1], take)
            x, gate, turn, before = self.inputs(symbols[at], [c[at] for c in found])
            cuts = before[upto]
            sign = np.float32(1) - 2 * turn.astype(np.float32)
            y = self.mix(x, gate, learned[:, :live] if done else None, np.diff(cuts))
            np.clip(y, -12, 12, out=y)
            y *= sign  # log odds of the other turn
            odds = np.exp(y)
            whole = 1 + odds
            cost = np.log(whole)
            total[:live] += np.add.reduceat(cost, cuts[:-1], dtype=np.float64)
            done, block, live = done + block, min(2 * block, MOST_BLOCK), int(np.count_nonzero(size > done + block))
            if live:  # those that go on learn from the block
                here = slice(cuts[live])
                error = odds[here] / whole[here]
                error *= -sign[here]
                gain = (RATE / np.maximum(np.diff(cuts[: live + 1]), 400)).astype(np.float32)
                for k in range(N_INPUTS - 1):
                    learned[k, :live] += gain * np.add.reduceat(error * x[k, here], cuts[:live])
        return total


def lowered(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, bounds, and begin, end, number before each text, and hash of the words."""
    data, at = utf8(texts)
    data = _LOWER[data]
    begin, end, upto = words_of(data, at)
    return data, at, begin, end, upto, word_hashes(data, begin, end).view(np.int64)


def fit_weights(weights: np.ndarray, cell: np.ndarray, n: np.ndarray, ones: np.ndarray, prior: np.ndarray, steps: int = 12) -> None:
    """Newton's steps on the weights of each gate. cell: gate and levels of the tables' inputs; n, ones: its bits, and those of turn 1; prior: mean input of the branches."""
    levels = np.stack([LEVELS[cell >> 3 * k & 7] for k in range(N_TABLES - 1, -1, -1)])
    x = np.concatenate([levels, prior[None], np.ones((1, len(cell)))])
    order = np.argsort(cell >> 3 * N_TABLES, kind="stable")
    cuts = np.searchsorted((cell >> 3 * N_TABLES)[order], np.arange(GATES + 1))
    for g in np.flatnonzero(np.diff(cuts)).tolist():
        mine = order[cuts[g] : cuts[g + 1]]
        begin = w = weights[:, g].astype(np.float64)
        here, total, hits = x[:, mine], n[mine], ones[mine]

        def loss(w, here=here, total=total, hits=hits, begin=begin):
            z = w @ here
            return (total * np.logaddexp(0, z) - hits * z).sum() + RIDGE / 2 * ((w - begin) ** 2).sum()

        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(w @ here, -12, 12)))
            gradient = here @ (total * p - hits) + RIDGE * (w - begin)
            step = np.linalg.solve((here * (total * p * (1 - p))) @ here.T + RIDGE * np.eye(len(w)), gradient)
            size = 1.0
            while size > 1e-3 and loss(w - size * step) > loss(w):
                size /= 2
            if size <= 1e-3:
                break
            w = w - size * step
        weights[:, g] = w


# ---------------------------------------------------------------- gathering


def _texts(df: DataFrame) -> DataFrame:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.crc32(name) % 10 == 0).alias("held_out"), row_key("doc_id", "text").alias("key"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash; of bytes for kind 1: their value), kind, n over all words, bytes and ends (kind 2), all lower-cased; size: a word's bytes."""
    names, kinds = ["word", "kind", "n", "size"], "word long, kind int, n long, size int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = np.zeros(256, np.int64)
        ends = 0
        for batch in portions(batches, "text", 8 << 20):
            found, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for part in portions(iter([batch]), "text", BATCH):
                data, _, begin, end, _, hashes = lowered(part.column("text"))
                symbols += np.bincount(data, minlength=256)
                found.append(hashes)
                sizes.append((end - begin).astype(np.int32))
            ends += batch.num_rows
            words, first, n = np.unique(np.concatenate(found), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.zeros(len(words), np.int32)), pa.array(n), pa.array(np.concatenate(sizes)[first])], names)
        zeros = np.zeros(257, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(256), 0]), pa.array(np.r_[np.ones(256), 2].astype(np.int32)), pa.array(np.r_[symbols, ends]), pa.array(zeros)], names)

    return docs.select("text").mapInArrow(run, kinds).groupBy("word", "kind").agg(F.sum("n").alias("n"), F.max("size").alias("size"))


def _packed(counts: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(raw: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * size, codec="zstd", asbytes=True), np.uint8).reshape(4, size)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


#: Slots of a stretch of a table.
STRETCH = 1 << 16


def coded_batches(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols of texts and their bounds, a portion at a time; from the texts or, where they are kept, the symbols."""
    for batch in batches:
        if "text" in batch.schema.names:
            for part in portions(iter([batch]), "text", BATCH):
                yield model.coded(*lowered(part.column("text")))
        else:
            for part in portions(iter([batch]), "low", BATCH // 2):
                yield symbols_in(part)


def places_of(model: Model, symbols: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each table, twice the slot of the last bit of each group of branches in the texts, and one more where its turn is 1."""
    found = contexts(symbols, bounds)
    for at in range(0, len(symbols), CACHED):  # groups are made as they are used
        symbol = np.take(model.tree.groups.symbol, symbols[at : at + CACHED], axis=0, mode="clip")
        rows, which, _ = rows_of(symbol, [c[at : at + CACHED] for c in found], model.tree.groups, model.bits)
        last = np.take(model.tree.groups.last, which, mode="clip")
        for k, row in enumerate(rows):
            row <<= np.uint32(5)
            row |= last
            yield k, row.astype(np.intp)


def with_ways(total: np.ndarray) -> None:
    """Adds to each place the counts of all places beyond it in its group: what came there came this way."""
    groups = total.reshape(-1, 32)
    for first in (16, 8, 4):
        groups[:, first // 2 : first] += groups[:, first : 2 * first : 2] + groups[:, first + 1 : 2 * first : 2]


def context_counts(docs: DataFrame, shared) -> DataFrame:
    """table, stretch, counts (both outcomes of STRETCH slots) summed over all documents; docs: text, or low and high; shared: a broadcast model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total = None
        for symbols, bounds in coded_batches(model, batches):
            if total is None:
                total = np.empty((N_TABLES, 2 << model.bits), np.uint32)
                total[...] = 0  # written, not left to be: so numpy asks wide pages for it
            for k, place in places_of(model, symbols, bounds):
                np.add.at(total[k], place, np.uint32(1))
        if total is not None:
            with_ways(total)
            task = TaskContext.get().partitionId()
            for k in range(N_TABLES):
                for s in range(0, 1 << model.bits, STRETCH):
                    raw = _packed(total[k, 2 * s : 2 * (s + STRETCH)])
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s], pa.int32()), pa.array([task], pa.int64()), pa.array([raw], pa.binary())], ["model", "stretch", "task", "counts"])

    def added(rows: pa.Table) -> pa.Table:
        total = sum(_unpacked(x.as_py(), 2 * STRETCH) for x in rows.column("counts"))
        return pa.table([rows.column("model").slice(0, 1), rows.column("stretch").slice(0, 1), rows.column("task").slice(0, 1), pa.array([_packed(np.minimum(total, 0xFFFFFFFF))], pa.binary())], ["model", "stretch", "task", "counts"])

    schema = "model int, stretch int, task long, counts binary"
    partial = docs.mapInArrow(run, schema)
    n = max(1, docs.rdd.getNumPartitions())
    while True:  # by stages, so that no task adds up more than FAN_IN tables
        n = -(-n // FAN_IN)
        partial = partial.withColumn("task", F.floor(F.col("task") / FAN_IN) if n > 1 else F.lit(0).cast("long")).groupBy("model", "stretch", "task").applyInArrow(added, schema)
        if n == 1:
            return partial.drop("task")


def left_out(both: np.ndarray) -> np.ndarray:
    """For each slot, the level of its log odds without one bit of turn 0, and, from the fourth binary digit on, without one of turn 1."""
    edges = (LEVELS[1:] + LEVELS[:-1]) / 2
    zero, one = both[::2], both[1::2]
    level = lambda a, b: np.searchsorted(edges, np.log((b + 0.4) / (a + 0.4)))
    return (level(np.maximum(zero - 1, 0), one) | level(zero, np.maximum(one - 1, 0)) << 3).astype(np.uint8)


def _odds(counts: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The tables of counts as log odds in steps, and as left_out(): a byte a slot each, a fixed size."""

    def odds(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                both = _unpacked(batch.column("counts")[k].as_py(), 2 * STRETCH)
                steps = np.clip(np.rint(np.log((both[1::2] + 0.4) / (both[::2] + 0.4)) / STEP), -127, 127).astype(np.int8)
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([row.column("model"), row.column("stretch"), pa.array([steps.tobytes()], pa.binary()), pa.array([left_out(both).tobytes()], pa.binary())], ["model", "stretch", "steps", "without"])

    tables, without = np.zeros((N_TABLES, 1 << bits), np.int8), np.zeros((N_TABLES, 1 << bits), np.uint8)
    for r in counts.mapInArrow(odds, "model int, stretch int, steps binary, without binary").toLocalIterator():
        tables[r.model, r.stretch : r.stretch + STRETCH] = np.frombuffer(bytes(r.steps), np.int8)
        without[r.model, r.stretch : r.stretch + STRETCH] = np.frombuffer(bytes(r.without), np.uint8)
    return tables, without


def cells_of(model: Model, without: np.ndarray, symbols: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each bit of the texts, twice its gate and levels, and one more where its turn is 1; the log odds of its branch in steps."""
    found = contexts(symbols, bounds)
    for i in range(0, len(symbols), CACHED):
        levels, at, packed, _ = gathered(without, symbols[i : i + CACHED], [c[i : i + CACHED] for c in found], model.tree.groups, model.bits)
        turn = (packed & 1).astype(np.uint8)
        three = 3 * turn
        cell = (packed >> 5).astype(np.uint32)
        for level in levels:
            level >>= three
            level &= 7
            cell <<= np.uint32(3)
            cell |= level
        cell <<= np.uint32(1)
        cell |= turn
        yield cell, np.take(model.tree.prior_steps, at, mode="clip")


#: Bits counted before a cell's sums, which share 64 binary digits, are taken apart: so many that neither reaches 2**31.
APART = 1 << 21


def cell_counts(docs: DataFrame, shared) -> DataFrame:
    """cell, n, ones, prior (sum): every bit of all documents by gate and levels of its inputs, in whole numbers, so that sums depend on no order. docs: text, or low and high; shared: a broadcast of model and left_out()."""
    names, kinds = ["cell", "n", "ones", "prior"], "cell int, n long, ones long, prior long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, without = shared.value
        without = in_wide_pages(without)
        size = GATES << 3 * N_TABLES
        sums, both, prior, met = np.zeros(2 * size, np.int64), np.zeros(2 * size, np.int64), np.zeros(size, np.int64), 0

        def apart() -> None:
            some = np.flatnonzero(sums)
            n = sums[some] & 0xFFFFFFFF
            both[some] += n
            np.add.at(prior, some >> 1, (sums[some] - n) >> 32)
            sums[some] = 0

        for symbols, bounds in coded_batches(model, batches):
            for cell, odds in cells_of(model, without, symbols, bounds):
                if met + len(cell) > APART:
                    apart()
                    met = 0
                met += len(cell)
                one = odds.astype(np.int64)
                one <<= 32
                one += 1
                np.add.at(sums, cell.astype(np.intp), one)
        apart()
        n = both[::2] + both[1::2]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(both[1::2][some]), pa.array(prior[some])], names)

    return docs.mapInArrow(run, kinds).groupBy("cell").agg(*(F.sum(c).alias(c) for c in names[1:]))


def table_bits(n_bytes: int) -> int:
    return min(max(int(np.ceil(np.log2(max(n_bytes / SLOT_BYTES, 1)))), LEAST_BITS), MOST_BITS)


def unfitted(words: np.ndarray, symbol_counts: np.ndarray, n_bytes: int) -> Model:
    """words: hashes, ascending, of the symbols from WORDS on; symbol_counts: of all symbols; n_bytes: of the training documents."""
    weights = np.full((N_INPUTS, GATES), 0.3, np.float32)
    weights[-1] = 0
    return Model(words, np.arange(WORDS, WORDS + len(words), dtype=np.int32), Tree.of(symbol_counts), table_bits(n_bytes), np.zeros((N_TABLES, 0), np.int8), weights)


def fitted(docs: DataFrame, model: Model) -> Model:
    """model with tables and weights. docs: text of the training documents, or low and high."""
    spark = docs.sparkSession
    weights = model.weights.copy()
    counts = stored(context_counts(docs, spark.sparkContext.broadcast(model)), "context-counts")
    tables, without = _odds(counts, model.bits)
    released(counts)
    cells = cell_counts(docs, spark.sparkContext.broadcast((model, without))).toArrow()  # GATES << 3 * N_TABLES rows at most
    cell, n, ones, prior = (np.asarray(cells.column(c), np.int64) for c in ("cell", "n", "ones", "prior"))
    order = np.argsort(cell)
    fit_weights(weights, cell[order], n[order], ones[order], (prior / np.maximum(n, 1) * STEP)[order])
    return replace(model, tables=tables, weights=weights)


def score(df: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row of df (doc_id, text)."""
    spark = df.sparkSession
    docs = _texts(df)
    train = docs.where("NOT held_out")
    counts = stored(word_counts(train), "word-counts")
    whole = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    by_kind = {r.kind: r for r in whole}
    n_docs = by_kind[2].n if 2 in by_kind else 0
    n_words, n_distinct = (by_kind[0].n, by_kind[0].v) if 0 in by_kind else (0, 0)
    n_bytes = by_kind[1].n if 1 in by_kind else 0
    tokens, distinct = n_words + n_docs, n_distinct + (n_docs > 0)
    least = max(1, -(-tokens // HOT))
    hot = counts.where((F.col("kind") == 0) & (F.col("n") >= least)).select("word", "n", "size").toArrow()  # at most HOT rows
    order = np.argsort(np.asarray(hot.column("word"), np.int64), kind="stable")
    hot_words, hot_n, hot_size = (np.asarray(hot.column(c), np.int64)[order] for c in ("word", "n", "size"))
    frequent = (hot_n * VOCABULARY >= tokens) & (hot_n >= REPEATED)
    if frequent.sum() > MOST_WORDS:
        frequent &= hot_n > np.partition(hot_n[frequent], -MOST_WORDS - 1)[-MOST_WORDS - 1]
    symbol_counts = np.zeros(WORDS)
    for r in counts.where("kind = 1").collect():
        symbol_counts[r.word] = r.n
    # bytes of words are coded where words are spelled, spaces between two such words, other white space always
    inside = ~_SPACE
    spelled_words = 1 - hot_n[frequent].sum() / max(n_words, 1)
    symbol_counts[:END][inside] *= 1 - (hot_n * hot_size)[frequent].sum() / max(symbol_counts[:END][inside].sum(), 1)
    symbol_counts[32] *= spelled_words**2
    symbol_counts[END] = n_docs
    model = unfitted(hot_words[frequent], np.r_[symbol_counts, hot_n[frequent]], n_bytes)
    hot_symbol = np.full(len(hot_words), -1, np.int32)
    hot_symbol[frequent] = model.symbol
    known = spark.sparkContext.broadcast((hot_words, np.log10(hot_n + 0.1), hot_symbol))
    names = ["key", "doc_id", "held_out", "n_tokens", "n_hot", "hot", "size", "rare", "times", "low", "high"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words, hot_logs, hot_symbol = known.value
        for batch in portions(batches, "text", BATCH):
            data, at, begin, end, upto, words = lowered(batch.column("text"))
            n = batch.num_rows
            row = np.repeat(np.arange(n), np.diff(upto))
            order = np.argsort(words)  # in order they are found near each other
            spot = np.empty(len(words), np.int64)
            spot[order] = np.minimum(np.searchsorted(hot_words, words[order]), max(len(hot_words) - 1, 0))
            is_hot = hot_words[spot] == words if len(hot_words) else np.zeros(len(words), bool)
            # one search serves both scores
            symbol = np.where(is_hot, hot_symbol[spot], np.int32(-1)) if len(hot_words) else np.full(len(words), -1, np.int32)
            logs = np.bincount(row[is_hot], hot_logs[spot[is_hot]], n) if is_hot.any() else np.zeros(n)
            rows, rare = row[~is_hot], words[~is_hot]
            o = np.lexsort((rare, rows))
            rows, rare = rows[o], rare[o]
            fresh = np.ones(len(rare), bool)
            fresh[1:] = (rare[1:] != rare[:-1]) | (rows[1:] != rows[:-1])
            first = np.flatnonzero(fresh)
            times = np.diff(np.r_[first, len(rare)]).astype(np.int32)
            cuts = pa.array(np.searchsorted(rows[first], np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(upto) + 1), pa.array(np.bincount(row[is_hot], minlength=n).astype(np.int64)),
                    pa.array(logs), pa.array(np.diff(at)), pa.ListArray.from_arrays(cuts, pa.array(rare[first])), pa.ListArray.from_arrays(cuts, pa.array(times)),
                    *kept_symbols(*symbols_of(data, at, begin, end, upto, symbol)),
                ],
                names,
            )

    plain = "key long, doc_id long, held_out boolean, n_tokens long, n_hot long, hot double, size long"
    # texts are coded once: the passes that fit and score read their symbols
    coded = stored(docs.select("key", "doc_id", "held_out", "text").mapInArrow(code, f"{plain}, rare array<long>, times array<int>, low binary, high binary"), "coded")
    shared = spark.sparkContext.broadcast(fitted(coded.where("NOT held_out").select("low", "high"), model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = replace(shared.value, tables=in_wide_pages(shared.value.tables))
        for batch in portions(batches, "low", BATCH // 2):
            bits = model.code_lengths(*symbols_in(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:7]), pa.array(bits)], [*names[:7], "bits"])

    scored = stored(coded.select(*names[:7], "low", "high").mapInArrow(run, f"{plain}, bits double"), "scored")
    # Equal rows share a key and all their words, so one of each key is looked up.
    asked = coded.where(F.size("rare") > 0).groupBy("key").agg(F.first(F.arrays_zip("rare", "times")).alias("w")).select("key", F.explode("w").alias("w")).select("key", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    cold = counts.where((F.col("kind") == 0) & (F.col("n") < least)).select("word", "n")
    met = asked.join(cold.hint("merge"), "word").groupBy("key").agg(F.sum("times").alias("n_cold"), F.sum(F.col("times") * F.log10(F.col("n") + 0.1)).alias("cold"))
    rows = scored.join(met, "key", "left")
    end_known = int(n_docs > 0)
    n_known = F.col("n_hot") + F.coalesce("n_cold", F.lit(0)) + end_known
    unknown = F.col("n_tokens") - n_known
    norm = float(np.log10(tokens + 0.1 * (distinct + 1)))
    base = F.col("hot") + F.coalesce("cold", F.lit(0.0)) + float(np.log10(n_docs + 0.1)) * end_known + unknown * float(np.log10(0.1)) - F.col("n_tokens") * norm
    done = rows.select(
        "doc_id", "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        (-F.col("bits") * float(np.log10(2))).alias("score"), (F.col("bits") / F.greatest("size", F.lit(1))).alias("bits_per_byte"),
    )
    return settled(done, "scores", counts, coded, scored)


def op9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
