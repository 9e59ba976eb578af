"""Quality rules with line sequence labelling by a linear-chain conditional random field.

A document is the sequence of its \\n-split lines that hold a word. The model, fitted on a
bounded sample of labelled documents, marks each line as content or boilerplate by Viterbi
decoding; a document stays if content lines hold at least `share` of its words and the base
rules pass. Null texts count as empty: no words, not kept. Repeated rows get equal results;
ties in decoding go to content. An empty table gives an empty result; other columns are not looked at. Without
labelled documents every line is content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphvein.llm.common import mixed, portions, table, utf8, word_hashes, words_of

BOILERPLATE, CONTENT = 0, 1
N_FEATURES = 20
#: Bounds of the fitting sample: labelled documents, and lines of them, taken whole in hash order.
SAMPLE_DOCUMENTS, SAMPLE_LINES = 3000, 60_000

_CLASS = {
    "letter": [*range(65, 91), *range(97, 123), *range(128, 256)],
    "upper": range(65, 91),
    "digit": range(48, 58),
    "symbol": [ord(c) for c in "#*$%&|<>"],
    "stop": [ord(c) for c in ".,;:!?"],
    "shout": [ord("!")],
    "bar": [ord("|")],
}
_TABLES = {k: np.isin(np.arange(256), list(v)).astype(np.uint8) for k, v in _CLASS.items()}


def _sums(flags: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[begin]


@dataclass
class Lines:
    """Lines with a word of a batch of texts, in order."""

    row: np.ndarray  # of the text
    words: np.ndarray  # how many
    repeated: np.ndarray  # equal to an earlier line of the text
    features: np.ndarray  # n x N_FEATURES


@dataclass
class Texts:
    """Counts for each text of a batch, and its lines."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    lines: Lines


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: occurs twice or more; occurred before."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    if len(keys) > 1:
        same[1:] = keys[order][1:] == keys[order][:-1]
    again, several = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order] = same
    several[order] = same
    several[order[:-1]] |= same[1:]
    return several, again


def measured(data: np.ndarray, at: np.ndarray) -> Texts:
    """Counts over a batch of whole texts, given as bytes."""
    n = len(at) - 1
    begin, end, upto = words_of(data, at)
    row = np.repeat(np.arange(n), np.diff(upto))
    points = (data & 0xC0) != 0x80
    chars = np.bincount(row, _sums(points, begin, end), n).astype(np.int64) if len(begin) else np.zeros(n, np.int64)
    symbols = _sums(_TABLES["symbol"][data], at[:-1], at[1:])

    repeat_words = np.zeros(n, np.int64)
    hashes = word_hashes(data, begin, end)
    if len(begin) > 2:
        windows = mixed(hashes[:-2] + mixed(hashes[1:-1] * np.uint64(3) + mixed(hashes[2:] * np.uint64(5))))
        inside = row[:-2] == row[2:]
        keys = mixed(windows + mixed(row[:-2].astype(np.uint64)))[inside]
        several = np.zeros(len(begin), bool)
        several[:-2][inside] = _repeats(keys)[0]
        covered = several.copy()
        covered[1:] |= several[:-1]
        covered[2:] |= several[:-2]
        repeat_words = np.bincount(row, covered, n).astype(np.int64)

    breaks = np.flatnonzero(data == 10)
    bounds = np.unique(np.concatenate([at, breaks, breaks + 1]))
    starts, stops = bounds[:-1], bounds[1:]
    real = np.diff(np.searchsorted(begin, bounds)) > 0
    starts, stops = starts[real], stops[real]
    line_row = np.searchsorted(at, starts, "right") - 1
    first, last = np.searchsorted(begin, starts), np.searchsorted(begin, stops)
    words = last - first
    length = stops - starts
    equal = word_hashes(data, starts, stops, 7) if len(starts) else np.zeros(0, np.uint64)
    again = _repeats(mixed(equal + mixed(line_row.astype(np.uint64))))[1]
    share = {k: _sums(t[data], starts, stops) / np.maximum(length, 1) for k, t in _TABLES.items()}
    place = np.arange(len(starts)) - np.searchsorted(line_row, line_row, "left")
    of = np.bincount(line_row, minlength=n)[line_row] if len(starts) else words
    capital = (_TABLES["upper"][data[begin[first]]] > 0) if len(starts) else words
    ends_well = np.isin(data[stops - 1], [46, 33, 63]) if len(starts) else words
    mean = length / np.maximum(words, 1)
    columns = [
        np.ones(len(starts)), words <= 3, (words > 3) & (words <= 10), words > 40, share["letter"] < 0.6, share["letter"] > 0.75, share["upper"] > 0.3,
        share["digit"] > 0.1, share["symbol"] > 0.02, share["symbol"] > 0.15, share["stop"] < 0.002, share["shout"] > 0.05, share["bar"] > 0.02, again,
        place == 0, place == of - 1, capital, ends_well, mean > 9, of == 1,
    ]
    features = np.stack([np.asarray(c, np.float64) for c in columns], 1) if len(starts) else np.zeros((0, N_FEATURES))
    dup = np.bincount(line_row, again, n).astype(np.int64) if len(starts) else np.zeros(n, np.int64)
    return Texts(np.diff(upto), chars, symbols, dup, repeat_words, Lines(line_row, words, again, features))


@dataclass
class Crf:
    """Two states; emission weights N_FEATURES x 2, transitions 2 x 2."""

    emission: np.ndarray
    transition: np.ndarray

    def viterbi(self, row: np.ndarray, features: np.ndarray) -> np.ndarray:
        """The likeliest states of all lines; consecutive lines of equal row are a sequence. All sequences advance together."""
        scores = features @ self.emission
        if not len(row):
            return np.zeros(0, np.int64)
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        size = np.diff(np.r_[begin, len(row)])
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        came = np.zeros((len(row), 2), np.int64)
        best = scores[begin].copy()
        final = best.copy()
        for step in range(1, size[0]):
            live = int(np.searchsorted(-size, -step, "left"))
            through = best[:live, :, None] + self.transition[None]
            from_content = through[:, CONTENT] >= through[:, BOILERPLATE]
            came[begin[:live] + step] = from_content
            best = np.where(from_content, through[:, CONTENT], through[:, BOILERPLATE]) + scores[begin[:live] + step]
            final[:live] = best
        states = np.zeros(len(row), np.int64)
        state = (final[:, CONTENT] >= final[:, BOILERPLATE]).astype(np.int64)
        for step in range(size[0] - 1, -1, -1):
            live = int(np.searchsorted(-size, -step, "left"))
            states[begin[:live] + step] = state[:live]
            if step:
                state[:live] = came[begin[:live] + step, state[:live]]
        return states


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, penalty: float = 1e-3) -> Crf:
    """Maximum likelihood by Adam over (features, states) sequences; exact gradients by forward-backward, all sequences together."""
    emission, transition = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    if not sequences:
        emission[0, CONTENT] = 1.0
        return Crf(emission, transition)
    sequences = sorted(sequences, key=lambda s: -len(s[1]))
    size = np.array([len(s) for _, s in sequences])
    begin = np.r_[0, np.cumsum(size)[:-1]]
    x, y = np.concatenate([f for f, _ in sequences]), np.concatenate([s for _, s in sequences])
    inner = np.ones(len(y), bool)
    inner[begin] = False
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    seen = np.stack([x[y == k].sum(0) for k in (0, 1)], 1)
    moments = [np.zeros_like(emission), np.zeros_like(transition)], [np.zeros_like(emission), np.zeros_like(transition)]
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(size[0])]
    for step in range(1, steps + 1):
        s = x @ emission
        forward, backward = s.copy(), np.zeros_like(s)
        for t in range(1, size[0]):
            at = begin[: live[t]] + t
            forward[at] += np.logaddexp(forward[at - 1, 0, None] + transition[0], forward[at - 1, 1, None] + transition[1])
        for t in range(size[0] - 1, 0, -1):
            at = begin[: live[t]] + t
            ahead = s[at] + backward[at]
            backward[at - 1] = np.logaddexp(transition[:, 0] + ahead[:, 0, None], transition[:, 1] + ahead[:, 1, None])
        total = np.logaddexp.reduce(forward[begin + size - 1], 1)
        z = np.repeat(total, size)
        state = np.exp(forward + backward - z[:, None])
        at = np.flatnonzero(inner)
        pairs = np.exp(forward[at - 1, :, None] + transition[None] + (s[at] + backward[at])[:, None, :] - z[at, None, None]).sum(0)
        gradients = [(seen - x.T @ state) / len(y) - penalty * emission, (seen_pairs - pairs) / len(y) - penalty * transition]
        for w, g, m, v in zip((emission, transition), gradients, *moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(emission, transition)


def fit_from_labels(docs: DataFrame, labels: DataFrame, n_documents: int = SAMPLE_DOCUMENTS, n_lines: int = SAMPLE_LINES) -> Crf:
    """Fits on a bounded sample of labelled documents.

    labels has doc_id and quality (0 or 1). A document's lines take its label; a line that is no
    first copy is boilerplate. Features are computed by the tasks; at most n_lines rows of them come back.
    """
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_documents)  # bounds the broadcast: 16 bytes a row
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            lines = measured(*utf8(batch.column("text"))).lines
            ids, quality = np.asarray(batch.column("doc_id")), np.asarray(batch.column("quality"))
            cuts = np.searchsorted(lines.row, np.arange(batch.num_rows + 1))
            bits, state = np.packbits(lines.features.astype(np.uint8), axis=1), np.where(lines.repeated, BOILERPLATE, quality[lines.row]).astype(np.uint8)
            packed, states = ([x[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)] for x in (bits, state))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([len(s) for s in states], pa.int64()), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array([s.tobytes() for s in states], pa.binary())],
                ["doc_id", "n", "features", "states"],
            )

    # A document with very many lines would fill the sample alone: such are left to scoring.
    rows = sample.mapInArrow(run, "doc_id long, n long, features binary, states binary").where(F.col("n").between(1, n_lines // 20)).orderBy(F.xxhash64("doc_id"), "doc_id", "n", "features").limit(n_documents)
    width = -(-N_FEATURES // 8)
    sequences, taken = [], 0
    for r in rows.collect():
        if taken + r.n > n_lines:
            break
        taken += r.n
        bits = np.unpackbits(np.frombuffer(r.features, np.uint8).reshape(r.n, width), axis=1)[:, :N_FEATURES]
        sequences.append((bits.astype(np.float64), np.frombuffer(r.states, np.uint8).astype(np.int64)))
    return fit(sequences)


_RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judged(docs: DataFrame, model: Crf, share: float = 0.5) -> DataFrame:
    """One row of counts and verdict per document, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            t = measured(*utf8(batch.column("text")))
            states = model.viterbi(t.lines.row, t.lines.features)
            content = np.bincount(t.lines.row, t.lines.words * (states == CONTENT), len(t.n_words))
            part = content / np.maximum(t.n_words, 1)
            failed = (t.n_words < 50) | (100 * t.n_repeat_words > 50 * t.n_words)
            columns = [t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, ~failed & (part >= share), part]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], [c.split()[0] for c in _RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _RESULT)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit_from_labels(docs, table(spark, sf_dir, "labels")))
