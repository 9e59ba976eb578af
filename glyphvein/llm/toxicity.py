"""Toxicity by a classifier chain.

The categories are predicted one after another by sparse logistic models over the presence
of words. Each later model also takes the earlier categories' probabilities; it is trained
with out-of-fold ones, so that it sees them as wrong as they will be on new documents. The
last category is the label `toxic`; a document is rejected if its probability is 0.5 or more.

The categories: `poor` is the labels' quality of 0 (none where the labels have no quality), `severe` a weak
label (labelled toxic, with three words or more that the sample ties to toxic documents), `toxic` the label itself.
Out-of-fold probabilities come from models whose vocabulary, weak labels and weights know the other folds alone.

Null texts count as empty. A document with no known word gets the models' base rates. Repeated
rows get equal results. Without any labelled row nothing is rejected. An empty table gives an empty result; columns
of the names of new ones are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphvein.llm.common import mixed, portions, stored, table, utf8, word_hashes, words_of

CATEGORIES = ("poor", "severe", "toxic")
COLUMNS = (*(f"p_{c}" for c in CATEGORIES), "rejected")
#: Bounds of the fitting sample and of the vocabulary.
SAMPLE_DOCUMENTS, VOCABULARY, FOLDS = 12_000, 6000, 5

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Linear:
    weights: np.ndarray  # one per word, then one per earlier category
    bias: float

    def probability(self, row: np.ndarray, word: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        z = np.full(n, self.bias)
        n_words = len(self.weights) - earlier.shape[1]
        z += np.bincount(row, self.weights[word], n) + earlier @ self.weights[n_words:]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_linear(row: np.ndarray, word: np.ndarray, n_words: int, earlier: np.ndarray, y: np.ndarray, l1: float = 2e-4, steps: int = 250) -> Linear:
    """L1-penalised logistic regression by accelerated proximal gradient steps."""
    n, extra = earlier.shape
    w, bias = np.zeros(n_words + extra), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    ahead, ahead_bias, pace = w.copy(), bias, 1.0
    per_row = np.bincount(row, minlength=n) if len(row) else np.zeros(n)
    # Rows are scaled by nothing, so the bound on curvature follows from the mean number of words and the hottest word.
    hottest = np.bincount(word, minlength=max(n_words, 1)).max() / n if len(word) else 0
    rate = 4 / (1 + extra + np.sqrt(max(per_row.mean() if n else 0, 1) * max(per_row.max() if n else 0, 1)) * max(hottest, 0.05))
    for _ in range(steps):
        p = Linear(ahead, ahead_bias).probability(row, word, n, earlier)
        error = (p - y) / n
        gradient = np.concatenate([np.bincount(word, error[row], n_words) if len(row) else np.zeros(n_words), earlier.T @ error])
        new = ahead - rate * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        new_bias = ahead_bias - rate * error.sum()
        new_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        momentum = (pace - 1) / new_pace
        ahead, ahead_bias = new + momentum * (new - w), new_bias + momentum * (new_bias - bias)
        w, bias, pace = new, new_bias, new_pace
    return Linear(w, bias)


@dataclass
class Chain:
    vocabulary: dict[str, int]
    models: list[Linear]

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """n x categories."""
        known = [[self.vocabulary[w] for w in words(t) if w in self.vocabulary] if t else [] for t in texts]
        row = np.repeat(np.arange(len(texts)), [len(k) for k in known])
        word = np.array([i for k in known for i in k], np.int64)
        earlier = np.zeros((len(texts), 0))
        for m in self.models:
            earlier = np.column_stack([earlier, m.probability(row, word, len(texts), earlier)])
        return earlier


def fit_chain(row: np.ndarray, word: np.ndarray, vocabulary: list[str], known: np.ndarray, targets: np.ndarray, folds: np.ndarray) -> Chain:
    """known: words that the sample without each fold has in its vocabulary, and last those of the whole sample; targets: the same, n x categories of 0 or 1 each; folds: 0 .. FOLDS - 1 of each row."""
    n, n_words = len(folds), len(vocabulary)

    def fit(without: int, rows: np.ndarray, earlier: np.ndarray, k: int) -> Linear:
        place = np.cumsum(rows) - 1
        use = rows[row] & known[without, word]
        return fit_linear(place[row[use]], word[use], n_words, earlier[rows], targets[without, rows, k].astype(np.float64))

    models, out_of_fold = [], np.zeros((n, 0))
    for k in range(targets.shape[2]):
        models.append(fit(FOLDS, np.ones(n, bool), out_of_fold, k))
        if k == targets.shape[2] - 1:
            break
        held = np.zeros(n)
        for fold in range(FOLDS):
            own = folds == fold
            if own.any() and not own.all():
                held[own] = fit(fold, ~own, out_of_fold, k).probability(row, word, n, out_of_fold)[own]
        out_of_fold = np.column_stack([out_of_fold, held])
    return Chain({w: i for i, w in enumerate(vocabulary)}, models)


def _first_shingle(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least hash among a text's three-word sequences: near copies mostly share it."""
    begin, end, upto = words_of(data, at)
    n = len(at) - 1
    least = np.full(n, np.uint64(2**64 - 1))
    if len(begin) > 2:
        h = word_hashes(data, begin, end)
        row = np.repeat(np.arange(n), np.diff(upto))
        inside = row[:-2] == row[2:]
        np.minimum.at(least, row[:-2][inside], mixed(h[:-2] + mixed(h[1:-1] * np.uint64(3) + mixed(h[2:] * np.uint64(5))))[inside])
    return least.view(np.int64)


def sampled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, toxic, poor of at most `most` labelled documents in hash order; of a group of near copies, one."""
    poor = F.coalesce(F.max((F.col("quality") == 0).cast("int")), F.lit(0)) if "quality" in labels.columns else F.lit(0)
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), poor.alias("poor"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounds the broadcast: 16 bytes a row
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            key = _first_shingle(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], [*batch.schema.names, "key"])

    keyed = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("key", T.LongType())]))
    keyed = stored(keyed, "toxicity-sample")
    first = keyed.groupBy("key", "toxic").agg(F.min("doc_id").alias("doc_id")).drop("toxic")
    return keyed.join(first, ["key", "doc_id"]).dropDuplicates(["doc_id"])


def fit_from_labels(docs: DataFrame, labels: DataFrame, n_documents: int = SAMPLE_DOCUMENTS, n_vocabulary: int = VOCABULARY) -> Chain:
    """Fits on a bounded sample; word counts and the sample's known words come back, not its texts."""
    sample = stored(sampled(docs, labels, n_documents), "toxicity-fit")
    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return Chain({}, [Linear(np.zeros(k), -8.0) for k in range(len(CATEGORIES))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for doc, text, label in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True):
                fold = int(fold_of(np.array([doc]))[0])
                seen.update((w, fold, int(bool(label))) for w in words(text or ""))
        if seen:
            w, fold, label = zip(*seen, strict=True)
            n, label = np.array(list(seen.values())), np.array(label)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(np.array(fold, np.int32)), pa.array(n * label), pa.array(n * (1 - label))], ["word", "fold", "t", "n"])

    seen = sample.select("doc_id", "text", "toxic").mapInArrow(count, "word string, fold int, t long, n long")
    # counts of each word without each fold, and over all
    without = [*((F.col("fold") != f).cast("int") for f in range(FOLDS)), F.lit(1)]
    seen = seen.groupBy("word").agg(*[F.sum(F.col(c) * use).alias(f"{c}{f}") for f, use in enumerate(without) for c in ("t", "n")])
    rate = n_toxic / (n_toxic + n_clean)
    part = lambda x, t, n, share: f"CASE WHEN {x} > 0 THEN {x} * ln({x} / (({t} + {n}) * {share})) ELSE 0 END"

    def strength(f: int) -> Column:
        t, n = f"t{f}", f"n{f}"
        g = f"2 * ({part(t, t, n, rate)} + {part(n, t, n, 1 - rate)}) * CASE WHEN {t} > {rate} * ({t} + {n}) THEN 1 ELSE -1 END"
        return F.expr(f"CASE WHEN {t} >= 3 THEN {g} ELSE 0 END")

    strong = seen.select("*", *[strength(f).alias(f"g{f}") for f in range(FOLDS + 1)]).withColumn("g", F.greatest(*[f"g{f}" for f in range(FOLDS + 1)]))
    chosen = strong.where("g > 12").orderBy(F.desc("g"), "word").limit(n_vocabulary).collect()
    index = {r.word: i for i, r in enumerate(chosen)}
    known_by = np.array([[r[f"g{f}"] > 12 for r in chosen] for f in range(FOLDS + 1)], bool).reshape(FOLDS + 1, -1)
    tied = np.array([[r[f"t{f}"] > 9 * r[f"n{f}"] for r in chosen] for f in range(FOLDS + 1)], bool).reshape(FOLDS + 1, -1) & known_by

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(index[w] for w in words(t or "") if w in index) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "toxic", "poor")), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "poor", "found"])

    rows = sample.select("doc_id", F.col("toxic").cast("int"), F.col("poor").cast("int"), "text").mapInArrow(known, "doc_id long, toxic int, poor int, found array<int>").orderBy("doc_id").collect()
    row = np.repeat(np.arange(len(rows)), [len(r.found) for r in rows])
    word = np.array([i for r in rows for i in r.found], np.int64)
    toxic, poor = np.array([r.toxic for r in rows]), np.array([r.poor for r in rows])
    hits = [np.bincount(row, tied[f, word], len(rows)) if len(word) else np.zeros(len(rows)) for f in range(FOLDS + 1)]
    targets = np.stack([np.column_stack([poor, toxic * (h >= 3), toxic]) for h in hits])
    return fit_chain(row, word, list(index), known_by, targets, fold_of(np.array([r.doc_id for r in rows], np.int64)))


def fold_of(doc_ids: np.ndarray) -> np.ndarray:
    return (mixed(doc_ids.astype(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)


def score(docs: DataFrame, chain: Chain, column: str = "text") -> DataFrame:
    """docs with p_<category> for each category and `rejected`."""
    names = list(COLUMNS[:-1])
    docs = docs.drop(*COLUMNS)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in names), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, column):
            p = chain.probabilities(batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, -1] >= 0.5)], [*batch.schema.names, *names, "rejected"])

    return docs.mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = fit_from_labels(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), chain).drop("text")
