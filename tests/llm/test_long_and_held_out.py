"""Very long texts through the operators, and the toxicity chain on labelled documents that its fit never saw."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glyphvein.llm import bpe, jaccard, secrets, substring, tokenfile, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
N = 250_000


@pytest.fixture(scope="module")
def long_texts():
    """Two texts of 250,000 words that differ in few, a part of them, one of letters alone, and a short one."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(5000)]
    own = [words[i] for i in rng.integers(0, 5000, N)]
    near = list(own)
    for i in rng.integers(0, N, 200):
        near[i] = "edited"
    own[-1] = near[-1] = "password=secret0123456789"
    return {1: " ".join(own), 2: " ".join(near), 3: " ".join(own[1000:1200]), 4: "x" * 1_500_000, 5: "short"}


@pytest.fixture(scope="module")
def long_docs(spark, long_texts):
    return spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in long_texts.items()], SCHEMA).repartition(2).cache()


def test_secrets_at_the_end(long_docs, long_texts):
    masked = {r.doc_id: r.text for r in secrets.redacted(long_docs).collect()}
    assert all(masked[k].endswith("[SECRET]") and len(masked[k]) > len(long_texts[k]) - 40 for k in (1, 2)) and masked[5] == "short"


def test_repeats_of_long_texts(long_docs, long_texts):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.repeats_removed(long_docs, digest=True).select("doc_id", "n_words", "n_removed").collect()}
    texts = {k: t.split() for k, t in long_texts.items()}
    starts = {}
    for k, ws in texts.items():
        for i in range(len(ws) - 34):
            starts.setdefault(hash(tuple(ws[i : i + 35])), []).append((k, i))
    gone = {k: np.zeros(len(ws), bool) for k, ws in texts.items()}
    for places in starts.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + 35] = True
    assert got == {k: (len(ws), int(gone[k].sum())) for k, ws in texts.items()} and got[1][1] > N * 0.9


def test_long_near_copies_are_linked(long_docs):
    got = {r.doc_id: (r.n_links, r.class_id) for r in jaccard.jaccard_links(jaccard._keyed(long_docs)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5)}


def test_token_file_of_long_texts(spark, long_docs, long_texts, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenfile.write_tokens(long_docs, str(tmp_path / "tokens"), path, 2)
    library = Tokenizer.from_file(path)
    expected = {k: [*library.encode(t, add_special_tokens=False).ids, 2] for k, t in long_texts.items()}
    assert {r.doc_id: r.ids for r in tokenfile.read_tokens(spark, str(tmp_path / "tokens")).collect()} == expected


def test_byte_bpe_of_long_texts(long_docs, long_texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.encoding(path, public_tokenizers.PATTERN)
    got = {r.doc_id: r.ids for r in bpe.encode_texts(long_docs, path, public_tokenizers.PATTERN).select("doc_id", "ids").collect()}
    assert got == {k: own.encode_ordinary(t) for k, t in long_texts.items()}


def test_toxicity_of_documents_left_out_of_the_fit(spark, long_docs):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL")
    out = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    chain = toxicity.fit_from_labels(docs, labels.where(~out))
    told = {(r.toxic, r.rejected): r["count"] for r in toxicity.score(docs.join(labels.where(out).select("doc_id", "toxic"), "doc_id"), chain).groupBy("toxic", "rejected").count().collect()}
    assert told[1, True] > 0.75 * (told[1, True] + told[1, False]) and told.get((0, True), 0) < 0.01 * told[0, False]
    assert toxicity.score(long_docs, chain).count() == 5
