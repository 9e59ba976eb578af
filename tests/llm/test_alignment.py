"""Alignment against a step-by-step version by the plain libraries, and its minimal perfect hash."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from glyphvein.llm import alignment

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}

    def tokens(text):
        if not text:
            return [], [], [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        said = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        whole = (" " + text).encode()
        return (*ids, *said) if b"".join(said[0]) == whole == b"".join(said[1]) else ([], [], [], [])

    def run(rows):
        counts, found = Counter(), []
        for doc, text in rows:
            ids_a, ids_b, said_a, said_b = tokens(text)
            links, groups, i, j = [], [], 0, 0
            end, open_ = [len(s[0]) if s else 0 for s in (said_a, said_b)], ([], [])
            while i < len(ids_a):  # both tokens reach over the place that we are at
                links.append((i, j))
                step = end[0] <= end[1], end[1] <= end[0]
                if step[0]:
                    open_[0].append(ids_a[i])
                if step[1]:
                    open_[1].append(ids_b[j])
                if all(step):
                    groups.append("|".join(",".join(map(str, o)) for o in open_))
                    open_ = [], []
                i, j = i + step[0], j + step[1]
                end = [end[0] + (len(said_a[i]) if step[0] and i < len(ids_a) else 0), end[1] + (len(said_b[j]) if step[1] and j < len(ids_b) else 0)]
            pairs = [(ids_a[i], ids_b[j]) for i, j in links]
            counts.update(pairs)
            found.append((doc, ids_a, ids_b, groups, pairs))
        best = Counter()
        for (_, y), n in counts.items():
            best[y] = max(best[y], n)
        sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
        return sorted(((d, len(x), len(y), len(g), len(p), sum(counts[q] == best[q[1]] for q in p), sum(counts[q] for q in p), sha(g)) for d, x, y, g, p in found), key=str)

    return run


def _rows():
    rng = np.random.default_rng(3)
    texts = [None, "", " ", "a", "é", "▁a", "a ", "<s> </s> <|endoftext|>", "a\0b", "\n\t x  y", "a" * 2000, "".join(rng.choice(list("abc <>PSM\n語é  𠀀\xa0"), 800)), "𠀀" * 300, "x " * 900, " <unk>", "<0x41>", "word's  end..."]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "abc def"), (7, "ab"), (7, "ab")]


@pytest.mark.parametrize(("shard", "most"), [(1 << 17, 1 << 22), (40, 150)])
def test_alignment(spark, brute, shard, most):
    """In one round and in several, whose sums add up."""
    df = spark.createDataFrame([(*r, 1) for r in _rows()], "doc_id long, text string, n_a int").repartition(3)
    got = sorted(map(tuple, alignment.align(df, A, B, shard, most).collect()), key=str)
    assert got == brute(_rows())


def test_query_and_empty_table(spark, brute):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, alignment.op12_alignment(spark, SF).collect()), key=str)
    assert got == brute(docs)
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_a_long_text_by_units(brute):
    """More than a batch of text, with and without spaces: units give what the libraries give for the whole."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    texts = [" ".join("".join(rng.choice(list("abcdefghé"), 5)) for _ in range(60_000)), "ab" * 50_000, " " * 3000 + "x"]
    a, b = alignment.Merged(A), alignment.Pieces(B)
    ids = alignment.both(pa.array(texts), a, b)
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    assert [x.tolist() for x in ids[0]] == [whole.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in ids[1]] == b.library.encode(texts)


def test_minimal_perfect_hash():
    rng = np.random.default_rng(9)
    keys = np.unique(rng.integers(0, 1 << 40, 20_000))
    shards = 7
    rows = []
    for k in range(shards):
        own = keys[alignment.shard_of(alignment._hash(keys), shards) == k]
        sizes, words, ordered = alignment.levels_of(own)
        assert sorted(ordered.tolist()) == sorted(own.tolist())
        rows.append((k, sizes, words, ordered))
    whole = alignment.Perfect.of(rows, shards)
    index = whole.index(keys)
    assert sorted(index.tolist()) == list(range(len(keys))) and (whole.keys[index] == keys).all()
    assert 64 * len(whole.words) < 6 * len(keys)
    part = alignment.Perfect.of(rows[2:4], shards)
    here = np.isin(alignment.shard_of(alignment._hash(keys), shards), (2, 3))
    assert (part.index(keys) >= 0).tolist() == here.tolist()
    strange = np.setdiff1d(rng.integers(0, 1 << 40, 1000), keys)
    with pytest.raises(ValueError):
        whole.index(strange)
    with pytest.raises(ValueError):
        alignment.levels_of(np.array([5, 5]))


def test_rounds():
    assert alignment.rounds_of([(2, 5), (0, 4), (1, 4), (3, 20)], 8) == [[0, 1], [2], [3]]
