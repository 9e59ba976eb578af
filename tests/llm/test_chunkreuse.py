"""Encoding by shared chunks against the plain library, over texts that bring joins into every position."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from glyphvein.llm import chunkreuse
from glyphvein.llm.chunkreuse import Encoder

SF, PATH = "/root/testdata/sf0.001", public_tokenizers.path("byte_bpe_50k.json")
SCRAPS = ["a", "b", "the ", " ", "  ", "\n", "\t", "\r\n", "é", "é é", "语", "𠀀", "'s", "'", "1", "!", ".", "<|endoftext|>", "\xa0", "　", "\x85", "\x1c", "​", "Ω ", "hello world "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _ids(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("average", [4, 16, 64, 256])
def test_ids_equal_the_library(library, average):
    rng = np.random.default_rng(average)
    own = Encoder(PATH, average, 2000)  # so little is remembered that much is forgotten
    for _ in range(25):
        texts = [None, *("".join(rng.choice(SCRAPS, n)) for n in rng.choice([0, 1, 5, 50, 500, 3000], 20))]
        assert [x.tolist() for x in own.encode(pa.array(texts, pa.string()))] == _ids(library, texts)


def test_long_texts_without_safe_places(library):
    texts = ["a" * 300_000, " " * 100_000, "语" * 100_000, "\t" * 50_000 + "x", "ab" * 100_000 + " end", "<|endoftext|>" * 5000]
    assert [x.tolist() for x in Encoder(PATH).encode(pa.array(texts))] == _ids(library, texts)


def test_decoding_equals_the_library(library):
    rng, own = np.random.default_rng(1), Encoder(PATH)
    for _ in range(500):
        ids = rng.integers(0, 50257, int(rng.integers(0, 30)))
        assert own.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_shared_passages_are_encoded_once(library):
    """Texts that share a passage, at different places, share its chunks: the second costs little, and a repeated text nothing."""
    rng = np.random.default_rng(5)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    passage, own = say(3000), Encoder(PATH)
    first = f"{say(40)} {passage}"
    own.encode(pa.array([first]))
    before = own.encoded_bytes
    second = f"{say(90)} {passage} {say(20)}"
    assert own.encode(pa.array([second]))[0].tolist() == _ids(library, [second])[0]
    assert own.encoded_bytes - before < 0.15 * len(second)
    before = own.encoded
    own.encode(pa.array([second, first]))
    assert own.encoded == before


def test_cuts_follow_content():
    rng = np.random.default_rng(6)
    shared = rng.integers(32, 127, 20_000).astype(np.uint8)
    a, b = (np.concatenate([rng.integers(32, 127, n).astype(np.uint8), shared]) for n in (100, 777))
    cuts = [set((chunkreuse.cuts(x, np.array([0, len(x)])) - n).tolist()) for x, n in ((a, 100), (b, 777))]
    inner = {c for c in cuts[0] if c > 64}
    assert len(inner) > 40 and inner == {c for c in cuts[1] if c > 64}
    assert (np.diff(chunkreuse.cuts(a, np.array([0, 50, 50, len(a)]))) > 0).all()


def test_memory_forgets_what_was_not_met():
    own = chunkreuse.Memory(100)
    for k in range(50):
        own.put(f"key-{k:03d}", k)
        assert own.get("key-000") == 0
    assert own.get("key-049") == 49 and own.get("key-001") is None and len(own.young) + len(own.old) < 35


def test_frames_and_query(spark, library):
    texts = [None, "", "two words", "end <|endoftext|> of", "é " * 4000, "x" * 5000, "two words"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(2)
    rows = chunkreuse.decode_ids(chunkreuse.encode_texts(df, PATH), PATH).collect()
    assert {r.doc_id: (r.ids, r.decoded) for r in rows} == {i: (e, t or "") for i, (t, e) in enumerate(zip(texts, _ids(library, texts), strict=True))}
    assert chunkreuse.digests(df.where("false"), PATH).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = _ids(library, [d.text for d in docs])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = sorted((d.doc_id, len(e), sha(np.array(e, "<u4").tobytes()), sha(library.decode(e, skip_special_tokens=False).encode())) for d, e in zip(docs, ids, strict=True))
    assert sorted(map(tuple, chunkreuse.op11_chunk_reuse(spark, SF).collect())) == expected


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        Encoder(public_tokenizers.path("word_bpe_49k.json"))
