import hashlib
from collections import defaultdict

import models
import numpy as np
import pyarrow as pa
import pytest
from vectors import VECTORS

from glyphvein.encodings import ENCODINGS
from glyphvein.functions import codecs, filters
from glyphvein.operators.runs import Scanner, run_batches
from glyphvein.operators.scan import OUTPUT, merged, scan
from glyphvein.operators.stitch import parted, scan_chunks, stitched
from glyphvein.sources.chunks import cut


def _frame(spark, values):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in values.items()], "path string, bytes binary")


def _found(df):
    out = defaultdict(list)
    for r in df.select("path", "offset", "text").collect():
        out[r.path].append((r.offset, r.text))
    return {k: sorted(v) for k, v in out.items()}


GROUPS = sorted({v[1:4] for v in VECTORS})


@pytest.mark.parametrize(("encoding", "names", "least"), GROUPS)
def test_vectors_whole_and_in_chunks(spark, encoding, names, least):
    own = {v[0]: bytes.fromhex(v[4]) for v in VECTORS if v[1:4] == (encoding, names, least)}
    expected = {v[0]: v[5] for v in VECTORS if v[0] in own and v[5]}
    df = _frame(spark, own)
    assert _found(scan(df, encoding, names, least)) == expected
    assert _found(scan_chunks(cut(df, 4), encoding, names, least)) == expected


def _noise(seed, n):
    state, out = seed | 1, bytearray()
    for _ in range(n):
        state ^= state << 13 & 0xFFFFFFFFFFFFFFFF
        state ^= state >> 7
        state ^= state << 17 & 0xFFFFFFFFFFFFFFFF
        out.append(state >> 24 & 0xFF)
    return bytes(out)


#: Noise with much text in it, so that runs, cuts and wrong readings are frequent.
def _inputs(n, extra):
    rng = np.random.default_rng(5)
    parts = [b"abcd", b"\x00", b"\t ok", "日本語".encode("utf-8"), b"\x1b$B", b"F|K\\", b"\x1b(B", b"\x1b(J\\~", b"\x1b(I6@", b"\x1b", b"H\x00i\x00!\x00", b"\x810", b"\x810\x846", b"\x88b", b"0", *extra]
    out = {}
    for i in range(n):
        picked = [parts[k] if k < len(parts) else _noise(int(rng.integers(1 << 30)), int(rng.integers(1, 5))) for k in rng.integers(0, len(parts) + 4, int(rng.integers(1, 14)))]
        out[str(i)] = b"".join(picked) or b"\x00"
    return out


def test_patterns_agree_with_models(spark):
    values = _inputs(150, [bytes([0x81, 0xFE]), bytes([0xB6, 0xC0])])
    df = _frame(spark, values).cache()
    keep = lambda found: {k: sorted(v) for k, v in found.items() if v}
    assert _found(scan(df, "ascii", "ascii,latin1", 2)) == keep({k: models.ascii_runs(v, ("ascii", "latin1"), 2) for k, v in values.items()})
    assert _found(scan(df, "utf8", "ascii", 1)) == keep({k: models.utf8_runs(v, 1) for k, v in values.items()})
    for name in ("cp932", "euc-kr", "big5", "gb18030", "gbk"):
        assert _found(scan(df, name, "ascii", 1)) == keep({k: models.double_byte_runs(v, name, 1) for k, v in values.items()}), name
    for names in (("ascii",), ("printable",), ("ascii", "kanji")):
        assert _found(scan(df, "utf16le", names, 2)) == keep({k: models.utf16_resolved(v, names, 2) for k, v in values.items()}), names


def _rows(scanner, values):
    batches = run_batches([scanner], pa.array(list(values.values()), pa.binary()), {"path": pa.array(list(values))})
    return sorted(tuple(r.values()) for b in batches for r in b.to_pylist())


def test_shifted_runs_agree_with_the_model():
    parts = [b"ab", b"K", b"\x00", b"\x1b$B", b"\x1b$@", b"\x1b(B", b"\x1b(J", b"\x1b(I", b"\x1b", b"\x1b$", b"\x1b(", b"\x1b$A", b"F|", b"K\\", b"~\\", b"6@", b"\x7f", b"!", b" ", b"\t", b"\x80", b"zz\x1b(H"]
    rng = np.random.default_rng(7)
    for least in (1, 2, 4):
        values = {str(i): b"".join(parts[k] for k in rng.integers(0, len(parts), int(rng.integers(0, 25)))) for i in range(2000)}
        found = defaultdict(list)
        for r in _rows(Scanner("iso2022-jp", ("ascii",), least), values):
            found[r[0]].append((r[1], r[6]))
        assert found == {k: v for k, v in ((k, models.iso2022jp_runs(v, least)) for k, v in values.items()) if v}


#: Digests of all assigned two-byte sequences of each charset with what they stand for.
TABLES = {
    "cp932": "03382ad0127c624757fbccac3f7476f144212d682dd7eb139f69621248b89cdd",
    "gbk": "e136c29944aeac6107cb6c890376a3be32e10915a78df7334ab49b7efc3214c1",
    "euc-kr": "92904e503704c0bc6ce8827c0f0123bc8cfd220c2ff977c9c618b7c9a47d8320",
    "big5": "17fb673f8a5670dd022fd43de1f6529b0c5cf9870592cf13e4758591a569a857",
    "gb18030": "e136c29944aeac6107cb6c890376a3be32e10915a78df7334ab49b7efc3214c1",
}


@pytest.mark.parametrize("name", list(codecs.LEADS))
def test_every_pair(name):
    """Each of the 65,536 two-byte values, alone and between letters: what the model finds, one scalar a pair but for four of Big5's."""
    pairs = [bytes([a, b]) for a in range(256) for b in range(256)]
    for values in ({p.hex(): p for p in pairs}, {p.hex(): b"x" + p + b"y" for p in pairs}):
        found = defaultdict(list)
        for r in _rows(Scanner(name, ("ascii",), 1), values):
            found[r[0]].append((r[1], r[6]))
            assert r[5] == len(r[6])
        assert found == {k: v for k, v in ((k, models.double_byte_runs(v, name, 1)) for k, v in values.items()) if v}
    table = codecs.pair_table(name)
    assert sorted(k for k, t in table.items() if len(t) != 1) == (sorted(codecs.BIG5_DOUBLES) if name == "big5" else [])
    assert hashlib.sha256("\n".join(f"{k.hex()} {t}" for k, t in sorted(table.items())).encode()).hexdigest() == TABLES[name]


def _chunk_batch(rows):
    path, at, data, total = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(path), pa.array(at, pa.int64()), pa.array(data, pa.binary()), pa.array(total, pa.int64())], ["path", "chunk_off", "bytes", "file_len"])


@pytest.mark.parametrize("name", [e.name for e in ENCODINGS])
def test_every_chunk_size_without_spark(name):
    """Chunks of 1 byte up to more than the input, in order, shuffled, and in batches of any size; pieces dealt by stretches of 512 bytes."""
    values = {k: v[:90] for k, v in _inputs(40, [bytes([0x81, 0xFE])]).items()}
    scanner, rng = Scanner(name, ("ascii", "kanji", "cyrillic"), 2), np.random.default_rng(2)
    expected = _rows(scanner, values)
    for size in range(1, max(map(len, values.values())) + 3):
        rows = [(k, at, v[at : at + size], len(v)) for k, v in values.items() for at in range(0, len(v), size)]
        if size % 3:
            rows = [rows[i] for i in rng.permutation(len(rows))]
        per = len(rows) if size % 2 else int(rng.integers(1, 60))
        sent = pa.Table.from_batches(list(parted([_chunk_batch(rows[i : i + per]) for i in range(0, len(rows), per)], [scanner], 0, 128)))
        sent = sent.sort_by([(c, "ascending") for c in ("path", "encoding_code", "bucket", "start")]).combine_chunks()
        got = [tuple(r.values()) for b in stitched(sent.to_batches(max_chunksize=1 + size % 9), [scanner], 128) for r in b.to_pylist()]
        assert sorted(got) == expected, size


@pytest.mark.parametrize("size", [6])
def test_chunks_do_not_change_results(spark, size):
    df = _frame(spark, _inputs(60, [])).cache()
    for e in ENCODINGS:
        assert _found(scan_chunks(cut(df, size), e.name, "ascii,kanji,cyrillic", 2)) == _found(scan(df, e.name, "ascii,kanji,cyrillic", 2)), e.name


def test_long_run_and_order(spark):
    df = _frame(spark, {"a": b"\x00" + b"A" * 300_000 + b"\x00", "b": b"hello\x00" + "hi there".encode("utf-16-le")})
    runs = merged(scan(df, "ascii,utf16le-ascii")).collect()
    assert [(r.path, r.offset, r.encoding_code, r.cch) for r in runs] == [("a", 1, 0, 300_000), ("b", 0, 0, 5), ("b", 4, 1, 9)]
    assert tuple(runs[0].asDict()) == OUTPUT
    assert scan_chunks(cut(df, 4096), "ascii").where("path = 'a'").select("offset", "cch").collect() == [(1, 300_000)]


def test_many_escapes_and_long_islands(spark):
    """A million escapes in a row, before and between text; whole and in chunks that hold nothing else."""
    e = b"\x1b(B" * 1_000_000
    df = _frame(spark, {"a": b"\x00ab" + e + b"cd\x00" + e + b"wxyz" + e, "b": "日本".encode("iso2022_jp") * 1000})
    runs = {(r.path, r.offset): (r.cb, r.cch) for r in scan(df, "iso2022-jp", min_length=4).collect()}
    assert runs == {("a", 1): (3_000_004, 4), ("a", 3_000_006): (3_000_004, 4), ("b", 0): (9997, 2000)}
    assert {(r.path, r.offset): (r.cb, r.cch) for r in scan_chunks(cut(df, 1 << 16), "iso2022-jp").collect()} == runs


def test_slabs_give_the_runs_of_the_whole(spark, monkeypatch):
    from glyphvein.operators import runs as found

    values = _inputs(40, [])
    data = b"".join(values.values())
    expected = {e.name: None for e in ENCODINGS}
    for slab in (1 << 20, 64):
        monkeypatch.setattr(found, "SLAB", slab)
        for e in ENCODINGS:
            rows = [tuple(r.values()) for b in found.run_batches([found.Scanner(e.name, ("ascii", "kanji", "cyrillic"), 2)], pa.array([data]), {}) for r in b.to_pylist()]
            expected[e.name] = expected[e.name] or sorted(rows)
            assert sorted(rows) == expected[e.name] and rows


def test_empty_and_null_inputs(spark):
    df = spark.createDataFrame([("a", None), ("b", bytearray())], "path string, bytes binary")
    assert scan(df, "ascii,utf8").count() == 0
    with pytest.raises(ValueError):
        scan(df, "latin9")
    with pytest.raises(ValueError):
        scan(df, "ascii", min_length=0)


def test_table_sizes(spark):
    """How many characters each filter and how many sequences each code table has."""
    sizes = {"ascii": 96, "latin1": 96, "cyrillic": 256, "kanji": 27584, "kanji-jis1": 2965, "kanji-jis2": 6355, "kanji-ext-b": 42720, "hiragana": 91, "katakana": 96, "hangul": 11585, "cjkpunct": 196, "cjkpunct-all": 304, "printable": 253592}
    assert {n: filters.size(n) for n in filters.NAMES} == sizes
    assert {n: len(codecs.pair_table(n)) for n in codecs.LEADS} == {"cp932": 9604, "gbk": 23940, "euc-kr": 17048, "big5": 18476, "gb18030": 23940}
    assert len(codecs.kanji_pairs()) == 7336
    pinned = {"a8bc": 0x1E3F, "a6d9": 0xFE10, "fe59": 0x9FB4, "a6fe": 0xE79F}
    assert {k: ord(codecs.pair_table("gb18030")[bytes.fromhex(k)]) for k in pinned} == pinned
    assert codecs.four_points()[codecs.linear(*bytes.fromhex("8135f437"))] == 0xE7C7 and len(np.unique(codecs.four_points())) == codecs.FOUR_BMP
    assert codecs.pair_table("big5")[bytes.fromhex("87df")] == "\u9fcb" and codecs.pair_table("big5")[bytes.fromhex("8862")] == "\u00ca\u0304"
