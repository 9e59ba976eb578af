"""Fill-in-middle forms against a step-by-step version, and the frames by themselves."""

import hashlib
import re

import numpy as np
import pytest

from glyphvein.llm import infill
from glyphvein.llm.infill import Frames

SF = "/root/testdata/sf0.001"


def _form(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, said = len(units), hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(said[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text), text
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(out), sha(text), out


def _texts():
    rng = np.random.default_rng(3)
    mixed = "".join(rng.choice(list("abc <>PSM\n語é𠀀"), 200_000))
    return [None, "", "a", "é", "<P> x", "abc<", "<S", "a" * 200_000, mixed, "𠀀" * 70_000, "x " * 90_000, "tail<"]


def test_forms(spark):
    rows = [(i, t) for i, t in enumerate(_texts())] + [(1000 + i, t) for i, t in enumerate(_texts())] + [(None, "abc def"), (7, "ab"), (7, "ab"), (-5, "neg ative")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, form string, n long")  # names that the result has, too
    got = sorted(map(tuple, infill.infilled(df, texts=True).collect()), key=str)
    assert got == sorted((_form(*r) for r in rows), key=str)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert infill.infilled(df.where("false")).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = infill.op13_infill(spark, SF)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(_form(*r)[:-1] for r in docs)


@pytest.mark.parametrize("frame", [1, 2, 3, 7, 64, 1 << 16])
def test_frames(frame):
    """Cuts, ranges and searches at every place, for frames that cut letters' runs, characters and markers."""
    text = "ab c<P>é語𠀀x<S>yz  <M>end"
    raw, units = text.encode(), re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    for pieces in ([raw], [raw[:5], b"", raw[5:]], [raw[i : i + 1] for i in range(len(raw))]):
        own = Frames.of(iter(pieces), frame)
        assert b"".join(own.frame(k) for k in range(len(own.frames))) == raw and own.units[-1] == len(units) and own.chars[-1] == len(text)
        for u in range(len(units) + 1):
            before = "".join(units[:u])
            assert own.cut(u) == (len(before.encode()), len(before))
        for a in range(len(raw) + 1):
            assert all(b"".join(own.stream(a, b)) == raw[a:b] for b in range(a, len(raw) + 1))
        assert [own.find(m) for m in (b"<P>", b"<S>", b"<M>", b"<Q>")] == [raw.find(m) for m in (b"<P>", b"<S>", b"<M>", b"<Q>")]


def test_only_cut_frames_are_decompressed(monkeypatch):
    own = Frames.of(iter([b"ab cd " * 1000]), 64)
    seen = []
    frame = Frames.frame
    monkeypatch.setattr(Frames, "frame", lambda self, k: seen.append(k) or frame(self, k))
    own.cut(1777)
    assert len(seen) == 1 and len(own.frames) > 90


def test_damaged_output_is_an_error():
    with pytest.raises(ValueError):
        list(infill.restored(Frames.of(iter([b"<P>a<M>b<S>c"])), "psm"))
