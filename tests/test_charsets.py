import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from glyphvein.operators.runs import run_batches, scanner
from glyphvein.plans import queries as core
from glyphvein.sources import chunks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("encoding", sorted(core.OWN))
def test_texts_are_put_into_a_charset_in_portions(encoding, monkeypatch):
    """Text by text what a replacement of characters and Python's codec give, whatever comes at once; what is sent on stays small."""
    monkeypatch.setattr(chunks, "PORTION", 300)
    codec, letters, to, own = core._shown_as(encoding)
    rng = np.random.default_rng(5)
    signs = [*"abcxyz AZ09~\t\n\x00\x1b\x7f" + to[:6] + own[:6] + "­€𠀀😀ｱ한"]
    texts = ["".join(rng.choice(signs, k)) for k in rng.integers(0, 60, 200)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), pa.array(texts)], ["path", "text"])
    out = list(chunks.charset(codec, letters, to, own)(iter([batch.slice(3), batch.slice(0, 3)])))
    shown = lambda t: re.sub(f"[^\\t\\n -~{own}]", "", t).translate(str.maketrans(letters[: len(to)], to[: len(letters)]))
    wanted = {str(i): None if t is None else shown(t).encode(codec, "ignore") for i, t in enumerate(texts)}
    assert {p: b for part in out for p, b in zip(*part.to_pydict().values(), strict=True)} == wanted
    assert max(part.num_rows for part in out) < 100 and len(out) > 10


def test_charset_scans_are_one_pass_of_python(spark):
    for e in core.DOUBLE:
        plan = core.queries()[f"scan_{e.replace('-', '')}_documents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "regexp_replace" not in plan


@pytest.mark.parametrize("name", ["utf8", "gb18030", "iso2022-jp"])
def test_what_a_scan_holds_is_bounded(name):
    """Rows that come at once are scanned in small slabs: at most 80 MB for 16 MB of values."""
    line = "text of some length, é and ü\n".encode() * 100
    values = pa.array([line] * (-(-(16 << 20) // len(line))), pa.binary())
    paths = pa.array([""] * len(values))
    tracemalloc.start()
    n = sum(b.num_rows for b in run_batches([scanner(name, ("ascii",), 4)], values, {"path": paths}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= 100 * len(values) and peak < 80 << 20, peak
