import numpy as np
import pandas as pd
import pyarrow as pa

from glyphvein.operators.scan import asked, scanners
from glyphvein.operators.stitch import parted
from glyphvein.streaming.chunks import Strings

WANTED = asked("utf8", "ascii", 2)


class Store(dict):
    """Keyed state that counts what is asked of it."""

    calls = 0

    def getValue(self, key):
        Store.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        Store.calls += 1
        self[key] = value

    def removeKey(self, key):
        Store.calls += 1
        del self[key]


class Handle:
    def getMapState(self, *_):
        return Store()


def _pieces(values, size):
    rows = [(p, at, v[at : at + size], len(v)) for p, v in values.items() for at in range(0, len(v), size)]
    parts = []
    for p, at, data, total in rows:
        batch = pa.RecordBatch.from_arrays([pa.array([p]), pa.array([at]), pa.array([data], pa.binary()), pa.array([total])], ["path", "chunk_off", "bytes", "file_len"])
        parts += [b.to_pandas() for b in parted([batch], scanners(WANTED), 0, 1 << 60, True)]
    return pd.concat(parts)


def test_many_inputs_share_a_key_and_whole_strings_are_no_state():
    """All inputs of a key in one call: strings whole within the rows at hand ask nothing of the state; in any order over calls all come, and nothing stays."""
    rng = np.random.default_rng(8)
    values = {f"p{i}": "".join(rng.choice([*"abé \n\x00"], rng.integers(1, 200))).encode() for i in range(60)} | {"long": b"x" * 300, "edge": b"\nab" * 40}
    pieces = _pieces(values, 7)
    wanted = None
    for calls in (1, 2, 9):
        strings = Strings(WANTED)
        strings.init(Handle())
        Store.calls = 0
        order = rng.permutation(len(pieces))
        got = [tuple(r) for k in range(calls) for out in strings.handleInputRows((0, scanners(WANTED)[0].encoding.code), iter([pieces.iloc[order[k::calls]]]), None) for r in out.itertuples(index=False)]
        assert not strings.onward and not strings.backward
        assert calls > 1 or Store.calls == 0
        wanted = wanted or sorted(got)
        assert sorted(got) == wanted and any(r[0] == "long" and r[4] == 300 for r in got)
