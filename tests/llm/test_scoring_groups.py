import numpy as np
import pyarrow as pa

from glyphvein.llm import scoring


def _model(rng, bits=16):
    tree = scoring.Tree.of(rng.integers(0, 1000, scoring.WORDS) ** 3)
    none = np.zeros(0, np.int64)
    return scoring.Model(none, none.astype(np.int32), tree, bits, np.zeros((scoring.N_TABLES, 0), np.int8), None)


def test_passes_read_symbols_that_were_kept(spark):
    """Without the texts, from symbols coded once: counts of all slots against a count bit by bit, though a group of branches is counted once."""
    rng = np.random.default_rng(31)
    model = _model(rng)
    texts = [" ".join(rng.choice(["ab", "cde", "f", "é"], k)) for k in (0, 3, 40, 2000)] + [None]
    symbols, bounds = model.coded(*scoring.lowered(pa.array(texts, pa.string())))
    low, high = scoring.kept_symbols(symbols, bounds)
    kept = spark.createDataFrame(list(zip(low.to_pylist(), high.to_pylist(), strict=True)), "low binary, high binary").repartition(3)
    wanted = np.zeros((scoring.N_TABLES, 2 << model.bits), np.int64)
    for t in texts:
        symbols, bounds = model.coded(*scoring.lowered(pa.array([t], pa.string())))
        for i, s in enumerate(symbols.tolist()):
            for b in range(model.tree.length[s]):
                at = model.tree.first[s] + b
                packed = int(model.tree.packed[at])
                for k, c in enumerate(scoring.contexts(symbols, bounds)):
                    slot = ((int(c[i]) + int(model.tree.salt[at]) & 0xFFFFFFFF) >> 20) * 16 + (packed >> 1 & 15)
                    wanted[k, 2 * slot + (packed & 1)] += 1
    got = np.zeros_like(wanted)
    for r in scoring.context_counts(kept, spark.sparkContext.broadcast(model)).collect():
        got[r.model, 2 * r.stretch : 2 * (r.stretch + scoring.STRETCH)] = scoring._unpacked(bytes(r.counts), 2 * scoring.STRETCH)
    assert (got == wanted).all()


def test_kept_symbols_are_read_back():
    """Also those above two bytes, of a part of the rows, and of empty rows."""
    rng = np.random.default_rng(32)
    symbols, bounds = rng.integers(0, scoring.WORDS + scoring.MOST_WORDS, 1000).astype(np.int32), np.array([0, 0, 10, 10, 700, 1000])
    batch = pa.RecordBatch.from_arrays(scoring.kept_symbols(symbols, bounds), ["low", "high"])
    for i, n in ((0, 5), (1, 3), (4, 1)):
        got, at = scoring.symbols_in(batch.slice(i, n))
        assert (got == symbols[bounds[i] : bounds[i + n]]).all() and (at == bounds[i : i + n + 1] - bounds[i]).all()


def test_sums_of_a_cell_are_taken_apart(spark):
    """Sums that share a number, over more bits than are summed at once."""
    rng = np.random.default_rng(33)
    model = _model(rng)
    without = rng.integers(0, 64, (scoring.N_TABLES, 1 << model.bits)).astype(np.uint8)
    rows = [("ab cde f" * k,) for k in range(300)]
    docs = spark.createDataFrame(rows, "text string").repartition(1)
    got = {r.cell: (r.n, r.ones, r.prior) for r in scoring.cell_counts(docs, spark.sparkContext.broadcast((model, without))).collect()}
    wanted: dict[int, list[int]] = {}
    symbols, bounds = model.coded(*scoring.lowered(pa.array([t for (t,) in rows])))
    for cell, odds in scoring.cells_of(model, without, symbols, bounds):
        for c, o in zip(cell.tolist(), odds.tolist(), strict=True):
            row = wanted.setdefault(c >> 1, [0, 0, 0])
            row[0], row[1], row[2] = row[0] + 1, row[1] + (c & 1), row[2] + o
    assert got == {k: tuple(v) for k, v in wanted.items()} and max(v[2] for v in got.values()) > 0
    assert sum(v[0] for v in got.values()) > scoring.APART
