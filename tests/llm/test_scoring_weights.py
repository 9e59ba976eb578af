import math

import numpy as np
import pyarrow as pa

from glyphvein.llm import scoring


def test_every_training_bit_fits_the_weights(spark):
    """Bits by gate, levels and turn, of all documents whatever their length and number: against a count one by one."""
    rng = np.random.default_rng(21)
    texts = [" ".join(rng.choice(["ab", "cde", "f"], k)) for k in (0, 3, 40, 9000)] + [None] + ["ab f"] * 300
    tree = scoring.Tree.of(rng.integers(0, 1000, scoring.WORDS))
    none = np.zeros(0, np.int64)
    model = scoring.Model(none, none.astype(np.int32), tree, 16, np.zeros((scoring.N_TABLES, 0), np.int8), None)
    without = rng.integers(0, 64, (scoring.N_TABLES, 1 << 16)).astype(np.uint8)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {r.cell: (r.n, r.ones, r.prior) for r in scoring.cell_counts(docs, spark.sparkContext.broadcast((model, without))).collect()}
    wanted: dict[int, list[int]] = {}
    for t in texts:
        symbols, bounds = model.coded(*scoring.lowered(pa.array([t], pa.string())))
        found = scoring.contexts(symbols, bounds)
        for i, s in enumerate(symbols.tolist()):
            for b in range(tree.length[s]):
                at = tree.first[s] + b
                packed = int(tree.packed[at])
                turn, cell = packed & 1, packed >> 5
                for k, c in enumerate(found):
                    slot = ((int(c[i]) + int(tree.salt[at]) & 0xFFFFFFFF) >> 20) * 16 + (packed >> 1 & 15)
                    cell = cell * 8 + (int(without[k, slot]) >> 3 * turn & 7)
                row = wanted.setdefault(cell, [0, 0, 0])
                row[0], row[1], row[2] = row[0] + 1, row[1] + turn, row[2] + round(float(tree.prior[at] / np.float32(scoring.STEP)))
    assert {k: tuple(v) for k, v in wanted.items()} == got


def test_a_bit_is_left_out_of_its_own_prediction():
    both = np.array([0, 0, 1, 0, 0, 1, 3, 50, 400, 2])
    for slot, x in enumerate(scoring.left_out(both).tolist()):
        zero, one = both[2 * slot : 2 * slot + 2].tolist()
        for turn in (0, 1):
            odds = math.log((max(one - turn, 0) + 0.4) / (max(zero - 1 + turn, 0) + 0.4))
            assert abs(scoring.LEVELS - odds).argmin() == x >> 3 * turn & 7


def test_weights_are_at_their_optimum():
    """No gradient is left at any gate that has bits; other gates keep where they began."""
    rng = np.random.default_rng(22)
    cell = np.unique(np.r_[rng.integers(0, 40 << 3 * scoring.N_TABLES, 5000)])
    n = rng.integers(1, 200, len(cell))
    ones = rng.binomial(n, 0.3)
    prior = rng.normal(0, 1, len(cell))
    weights = np.full((scoring.N_INPUTS, scoring.GATES), 0.3, np.float32)
    scoring.fit_weights(weights, cell, n, ones, prior)
    x = np.stack([*(scoring.LEVELS[cell >> 3 * k & 7] for k in (3, 2, 1, 0)), prior, np.ones(len(cell))])
    for g in range(40):
        mine = cell >> 12 == g
        w = weights[:, g].astype(float)
        left = x[:, mine] @ (n[mine] / (1 + np.exp(-(w @ x[:, mine]))) - ones[mine]) + scoring.RIDGE * (w - 0.3)
        assert abs(left).max() < 1e-2 * n[mine].sum()
    assert (weights[:, 40:] == np.float32(0.3)).all()
