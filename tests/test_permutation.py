"""Chain assignment: planted permutations under a rigid motion are found."""

import numpy as np

from siltstone.operators import permutation


def structure_rows(seed, order, hidden=()):
    """A2B3 with the true copies of B dealt by ``order`` and all points moved."""
    draw = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(draw.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    shape = {"a": draw.normal(size=(20, 3)) * 3, "b": draw.normal(size=(15, 3)) * 3}
    chains = [("a", "A"), ("a", "B"), ("b", "C"), ("b", "D"), ("b", "E")]
    true = {c: shape[e] + draw.normal(size=3) * 40 for e, c in chains}
    stands = dict(zip("ABCDE", order))
    rows = []
    for e, c in chains:
        moved = true[stands[c]] @ turn + 5.0
        for k in range(len(moved)):
            seen = true[c][k].tolist() if c not in hidden else [None] * 3
            rows.append((seed, e, c, k, *moved[k].tolist(), *seen))
    return rows, stands


NAMES = "structure long, entity string, chain string, atom int, px double, py double, pz double, tx double, ty double, tz double"


def test_planted_orders(spark):
    rows, want = [], {}
    for seed, order in enumerate(["ABCDE", "BACDE", "ABDEC", "BAEDC", "BADCE"]):
        more, stands = structure_rows(seed, order)
        rows += more
        want |= {(seed, c): s for c, s in stands.items()}
    got = permutation.match_chains(spark.createDataFrame(rows, NAMES)).collect()
    assert {(r.structure, r.chain): r.matched for r in got} == want
    assert max(r.rmsd for r in got) < 1e-6


def test_unresolved_and_unanchored(spark):
    rows, _ = structure_rows(7, "ABCDE", hidden="E")
    got = {r.chain: r for r in permutation.match_chains(spark.createDataFrame(rows, NAMES)).collect()}
    assert {c: r.matched for c, r in got.items()} == {c: c for c in "ABCDE"} and got["E"].rmsd == 0.0
    rows, _ = structure_rows(8, "ABCDE", hidden="ABCDE")
    got = permutation.match_chains(spark.createDataFrame(rows, NAMES)).collect()
    assert all(r.chain == r.matched and r.rmsd is None for r in got) and len(got) == 5
    assert permutation.match_chains(spark.createDataFrame([], NAMES)).count() == 0
