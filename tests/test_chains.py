"""Draws, symmetries, templates, alignments, crops, motions and errors against
plain versions, with their edges."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import alignments, clashes, cropping, deviation, motion, patterns, sampling, symmetry
from siltstone.operators.ordered import as_of, prefix_sums
from siltstone.operators.sidechain import RESIDUE_ATOMS, SPINES, bonds_of
from siltstone.operators.structure import ATOM_SLOTS
from siltstone.plans import chains

SF = "/root/testdata/sf0.001"


def test_draws_follow_weights_seed_and_epoch(spark):
    weights = [0.0, None, -1.0, 5.0, 1.0, 3.0, 991.0]
    df = spark.createDataFrame(list(enumerate(weights)), "k long, w double")
    draw = lambda **how: sampling.draw_with_replacement(df.repartition(3), "k", F.col("w"), 20_000, **how)
    got = {r.k: r.n for r in draw(seed=1).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(got) == {3, 4, 5, 6} and sum(got.values()) == 20_000
    assert all(abs(got[k] - 20 * weights[k]) < 6 * (20 * weights[k]) ** 0.5 + 1 for k in got)
    plain = lambda rows: sorted((r.draw, r.k) for r in rows.collect())
    assert plain(draw(seed=1)) == plain(draw(seed=1, replicas=3)) != plain(draw(seed=1, epoch=1)) != plain(draw(seed=2))
    parts = draw(seed=1, replicas=3).select("draw", "replica", "step").collect()
    assert all(r.draw == 3 * r.step + r.replica for r in parts)
    assert sampling.draw_with_replacement(df.limit(0), "k", F.col("w"), 9, seed=1).count() == 0


def test_prefix_sums_and_as_of(spark):
    rows = [(i, random.Random(i).randint(0, 9)) for i in range(500)]
    got = {r.i: r.before for r in prefix_sums(spark.createDataFrame(rows, "i long, v long").repartition(5), [F.col("i")], "v", "before").collect()}
    assert got == {i: sum(v for _, v in rows[:i]) for i in range(500)}
    marks = spark.createDataFrame([(10, 0), (20, 1), (20, 2)], "at long, m long")
    asked = spark.createDataFrame([(k,) for k in (1, 10, 15, 20, 99)], "at long")
    assert sorted((r.at, r.mark) for r in as_of(asked, marks, "at", F.col("m")).filter("mark IS NOT NULL").collect()) == [(10, 0), (15, 0), (20, 2), (99, 2)]


def all_orders(colours, bonds):
    """By trying every order within each colour."""
    edges = {frozenset(b) for b in bonds}
    groups = {}
    for i, c in enumerate(colours):
        groups.setdefault(c, []).append(i)
    out = []
    for images in itertools.product(*[itertools.permutations(g) for g in groups.values()]):
        order = [0] * len(colours)
        for g, image in zip(groups.values(), images):
            for i, k in zip(g, image):
                order[i] = k
        if {frozenset((order[a], order[b])) for a, b in bonds} == edges:
            out.append(order)
    return sorted(out)


def test_symmetries_are_all_orders(spark):
    found = symmetry.residue_symmetries()
    assert len(found) == 20
    for residue, names in RESIDUE_ATOMS.items():
        atoms = names.split()
        pairs = [*symmetry.BACKBONE, *[(a, b) for a, b, _ in bonds_of(residue)], *([("CD", "N")] if residue == "PRO" else [])]
        bonds = [(atoms.index(a), atoms.index(b)) for a, b in pairs if a in atoms and b in atoms]
        if len(atoms) <= 12:
            # elements and the count of bonds narrow the orders to try
            degree = [sum(i in b for b in bonds) for i in range(len(atoms))]
            assert found[residue] == all_orders([(a[0], d) for a, d in zip(atoms, degree)], bonds), residue
        assert found[residue][0] == list(range(len(atoms)))
    assert len(found["PHE"]) == 2 and len(found["ARG"]) == 2 and len(found["TRP"]) == 1
    ring = symmetry.symmetries(["C"] * 6 + ["F"] * 6, [(i, (i + 1) % 6) for i in range(6)] + [(i, i + 6) for i in range(6)])
    assert len(ring) == 12 and len(symmetry.symmetries(["C"] * 9, [], most=50)) == 50


def test_best_order_after_the_fit(spark):
    draw = np.random.default_rng(3)
    rows, want = [], {}
    names = list(RESIDUE_ATOMS)
    orders = symmetry.residue_symmetries() | {"LIG": symmetry.symmetries(["C", "O", "O", "O"], [(0, 1), (0, 2), (0, 3)])}
    turn = np.linalg.qr(draw.standard_normal((3, 3)))[0]
    turn[:, 0] *= np.sign(np.linalg.det(turn))
    for k, residue in enumerate([*names, "LIG", "LIG", "ZZZ"]):
        n = 4 if residue in ("LIG", "ZZZ") else len(RESIDUE_ATOMS[residue].split())
        true = draw.standard_normal((n, 3)) * 3 + k
        order = orders.get(residue, [list(range(n))])[-1]
        predicted = (true[order] - 5) @ turn.T + 0.001 * draw.standard_normal((n, 3))
        seen = [p.tolist() if j or k % 4 else None for j, p in enumerate(true)]
        rows.append((k, residue, predicted.tolist(), seen))
        want[k] = order
    df = spark.createDataFrame(rows, "k int, residue string, p array<array<double>>, q array<array<double>>")
    flat = df.select(F.lit(1).alias("structure"), F.posexplode("p").alias("j", "a"), F.col("q")).withColumn("b", F.get("q", F.col("j")))
    flat = flat.filter("j < 4").select("structure", *[F.get("a", F.lit(i)).alias(f"a{i}") for i in range(3)], *[F.get("b", F.lit(i)).alias(f"b{i}") for i in range(3)])
    fit = motion.fitted_motion(flat, ["structure"], ["a0", "a1", "a2"], ["b0", "b1", "b2"]).first()
    assert np.allclose(np.array(fit.turn).reshape(3, 3) @ np.array(fit.turn).reshape(3, 3).T, np.eye(3))
    moved = df.withColumn("p", F.transform("p", lambda x: motion.moved(x, F.array(*map(F.lit, fit.turn)), F.array(*map(F.lit, fit.shift)))))
    best = {r.k: r.best for r in symmetry.with_best_order(moved, "residue", "p", "q", symmetry.symmetry_table(spark, {"LIG": orders["LIG"]})).collect()}
    far = [k for k in want if k not in (20, 21)]  # the ligands' first four atoms are what the fit takes as named
    assert all(best[k].order == want[k] for k in far if k % 4), {k: (best[k].order, want[k]) for k in far if best[k].order != want[k]}
    assert all(best[k].rmsd <= best[k].before for k in want)


def test_fit_is_exact(spark):
    draw = np.random.default_rng(1)
    a = draw.standard_normal((30, 3))
    turn = np.linalg.qr(draw.standard_normal((3, 3)))[0]
    turn[:, 0] *= np.sign(np.linalg.det(turn))
    b = a @ turn.T + [1, 2, 3]
    rows = [(n % 2, *map(float, x), *map(float, y)) for n, (x, y) in enumerate(zip(a, b))] + [(0, None, 1.0, 1.0, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "g int, a0 double, a1 double, a2 double, b0 double, b1 double, b2 double")
    for r in motion.fitted_motion(df, ["g"], ["a0", "a1", "a2"], ["b0", "b1", "b2"]).collect():
        assert np.allclose(np.array(r.turn).reshape(3, 3), turn) and np.allclose(r.shift, [1, 2, 3])


def test_rotations_are_uniform_and_repeatable(spark):
    df = spark.range(3000).select("id", F.array(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.lit(None), F.array(F.lit(-1.0), F.lit(0.0), F.lit(0.0))).alias("p"))
    made = motion.random_motion(df, "id", "p", "s", 0.0)
    rows = made.collect()
    turns = np.array([r.turn for r in rows]).reshape(-1, 3, 3)
    assert np.allclose(turns @ np.transpose(turns, (0, 2, 1)), np.eye(3)) and np.allclose(np.linalg.det(turns), 1)
    ends = turns[:, :, 0]
    assert abs(ends.mean(0)).max() < 0.05 and abs((ends**2).mean(0) - 1 / 3).max() < 0.03
    assert all(r.p[1] is None and np.allclose(r.p[0], -np.array(r.p[2])) for r in rows)
    again = {r.id: r.turn for r in motion.random_motion(df.repartition(7), "id", "p", "s", 0.0).collect()}
    assert all(again[r.id] == r.turn for r in rows)


def test_first_matches_are_the_regular_expression():
    draw = random.Random(4)
    for _ in range(300):
        chain = "".join(draw.choices("ABX", k=draw.randint(0, 60)))
        some = ["".join(draw.choices("ABX", k=draw.randint(0, 6))) for _ in range(draw.randint(0, 9))]
        want = []
        for p in some:
            m = re.search("".join("." if c == "X" else f"(?:{c}|X)" for c in p), chain)
            want.append(m.start() if m else -1)
        assert patterns.first_matches(some, chain) == want


def test_template_order_of_matches(spark):
    chain = [("e", 1, "A", "MKVLTT"), ("e", 2, "B", "GGMKVLTT"), ("e", 3, "C", "MXVPPP"), ("f", 1, "A", ""), ("g", 1, "A", None)]
    wanted = [("e", "named", "B", "MKV"), ("e", "other", "C", "GGM"), ("e", "wild", "A", "MKVPP"), ("e", "wild2", "A", "GXMK"), ("e", "none", "A", "WWW"), ("f", "empty", "A", "M"), ("h", "no entry", "A", "M"), ("g", "null", "A", None)]
    t = spark.createDataFrame(wanted, "entry string, template string, chain string, pattern string")
    c = spark.createDataFrame(chain, "entry string, number int, chain string, seq string")
    got = {r.template: (r.chain, r.place, r.how) for r in patterns.find_templates(t, c).collect()}
    no = (None, None, None)
    assert got == {"named": ("B", 2, "exact"), "other": ("B", 0, "sequence"), "wild": ("C", 0, "wildcard"), "wild2": ("B", 0, "wildcard"), "none": no, "empty": no, "no entry": no, "null": no}


def test_alignment_edges(spark):
    rows = [(1, 0, "q", "A-C-"), (1, 1, "a", "AGC-"), (1, 2, "b", "--C-"), (1, 3, "a", "T"), (2, 0, "q", "----"), (2, 1, "r", "----")]
    df = spark.createDataFrame(rows, "alignment int, row int, name string, seq string")
    plain = lambda d: sorted(map(tuple, d.select("alignment", "row", "seq").collect()))
    assert plain(alignments.without_empty_columns(df)) == [(1, 0, "A-C"), (1, 1, "AGC"), (1, 2, "--C"), (1, 3, "T"), (2, 0, ""), (2, 1, "")]
    assert plain(alignments.without_copies(df)) == [(1, 0, "A-C-"), (1, 2, "--C-"), (1, 3, "T"), (2, 0, "----")]
    assert [r[1] for r in plain(alignments.first_rows(df, 2))] == [0, 1, 3, 0, 1]
    wide = spark.createDataFrame([(1, r, "n", "".join("A" if (c * 7 + r) % 11 == 0 else "-" for c in range(200))) for r in range(3)], "alignment int, row int, name string, seq string")
    keep = [c for c in range(200) if any((c * 7 + r) % 11 == 0 for r in range(3))]
    assert plain(alignments.without_empty_columns(wide)) == [(1, r, "".join("A" if (c * 7 + r) % 11 == 0 else "-" for c in keep)) for r in range(3)]
    with pytest.raises(ValueError):
        alignments.merged(df, "other", {})


def test_crop_edges(spark):
    rows = [(1, n, n // 3, n // 2, float(n) if n < 7 else None, 0.0, 0.0) for n in range(9)] + [(2, 0, 0, 0, None, None, None)]
    df = spark.createDataFrame(rows, "structure int, token int, chain int, residue int, x double, y double, z double")
    crop = cropping.spatial_crop(df, 4, "s", radius=1.5).collect()
    assert len(crop) == 4 and {r.structure for r in crop} == {1}  # nothing is resolved in the other
    centre = crop[0].centre
    assert centre in (2, 3, 5, 6) and centre in {r.token for r in crop}
    assert cropping.spatial_crop(df, 99, "s").count() == 9
    whole = cropping.spatial_crop(df, 3, "s", interface=False, whole=F.lit(True)).collect()
    assert len(whole) % 2 == 0
    assert cropping.nearest_chains(df.withColumn("molecule", F.col("chain")), "s").count() == 0
    apart = df.withColumn("molecule", F.col("chain")).withColumn("x", F.col("chain") * 100.0).withColumn("y", F.lit(0.0)).withColumn("z", F.lit(0.0))
    assert {r.kept for r in cropping.nearest_chains(apart, "s", most_chains=2).collect()} == {False}


def test_clashes_of_many_close_pairs(spark):
    rows = [(1, c, "prot", c, f"C{n}", "C", c * 0.5 + n * 0.0, 0.0, float(n % 3)) for c in range(2) for n in range(30)] + [(1, 2, None, 9, "X", "C", 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "structure int, chain int, kind string, molecule int, atom string, element string, x double, y double, z double")
    (r,) = clashes.chain_clashes(df).collect()
    near = [(a, b) for a in rows[:30] for b in rows[30:60] if sum((a[k] - b[k]) ** 2 for k in (6, 7, 8)) < 1.21]
    assert r.close_pairs == len(near) and r.close_clash and r.vdw_clash and abs(r.nearest - 0.5 / 3.4) < 1e-9


def chi(points):
    b = np.diff(points, axis=0)
    n1, n2 = np.cross(b[0], b[1]), np.cross(b[1], b[2])
    return np.arctan2(np.dot(np.cross(n1, n2), b[1] / np.linalg.norm(b[1])), np.dot(n1, n2))


def test_errors_by_residue(spark):
    rows = chains.residues(spark, SF).limit(60).collect()
    got = {r.vec_id: r for r in deviation.residue_errors(chains.residues(spark, SF).filter(F.col("vec_id").isin([r.vec_id for r in rows])), "residue", "p", "q").collect()}
    for r in rows:
        p, q = np.array(r.p), np.array(r.q)
        other = p.copy()
        for pair in deviation.SWAPS.get(r.residue, "").split():
            a, b = (ATOM_SLOTS.index(x) for x in pair.split("-"))
            other[[a, b]] = other[[b, a]]
        off = [np.sqrt(((x - q) ** 2).sum(1).mean()) for x in (p, other)]
        best = other if off[1] < off[0] else p
        path = ["N", "CA", "CB", *SPINES.get(r.residue, "").split()]
        turns = []
        for k in range(len(path) - 3):
            at = [ATOM_SLOTS.index(x) for x in path[k : k + 4]]
            d = abs(chi(best[at]) - chi(q[at]))
            turns.append(np.degrees(min(d, 2 * np.pi - d)))
        assert abs(got[r.vec_id].rmsd - min(off)) < 1e-9
        assert (got[r.vec_id].chi_mae is None) == (not turns) and (not turns or abs(got[r.vec_id].chi_mae - np.mean(turns)) < 1e-3)
    gaps = spark.createDataFrame([("ALA", [None] * 37, [None] * 37), ("XYZ", [[0.0] * 3] * 37, [[float("nan")] * 3] * 37)], "residue string, p array<array<double>>, q array<array<double>>")
    assert all(r.rmsd is None and r.bond_mse is None and r.chi_mae is None for r in deviation.residue_errors(gaps, "residue", "p", "q").collect())
