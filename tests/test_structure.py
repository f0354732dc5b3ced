"""Slots, frames and clash removal against cases by hand and a plain scan."""

import math
import random

from pyspark.sql import functions as F

from siltstone.operators import sidechain, structure


def test_atom37(spark):
    rows = [("A", 1, "ATOM", "MSE", "SE", 1.0, 0), ("A", 1, "ATOM", "MSE", "CA", 2.0, 1), ("A", 1, "ATOM", "MSE", "CA", 3.0, 2),
            ("A", 2, "HETATM", "ALA", "CA", 9.0, 3), ("A", 3, "ATOM", "XYZ", "CA", 9.0, 4), ("A", 4, "ATOM", " gly ", "n", 4.0, 5), ("A", 4, "ATOM", "GLY", "QQ", 5.0, 6)]
    df = spark.createDataFrame(rows, "chain string, number int, group string, residue string, atom string, x double, at int").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    got = {r.number: r for r in structure.atom37(df, ["chain", "number"], "at").collect()}
    assert sorted(got) == [1, 4] and got[1].residue == "MET" and len(got[1].slots) == 37
    slots = structure.ATOM_SLOTS
    assert got[1].slots[slots.index("SD")] == [1.0, 0.0, 0.0] and got[1].slots[slots.index("CA")][0] == 3.0
    assert sum(got[1].mask) == 2 and math.isnan(got[1].slots[0][0]) and got[4].mask[0] and sum(got[4].mask) == 1


def test_torsion(spark):
    points = lambda *p: [F.array(*[F.lit(float(x)) for x in q]) for q in p]
    for degrees in (-170, -60, 0, 45, 90, 180):
        r = math.radians(degrees)
        four = points((1, 0, 0), (0, 0, 0), (0, 0, 1), (math.cos(r), math.sin(r), 1))
        got = structure.with_torsion(spark.range(1), *four, "t").first().t
        assert abs(got.sin - math.sin(r)) < 1e-6 and abs(got.cos - math.cos(r)) < 1e-6


def scanned(chains, atoms, hits, core):
    gone = []
    for a, i in enumerate(chains):
        for j in chains[a + 1 :]:
            if i in gone or j in gone:
                continue
            x, y = hits.get((i, j), 0) / atoms[i], hits.get((j, i), 0) / atoms[j]
            if max(x, y) <= 0.3:
                continue
            if (i in core) != (j in core):
                gone.append(j if i in core else i)
            else:
                gone.append(min((-x, atoms[i], j), (-y, atoms[j], i))[2] == j and i or j)
    return gone


def test_clash_removals(spark):
    draw = random.Random(3)
    rows, want = [], set()
    for s in range(40):
        chains = [chr(65 + k) for k in range(draw.randint(2, 7))]
        atoms = {c: draw.choice([10, 20]) for c in chains}
        hits = {(i, j): draw.randint(0, 8) for i in chains for j in chains if i != j}
        core = set(draw.sample(chains, draw.randint(0, 2)))
        want |= {(s, c) for c in scanned(chains, atoms, hits, core)}
        rows += [(s, i, j, hits[i, j], hits[j, i], atoms[i], atoms[j], i in core, j in core) for i in chains for j in chains if i < j]
    names = ["structure", "i", "j", "hits_i", "hits_j", "atoms_i", "atoms_j", "core_i", "core_j"]
    got = structure.clash_removals(spark.createDataFrame(rows, names), *names)
    assert {tuple(r) for r in got.collect()} == want and want


def test_delete_blocks_keeps_first(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 5)
    got = structure.delete_blocks(df, "g", [F.col("id")], 3, 0.4, "s").collect()
    assert {r.id for r in got} >= set(range(5)) and len(got) < 100
    assert structure.delete_blocks(df, "g", [F.col("id")], 3, 0.0, "s").count() == 100


def test_clash_removals_query(spark):
    from collections import Counter, defaultdict

    from siltstone.plans.queries import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r.label, [10 * float(x) for x in r.embedding[:3]], r.vec_id) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    atoms, near = Counter(r[0] for r in rows), defaultdict(set)
    for i, p, a in rows:
        for j, q, _ in rows:
            if i != j and math.dist(p, q) <= 0.9:
                near[i, j].add(a)
    want = scanned(sorted(atoms), atoms, {k: len(v) for k, v in near.items()}, {3})
    assert sorted(r.chain for r in queries()["clash_removals"](spark, sf).collect()) == sorted(want) and want


def test_bonded_chains_do_not_clash(spark):
    names = ["structure", "i", "j", "hits_i", "hits_j", "atoms_i", "atoms_j", "core_i", "core_j"]
    rows = spark.createDataFrame([(1, "A", "B", 9, 9, 10, 20, False, False), (1, "A", "C", 9, 9, 10, 20, False, False)], names)
    bonds = spark.createDataFrame([(1, "B", "A")], "structure long, a string, b string")
    assert {tuple(r) for r in structure.clash_removals(rows, *names).collect()} == {(1, "A")}
    alone = structure.clash_removals(rows.filter("j = 'B'"), *names, bonded=bonds)
    assert alone.count() == 0 and structure.clash_removals(rows, *names, bonded=bonds).count() == 1


def test_clash_scan_of_many_pairs(spark):
    """Some thousands of pairs in a structure, repeated ones, a null chain."""
    draw = random.Random(7)
    pairs = {(s, *sorted(draw.sample(range(400), 2))) for s in (1, 2, None) for _ in range(3000)}
    rows = [(s, i, j, draw.randint(0, 9), draw.randint(0, 9), 20, 20, False, False) for s, i, j in pairs]
    names = ["structure", "i", "j", "hits_i", "hits_j", "atoms_i", "atoms_j", "core_i", "core_j"]
    df = spark.createDataFrame([*rows, *rows[:50], (1, None, 3, 9, 9, 20, 20, False, False)], "structure int, i long, j long, hits_i int, hits_j int, atoms_i int, atoms_j int, core_i boolean, core_j boolean")
    want = set()
    for s in (1, 2, None):
        gone = set()
        for _, i, j, a, b, *_ in sorted((r for r in rows if r[0] == s), key=lambda r: r[1:3]):
            if max(a, b) / 20 > 0.3 and not {i, j} & gone:
                gone.add(i if a > b else j)
        want |= {(s, c) for c in gone}
    got = [tuple(r) for r in structure.clash_removals(df, *names).collect()]
    assert set(got) == want and len(got) == len(want)


def test_sidechain_features(spark):
    got = {(r.residue, r.atom): r for r in sidechain.feature_table(spark).collect()}
    f = lambda residue, atom: got[residue, atom].features
    # SP2, aromatic, in a ring: the rings' atoms
    for residue, number, atoms in (("PHE", 4, "CG CD1 CD2 CE1 CE2 CZ"), ("HIS", 6, "ND1 NE2"), ("TRP", 18, "CG CD1 CD2 CE2 CE3 NE1 CH2 CZ2 CZ3")):
        for atom in atoms.split():
            assert f(residue, atom)[1] == f(residue, atom)[7] == f(residue, atom)[8] == 1 and got[residue, atom].number == number
    assert f("CYS", "SG")[10] == 0.5 and f("LYS", "NZ")[9] == 1 and f("LYS", "NZ")[2] == 1
    assert [got["PHE", a].slot for a in "CG CD1 CD2 CE1 CE2 CZ".split()] == [0, 7, 8, 15, 16, 27] and got["LYS", "NZ"].slot == 30 and got["CYS", "SG"].slot == 5
    assert f("ASN", "ND2")[1] == 1 and f("ASN", "ND2")[9] == 1 and f("HIS", "ND1")[9] == 0 and f("TRP", "CD2")[11] == 3 / 5
    wide = sidechain.with_features(spark.createDataFrame([(0,), (5,), (4,), (20,), (None,), (99,)], "n int"), "n").collect()
    total = {r.n: sum(map(sum, r.features)) if r.features else 0 for r in wide}
    assert total[0] == total[5] == total[20] == total[None] == total[99] == 0 and total[4] > 0
    assert len(wide) == 6 and all(len(r.features) == 32 and len(r.features[0]) == 12 for r in wide if r.n in (0, 4, 5, 20))


def test_slots_and_chi(spark):
    draw = random.Random(2)
    rows = []
    for residue, atoms in sidechain.RESIDUE_ATOMS.items():
        slots = [[draw.uniform(-5, 5) for _ in range(3)] if a in atoms.split() else None for a in structure.ATOM_SLOTS]
        rows.append((residue, slots))
    rows.append(("UNK", [None] * 37))
    df = spark.createDataFrame(rows, "residue string, slots array<array<double>>")
    packed = df.withColumn("own", sidechain.to_14(F.col("residue"), F.col("slots")))
    back = packed.withColumn("again", sidechain.to_37(F.col("residue"), F.col("own"))).collect()
    for r in back:
        assert r.again == r.slots and len(r.own) == 14
        named = dict(zip(structure.ATOM_SLOTS, r.slots))
        assert [p for p in r.own if p] == [named[a] for a in sidechain.RESIDUE_ATOMS.get(r.residue, "").split()]
    chi = {r.residue: r for r in sidechain.with_chi(df, "residue", "slots").collect()}
    count = {r: sum(chi[r][f"chi{k}"] is not None for k in (1, 2, 3, 4)) for r in chi}
    assert (count["ALA"], count["GLY"], count["SER"], count["LYS"], count["ARG"], count["PHE"], count["MET"], count["UNK"]) == (0, 0, 1, 4, 4, 2, 3, 0)
    lys = dict(zip(structure.ATOM_SLOTS, dict(rows)["LYS"]))
    four = [F.array(*[F.lit(x) for x in lys[a]]) for a in ("CA", "CB", "CG", "CD")]
    assert structure.with_torsion(spark.range(1), *four, "t").first().t == chi["LYS"].chi2
