"""mmCIF files: alternatives, assemblies, bonds, and a round trip of the writer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators.structure import ATOM_SLOTS
from siltstone.sources import mmcif, mmcif_writer

HEAD = """data_X
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_entity_id
_atom_site.label_seq_id
_atom_site.pdbx_PDB_ins_code
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.auth_seq_id
_atom_site.auth_asym_id
_atom_site.pdbx_PDB_model_num
"""
ATOMS = """ATOM 1 N N . GLY A 1 1 ? 0 0 0 1.0 10 H 1
ATOM 2 C CA . GLY A 1 1 ? 1 0 0 1.0 10 H 1
ATOM 3 N N A SER A 1 2 ? 2 0 0 0.3 11 H 1
ATOM 4 N N B SER A 1 2 ? 2 1 0 0.7 11 H 1
ATOM 5 C CA A SER A 1 2 ? 3 0 0 0.9 11 H 1
ATOM 6 C CA B SER A 1 2 ? 3 1 0 0.1 11 H 1
ATOM 7 N N C VAL B 1 1 ? 5 0 0 0.5 1 L 1
ATOM 8 N N A VAL B 1 1 ? 5 1 0 0.5 1 L 1
ATOM 9 SE SE . MSE B 1 2 ? 6 0 0 1.0 2 L 1
HETATM 10 O O . HOH C 2 . ? 9 9 9 1.0 3 L 1
ATOM 11 N N . GLY A 1 1 ? 7 7 7 1.0 10 H 2
#
"""
ASSEMBLY = """loop_
_pdbx_struct_assembly_gen.assembly_id
_pdbx_struct_assembly_gen.oper_expression
_pdbx_struct_assembly_gen.asym_id_list
1 (1,2)(3-4) A
1 1 B,C
2 1-2 A
#
loop_
_pdbx_struct_oper_list.id
_pdbx_struct_oper_list.matrix[1][1]
_pdbx_struct_oper_list.matrix[1][2]
_pdbx_struct_oper_list.matrix[1][3]
_pdbx_struct_oper_list.matrix[2][1]
_pdbx_struct_oper_list.matrix[2][2]
_pdbx_struct_oper_list.matrix[2][3]
_pdbx_struct_oper_list.matrix[3][1]
_pdbx_struct_oper_list.matrix[3][2]
_pdbx_struct_oper_list.matrix[3][3]
_pdbx_struct_oper_list.vector[1]
_pdbx_struct_oper_list.vector[2]
_pdbx_struct_oper_list.vector[3]
1 1 0 0 0 1 0 0 0 1 0 0 0
2 0 -1 0 1 0 0 0 0 1 10 0 0
3 1 0 0 0 1 0 0 0 1 0 5 0
4 -1 0 0 0 -1 0 0 0 1 0 0 1
#
_struct_conn.conn_type_id disulf
_struct_conn.ptnr1_label_asym_id A
_struct_conn.ptnr1_label_seq_id 1
_struct_conn.ptnr1_label_comp_id GLY
_struct_conn.ptnr1_label_atom_id N
_struct_conn.ptnr2_label_asym_id B
_struct_conn.ptnr2_label_seq_id 2
_struct_conn.ptnr2_label_comp_id MSE
_struct_conn.ptnr2_label_atom_id SE
loop_
_entity_poly_seq.entity_id
_entity_poly_seq.num
_entity_poly_seq.mon_id
1 1 GLY
1 2 SER
1 3 TRP
"""


@pytest.fixture
def found(spark, tmp_path):
    (tmp_path / "a.cif").write_text(HEAD + ATOMS + ASSEMBLY)
    (tmp_path / "b.cif").write_text(HEAD + ATOMS)
    return mmcif.read_categories(spark, str(tmp_path)).cache()


def serials(df, name="a.cif"):
    return sorted(r.serial for r in df.filter(F.col("file").endswith(name)).collect())


def test_one_alternative_of_a_residue(found):
    atoms = mmcif.atoms(found)
    assert serials(atoms) == list(range(1, 11))
    assert serials(mmcif.one_alternative(atoms, "all")) == list(range(1, 11))
    assert serials(mmcif.one_alternative(atoms)) == [1, 2, 3, 5, 8, 9, 10]
    # by first atoms A has 0.4, B 0.7 and C 0.5 on average: B at residue 2, C at the other
    assert serials(mmcif.one_alternative(atoms, "largest")) == [1, 2, 4, 6, 7, 9, 10]
    assert serials(mmcif.one_alternative(atoms, "B")) == [1, 2, 4, 6, 9, 10]


def test_expressions():
    assert mmcif.operations("1") == [["1"]]
    assert mmcif.operations("1,3-5,P") == [["1"], ["3"], ["4"], ["5"], ["P"]]
    assert mmcif.operations("(1-2)(X0, 7)") == [["1", "X0"], ["1", "7"], ["2", "X0"], ["2", "7"]]
    assert mmcif.operations("(1,2)") == [["1"], ["2"]]
    for bad in ("", "(1", "1)(2)", "()", "(1)2"):
        with pytest.raises(ValueError):
            mmcif.operations(bad)


def test_assemblies_are_products_applied_from_the_right(found):
    atoms = mmcif.one_alternative(mmcif.atoms(found), "largest")
    out = mmcif.expand_assembly(atoms, mmcif.assembly_motions(found))
    mine = out.filter(F.col("file").endswith("a.cif")).collect()
    turn = {"1": (np.eye(3), [0, 0, 0]), "2": (np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]]), [10, 0, 0]), "3": (np.eye(3), [0, 5, 0]), "4": (np.diag([-1, -1, 1]), [0, 0, 1])}
    at = {r.serial: np.array([r.x, r.y, r.z]) for r in atoms.filter(F.col("file").endswith("a.cif")).collect()}
    want = []
    for copy, (a, b) in enumerate([("1", "3"), ("1", "4"), ("2", "3"), ("2", "4")]):
        for s in (1, 2, 4, 6):
            p = turn[b][0] @ at[s] + turn[b][1]
            want.append((s, copy, *(turn[a][0] @ p + turn[a][1])))
    want += [(s, 0, *at[s]) for s in (7, 9, 10)]
    assert sorted((r.serial, r.copy, r.x, r.y, r.z) for r in mine) == sorted(want)
    assert {r.copy for r in out.filter(F.col("file").endswith("b.cif")).collect()} == {0} and serials(out, "b.cif") == [1, 2, 4, 6, 7, 9, 10]
    every = mmcif.assembly_motions(found, None).groupBy("assembly").count().collect()
    assert {r.assembly: r["count"] for r in every} == {"1": 6, "2": 2}


def test_bonds_sequences_and_slots_of_a_chain(found):
    bond = mmcif.bonds(found).drop("file").collect()
    assert [tuple(b) for b in bond] == [("disulf", "A", 1, "GLY", "N", "B", 2, "MSE", "SE")]
    assert sorted((r.seq_id, r.residue) for r in mmcif.sequences(found).collect()) == [(1, "GLY"), (2, "SER"), (3, "TRP")]
    atoms = mmcif.one_alternative(mmcif.atoms(found), "largest").filter(F.col("file").endswith("a.cif"))
    rows = sorted(mmcif.chain_atom37(atoms, "L").collect(), key=lambda r: r["first"])
    assert [r.residue for r in rows] == ["VAL", "MET"] and rows[1].slots[ATOM_SLOTS.index("SD")] == [6.0, 0.0, 0.0]
    rows = sorted(mmcif.chain_atom37(atoms, "H").collect(), key=lambda r: r["first"])
    assert [(r.auth_seq_id, r.residue, r.slots[0]) for r in rows] == [(10, "GLY", [0.0, 0.0, 0.0]), (11, "SER", [2.0, 1.0, 0.0])]
    assert mmcif.chain_atom37(atoms, "Z").count() == 0


NASTY = ["O5'", 'C1"', "a b", "it's a b", 'say "x" y', "two ' and \" here", ";semi", "a;b", "line\nbreak", "", ".", "?", "_name", "data_x", "loop_", "#x", "$y", "[z", "'", '"', "C'", "x' y\" z", "tab\tin", "stop_", "global_", "normal"]


def test_written_structures_come_back(spark, tmp_path):
    rows = [(f"s{k % 3}" if k % 7 else "odd name", k, "ATOM" if k % 5 else "HETATM", "C", NASTY[k % len(NASTY)], "GLY" if k % 2 else "ALA", "AB"[k % 2], str(1 + k % 2), k // 4, None if k % 3 else k * 0.12345, -1.5, 1e3) for k in range(60)]
    atoms = spark.createDataFrame(rows, "structure string, serial int, group string, element string, atom string, residue string, chain string, entity string, seq_id int, x double, y double, z double")
    polymers = spark.createDataFrame([(s, "1", "polypeptide(L)") for s in ("s0", "s1", "s2")], "structure string, entity string, type string")
    bonds = spark.createDataFrame([("s1", "covale", "A", 1, "GLY", "O5'", "B", 2, "ALA", "a b")], "structure string, kind string, chain_1 string, seq_1 int, residue_1 string, atom_1 string, chain_2 string, seq_2 int, residue_2 string, atom_2 string")
    folder = str(tmp_path / "out")
    mmcif_writer.write_structures(atoms.repartition(5), folder, polymers, bonds)
    back = mmcif.read_categories(spark, folder, glob="*.txt").cache()
    assert back.filter("error IS NOT NULL").count() == 0
    names = {r.file: r.id for r in back.filter("category = 'entry'").select("file", mmcif.item("id").alias("id")).collect()}
    assert sorted(names.values()) == ["odd name", "s0", "s1", "s2"]
    raw = back.filter("category = 'atom_site'").select("file", "row", F.col("items")["id"].alias("serial"), F.col("items")["label_atom_id"].alias("atom"), F.col("items")["Cartn_x"].alias("x"), F.col("items")["label_seq_id"].alias("seq"), F.col("items")["occupancy"].alias("o")).collect()
    assert sorted((names[r.file], int(r.serial), r.atom, r.x, int(r.seq), r.o) for r in raw) == sorted((r[0], r[1], r[4], "?" if r[9] is None else f"{r[9]:.3f}", r[8], "1.00") for r in rows)
    for file in names:
        mine = sorted((r.row, int(r.serial)) for r in raw if r.file == file)
        assert [s for _, s in mine] == sorted(s for _, s in mine)
    kinds = {(names[r.file], r.id): r.type for r in back.filter("category = 'entity'").select("file", mmcif.item("id").alias("id"), mmcif.item("type").alias("type")).collect()}
    assert kinds["s1", "1"] == "polymer" and kinds["s1", "2"] == "non-polymer" and kinds["odd name", "1"] == "non-polymer"
    strands = {names[r.file]: r.s for r in back.filter("category = 'entity_poly'").select("file", mmcif.item("pdbx_strand_id").alias("s")).collect()}
    assert strands == {"s0": "A", "s1": "A", "s2": "A"}
    read = mmcif.bonds(back).collect()
    assert [tuple(r)[1:] for r in read] == [("covale", "A", 1, "GLY", "O5'", "B", 2, "ALA", "a b")]
    assert mmcif.sequences(back).count() > 0


def test_many_structures_are_few_tasks(spark, tmp_path):
    n = 20 * spark.sparkContext.defaultParallelism
    atoms = spark.range(2 * n).select((F.col("id") % n).cast("string").alias("structure"), F.col("id").alias("serial"), F.lit("C").alias("atom"), F.lit("A").alias("chain"), F.lit("1").alias("entity"), F.lit(1).alias("seq_id"), *[F.lit(0.5).alias(a) for a in "xyz"])
    mmcif_writer.write_structures(atoms, str(tmp_path / "many"))
    files = list((tmp_path / "many").rglob("part-*.txt"))
    assert len(files) == n and len({f.name[:10] for f in files}) <= spark.sparkContext.defaultParallelism
    for f in files[::9]:
        text = f.read_text()
        assert text.startswith("data_") and text.count("loop_") == 1
        serials = [int(line.split()[1]) for line in text.splitlines() if line.startswith("ATOM")]
        assert len(serials) == 2 and serials[1] == serials[0] + n and text.index("loop_") < text.index("ATOM ")
