import gzip

import pytest

from pyspark.sql import functions as F

from siltstone.sources import mmcif, sinks, tabular, texts

CIF = """data_1abc
# a comment
_entry.id 1abc
_exptl.method 'X-RAY DIFFRACTION'
_struct.title
;two
lines
;
_refine.ls_d_res_high 1.9
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.label_atom_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.auth_asym_id
_atom_site.Cartn_x
_atom_site.pdbx_PDB_model_num
ATOM 1 "O5'" A 1 X 1.5 1
ATOM 2 CA A 2 X ? 1
HETATM 3 ZN B . Y -3.25 1
ATOM 4 CA A 1 X 9 2
#
"""


def test_mmcif(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "1abc-assembly2.cif").write_text(CIF)
    (tmp_path / "deep/2xyz.cif.gz").write_bytes(gzip.compress(b"data_2xyz\n_entry.id 2xyz\n"))
    (tmp_path / "bad.cif").write_text("data_b\nloop_\n_a.x\n_a.y\n1 2 3\n")
    (tmp_path / "empty.cif").write_text("")
    got = mmcif.read_categories(spark, str(tmp_path))
    rows = {(r["file"].split("/")[-1], r["category"], r["row"]): r["items"] for r in got.filter("error is null").collect()}
    assert rows[("1abc-assembly2.cif", "struct", 0)] == {"title": "two\nlines"}
    assert rows[("1abc-assembly2.cif", "atom_site", 0)]["label_atom_id"] == "O5'"
    assert rows[("2xyz.cif.gz", "entry", 0)] == {"id": "2xyz"}
    assert [r["error"] for r in got.filter("error is not null").collect()] == ["ragged loop a.x"]
    found = [(r.serial, r.x, r.seq_id) for r in mmcif.atoms(got).orderBy("serial").collect()]
    assert found == [(1, 1.5, 1), (2, None, 2), (3, -3.25, None)]
    meta = {r.pdb_id: r for r in mmcif.metadata(got).collect()}
    one = meta["1abc"]
    assert (one.assembly_num, one.exp_method, one.resolution, one.chain_ids, one.num_residues, one.num_ligand_atoms) == (2, "X-RAY DIFFRACTION", 1.9, ["X"], 2, 1)
    assert meta["2xyz"].num_chains == 0 and meta["bad"].error


@pytest.mark.parametrize("text", ["1 2", "data_x\n_a.b\n_a.c 1", "data_x\nloop_\n_a.b\n_a.c\n1"])
def test_mmcif_faults(text):
    with pytest.raises(ValueError):
        list(mmcif.category_rows(text))


def test_pdb_and_sdf(spark):
    line = "ATOM      1  CA  ALA B   7      11.104   6.134  -6.504  1.00  0.00           C  "
    rows = spark.createDataFrame([("f", line), ("f", "TER"), ("f", ""), ("f", None)], "file string, value string")
    atom = texts.pdb_atoms(rows).collect()
    assert [(a.atom, a.residue, a.chain, a.seq_id, a.x, a.z, a.element) for a in atom] == [("CA", "ALA", "B", 7, 11.104, -6.504, "C")]
    assert texts.pdb_chains(rows).first().chains == ["B"]
    sdf = "m\n\n\n  2  0  0  0  0  0  0  0  0  0999 V2000\n    1.0000    2.0000    3.0000 C   0  0\n    0.0000    0.0000    1.0000 H   0  0\nM  END\n$$$$\n"
    files = spark.createDataFrame([("a", sdf), ("flat", sdf.replace("3.0000", "0.0000").replace("1.0000 H", "0.0000 H")), ("bad", "x"), ("none", None)], "file string, text string")
    got = {r.file: r.atoms for r in texts.sdf_molecules(files).collect()}
    assert [(a.x, a.y, a.z, a.symbol) for a in got["a"]] == [(1.0, 2.0, 3.0, "C")]
    assert got["flat"] is None and got["bad"] is None and got["none"] is None


def test_alignments(spark):
    sto = "# STOCKHOLM 1.0\n\nq  AB-\nh  A-x\n\nq  -CD\nh  yC-\n//\n"
    got = texts.stockholm(spark.createDataFrame([("f", sto)], "file string, text string")).orderBy("position").collect()
    assert [(r.position, r.name, r.aligned, r.deletions) for r in got] == [(0, "q", "ABCD", [0, 0, 0, 0]), (1, "h", "A-C-", [0, 0, 2, 0])]
    hhr = "Query q\n\nNo 1\n>7abc_A Some protein\nProbab=99.5  E-value=1e-10  Score=50.1  Aligned_cols=4  Identities=50%  Similarity=0.9  Sum_probs=3.5  Template_Neff=5.0\n\nQ ss_pred             ccc\nQ Consensus         3 aa~a    6 (9)\nQ query             3 AB-C    5 (9)\nT Consensus         1 abcd    4 (8)\nT 7abc_A            2 A-DE    4 (8)\n\n"
    hit = texts.hhr_hits(spark.createDataFrame([("f", hhr)], "file string, text string")).first()
    assert (hit["index"], hit["name"], hit.probability, hit.e_value, hit.aligned_cols, hit.sum_probs) == (1, "7abc_A Some protein", 99.5, 1e-10, 4, 3.5)
    assert (hit.query, hit.indices_query, hit.hit_sequence, hit.indices_hit) == ("AB-C", [2, 3, -1, 4], "A-DE", [1, -1, 2, 3])
    a3m = spark.createDataFrame([("4pqx_A/2-7 [subseq from] mol:protein length:217  A title", "AbC-D"), ("1abc_A/1-2 mol:na length:2", "AC")], "header string, sequence string")
    one = texts.hmmsearch_hits(a3m).collect()
    assert [(r.id, r.chain, r.start, r.end, r.length, r.title, r.aligned_cols, r.indices_hit) for r in one] == [("4pqx", "A", 2, 7, 217, "A title", 3, [1, 3, -1, 4])]
    tbl = spark.createDataFrame([(0, "# c"), (1, "n - q - 1e-3 x"), (2, "n - q - 2e-3 x")], "line long, value string")
    assert {r["name"]: r.e_value for r in texts.tblout_e_values(tbl).collect()} == {"n": 0.002, "query": 0.0}


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(3).write.parquet(at)
    for _ in range(2):
        now = spark.read.parquet(at)
        sinks.overwrite_with_backup(now.selectExpr("id + 1 AS id"), at)
    assert sorted(r.id for r in spark.read.parquet(at).collect()) == [2, 3, 4]
    assert sorted(r.id for r in spark.read.parquet(at + "_backup").collect()) == [0, 1, 2]
    # cut off between the renames: the table set aside comes back
    (tmp_path / "t").rename(tmp_path / "t_aside")
    sinks.recover(spark, at)
    assert sorted(r.id for r in spark.read.parquet(at).collect()) == [2, 3, 4] and not (tmp_path / "t_aside").exists()
    errors = spark.createDataFrame([("a", None, "x"), ("a", None, "x"), ("b", "1", "y")], "pdb string, chain string, message string")
    for _ in range(2):
        sinks.append_errors(errors, str(tmp_path / "e"), ["pdb", "chain"])
    assert spark.read.json(str(tmp_path / "e")).count() == 2


def test_csv_types_are_inferred(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,name,value\n1,"a ""b"", c",2.5\n2,NA,\n')
    got = tabular.typed_csv(spark, str(tmp_path / "t.csv"))
    assert [f.dataType.simpleString() for f in got.schema] == ["int", "string", "double"]
    assert sorted(map(tuple, got.collect())) == [(1, 'a "b", c', 2.5), (2, "NA", None)]
    assert [tuple(r) for r in tabular.text_csv(spark, str(tmp_path / "t.csv")).orderBy("id").collect()] == [("1", 'a "b", c', "2.5"), ("2", "NA", None)]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("\n\n>one first \r\nAC\r\n\r\n  GT \n>two\n>three\nAA\nCC")
    (tmp_path / "b.fasta").write_text(">four\nTT\n")
    (tmp_path / "c.fasta").write_text("")
    got = sorted((r.description, r.sequence) for r in texts.fasta_records(spark, str(tmp_path)).collect())
    assert got == [("four", "TT"), ("one first", "ACGT"), ("three", "AACC"), ("two", "")]


def test_proteinnet(spark, tmp_path):
    numbers = lambda k: " ".join(str(100 * (9 * k + i)) for i in range(9))
    (tmp_path / "p").write_text(f"[ID]\nx\n[PRIMARY]\nABK\n[TERTIARY]\n{numbers(0)}\n{numbers(1)}\n{numbers(2)}\n[MASK]\n+-+\n")
    got = texts.proteinnet_residues(texts.whole(spark, str(tmp_path))).orderBy("index").collect()
    assert [(r.residue, r.known) for r in got] == [("A", True), ("X", False), ("K", True)]
    assert got[1].ca == [4.0, 13.0, 22.0] and got[2].c == [8.0, 17.0, 26.0]


MOL2 = "@<TRIPOS>MOLECULE\nm\n@<TRIPOS>ATOM\n 1 C1 0.0 1.0 {z} C.ar 1 L 0.1\n 2 H1 1 1 1 H\n 3 CL 2 2 2 Cl\n@<TRIPOS>BOND\n 1 1 2 ar\n@<TRIPOS>MOLECULE\n@<TRIPOS>ATOM\n 1 N 9 9 9 N.3\n"
SDF = "m\n p\n c\n  2  1  0  0\n    1.0000    2.0000    3.0000 O   0  0\n    1.0000    2.0000    4.0000 H   0  0\n  1  2  1\nM  END\n$$$$\n"


def test_mol2_and_its_fallback(spark):
    mol2 = spark.createDataFrame([("x/a.mol2", MOL2.format(z=0.5)), ("x/b.mol2", MOL2.format(z="bad"))], "file string, text string")
    sdf = spark.createDataFrame([("x/a.sdf", SDF), ("x/b.sdf", SDF), ("x/c.sdf", SDF)], "file string, text string")
    got = {r.molecule: [(a.symbol, a.x, a.z) for a in r.atoms] for r in texts.molecules(mol2, sdf, F.regexp_extract("file", "/([a-z]+)\\.", 1)).collect()}
    assert got == {"a": [("C", 0.0, 0.5), ("Cl", 2.0, 2.0)], "b": [("O", 1.0, 3.0)], "c": [("O", 1.0, 3.0)]}


def test_listed_files_and_dates(spark, tmp_path):
    for name in ("a.txt", "b.txt", "c.txt"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("x")
    (tmp_path / "list").write_text(f"# all\na.txt\n\n./c.txt  # the last\nabsent.txt\n{tmp_path}/in/a.txt\n")
    got = tabular.listed_files(spark, str(tmp_path / "list"), str(tmp_path / "in"))
    assert sorted(r.file.rsplit("/", 1)[1] for r in got.collect()) == ["a.txt", "c.txt"]
    rows = spark.createDataFrame([('{"1ABC": "2020-01-02", "2x": {"release_date": "2021-03-04"}}',), ('{"1abc": "2019-01-01", "3y": "soon"}',), ("not json",), (None,)], "value string")
    assert {r.id: str(r.released) for r in tabular.dates_by_id(rows).collect()} == {"1abc": "2020-01-02", "2x": "2021-03-04", "3y": "None"}


def test_hmmsearch_hits_from_stockholm(spark):
    sto = "# STOCKHOLM 1.0\n#=GS 4pqx_A/2-9 DE [subseq from] mol:protein length:217  A title\n#=GS 1abc_B/1-3 DE mol:na length:9\nquery  AB-CD\n4pqx_A/2-9  AKxC-\n1abc_B/1-3  A----\n//\n"
    got = texts.hmmsearch_stockholm_hits(spark.createDataFrame([("f", sto)], "file string, text string")).collect()
    assert [(r.id, r.chain, r.start, r.end, r.length, r.title, r.aligned_cols, r.indices_hit) for r in got] == [("4pqx", "A", 2, 9, 217, "A title", 3, [1, 2, 4, -1])]


def test_structures_come_back_from_their_files(spark):
    from siltstone.plans.queries import queries

    sf = "/root/testdata/sf0.001"
    got = {r.serial: r for r in queries()["mmcif_round_trip"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.vec_id]
        assert (g.structure, g.atom, g.seq_id) == (f"s {r.vec_id // 25}", f"C{r.vec_id % 25}'", r.vec_id % 25)
        assert all(abs(v - 10 * e) < 6e-4 for v, e in zip((g.x, g.y, g.z), r.embedding))
