"""Queries on file formats: texts made from driver tables, then parsed. No file
is written but by the round trip of structures, which has no SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.shared import shared_dir
from ..sources import mmcif, mmcif_writer, tabular, texts
from .registry import query, table as t


def rounded(k, digits=3, scale=10):
    return F.format_string(f"%.{digits}f", F.get("embedding", F.lit(k)).cast("double") * scale)


def embeddings(spark, d):
    return t(spark, d, "embeddings").select("vec_id", "label", "embedding")


NUM = "round(embedding[{}]::DOUBLE * 10, {})"


@query(f"""SELECT 'f' || label AS file, 'HETATM' AS group, vec_id::INTEGER AS serial, 'CA' AS atom, 'ALA' AS residue, chr((65 + label)::INTEGER) AS chain, (vec_id % 1000)::INTEGER AS seq_id, '' AS insertion,
{', '.join(f"{NUM.format(k + 1, 3)} AS {a}" for k, a in enumerate('xyz'))}, 'C' AS element FROM embeddings WHERE label IS NOT NULL""")
def pdb_atoms(spark, d):
    """Fixed-width lines of atoms, among lines of other kinds."""
    line = F.format_string("HETATM%s  CA  ALA %s%4d    %8.3f%8.3f%8.3f  1.00  0.00           C  ", texts.pdb_serial(F.col("vec_id")), F.char((F.col("label") + 65).cast("long")), F.col("vec_id") % 1000, *[F.get("embedding", F.lit(k)).cast("double") * 10 for k in range(3)])
    rows = embeddings(spark, d).filter("label IS NOT NULL").select(F.concat(F.lit("f"), F.col("label").cast("string")).alias("file"), F.explode(F.array(line, F.lit("TER"), F.lit("REMARK ATOM"))).alias("value"))
    return texts.pdb_atoms(rows)


MOLECULE = """SELECT vec_id, len(a)::INTEGER AS n, round(list_sum(list_transform(a, lambda k: round(embedding[3 * k + 1]::DOUBLE * 10, 4))), 4) AS x, array_to_string(list_transform(a, lambda k: ['C', 'N', 'H', 'O'][1 + (k + vec_id) % 4]), '') AS symbols
FROM (SELECT vec_id, embedding, list_filter(range(6), lambda k: (k + vec_id) % 4 <> 2) AS a FROM embeddings)"""
SYMBOLS = ["C", "N", "H", "O"]


def symbol(k):
    return F.get(F.array(*map(F.lit, SYMBOLS)), ((F.col("vec_id") + k) % 4).cast("int"))


def summed(molecules):
    total = F.aggregate("atoms", F.lit(0.0), lambda s, a: s + a["x"])
    return molecules.select("vec_id", F.size("atoms").alias("n"), F.round(total, 4).alias("x"), F.array_join(F.transform("atoms", lambda a: a["symbol"]), "").alias("symbols"))


@query(MOLECULE)
def sdf_molecules(spark, d):
    """Molecules of six atoms; hydrogens go, and only the first one counts."""
    atom = lambda k: F.concat(*[F.lpad(rounded(3 * k + i, 4), 10, " ") for i in range(3)], F.lit(" "), F.rpad(symbol(k), 3, " "), F.lit(" 0  0  0"))
    text = F.concat_ws("\n", F.lit("m\n  made\n"), F.lit("  6  0  0  0  0            999 V2000"), *[atom(k) for k in range(6)], F.lit("M  END\n$$$$"), F.lit("second\n\n\n  1  0"))
    files = embeddings(spark, d).select(F.col("vec_id").cast("string").alias("file"), text.alias("text"))
    return summed(texts.sdf_molecules(files).withColumn("vec_id", F.col("file").cast("long")))


@query(MOLECULE)
def mol2_molecules(spark, d):
    atom = lambda k: F.concat_ws(" ", F.lit(str(k + 1)), F.concat(symbol(k), F.lit(str(k))), *[rounded(3 * k + i, 4) for i in range(3)], F.concat(symbol(k), F.lit(".3")), F.lit("1 L 0.0"))
    text = F.concat_ws("\n", F.lit("@<TRIPOS>MOLECULE\nm\n@<TRIPOS>ATOM"), *[atom(k) for k in range(6)], F.lit("@<TRIPOS>BOND\n 1 1 2 1"))
    files = embeddings(spark, d).select(F.col("vec_id").cast("string").alias("file"), text.alias("text"))
    return summed(texts.mol2_molecules(files).withColumn("vec_id", F.col("file").cast("long")))


#: A row of letters and gaps of a vector's components from one place on.
LETTER = "CASE WHEN x > 0.1 THEN 'A' WHEN x < -0.1 THEN 'C' ELSE '-' END"
ROW = "array_to_string(list_transform(embedding[{}:{}], lambda x: " + LETTER + "), '')"


def row(start, stop):
    return F.array_join(F.transform(F.slice("embedding", start, stop - start + 1), lambda x: F.when(x > F.lit(0.1).cast("float"), "A").when(x < F.lit(-0.1).cast("float"), "C").otherwise("-")), "")


@query(f"""WITH r AS (SELECT vec_id, {ROW.format(1, 32)} AS q, {ROW.format(33, 64)} AS h FROM embeddings), n AS (SELECT vec_id, unnest([0, 1]) AS position, q, CASE unnest([0, 1]) WHEN 0 THEN q ELSE h END AS s FROM r),
k AS (SELECT vec_id, position, s, q, list_filter(range(1, 33), lambda i: q[i] <> '-') AS spot FROM n)
SELECT vec_id, position::INTEGER AS position, array_to_string(list_transform(spot, lambda i: s[i]), '') AS aligned,
list_transform(range(1, len(spot) + 1), lambda j: len(replace(replace(substr(CASE WHEN position = 0 THEN '' ELSE array_to_string(list_transform(range(1, 33), lambda i: CASE WHEN q[i] = '-' THEN s[i] ELSE '-' END), '') END,
  (CASE WHEN j = 1 THEN 1 ELSE spot[j - 1] END)::INTEGER, (spot[j] - (CASE WHEN j = 1 THEN 1 ELSE spot[j - 1] END))::INTEGER), '-', ''), ' ', ''))::INTEGER) AS deletions FROM k""")
def stockholm_rows(spark, d):
    """Two rows in two blocks: gaps of the first are no columns."""
    block = lambda a, b: F.concat(F.lit("q "), row(a, a + 15), F.lit("\nh "), row(b, b + 15), F.lit("\n\n"))
    text = F.concat(F.lit("# STOCKHOLM 1.0\n#=GF x\n"), block(1, 33), block(17, 49), F.lit("//\n"))
    files = embeddings(spark, d).select(F.col("vec_id").cast("string").alias("file"), F.lit("").alias("x"), text.alias("text"))
    return texts.stockholm(files).select(F.col("file").cast("long").alias("vec_id"), "position", "aligned", "deletions")


INDICES = "list_transform(range(1, 17), lambda i: CASE WHEN {0}[i] = '-' THEN -1 ELSE {1} + len(replace({0}[1:i], '-', '')) - 1 END)"


@query(f"""WITH r AS (SELECT vec_id, label, {ROW.format(1, 16)} AS q, {ROW.format(17, 32)} AS h FROM embeddings)
SELECT vec_id, 1 AS index, 'hit ' || vec_id AS name, 90.5::DOUBLE AS probability, 1e-5::DOUBLE AS e_value, 16 AS aligned_cols, 3.5::DOUBLE AS sum_probs, q AS query, h AS hit_sequence, {INDICES.format('q', '(2)')} AS indices_query, {INDICES.format('h', '(vec_id % 50)')} AS indices_hit FROM r""")
def hhr_hits(spark, d):
    """One hit a text, with annotation rows that do not count."""
    text = F.concat(
        F.lit("Query q\n\nNo 1\n>hit "), F.col("vec_id").cast("string"), F.lit("\nProbab=90.50  E-value=1e-05  Score=1.0  Aligned_cols=16  Identities=50%  Similarity=0.9  Sum_probs=3.5\n\nQ ss_pred             ccc\nQ query             3 "), row(1, 16),
        F.lit("   20 (99)\nT Consensus         1 aa   9 (9)\nT t                 "), (F.col("vec_id") % 50 + 1).cast("string"), F.lit(" "), row(17, 32), F.lit("   40 (99)\n\n"),
    )
    files = embeddings(spark, d).select(F.col("vec_id").cast("string").alias("file"), text.alias("text"))
    return texts.hhr_hits(files).withColumn("file", F.col("file").cast("long")).withColumnRenamed("file", "vec_id")


@query(f"""WITH r AS (SELECT vec_id, {ROW.format(1, 16)} AS s FROM embeddings)
SELECT lpad(vec_id::VARCHAR, 4, '0') AS id, 'B' AS chain, (vec_id % 9 + 1)::INTEGER AS start, 40 AS end, 200 AS length, 'a title ' || vec_id AS title, len(replace(s, '-', ''))::INTEGER AS aligned_cols, {INDICES.format('s', '(vec_id % 9)')} AS indices_hit FROM r WHERE vec_id % 3 <> 0""")
def hmmsearch_hits(spark, d):
    """Headers of proteins and of others."""
    k = F.col("vec_id").cast("string")
    header = F.concat(F.lpad(k, 4, "0"), F.lit("_B/"), (F.col("vec_id") % 9 + 1).cast("string"), F.lit("-40 [subseq from] mol:"), F.when(F.col("vec_id") % 3 == 0, "na").otherwise("protein"), F.lit(" length:200  a title "), k)
    return texts.hmmsearch_hits(embeddings(spark, d).select(header.alias("header"), row(1, 16).alias("sequence")))


@query("""SELECT 'n' || c_custkey % 40 AS name, max_by(e, c_custkey) AS e_value FROM (SELECT c_custkey, (c_nationkey + 1) / 1000.0 AS e FROM customer) GROUP BY 1 UNION ALL SELECT 'query', 0.0""")
def tblout_e_values(spark, d):
    """The last line of a name counts."""
    value = F.concat(F.lit("n"), (F.col("c_custkey") % 40).cast("string"), F.lit("  -  q  -  "), ((F.col("c_nationkey") + 1) / 1000).cast("string"), F.lit(" 1.0"))
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("line"), value.alias("value"))
    return texts.tblout_e_values(rows.unionByName(rows.select("line", F.lit("# note").alias("value"))))


@query(f"""SELECT vec_id, i::INTEGER AS index, CASE WHEN (vec_id + i) % 3 = 0 THEN 'X' ELSE ['A', 'C', 'D'][1 + (vec_id + i) % 3] END AS residue, i % 2 = 0 AS known,
{', '.join(f"list_transform([0, 1, 2], lambda a: round(embedding[9 * a + 3 * i + {k} + 1]::DOUBLE * 1000, 1) / 100) AS {n}" for k, n in enumerate(('n', 'ca', 'c')))} FROM embeddings, range(3) r(i)""")
def proteinnet_residues(spark, d):
    letter = lambda k: F.get(F.array(F.lit("B"), F.lit("C"), F.lit("D")), ((F.col("vec_id") + k) % 3).cast("int"))
    axis = lambda a: F.concat_ws("\t", *[rounded(9 * a + k, 1, 1000) for k in range(9)])
    text = F.concat(F.lit("[ID]\nx\n[PRIMARY]\n"), *[letter(k) for k in range(3)], F.lit("\n[TERTIARY]\n"), F.concat_ws("\n", *[axis(a) for a in range(3)]), F.lit("\n[MASK]\n+-+\n"))
    rows = texts.proteinnet_residues(embeddings(spark, d).select(F.col("vec_id").cast("string").alias("file"), text.alias("text")))
    return rows.withColumn("file", F.col("file").cast("long")).withColumnRenamed("file", "vec_id")


def cif_files(spark, d):
    """A structure for each 25 vectors: two chains, alternatives at every fifth
    atom, an assembly of products, and a little metadata."""
    n = F.col("vec_id") % 25
    alternative = F.when(n % 5 == 0, "A").when(n % 5 == 1, "B").otherwise(".")
    line = F.concat_ws(
        " ", F.when(n == 24, "HETATM").otherwise("ATOM"), F.col("vec_id").cast("string"), F.lit("C"), F.when(n % 5 < 2, "CA").when(n % 5 == 2, "N").when(n % 5 == 3, "'C'").otherwise('"O"'), alternative,
        F.when(n == 24, "HOH").otherwise("ALA"), F.when(n < 15, "A").otherwise("B"), F.lit("1"), F.floor(n / 5 + 1).cast("string"), F.lit("?"), *[rounded(k) for k in range(3)],
        F.when(n % 5 == 0, "0.40").when(n % 5 == 1, "0.60").otherwise("1.00"), F.floor(n / 5 + 11).cast("string"), F.when(n < 15, "H").otherwise("L"), F.lit("1"),
    )
    names = "group_PDB id type_symbol label_atom_id label_alt_id label_comp_id label_asym_id label_entity_id label_seq_id pdbx_PDB_ins_code Cartn_x Cartn_y Cartn_z occupancy auth_seq_id auth_asym_id pdbx_PDB_model_num".split()
    rest = ["_exptl.method 'X-RAY DIFFRACTION'", "_refine.ls_d_res_high 2.5", "loop_", *[f"_pdbx_struct_assembly_gen.{i}" for i in ("assembly_id", "oper_expression", "asym_id_list")], "1 (1,2)(3) A", "1 2 B", "loop_", "_pdbx_struct_oper_list.id"]
    rest += [f"_pdbx_struct_oper_list.matrix[{r}][{c}]" for r in (1, 2, 3) for c in (1, 2, 3)] + [f"_pdbx_struct_oper_list.vector[{r}]" for r in (1, 2, 3)]
    rest += ["1 1 0 0 0 1 0 0 0 1 0 0 0", "2 0 -1 0 1 0 0 0 0 1 10 0 0", "3 1 0 0 0 1 0 0 0 1 0 5 0", "#"]
    head = "\n".join(["data_x", *rest[:2], "loop_", *[f"_atom_site.{i}" for i in names], ""])
    rows = embeddings(spark, d).select(F.floor(F.col("vec_id") / 25).cast("string").alias("s"), F.struct("vec_id", line.alias("line")).alias("line"))
    text = F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["line"]), "\n"), F.lit("\n" + "\n".join(rest[2:]) + "\n"))
    files = rows.groupBy("s").agg(text.alias("text"))
    return mmcif.parse_categories(files.select(F.concat(F.lit("in/"), "s", F.lit("-assembly2.cif")).alias("path"), F.encode("text", "UTF-8").alias("content")))


def structure_of(df):
    return df.withColumn("structure", F.regexp_extract("file", r"in/(\d+)-", 1).cast("long"))


AT = """SELECT vec_id // 25 AS structure, vec_id, vec_id % 25 AS n, round(embedding[1]::DOUBLE * 10, 3) AS x, round(embedding[2]::DOUBLE * 10, 3) AS y, round(embedding[3]::DOUBLE * 10, 3) AS z FROM embeddings"""


@query(f"SELECT structure, vec_id::INTEGER AS serial, ['CA', 'CA', 'N', 'C', 'O'][1 + n % 5] AS atom, CASE WHEN n < 15 THEN 'A' ELSE 'B' END AS chain, (n // 5 + 1)::INTEGER AS seq_id, CASE n % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS alternative, x, y, z FROM ({AT})")
def mmcif_atoms(spark, d):
    return structure_of(mmcif.atoms(cif_files(spark, d))).select("structure", "serial", "atom", "chain", "seq_id", "alternative", "x", "y", "z")


@query("SELECT (vec_id // 25)::VARCHAR AS pdb_id, 2 AS assembly_num, 'X-RAY DIFFRACTION' AS exp_method, 2.5::DOUBLE AS resolution, list_sort(list(DISTINCT CASE WHEN vec_id % 25 < 15 THEN 'H' ELSE 'L' END)) AS chain_ids, count(*) FILTER (WHERE vec_id % 25 = 24) AS ligand_atoms FROM embeddings GROUP BY 1")
def mmcif_metadata(spark, d):
    return mmcif.metadata(cif_files(spark, d)).select("pdb_id", "assembly_num", "exp_method", "resolution", "chain_ids", F.col("num_ligand_atoms").alias("ligand_atoms"))


#: Atoms that stay: B goes before A where a residue has both; an A alone stays.
STAYS = "(n % 5 <> 0 OR NOT EXISTS (SELECT 1 FROM embeddings b WHERE b.vec_id = a.vec_id + 1))"


@query(f"SELECT structure, vec_id::INTEGER AS serial FROM ({AT}) a WHERE {STAYS}")
def mmcif_alternatives(spark, d):
    """Of two alternatives the one of larger mean occupancy, residue by residue."""
    return structure_of(mmcif.one_alternative(mmcif.atoms(cif_files(spark, d)), "largest")).select("structure", "serial")


@query(f"""WITH a AS ({AT}), t AS (SELECT *, y + 5 AS v FROM a WHERE n < 15)
SELECT structure, vec_id::INTEGER AS serial, 0 AS copy, x, round(v, 3) AS y, z FROM t UNION ALL SELECT structure, vec_id::INTEGER, 1, round(10 - v, 3), x, z FROM t UNION ALL SELECT structure, vec_id::INTEGER, 0, round(10 - y, 3), x, z FROM a WHERE n >= 15""")
def mmcif_assembly(spark, d):
    """Both products of an expression for one chain, one operator for the other."""
    cif = cif_files(spark, d)
    out = structure_of(mmcif.expand_assembly(mmcif.atoms(cif), mmcif.assembly_motions(cif)))
    return out.select("structure", "serial", "copy", *[F.round(a, 3).alias(a) for a in "xyz"])


@query(f"""SELECT structure, (n // 5 + 11)::INTEGER AS auth_seq_id, count(*)::INTEGER AS atoms, round(max(x) FILTER (WHERE n % 5 < 2), 3) AS ca FROM ({AT}) a WHERE n < 15 AND {STAYS} GROUP BY 1, 2""")
def mmcif_chain_slots(spark, d):
    """From a file to the 37 slots of a chain, one alternative of each residue."""
    atoms = mmcif.one_alternative(mmcif.atoms(cif_files(spark, d)), "largest")
    slots = structure_of(mmcif.chain_atom37(atoms, "H"))
    ca = F.get(F.get("slots", F.lit(1)), F.lit(0))
    return slots.select("structure", "auth_seq_id", F.size(F.filter("mask", lambda m: m)).alias("atoms"), F.when(~F.isnan(ca), ca).alias("ca"))


@query()
def mmcif_round_trip(spark, d):
    """Structures of 25 vectors written as files, a file each, and read back;
    held against the table in the tests."""
    e = embeddings(spark, d)
    atoms = e.select(
        F.concat(F.lit("s "), F.floor(F.col("vec_id") / 25).cast("string")).alias("structure"), F.col("vec_id").alias("serial"), F.lit("C").alias("element"), F.concat(F.lit("C"), (F.col("vec_id") % 25).cast("string"), F.lit("'")).alias("atom"),
        F.lit("ALA").alias("residue"), F.lit("A").alias("chain"), F.lit("1").alias("entity"), (F.col("vec_id") % 25).alias("seq_id"), *[(F.get("embedding", F.lit(k)).cast("double") * 10).alias(a) for k, a in enumerate("xyz")],
    )
    folder = f"{shared_dir(spark)}/siltstone/structures-{uuid.uuid4().hex}"
    mmcif_writer.write_structures(atoms, folder, atoms.select("structure", "entity", F.lit("polypeptide(L)").alias("type")).distinct())
    back = mmcif.read_categories(spark, folder, glob="*.txt")
    name = back.filter("category = 'entry'").select("file", mmcif.item("id").alias("structure"))
    return mmcif.atoms(back).join(name, "file").select("structure", "serial", "atom", "seq_id", "x", "y", "z")


@query("SELECT lower('E' || o_orderkey % 500) AS id, max(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate::DATE END) AS released FROM orders GROUP BY 1")
def release_dates(spark, d):
    """Dates from objects by id, plain or in an object of their own."""
    k, day = F.concat(F.lit("E"), (F.col("o_orderkey") % 500).cast("string")), F.date_format("o_orderdate", "yyyy-MM-dd")
    value = F.when(F.col("o_orderkey") % 3 == 0, F.lit('"none"')).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('"'), day, F.lit('"'))).otherwise(F.concat(F.lit('{"release_date": "'), day, F.lit('", "other": 1}')))
    return tabular.dates_by_id(t(spark, d, "orders").select(F.concat(F.lit('{"'), k, F.lit('": '), value, F.lit("}")).alias("value")))
