"""mmCIF files as tables.

Each file is tokenized by one pass in an Arrow worker; every row of a category,
looped or single, becomes one output row. What follows is DataFrame work.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "file string, category string, row int, items map<string,string>, error string"
#: Rows that a worker holds before it hands them on.
CHUNK = 20_000
TOKEN = re.compile(r"""^;([\s\S]*?)\n;(?=\s|\Z)|\#[^\n]*|'((?:[^'\n]|'(?=\S))*)'|"((?:[^"\n]|"(?=\S))*)"|(\S+)""", re.M)


def tokens(text: str) -> Iterator[tuple[str, bool]]:
    """(value, whether it is a bare word)."""
    for m in TOKEN.finditer(text):
        if m.lastindex:
            yield m.group(m.lastindex), m.lastindex == 4


def category_rows(text: str) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(category, row number, items) in file order; only the first data block.
    Raises ValueError for a value without a name and for a ragged loop."""
    single: dict[str, dict[str, str]] = {}
    names: list[str] = []  # of the open loop
    values: list[str] = []
    looping, name, blocks, number = False, "", 0, 0

    def loop_row() -> tuple[str, int, dict[str, str]]:
        return names[0].split(".")[0], number, {n.split(".", 1)[-1]: v for n, v in zip(names, values)}

    for value, bare in tokens(text):
        word = value.lower() if bare else ""
        key = bare and value.startswith("_")
        if key or word == "loop_" or word.startswith("data_"):
            if values:
                raise ValueError(f"ragged loop {names[0]}")
            if name:
                raise ValueError(f"no value for {name}")
        if word.startswith("data_"):
            blocks += 1
            if blocks > 1:
                break
        elif word == "loop_":
            looping, names, number = True, [], 0
        elif key and looping and not number:
            names.append(value[1:])
        elif key:
            looping, name = False, value[1:]
        elif looping and names:
            values.append(value)
            if len(values) == len(names):
                yield loop_row()
                number, values = number + 1, []
        elif name:
            category, _, item = name.partition(".")
            single.setdefault(category, {})[item] = value
            name = ""
        else:
            raise ValueError(f"value without a name: {value[:40]}")
    if values:
        raise ValueError(f"ragged loop {names[0]}")
    for category, items in single.items():
        yield category, 0, items


def read_categories(spark: SparkSession, path: str, categories: list[str] | None = None, glob: str = "*.cif*") -> DataFrame:
    """(file, category, row, items, error) of all files below ``path``.

    All values are strings, ``.`` and ``?`` included. Gzipped files are opened
    by their content. A file that cannot be parsed gives its rows up to the
    fault and then one row with ``error`` set; an absent category gives none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return parse_categories(files.select("path", "content"), categories)


def parse_categories(files: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """As :func:`read_categories`, of (path, content) wherever they come from."""
    wanted = set(categories) if categories is not None else None

    def parsed(name: str, content: bytes):
        try:
            raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
            for category, row, items in category_rows(raw.decode("utf-8", "replace")):
                if wanted is None or category in wanted:
                    yield name, category, row, list(items.items()), None
        except (ValueError, OSError, EOFError) as fault:
            yield name, None, None, None, str(fault)

    kind = pa.schema([("file", pa.string()), ("category", pa.string()), ("row", pa.int32()), ("items", pa.map_(pa.string(), pa.string())), ("error", pa.string())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in parsed(name, content.as_py()):
                    rows.append(row)
                    if len(rows) >= CHUNK:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return files.select("path", "content").mapInArrow(work, SCHEMA)


def item(name: str) -> Column:
    """An item of a category row; null for ``.``, ``?`` and absence."""
    value = F.try_element_at(F.col("items"), F.lit(name))
    return F.when(~value.isin(".", "?"), value)


def atoms(categories: DataFrame) -> DataFrame:
    """Typed atoms of model 1, in file order by ``row``."""
    text = {"group": "group_PDB", "alternative": "label_alt_id", "element": "type_symbol", "atom": "label_atom_id", "residue": "label_comp_id", "chain": "label_asym_id", "entity": "label_entity_id", "auth_chain": "auth_asym_id", "insertion": "pdbx_PDB_ins_code"}
    number = {"x": "Cartn_x", "y": "Cartn_y", "z": "Cartn_z", "occupancy": "occupancy", "b_factor": "B_iso_or_equiv"}
    whole = {"serial": "id", "seq_id": "label_seq_id", "auth_seq_id": "auth_seq_id"}
    first = categories.filter((F.col("category") == "atom_site") & (F.coalesce(item("pdbx_PDB_model_num"), F.lit("1")) == "1"))
    return first.select("file", "row", *[item(i).alias(n) for n, i in text.items()], *[item(i).try_cast("double").alias(n) for n, i in number.items()], *[item(i).try_cast("int").alias(n) for n, i in whole.items()])


def one_alternative(atoms: DataFrame, how: str = "first") -> DataFrame:
    """``atoms`` with one alternative location each.

    ``first`` keeps a file's first letter; ``largest`` keeps, residue by residue,
    the letter among the residue's own of largest mean occupancy over the file's
    residues, each counted by its first atom, so that a residue is one
    alternative throughout; any other value is the letter to keep, and ``all``
    keeps all. Atoms without a letter always stay."""
    letter = F.col("alternative")
    if how == "all":
        return atoms
    if how not in ("first", "largest"):
        return atoms.filter(letter.isNull() | (letter == how))
    marked = atoms.filter(letter.isNotNull())
    if how == "first":
        least = marked.groupBy("file").agg(F.min(letter).alias("__kept"))
        return atoms.join(least, "file", "left").filter(letter.isNull() | (letter == F.col("__kept"))).drop("__kept")
    residue = ["file", "chain", "auth_chain", "seq_id", "auth_seq_id", "insertion"]
    own = marked.groupBy(*residue, "alternative").agg(F.min_by("occupancy", "row").alias("__occupancy"), F.min("row").alias("__row"))
    means = own.groupBy("file", "alternative").agg(F.avg("__occupancy").alias("__mean"))
    best = own.join(means, ["file", "alternative"]).groupBy(*residue).agg(F.min_by("alternative", F.struct(-F.coalesce("__mean", F.lit(0.0)), letter)).alias("__kept"))
    names = [F.col(c).alias(f"__{c}") for c in residue]
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in residue]
    return atoms.join(best.select(*names, "__kept"), same, "left").filter(letter.isNull() | (letter == F.col("__kept"))).select(*atoms.columns)


def operations(expression: str) -> list[list[str]]:
    """Steps of an assembly's expression: ``1,3-5`` lists operators and ranges,
    ``(1-3)(4,5)`` is every product of one of each, the right one applied first.
    Raises ValueError for anything else."""
    text = expression.replace(" ", "")
    if not re.fullmatch(r"(?:\([^()]+\))+|[^()]+", text):
        raise ValueError(f"not an expression: {expression}")
    groups = re.findall(r"[^()]+", text)

    def members(group: str) -> list[str]:
        out = []
        for part in group.split(","):
            low, dash, high = part.partition("-")
            if dash and low.isdigit() and high.isdigit():
                out += [str(n) for n in range(int(low), int(high) + 1)]
            elif part:
                out.append(part)
        return out

    steps: list[list[str]] = [[]]
    for group in map(members, groups):
        if not group:
            raise ValueError(f"an empty list in {expression}")
        steps = [[*s, m] for s in steps for m in group]
    return steps


def assembly_motions(categories: DataFrame, assembly: str | None = "1") -> DataFrame:
    """(file, assembly, chain, copy, turn, shift): for each chain of an assembly
    the motions that make its copies, numbered from 0 through the assembly's
    lines and their products; ``assembly`` None takes all. Products are made up
    beforehand, row by row of a category that has a few lines a file."""
    operators = categories.filter("category = 'pdbx_struct_oper_list'").select("file", item("id").alias("id"), *[item(f"matrix[{r}][{c}]").try_cast("double").alias(f"m{r}{c}") for r in (1, 2, 3) for c in (1, 2, 3)], *[item(f"vector[{r}]").try_cast("double").alias(f"v{r}") for r in (1, 2, 3)])
    cells = [F.col(f"m{r}{c}") for r in (1, 2, 3) for c in (1, 2, 3)] + [F.col(f"v{r}") for r in (1, 2, 3)]
    known = operators.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("id", F.array(*cells)))).alias("operators"))
    lines = categories.filter("category = 'pdbx_struct_assembly_gen'").select("file", "row", item("assembly_id").alias("assembly"), item("oper_expression").alias("expression"), item("asym_id_list").alias("chains"))
    if assembly is not None:
        lines = lines.filter(F.col("assembly") == assembly)
    schema = "file string, assembly string, row int, chains string, number int, turn array<double>, shift array<double>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rows = []
            for file, name, row, expression, chains, found in zip(*[c.to_pylist() for c in batch.columns]):
                table = dict(found or [])
                try:
                    products = operations(expression or "")
                except ValueError:
                    continue
                for number, steps in enumerate(products):
                    if any(s not in table or None in table[s] for s in steps):
                        continue
                    turn, shift = np.eye(3), np.zeros(3)
                    for s in reversed(steps):
                        m = np.array(table[s])
                        turn, shift = m[:9].reshape(3, 3) @ turn, m[:9].reshape(3, 3) @ shift + m[9:]
                    rows.append((file, name, row, chains, number, turn.ravel().tolist(), shift.tolist()))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=[p.split()[0] for p in schema.split(", ")])

    made = lines.join(known, "file").select("file", "assembly", "row", "expression", "chains", "operators").mapInArrow(work, schema)
    each = made.withColumn("chain", F.explode(F.split(F.regexp_replace("chains", r"\s", ""), ",")))
    order = Window.partitionBy("file", "assembly", "chain").orderBy("row", "number")  # a row a copy
    return each.select("file", "assembly", "chain", (F.row_number().over(order) - 1).alias("copy"), "turn", "shift")


def expand_assembly(atoms: DataFrame, motions: DataFrame) -> DataFrame:
    """``atoms`` of the assemblies of :func:`assembly_motions`, with ``assembly``
    and ``copy``: each chain once a motion. A file without motions is as it is,
    with null ``assembly`` and copy 0; chains that no line names are left out."""
    files = motions.select("file").distinct()
    moved = atoms.join(motions, ["file", "chain"])
    new = {a: sum((F.get("turn", F.lit(3 * k + i)) * F.col(b) for i, b in enumerate("xyz")), F.get("shift", F.lit(k))) for k, a in enumerate("xyz")}
    out = moved.withColumns({f"__{a}": c for a, c in new.items()}).drop("x", "y", "z", "turn", "shift").withColumnsRenamed({f"__{a}": a for a in "xyz"})
    plain = atoms.join(files, "file", "left_anti").withColumn("assembly", F.lit(None).cast("string")).withColumn("copy", F.lit(0))
    return out.select(*atoms.columns, "assembly", "copy").unionByName(plain)


def bonds(categories: DataFrame, kinds: tuple[str, ...] = ("covale", "disulf", "metalc")) -> DataFrame:
    """(file, kind, chain_1, seq_1, residue_1, atom_1, chain_2, ...) of the bonds
    between residues that a file lists, of the given kinds."""
    rows = categories.filter("category = 'struct_conn'").withColumn("kind", F.lower(item("conn_type_id"))).filter(F.col("kind").isin(*kinds))
    side = lambda k: [item(f"ptnr{k}_label_asym_id").alias(f"chain_{k}"), item(f"ptnr{k}_label_seq_id").try_cast("int").alias(f"seq_{k}"), item(f"ptnr{k}_label_comp_id").alias(f"residue_{k}"), item(f"ptnr{k}_label_atom_id").alias(f"atom_{k}")]
    return rows.select("file", "kind", *side(1), *side(2))


def sequences(categories: DataFrame) -> DataFrame:
    """(file, entity, seq_id, residue) of polymers, the residues without atoms
    included."""
    rows = categories.filter("category = 'entity_poly_seq'")
    return rows.select("file", item("entity_id").alias("entity"), item("num").try_cast("int").alias("seq_id"), item("mon_id").alias("residue")).dropDuplicates(["file", "entity", "seq_id"])


def chain_atom37(atoms: DataFrame, auth_chain: str | None = None) -> DataFrame:
    """(file, auth_chain, auth_seq_id, insertion, first, residue, slots, mask) of
    the standard residues of the chain with that author name, or of all; ``first``
    orders a chain's residues as the file has them."""
    from ..operators.structure import atom37

    mine = atoms if auth_chain is None else atoms.filter(F.col("auth_chain") == auth_chain)
    keys = ["file", "auth_chain", "auth_seq_id", "insertion"]
    first = mine.groupBy(*keys).agg(F.min("row").alias("first"))
    wide = atom37(mine.withColumn("insertion", F.coalesce("insertion", F.lit(""))), keys, "row")
    named = first.withColumn("insertion", F.coalesce("insertion", F.lit("")))
    return wide.join(named, keys).select(*keys, "first", "residue", "slots", "mask")


def metadata(categories: DataFrame) -> DataFrame:
    """One row a file: id and assembly from its name, method, resolution (the
    first positive of reflections, refinement, microscopy), author chains of
    polymers, and counts. A file without atoms gives zeros."""
    is_atom = (F.col("category") == "atom_site") & (F.coalesce(item("pdbx_PDB_model_num"), F.lit("1")) == "1")
    polymer = is_atom & (item("group_PDB") == "ATOM")

    def of(category: str, name: str) -> Column:
        return F.min(F.when((F.col("category") == category) & (F.col("row") == 0), item(name)))

    def resolution(category: str, name: str) -> Column:
        value = of(category, name).try_cast("double")
        return F.when(value > 0, value)

    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.cif(\.gz)?$", "")
    return categories.groupBy("file").agg(
        of("exptl", "method").alias("exp_method"),
        F.coalesce(resolution("reflns", "d_resolution_high"), resolution("refine", "ls_d_res_high"), resolution("em_3d_reconstruction", "resolution")).alias("resolution"),
        F.array_sort(F.collect_set(F.when(polymer, item("auth_asym_id")))).alias("chain_ids"),
        F.count_distinct(F.when(polymer, F.struct(item("label_asym_id"), item("label_seq_id")))).alias("num_residues"),
        F.count(F.when(is_atom & (item("group_PDB") == "HETATM"), 1)).alias("num_ligand_atoms"),
        F.max("error").alias("error"),
    ).select(
        "file",
        F.regexp_replace(stem, r"-assembly\d+$", "").alias("pdb_id"),
        F.coalesce(F.regexp_extract(stem, r"-assembly(\d+)$", 1).try_cast("int"), F.lit(1)).alias("assembly_num"),
        "exp_method", "resolution", "chain_ids", F.size("chain_ids").alias("num_chains"), "num_residues", "num_ligand_atoms", "error",
    )
