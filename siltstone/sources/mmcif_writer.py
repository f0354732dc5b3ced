"""Structures as mmCIF files, one a structure.

Lines are made as columns: each row of each category is one text with its place
in its file. An exchange by structure and a sort by place put them in order, and
a task writes its files one by one as streams of lines, so that no structure is
gathered in memory and tasks grow with the rows, not with the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import dense_ids
from ..operators.shared import TASK_ROWS

# Words that a bare value must not be, or begin with.
RESERVED = r"(?i)^(?:data_|save_|loop_$|stop_$|global_$)"
#: The columns of an atom's line, and the item that each is.
ATOM_ITEMS = {
    "group": "group_PDB", "serial": "id", "element": "type_symbol", "atom": "label_atom_id", "alternative": "label_alt_id", "residue": "label_comp_id", "chain": "label_asym_id",
    "entity": "label_entity_id", "seq_id": "label_seq_id", "insertion": "pdbx_PDB_ins_code", "x": "Cartn_x", "y": "Cartn_y", "z": "Cartn_z", "occupancy": "occupancy",
    "b_factor": "B_iso_or_equiv", "auth_seq_id": "auth_seq_id", "auth_chain": "auth_asym_id", "model": "pdbx_PDB_model_num",
}
#: Items that a writer fills where the rows have none.
DEFAULTS = {"group": "ATOM", "occupancy": "1.00", "b_factor": "0.00", "model": "1"}


def quoted(value: Column, unknown: str = "?") -> Column:
    """A value as the format wants it: bare, in single or double quotes, or
    between semicolon lines; null as ``unknown``.

    A quote only ends a value where a blank follows, so a value may hold it
    elsewhere. A value with a line break, or with both quotes before blanks,
    goes between semicolons; a line of it that begins with one gets a blank
    before, as the format has no other way."""
    text = value.cast("string")
    bare = text.rlike(r"""^[^\s'"#$_;\[\]][^\s]*$""") & ~text.rlike(RESERVED) & ~text.isin(".", "?")
    block = F.concat(F.lit("\n;"), F.regexp_replace(text, r"\n;", "\n ;"), F.lit("\n;\n"))
    single, double = ~text.rlike(r"'(?:\s|$)"), ~text.rlike(r'"(?:\s|$)')
    return (
        F.when(text.isNull(), unknown).when(bare, text).when(text.rlike(r"[\r\n]"), block)
        .when(single, F.concat(F.lit("'"), text, F.lit("'"))).when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(block)
    )


def category(rows: DataFrame, name: str, items: dict[str, str], order: list[Column], place: int) -> DataFrame:
    """(structure, place, at, head, line): the rows of a loop, ``items`` from
    columns to item names. ``head`` is the loop's first lines."""
    head = "\n".join(["#", "loop_", *[f"_{name}.{i}" for i in items.values()]])
    line = F.concat_ws(" ", *[quoted(F.col(c)) for c in items])
    return rows.select("structure", F.lit(place).alias("place"), F.struct(*order).alias("at"), F.lit(head).alias("head"), line.alias("line"))


def entity_rows(atoms: DataFrame, polymers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, polymers with their chains, and the residues of each polymer's
    first chain. ``polymers``: structure, entity, type."""
    chains = atoms.groupBy("structure", "entity").agg(F.array_sort(F.collect_set("chain")).alias("chains"))
    known = chains.join(polymers.select("structure", "entity", "type"), ["structure", "entity"], "left")
    entities = known.select("structure", "entity", F.when(F.col("type").isNull(), "non-polymer").otherwise("polymer").alias("kind"), F.lit(None).cast("string").alias("description"))
    poly = known.filter("type IS NOT NULL").select("structure", "entity", "type", F.array_join("chains", ",").alias("strands"), F.get("chains", F.lit(0)).alias("first"))
    inside = atoms.join(poly.select("structure", "entity", "first"), ["structure", "entity"]).filter(F.col("chain") == F.col("first"))
    residues = inside.groupBy("structure", "entity", "seq_id").agg(F.min_by("residue", "serial").alias("residue"), F.when(F.min_by("group", "serial") == "HETATM", "y").otherwise("n").alias("hetero"))
    return entities, poly, residues


def write_structures(atoms: DataFrame, folder: str, polymers: DataFrame | None = None, bonds: DataFrame | None = None, digits: int = 3) -> None:
    """A file ``file=*/part-*.txt`` of ``folder`` for each structure of ``atoms``.

    ``atoms``: structure (a text, the data block's name and entry id), serial, and
    any of the columns of :data:`ATOM_ITEMS`; ``polymers`` (structure, entity,
    type) adds the entity blocks; ``bonds`` (structure and the columns that
    :func:`siltstone.sources.mmcif.bonds` gives, but for the file) the bonds
    between residues. Repeated rows are written as they are; null values are
    unknown; coordinates have ``digits`` places."""
    spark = atoms.sparkSession
    named = atoms.select("structure", *[(F.col(c) if c in atoms.columns else F.lit(DEFAULTS.get(c)).cast("string")).alias(c) for c in ATOM_ITEMS])
    number = lambda c: F.format_string(f"%.{digits}f", F.col(c).cast("double"))
    named = named.withColumns({c: F.when(F.col(c).isNotNull(), number(c)) for c in "xyz"})
    structures = atoms.select("structure").distinct()
    block = F.regexp_replace("structure", r"\s", "_")
    parts = [structures.select("structure", F.lit(0).alias("place"), F.struct(F.lit(0)).alias("at"), F.lit(None).cast("string").alias("head"), F.concat(F.lit("data_"), block, F.lit("\n#\n_entry.id "), quoted(F.col("structure"))).alias("line"))]
    if polymers is not None:
        entities, poly, residues = entity_rows(named, polymers)
        parts.append(category(entities, "entity", {"entity": "id", "kind": "type", "description": "pdbx_description"}, [F.col("entity")], 1))
        parts.append(category(poly, "entity_poly", {"entity": "entity_id", "type": "type", "strands": "pdbx_strand_id"}, [F.col("entity")], 2))
        parts.append(category(residues, "entity_poly_seq", {"entity": "entity_id", "seq_id": "num", "residue": "mon_id", "hetero": "hetero"}, [F.col("entity"), F.col("seq_id").cast("int")], 3))
    if bonds is not None:
        ends = {f"{c}_{k}": f"ptnr{k}_label_{i}" for k in (1, 2) for c, i in (("chain", "asym_id"), ("seq", "seq_id"), ("residue", "comp_id"), ("atom", "atom_id"))}
        parts.append(category(bonds, "struct_conn", {"kind": "conn_type_id", **ends}, [F.col(c) for c in ends], 4))
    parts.append(category(named, "atom_site", ATOM_ITEMS, [F.col("serial").cast("long")], 5))
    lines = None
    for k, part in enumerate(parts):
        spread = part.select("structure", "place", "head", "line", *[(F.col("at") if j == k else F.lit(None).cast(p.schema["at"].dataType)).alias(f"at{j}") for j, p in enumerate(parts)])
        lines = spread if lines is None else lines.unionByName(spread)
    files = dense_ids(lines, ["structure"], "file").withColumn("file", F.col("file").cast("int"))
    # a task writes its files one after the other, as one a file would each report to the driver
    tasks = max(spark.sparkContext.defaultParallelism, -(-atoms.count() // TASK_ROWS))
    order = Window.partitionBy("file", "place").orderBy(*[f"at{k}" for k in range(len(parts))])
    placed = files.repartition(tasks, "file").withColumn("number", F.row_number().over(order))
    # a loop's head goes before its first line: lines of a file are a stream
    value = F.when(F.col("number") == 1, F.concat_ws("\n", "head", "line")).otherwise(F.col("line"))
    # the sort begins with the files, so that writing them apart does not sort again
    placed.sortWithinPartitions("file", "place", "number").select("file", value.alias("value")).write.partitionBy("file").option("lineSep", "\n").text(folder)
