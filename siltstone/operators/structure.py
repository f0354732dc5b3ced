"""Slots, frames, torsions, clash removal and block deletion."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import dot, hash_uniform

# The 37 atom slots, and the residues that count as standard.
ATOM_SLOTS = (
    "N CA C CB O CG CG1 CG2 OG OG1 SG CD CD1 CD2 ND1 ND2 OD1 OD2 SD CE CE1 CE2 CE3 "
    "NE NE1 NE2 OE1 OE2 CH2 NH1 NH2 OH CZ CZ2 CZ3 NZ OXT"
).split()
RESIDUES = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL MSE".split()


def slot_values(df: DataFrame, keys: list[str], name: Column, value: Column, order: Column, slots: list) -> DataFrame:
    """(keys, slots, mask): for each key the value of each slot name, null where
    none; of several, that of largest ``order``.

    One conditional aggregate for each slot, so that rows are combined before
    the shuffle and no group is gathered."""
    picked = [F.max_by(F.when(name == s, value), F.when(name == s, order)).alias(f"__s{i}") for i, s in enumerate(slots)]
    wide = df.groupBy(*keys).agg(*picked)
    cells = [F.col(f"__s{i}") for i in range(len(slots))]
    return wide.select(*keys, F.array(*cells).alias("slots"), F.array(*[c.isNotNull() for c in cells]).alias("mask"))


def atom37(atoms: DataFrame, keys: list[str], order: str, group: str = "group", residue: str = "residue", atom: str = "atom", xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """(keys, residue, slots, mask) of each standard residue's ATOM rows, NaN
    where a slot has no atom. MSE becomes MET and its SE the slot SD.

    ``keys`` name one residue. Rows of other groups or residues, and atoms
    outside the slots, are skipped; of repeated atoms the last counts."""
    kind, name = F.upper(F.trim(residue)), F.upper(F.trim(atom))
    slot = F.when((kind == "MSE") & (name == "SE"), "SD").otherwise(name)
    usable = atoms.filter((F.trim(group) == "ATOM") & kind.isin(RESIDUES))
    named = usable.withColumn("__residue", F.when(kind == "MSE", "MET").otherwise(kind)).withColumn("__slot", slot)
    at = F.array(*[F.col(c).cast("double") for c in xyz])
    wide = slot_values(named, [*keys, "__residue"], F.col("__slot"), at, F.col(order), ATOM_SLOTS)
    missing = F.array(*[F.lit(float("nan"))] * 3)
    return wide.select(*keys, F.col("__residue").alias("residue"), F.transform("slots", lambda p: F.coalesce(p, missing)).alias("slots"), "mask")


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def _unit(a: Column, eps: float) -> Column:
    size = F.sqrt(dot(a, a) + F.lit(eps))
    return F.transform(a, lambda x: x / size)


def with_frame(df: DataFrame, negative_x: Column, origin: Column, plane: Column, name: str, eps: float = 1e-8) -> DataFrame:
    """Adds ``name``: struct (e0, e1, e2, origin), the orthonormal axes of three
    points by Gram-Schmidt. The first axis leads from ``negative_x`` to
    ``origin``, ``plane`` is in the half plane of the second. Each axis is a
    column of its own, so that none is computed twice."""
    first = df.withColumn("__e0", _unit(_minus(origin, negative_x), eps)).withColumn("__v", _minus(plane, origin))
    along = first.withColumn("__along", dot(F.col("__e0"), F.col("__v")))
    second = along.withColumn("__e1", _unit(F.zip_with("__v", "__e0", lambda v, e: v - e * F.col("__along")), eps))
    g = lambda c, i: F.get(c, F.lit(i))
    cross = F.array(*[g("__e0", i) * g("__e1", j) - g("__e0", j) * g("__e1", i) for i, j in ((1, 2), (2, 0), (0, 1))])
    return second.withColumn(name, F.struct(F.col("__e0").alias("e0"), F.col("__e1").alias("e1"), cross.alias("e2"), F.transform(origin, lambda x: x.cast("double")).alias("origin"))).drop("__e0", "__v", "__along", "__e1")


def into_frame(point: Column, frame: Column) -> Column:
    """``point`` in the coordinates of ``frame``."""
    moved = _minus(point, frame["origin"])
    return F.array(*[dot(frame[e], moved) for e in ("e0", "e1", "e2")])


def with_torsion(df: DataFrame, a: Column, b: Column, c: Column, d: Column, name: str, eps: float = 1e-8) -> DataFrame:
    """Adds ``name``: struct (sin, cos) of the torsion about b-c."""
    local = with_frame(df, b, c, a, "__frame", eps).withColumn("__local", into_frame(d, F.col("__frame")))
    y, z = F.get("__local", F.lit(1)), F.get("__local", F.lit(2))
    size = F.sqrt(y * y + z * z + F.lit(eps))
    return local.withColumn(name, F.struct((z / size).alias("sin"), (y / size).alias("cos"))).drop("__frame", "__local")


def clash_removals(records: DataFrame, structure: str, first: str, second: str, hits_first: str, hits_second: str, atoms_first: str, atoms_second: str, core_first: str, core_second: str, limit: float = 0.3, bonded: DataFrame | None = None) -> DataFrame:
    """(structure, chain): the chains that a scan of the clashing pairs removes.

    ``records`` has one row for each unordered pair of chains, smaller first,
    with the atoms of each that clash with the other. Pairs are taken in order;
    one of whose chains is gone already is skipped. A pair above ``limit`` on
    either side loses the chain outside the core, else that of larger share,
    else of fewer atoms, else of larger id. Chains that are one molecule do not
    clash: ``bonded`` has (structure, chain, chain) of those that covalent bonds
    join, in either order; pairs with a null chain are skipped. The scan gathers
    a structure's pairs above the limit only, in one pass of them."""
    if bonded is not None:
        s, a, b = bonded.columns
        joined = bonded.select(F.col(s).alias(structure), F.least(a, b).alias(first), F.greatest(a, b).alias(second))
        records = records.join(joined, [structure, first, second], "left_anti")
    share_i, share_j = F.col(hits_first) / F.col(atoms_first), F.col(hits_second) / F.col(atoms_second)
    core_i, core_j = F.coalesce(F.col(core_first), F.lit(False)), F.coalesce(F.col(core_second), F.lit(False))
    loses_i = (
        F.when(core_i & ~core_j, False).when(~core_i & core_j, True)
        .when(share_i != share_j, share_i > share_j)
        .otherwise(F.col(atoms_first) < F.col(atoms_second))
    )
    over = records.filter((share_i > limit) | (share_j > limit))
    pairs = over.select(F.col(structure).alias("s"), F.col(first).alias("i"), F.col(second).alias("j"), F.coalesce(loses_i, F.lit(False)).alias("loses_i")).filter("i IS NOT NULL AND j IS NOT NULL")
    kind = lambda c: records.schema[c].dataType.simpleString()
    return pairs.groupBy("s").applyInArrow(_scan_pairs, f"s {kind(structure)}, chain {kind(first)}").select(F.col("s").alias(structure), "chain")


def _scan_pairs(pairs: pa.Table) -> pa.Table:
    """The chains that the scan of one structure's pairs removes, by look-up in
    a set, so that its time grows with the pairs only."""
    gone: dict = {}
    for i, j, loses_i in sorted(zip(*(pairs[c].to_pylist() for c in ("i", "j", "loses_i")))):
        if i not in gone and j not in gone:
            gone[i if loses_i else j] = None
    return pa.table({"s": pairs["s"].slice(0, 1).take(pa.array([0] * len(gone), pa.int64())), "chain": pa.array(list(gone), pairs["i"].type)})


def delete_blocks(df: DataFrame, group: str, order: list[Column], blocks: int, fraction: float, seed: str) -> DataFrame:
    """``df`` without ``blocks`` runs of floor(fraction * rows) rows of each
    group, from hash-drawn starts; the first row always stays and runs end with
    their group."""
    numbered = df.withColumn("__row", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
    counted = numbered.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    size = F.floor(F.col("__n") * F.lit(fraction))
    start = lambda k: F.floor(hash_uniform(F.col(group), f"{seed}{k}:") * F.col("__n"))
    inside = F.lit(False)
    for k in range(blocks):
        inside = inside | ((F.col("__row") >= start(k)) & (F.col("__row") < start(k) + size))
    return counted.filter((F.col("__row") == 0) | ~inside).drop("__row", "__n")
