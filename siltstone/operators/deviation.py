"""Errors of predicted residues: bonds, deviation with symmetric atoms swapped,
and side-chain angles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import bind
from .sidechain import RESIDUE_ATOMS, bonds_of, with_chi
from .structure import ATOM_SLOTS
from .symmetry import BACKBONE

# Pairs of atoms whose names may be exchanged.
SWAPS = {"ASP": "OD1-OD2", "GLU": "OE1-OE2", "PHE": "CD1-CD2 CE1-CE2", "TYR": "CD1-CD2 CE1-CE2"}


def bond_table(spark: SparkSession) -> DataFrame:
    """(residue, bonds): pairs of slots of each residue's bonds, backbone first;
    a fixed dimension of twenty rows."""
    rows = []
    for residue, names in RESIDUE_ATOMS.items():
        atoms = names.split()
        pairs = [(a, b) for a, b in [*BACKBONE, *[(a, b) for a, b, _ in bonds_of(residue)], *([("CD", "N")] if residue == "PRO" else [])] if a in atoms and b in atoms]
        rows.append((residue, [[ATOM_SLOTS.index(a), ATOM_SLOTS.index(b)] for a, b in pairs]))
    return spark.createDataFrame(rows, "residue string, bonds array<array<int>>")


def known(point: Column) -> Column:
    return point.isNotNull() & ~F.exists(point, lambda v: v.isNull() | F.isnan(v))


def square(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def mean(values: Column) -> Column:
    """Of the values that are not null; null without one."""
    have = F.filter(values, lambda v: v.isNotNull())
    return bind(have, lambda vs: F.when(F.size(vs) > 0, F.aggregate(vs, F.lit(0.0), lambda s, v: s + v) / F.size(vs)))


def swapped(residue: Column, slots: Column) -> Column:
    """The slots with the symmetric atoms of ``residue`` exchanged where both are
    there."""
    out = slots
    for name, pairs in SWAPS.items():
        to = {}
        for pair in pairs.split():
            a, b = (ATOM_SLOTS.index(x) for x in pair.split("-"))
            to[a], to[b] = b, a
        both = lambda a, b: known(F.get(slots, F.lit(a))) & known(F.get(slots, F.lit(b)))
        exchanged = F.array(*[F.when(both(k, to[k]), F.get(slots, F.lit(to[k]))).otherwise(F.get(slots, F.lit(k))) if k in to else F.get(slots, F.lit(k)) for k in range(len(ATOM_SLOTS))])
        out = F.when(residue == name, exchanged).otherwise(out)
    return out


def residue_errors(df: DataFrame, residue: str, predicted: str, true: str) -> DataFrame:
    """``df`` with ``bond_mse``, ``rmsd`` and ``chi_mae`` (degrees) of each row,
    a residue with 37 slots of predicted and true points in one frame.

    Only atoms known on both sides count; a number without any is null. The
    deviation is the smaller of that as named and that with the symmetric atoms
    of the prediction exchanged; angles follow the names of that choice, and
    their error goes round the circle. Residues outside the twenty have no bonds
    and no angles."""
    bonds = F.broadcast(bond_table(df.sparkSession).withColumnsRenamed({"residue": "__name", "bonds": "__bonds"}))
    columns = df.columns
    point = lambda s, k: F.get(s, k)

    def rmsd(other: str) -> Column:
        each = F.zip_with(other, true, lambda p, q: F.when(known(p) & known(q), square(p, q)))
        return F.sqrt(mean(each))

    def length(slots: str, bond: Column) -> Column:
        a, b = point(slots, F.get(bond, F.lit(0))), point(slots, F.get(bond, F.lit(1)))
        return F.when(known(a) & known(b), F.sqrt(square(a, b)))

    off = F.transform("__bonds", lambda bond: length(predicted, bond) - length(true, bond))
    rows = df.join(bonds, F.col(residue) == F.col("__name"), "left").withColumn("bond_mse", mean(F.transform(off, lambda d: d * d)))
    rows = rows.withColumn("__swapped", swapped(F.col(residue), F.col(predicted)))
    rows = rows.withColumn("__plain", rmsd(predicted)).withColumn("__other", rmsd("__swapped"))
    rows = rows.withColumn("rmsd", F.least("__plain", "__other")).withColumn("__best", F.when(F.col("__other") < F.col("__plain"), F.col("__swapped")).otherwise(F.col(predicted)))
    names = [f"chi{k}" for k in range(1, 5)]
    for slots, prefix in (("__best", "__p"), (true, "__t")):
        rows = with_chi(rows, residue, slots).withColumnsRenamed({c: f"{prefix}{c}" for c in names})
    angle = lambda c: F.atan2(F.col(f"{c}.sin"), F.col(f"{c}.cos"))
    turn = lambda c: F.abs(angle(f"__p{c}") - angle(f"__t{c}"))
    errors = F.array(*[F.degrees(F.least(turn(c), F.lit(2 * 3.141592653589793) - turn(c))) for c in names])
    return rows.withColumn("chi_mae", mean(errors)).select(*columns, "bond_mse", "rmsd", "chi_mae")


def mean_errors(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Means over the residues of each key, nulls left out, and their number."""
    return scored.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("bond_mse", "rmsd", "chi_mae")], F.count(F.lit(1)).alias("residues"))
