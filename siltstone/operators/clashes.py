"""Clashes between chains, by radii of elements and by a fixed distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import radius_pairs

# Van der Waals radii by element, in angstrom.
RADII = {"H": 1.2, "C": 1.7, "N": 1.6, "O": 1.55, "F": 1.5, "P": 1.95, "S": 1.8, "CL": 1.8, "SE": 1.9, "BR": 1.9, "I": 2.1}
OTHER_RADIUS = 1.8


def chain_clashes(atoms: DataFrame, radii: dict[str, float] | None = None, relative: float = 0.75, distance: float = 1.1, most: int = 100, share: float = 0.5) -> DataFrame:
    """(structure, i, j, vdw_pairs, nearest, vdw_clash, close_pairs, close_share,
    close_clash) of each two chains i < j of which some atoms clash.

    ``atoms``: structure, chain, kind (``lig`` or a polymer's), molecule, atom,
    element, x, y, z. Two atoms clash by radii below ``relative`` times the sum
    of theirs; a ligand and a polymer of one molecule are bonded and left out.
    Two polymers clash by distance if over ``most`` pairs of atoms, or more than
    ``share`` of the smaller chain's atoms, are nearer than ``distance``. Chains
    of kind null are left out. One radius join with cells of the largest limit
    serves both; the exact tests follow."""
    table = RADII if radii is None else radii
    radius = F.lit(OTHER_RADIUS)
    for element, r in table.items():
        radius = F.when(F.upper("element") == element, F.lit(r)).otherwise(radius)
    known = atoms.filter(F.col("kind").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).withColumn("radius", radius)
    side = lambda s: known.select("structure", *[F.col(c).alias(f"{s}_{c}") for c in ("chain", "kind", "molecule", "radius")], "x", "y", "z")
    reach = max(distance, relative * 2 * max([*table.values(), OTHER_RADIUS]))
    near = radius_pairs(side("a"), side("b"), reach, ["structure"]).filter("a_chain < b_chain")
    ligands = (F.col("a_kind") == "lig").cast("int") + (F.col("b_kind") == "lig").cast("int")
    bonded = (ligands == 1) & (F.col("a_molecule") == F.col("b_molecule"))
    ratio = F.col("distance") / (F.col("a_radius") + F.col("b_radius"))
    by_radii = (ratio < relative) & ~F.coalesce(bonded, F.lit(False))
    by_distance = (F.col("distance") < distance) & (ligands == 0)
    hits = near.filter(by_radii | by_distance).groupBy("structure", F.col("a_chain").alias("i"), F.col("b_chain").alias("j")).agg(
        F.count_if(by_radii).alias("vdw_pairs"), F.min(F.when(by_radii, ratio)).alias("nearest"), F.count_if(by_distance).alias("close_pairs")
    )
    size = lambda s: known.groupBy("structure", F.col("chain").alias(s)).agg(F.count(F.lit(1)).alias(f"n_{s}"))
    sized = hits.join(size("i"), ["structure", "i"]).join(size("j"), ["structure", "j"])
    of_smaller = F.col("close_pairs") / F.least("n_i", "n_j")
    return sized.select("structure", "i", "j", "vdw_pairs", "nearest", (F.col("vdw_pairs") > 0).alias("vdw_clash"), "close_pairs", of_smaller.alias("close_share"), ((F.col("close_pairs") > most) | (of_smaller > share)).alias("close_clash"))
