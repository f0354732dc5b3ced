"""Crops of structures by space: tokens around an interface, and near chains.

A structure's random centre is the token of smallest keyed hash, so it is the
same under any partitioning. Ranks and running sums are within one structure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import hash_int
from .spatial import radius_pairs

XYZ = ("x", "y", "z")


def resolved(tokens: DataFrame) -> DataFrame:
    return tokens.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())


def interface_tokens(tokens: DataFrame, chain: str, radius: float) -> DataFrame:
    """The resolved tokens (structure, token, ...) nearer than ``radius`` to a
    token of another ``chain``."""
    known = resolved(tokens)
    a = known.select("structure", F.col("token").alias("a"), F.col(chain).alias("ca"), *XYZ)
    b = known.select("structure", F.col(chain).alias("cb"), *XYZ)
    near = radius_pairs(a, b, radius, ["structure"]).filter((F.col("ca") != F.col("cb")) & (F.col("distance") < radius))
    return known.join(near.select("structure", F.col("a").alias("token")).distinct(), ["structure", "token"], "left_semi")


def centres(tokens: DataFrame, seed: str) -> DataFrame:
    """(structure, centre, cx, cy, cz): one token of each structure by hash."""
    key = F.concat_ws(":", F.col("structure").cast("string"), F.col("token").cast("string"))
    pick = tokens.groupBy("structure").agg(F.min_by(F.struct("token", *XYZ), F.struct(hash_int(key, seed), F.col("token"))).alias("c"))
    return pick.select("structure", F.col("c.token").alias("centre"), *[F.col(f"c.{a}").alias(f"c{a}") for a in XYZ])


def to_centre() -> Column:
    return F.sqrt(sum(((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in XYZ), F.lit(0.0)))


def spatial_crop(tokens: DataFrame, size: int, seed: str, interface: bool = True, radius: float = 15.0, whole: Column | None = None) -> DataFrame:
    """The ``size`` tokens nearest to each structure's centre, with ``centre``.

    ``tokens``: structure, token (0, 1, ...), chain, residue, x, y, z, null where
    unresolved, and any others. The centre is drawn from the tokens at an
    interface, from all resolved ones where there is none or without
    ``interface``; a structure without resolved tokens is left out. A thousandth
    of its number is added to each token's distance, which breaks ties;
    unresolved tokens are farthest. Tokens of residues for which ``whole`` holds
    go again if their residue is not taken whole."""
    known = resolved(tokens)
    centre = centres(known, seed)
    if interface:
        at = centres(interface_tokens(tokens, "chain", radius), seed)
        named = at.select("structure", F.struct(*at.columns[1:]).alias("at"))
        both = centre.select("structure", F.struct(*centre.columns[1:]).alias("own")).join(named, "structure", "left")
        centre = both.select("structure", F.coalesce("at", "own").alias("c")).select("structure", "c.*")
    away = tokens.join(centre, "structure").withColumn("__away", F.coalesce(to_centre(), F.lit(float("inf"))) + F.col("token") * F.lit(1e-3))
    rank = F.row_number().over(Window.partitionBy("structure").orderBy("__away", "token"))
    taken = away.withColumn("__rank", rank).filter(F.col("__rank") <= size).drop("__rank", "__away", "cx", "cy", "cz")
    if whole is None:
        return taken
    counts = tokens.groupBy("structure", "residue").agg(F.count(F.lit(1)).alias("__n"))
    have = taken.groupBy("structure", "residue").agg(F.count(F.lit(1)).alias("__have"))
    cut = counts.join(have, ["structure", "residue"]).filter("__have < __n").select("structure", "residue", F.lit(True).alias("__cut"))
    return taken.join(cut, ["structure", "residue"], "left").filter(~(whole & F.coalesce("__cut", F.lit(False)))).select(*taken.columns)


def nearest_chains(tokens: DataFrame, seed: str, most_chains: int = 20, most_tokens: int = 0, radius: float = 15.0, core: str | None = None) -> DataFrame:
    """(structure, molecule, rank, running, kept) of structures with more than
    ``most_chains`` molecules; others are kept whole and have no rows here.

    ``tokens``: structure, token, molecule, x, y, z and perhaps a boolean
    ``core``. The centre is an interface token, of the core where one is given.
    Molecules are ranked by their nearest token, those of the core first. The
    first ``most_chains`` stay, and further ones while all together have at most
    ``most_tokens`` tokens. A structure without an interface keeps nothing:
    ``kept`` is false throughout."""
    counts = tokens.groupBy("structure", "molecule").agg(F.count(F.lit(1)).alias("n"), F.max(F.col(core) if core else F.lit(False)).alias("is_core"))
    large = counts.groupBy("structure").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > most_chains).select("structure")
    mine = tokens.join(large, "structure", "left_semi")
    at = interface_tokens(mine, "molecule", radius)
    centre = centres(at.filter(F.col(core)) if core else at, seed)
    nearest = resolved(mine).join(centre, "structure").groupBy("structure", "molecule").agg(F.min(to_centre()).alias("away"))
    listed = counts.join(large, "structure", "left_semi").join(nearest, ["structure", "molecule"], "left")
    order = Window.partitionBy("structure").orderBy(F.desc("is_core"), F.col("away").asc_nulls_last(), "molecule")
    ranked = listed.withColumn("rank", F.row_number().over(order)).withColumn("running", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.col("away").isNotNull() & ((F.col("rank") <= most_chains) | (F.col("running") <= most_tokens))
    return ranked.select("structure", "molecule", "rank", "running", kept.alias("kept"))
