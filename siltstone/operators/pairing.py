"""Rows of several chains' alignments paired by species."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A species with more rows than this in one chain is not paired.
MOST_ROWS = 600


def pair_rows(rows: DataFrame, group: str, chain: str, species: str, row: str, order: list[Column], chains: list, most: int = MOST_ROWS) -> DataFrame:
    """(group, species, rank, n_chains, rows): for each species that at least
    two of ``chains`` have, its rows zipped by rank in ``order`` (likest first)
    to the fewest that a chain has; -1 for a chain without the species. The
    first row of all, of the targets themselves, has species ''.

    Ranks are cut by the bound ``most`` before anything is gathered."""
    known = rows.filter(F.col(species).isNotNull() & (F.col(species) != "") & F.col(chain).isin(chains))
    sizes = known.groupBy(group, species, chain).agg(F.count(F.lit(1)).alias("__n"))
    fit = sizes.groupBy(group, species).agg(F.count(F.lit(1)).alias("n_chains"), F.min("__n").alias("__take"), F.max("__n").alias("__most")).filter(f"n_chains > 1 AND __most <= {most}")
    rank = F.row_number().over(Window.partitionBy(group, species, chain).orderBy(*order))
    taken = known.join(fit, [group, species]).withColumn("rank", rank).filter("rank <= __take")
    wide = taken.groupBy(group, species, "rank", "n_chains").pivot(chain, chains).agg(F.max(row))
    paired = wide.select(group, species, "rank", F.col("n_chains").cast("int").alias("n_chains"), F.array(*[F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(-1).cast("long")) for c in chains]).alias("rows"))
    target = rows.select(group).distinct().select(group, F.lit("").alias(species), F.lit(0).alias("rank"), F.lit(len(chains)).alias("n_chains"), F.array_repeat(F.lit(0).cast("long"), len(chains)).alias("rows"))
    return paired.unionByName(target)


def order_pairs(paired: DataFrame, group: str, species: str) -> DataFrame:
    """Adds ``place``, from 0 in each group: rows of more chains first, then by
    the size of the product of their row numbers, then by species and rank. A
    group's pairs are one structure's alignment, which its rows bound."""
    product = F.abs(F.aggregate("rows", F.lit(1.0), lambda s, x: s * x))
    w = Window.partitionBy(group).orderBy(F.desc("n_chains"), product, species, "rank")
    return paired.withColumn("place", (F.row_number().over(w) - 1).cast("long"))
