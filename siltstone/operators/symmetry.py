"""Symmetries of small bond graphs, and the best of a residue's atom orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import bind
from .sidechain import RESIDUE_ATOMS, bonds_of

#: Symmetries of a graph that are listed, the identity first; a molecule with
#: more is matched among these.
MOST = 1000
# Bonds within the backbone, up to CB.
BACKBONE = [("N", "CA"), ("CA", "C"), ("C", "O"), ("CA", "CB")]


def refined(colours: list, neighbours: list[list[int]]) -> list[int]:
    """Colours split by the colours around, until no split is new."""
    kinds = {c: k for k, c in enumerate(sorted(set(colours)))}
    now = [kinds[c] for c in colours]
    while True:
        around = [(now[i], tuple(sorted(now[j] for j in neighbours[i]))) for i in range(len(now))]
        kinds = {c: k for k, c in enumerate(sorted(set(around)))}
        after = [kinds[c] for c in around]
        if len(set(after)) == len(set(now)):
            return after
        now = after


def symmetries(colours: list, bonds: list[tuple[int, int]], most: int = MOST) -> list[list[int]]:
    """Orders of the atoms that keep colours and bonds, by backtracking among
    atoms of one refined colour; in lexical order, so the identity is first."""
    n = len(colours)
    neighbours: list[list[int]] = [[] for _ in range(n)]
    for a, b in bonds:
        neighbours[a].append(b)
        neighbours[b].append(a)
    colour = refined(colours, neighbours)
    found: list[list[int]] = []
    image: list[int] = []

    def extend() -> None:
        i = len(image)
        if i == n:
            found.append(list(image))
            return
        before = [j for j in neighbours[i] if j < i]
        for k in range(n):
            if len(found) >= most:
                return
            if colour[k] != colour[i] or k in image or any(image[j] not in neighbours[k] for j in before):
                continue
            image.append(k)
            extend()
            image.pop()

    extend()
    return found


def residue_symmetries() -> dict[str, list[list[int]]]:
    """For each of the twenty residues the orders of its heavy atoms that keep
    elements and bonds; kinds of bonds do not count, as charges resonate."""
    out = {}
    for residue, names in RESIDUE_ATOMS.items():
        atoms = names.split()
        at = {a: i for i, a in enumerate(atoms)}
        pairs = [*BACKBONE, *[(a, b) for a, b, _ in bonds_of(residue)], *([("CD", "N")] if residue == "PRO" else [])]
        out[residue] = symmetries([a[0] for a in atoms], [(at[a], at[b]) for a, b in pairs if a in at and b in at])
    return out


def symmetry_table(spark: SparkSession, more: dict[str, list[list[int]]] | None = None) -> DataFrame:
    """(residue, orders): a fixed dimension, ``more`` adding ligands by name."""
    rows = list((residue_symmetries() | (more or {})).items())
    return spark.createDataFrame(rows, "residue string, orders array<array<int>>")


def with_best_order(df: DataFrame, residue: str, predicted: str, true: str, table: DataFrame, broadcast: bool = True) -> DataFrame:
    """Adds ``best``: struct (rmsd, number, order, before), the order of the true
    atoms of least deviation from the predicted, the first on ties, and the
    deviation of the order as it is. Slots are arrays of points, in the atoms'
    order and in one frame; null points do not count, and a residue without an
    entry keeps its order."""
    square = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)

    def rmsd(order: Column) -> Column:
        each = F.transform(order, lambda k, i: F.when(F.get(predicted, i).isNotNull() & F.get(true, k).isNotNull(), square(F.get(predicted, i), F.get(true, k))))
        known = F.filter(each, lambda v: v.isNotNull())
        mean = lambda vs: F.when(F.size(vs) > 0, F.aggregate(vs, F.lit(0.0), lambda s, v: s + v) / F.size(vs)).otherwise(F.lit(0.0))
        return F.sqrt(bind(known, mean))

    named = table.select(F.col("residue").alias("__residue"), "orders")
    joined = df.join(F.broadcast(named) if broadcast else named, F.col(residue) == F.col("__residue"), "left")
    plain = F.transform(F.coalesce(true, F.array()), lambda _, i: i)
    joined = joined.withColumn("__orders", F.coalesce("orders", F.array(plain)))
    tried = F.transform("__orders", lambda order, n: F.struct(rmsd(order).alias("rmsd"), n.alias("number")))
    joined = joined.withColumn("__tried", tried).withColumn("__best", F.array_min("__tried"))
    best = F.struct("__best.rmsd", "__best.number", F.get("__orders", F.col("__best.number")).alias("order"), F.get("__tried", F.lit(0))["rmsd"].alias("before"))
    return joined.withColumn("best", best).drop("__residue", "orders", "__orders", "__tried", "__best")
