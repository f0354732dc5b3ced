"""Assignment of predicted to true copies of the same chain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest atoms of a chain that can be an anchor, and fewest of a polymer's.
ANCHOR_ATOMS = 4
POLYMER_ATOMS = 12


def rigid_fit(moving: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, shift) so that ``moving @ rotation + shift`` is nearest to ``fixed``."""
    a, b = moving.mean(0), fixed.mean(0)
    u, _, v = np.linalg.svd((moving - a).T @ (fixed - b))
    turn = u @ np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ v)) or 1.0]) @ v
    return turn, b - a @ turn


def best_chains(atoms: pd.DataFrame) -> pd.DataFrame:
    """chain, matched, rmsd of one structure; see :func:`match_chains`."""
    entity = atoms.groupby("chain", sort=True)["entity"].first().to_dict()
    ligand = atoms.groupby("chain")["ligand"].mean().gt(0.5).to_dict()
    whole = {c: g.drop_duplicates("atom").set_index("atom").sort_index() for c, g in atoms.groupby("chain", sort=True)}
    predicted = {c: g[["px", "py", "pz"]].dropna() for c, g in whole.items()}
    predicted = {c: p for c, p in predicted.items() if len(p)}
    truth = {c: g[["tx", "ty", "tz"]] for c, g in whole.items()}
    copies: dict = {}
    for c, e in entity.items():
        copies.setdefault(e, []).append(c)
    none = pd.DataFrame({"chain": list(predicted), "matched": list(predicted), "rmsd": [None] * len(predicted)})

    # points[p, t]: the predicted atoms of p and, for the same atoms, those of t that are resolved
    points = {}
    for p, mine in predicted.items():
        for c in copies[entity[p]]:
            other = truth[c].reindex(mine.index).to_numpy(float)
            seen = ~np.isnan(other).any(1)
            points[p, c] = mine.to_numpy(float)[seen], other[seen]

    able = [c for c in predicted if len(predicted[c]) >= ANCHOR_ATOMS and any(truth[k].notna().all(axis=1).sum() >= ANCHOR_ATOMS for k in copies[entity[c]])]
    able = [c for c in able if not ligand[c] and len(predicted[c]) >= POLYMER_ATOMS] or able
    if not able:
        return none
    anchor = min(able, key=lambda c: (len(copies[entity[c]]), -len(predicted[c]), c))
    rest = sorted((c for c in predicted if c != anchor), key=lambda c: (-len(predicted[c]), c))
    best = None
    for start in copies[entity[anchor]]:
        mine, other = points[anchor, start]
        if not len(mine):
            continue
        turn, shift = rigid_fit(other, mine)
        pairs, free = {anchor: start}, set(truth) - {start}
        for p in rest:
            open_ = [c for c in copies[entity[p]] if c in free]
            seen = [c for c in open_ if len(points[p, c][0])]
            gap = lambda c: np.linalg.norm(points[p, c][0].mean(0) - (points[p, c][1].mean(0) @ turn + shift))
            pairs[p] = min(seen, key=gap) if seen else open_[0]
            free.discard(pairs[p])
        errors = {p: float(np.sqrt(((a - (b @ turn + shift)) ** 2).sum(1).mean())) if len(a) else 0.0 for p, (a, b) in ((p, points[p, c]) for p, c in pairs.items())}
        mean = sum(errors.values()) / len(errors)
        if best is None or mean < best[0]:
            best = mean, pairs, errors
    if best is None:
        return none
    return pd.DataFrame({"chain": list(best[1]), "matched": list(best[1].values()), "rmsd": [best[2][c] for c in best[1]]})


def match_chains(
    atoms: DataFrame, structure: str = "structure", entity: str = "entity", chain: str = "chain", atom: str = "atom", ligand: str | None = None,
    predicted: tuple[str, str, str] = ("px", "py", "pz"), true: tuple[str, str, str] = ("tx", "ty", "tz"),
) -> DataFrame:
    """(structure, chain, matched, rmsd): the true chain that each predicted
    chain stands for.

    The anchor is the longest chain of the entity with the fewest copies, the
    smallest id on ties; polymers go first. It is laid on each copy of its
    entity in turn; the other chains, longest first, take the free copy of
    nearest centroid, or the first if none is resolved. The mean RMSD of the
    chains decides. Null true coordinates are unresolved atoms, null predicted
    ones atoms outside the crop; without an anchor each chain keeps itself and
    has no RMSD. The atoms of one structure, and no more, meet in one call."""
    number = lambda c: F.col(c).cast("double")
    rows = atoms.select(
        F.col(structure).alias("structure"), F.col(entity).alias("entity"), F.col(chain).cast("string").alias("chain"), F.col(atom).alias("atom"),
        (F.coalesce(F.col(ligand), F.lit(False)) if ligand else F.lit(False)).cast("double").alias("ligand"),
        *[number(c).alias(n) for c, n in zip((*predicted, *true), ("px", "py", "pz", "tx", "ty", "tz"))],
    )
    kind = rows.schema["structure"].dataType.simpleString()

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = best_chains(group)
        found.insert(0, "structure", key[0])
        return found

    return rows.groupBy("structure").applyInPandas(one, f"structure {kind}, chain string, matched string, rmsd double").withColumnRenamed("structure", structure)
