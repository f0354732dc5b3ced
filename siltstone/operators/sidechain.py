"""Side-chain atoms of the twenty residues and what follows from their bonds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .structure import ATOM_SLOTS, with_torsion

# The heavy atoms of each residue, in their order.
RESIDUE_ATOMS = {
    "ALA": "N CA C O CB",
    "ARG": "N CA C O CB CG CD NE CZ NH1 NH2",
    "ASN": "N CA C O CB CG OD1 ND2",
    "ASP": "N CA C O CB CG OD1 OD2",
    "CYS": "N CA C O CB SG",
    "GLN": "N CA C O CB CG CD OE1 NE2",
    "GLU": "N CA C O CB CG CD OE1 OE2",
    "GLY": "N CA C O",
    "HIS": "N CA C O CB CG ND1 CD2 CE1 NE2",
    "ILE": "N CA C O CB CG1 CG2 CD1",
    "LEU": "N CA C O CB CG CD1 CD2",
    "LYS": "N CA C O CB CG CD CE NZ",
    "MET": "N CA C O CB CG SD CE",
    "PHE": "N CA C O CB CG CD1 CD2 CE1 CE2 CZ",
    "PRO": "N CA C O CB CG CD",
    "SER": "N CA C O CB OG",
    "THR": "N CA C O CB OG1 CG2",
    "TRP": "N CA C O CB CG CD1 CD2 NE1 CE2 CE3 CZ2 CZ3 CH2",
    "TYR": "N CA C O CB CG CD1 CD2 CE1 CE2 CZ OH",
    "VAL": "N CA C O CB CG1 CG2",
}
# The side chain's spine after CB; the torsions are about its bonds.
SPINES = {
    "ARG": "CG CD NE CZ", "ASN": "CG OD1", "ASP": "CG OD1", "CYS": "SG", "GLN": "CG CD OE1", "GLU": "CG CD OE1", "HIS": "CG ND1", "ILE": "CG1 CD1", "LEU": "CG CD1",
    "LYS": "CG CD CE NZ", "MET": "CG SD CE", "PHE": "CG CD1", "PRO": "CG CD", "SER": "OG", "THR": "OG1", "TRP": "CG CD1", "TYR": "CG CD1", "VAL": "CG1",
}
# Bonds from CB outward; = is double, : aromatic.
BONDS = {
    "CYS": "CB-SG", "SER": "CB-OG", "VAL": "CB-CG1 CB-CG2", "THR": "CB-OG1 CB-CG2", "ILE": "CB-CG1 CG1-CD1 CB-CG2", "LEU": "CB-CG CG-CD1 CG-CD2", "PRO": "CB-CG CG-CD",
    "MET": "CB-CG CG-SD SD-CE", "ASP": "CB-CG CG=OD1 CG-OD2", "ASN": "CB-CG CG=OD1 CG-ND2", "GLU": "CB-CG CG-CD CD=OE1 CD-OE2", "GLN": "CB-CG CG-CD CD=OE1 CD-NE2",
    "LYS": "CB-CG CG-CD CD-CE CE-NZ", "ARG": "CB-CG CG-CD CD-NE NE-CZ CZ=NH1 CZ-NH2", "PHE": "CB-CG CG:CD1 CD1:CE1 CE1:CZ CZ:CE2 CE2:CD2 CD2:CG",
    "TYR": "CB-CG CG:CD1 CD1:CE1 CE1:CZ CZ:CE2 CE2:CD2 CD2:CG CZ-OH", "HIS": "CB-CG CG:CD2 CD2:NE2 NE2:CE1 CE1:ND1 ND1:CG",
    "TRP": "CB-CG CG:CD1 CD1:NE1 NE1:CE2 CE2:CZ2 CZ2:CH2 CH2:CZ3 CZ3:CE3 CE3:CD2 CD2:CG CD2:CE2",
}
# Residue letters in the order of their numbers, aromatic nitrogens with a hydrogen, and the names of hybridisations.
LETTERS = "ACDEFGHIKLMNPQRSTVWYX"
NAMES = dict(zip(LETTERS, "ALA CYS ASP GLU PHE GLY HIS ILE LYS LEU MET ASN PRO GLN ARG SER THR VAL TRP TYR".split()))
AROMATIC_NH = {("HIS", "NE2"), ("TRP", "NE1")}
SP2, SP3 = 1, 2
VALENCE = {"C": 4, "N": 3, "O": 2, "S": 2}
FIRST_SLOT, SLOTS = 5, 32


def bonds_of(residue: str) -> list[tuple[str, str, str]]:
    """(atom, atom, kind) of a side chain."""
    out = []
    for bond in BONDS.get(residue, "").split():
        kind = next(k for k in "-=:" if k in bond)
        out.append((*bond.split(kind), kind))
    return out


def atom_features(residue: str, atom: str) -> list[float]:
    """Twelve features: hybridisation one-hot of six, charge, aromatic, in a
    ring, donor, acceptor, degree / 5, of the fragment from CB outward.

    Aromatic and doubly bonded atoms are flat, and so are nitrogens and oxygens
    beside one, whose free pair joins in."""
    bonds = [(b if a == atom else a, kind) for a, b, kind in bonds_of(residue) if atom in (a, b)]
    every = bonds_of(residue)
    flat = {x for a, b, kind in every if kind != "-" for x in (a, b)}
    aromatic = any(kind == ":" for _, kind in bonds)
    element, degree = atom[0], len(bonds)
    sp2 = atom in flat or (element in "NO" and any(other in flat for other, _ in bonds))
    if aromatic:
        hydrogens = int((residue, atom) in AROMATIC_NH) if element == "N" else 3 - degree
    else:
        hydrogens = VALENCE[element] - sum(2 if kind == "=" else 1 for _, kind in bonds)
    hybrid = [0.0] * 6
    hybrid[SP2 if sp2 else SP3] = 1.0
    acceptor = {"O": 1.0, "N": float(degree < (3 if sp2 else 4)), "S": 0.5 * (degree <= 2 and not aromatic)}.get(element, 0.0)
    # with these residues every ring is aromatic: proline's closes through the backbone, outside the fragment
    return [*hybrid, 0.0, float(aromatic), float(aromatic), float(element in "NOS" and hydrogens > 0), acceptor, degree / 5]


def feature_rows() -> list[tuple[int, str, int, str, list[float]]]:
    """(number, residue, slot, atom, features) of every side-chain atom beyond CB."""
    rows = []
    for number, letter in enumerate(LETTERS):
        residue = NAMES.get(letter)
        for atom in RESIDUE_ATOMS.get(residue, "").split()[FIRST_SLOT:]:
            rows.append((number, residue, ATOM_SLOTS.index(atom) - FIRST_SLOT, atom, atom_features(residue, atom)))
    return rows


def feature_table(spark: SparkSession) -> DataFrame:
    """(number, residue, slot, atom, features): a fixed dimension of some ninety
    rows; the slots of a residue that are not listed have zeros."""
    return spark.createDataFrame(feature_rows(), "number int, residue string, slot int, atom string, features array<double>")


def with_features(df: DataFrame, number: str, name: str = "features") -> DataFrame:
    """Adds the 32 x 12 features of the residue's slots, zeros where it has no
    atom; a number outside the twenty has zeros throughout."""
    zeros = [0.0] * 12
    tables = {}
    for n, _, slot, _, features in feature_rows():
        tables.setdefault(n, [zeros] * SLOTS)[slot] = features
    rows = [(n, tables.get(n, [zeros] * SLOTS)) for n in range(len(LETTERS))]
    table = df.sparkSession.createDataFrame(rows, f"__number int, {name} array<array<double>>")
    return df.join(F.broadcast(table), F.coalesce(F.col(number), F.lit(len(LETTERS) - 1)) == F.col("__number"), "left").drop("__number")  # 21 rows


def _slots_of(residue: Column, slots: Column, names: dict[str, list[str]], source: list[str] | None, size: int) -> Column:
    out = F.array_repeat(F.lit(None), size)
    for name, atoms in names.items():
        if source is None:  # from 37 slots to the residue's own
            picked = [F.get(slots, F.lit(ATOM_SLOTS.index(a))) for a in atoms]
        else:
            picked = [F.get(slots, F.lit(atoms.index(a))) if a in atoms else F.lit(None) for a in source]
        out = F.when(residue == name, F.array(*picked, *[F.lit(None)] * (size - len(picked)))).otherwise(out)
    return out


def to_14(residue: Column, slots: Column) -> Column:
    """The 14 slots of a residue's own atoms from the 37; null beyond them."""
    return _slots_of(residue, slots, {r: a.split() for r, a in RESIDUE_ATOMS.items()}, None, 14)


def to_37(residue: Column, slots: Column) -> Column:
    """The 37 slots from the 14; null where the residue has no such atom."""
    return _slots_of(residue, slots, {r: a.split() for r, a in RESIDUE_ATOMS.items()}, ATOM_SLOTS, 37)


def with_chi(df: DataFrame, residue: str, slots: str) -> DataFrame:
    """Adds chi1 .. chi4: struct (sin, cos) of the torsions along N, CA, CB and
    the side chain's spine, null where a residue has no such torsion or an atom
    of it is missing. ``slots`` are 37 points, null or NaN where none."""
    columns = df.columns
    paths = {r: ["N", "CA", "CB", *s.split()] for r, s in SPINES.items()}
    for k in range(4):
        four = []
        for place in range(4):
            atom = F.lit(None).cast("array<double>")
            for r, path in paths.items():
                if len(path) >= k + 4:
                    atom = F.when(F.col(residue) == r, F.get(slots, F.lit(ATOM_SLOTS.index(path[k + place])))).otherwise(atom)
            four.append(f"__p{place}")
            df = df.withColumn(f"__p{place}", atom)
        df = with_torsion(df, *[F.col(c) for c in four], "__chi")
        df = df.withColumn(f"chi{k + 1}", F.when(F.col("__chi.sin").isNotNull() & ~F.isnan("__chi.sin"), F.col("__chi"))).drop("__chi", *four)
    return df.select(*columns, "chi1", "chi2", "chi3", "chi4")
