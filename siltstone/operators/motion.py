"""Rigid motions as columns: random ones from hashes, and those of best fit."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bind, dot, hash_uniform
from .spatial import box_muller


def random_normal(key: Column, seed: str) -> Column:
    return box_muller(hash_uniform(key, f"{seed}a:"), hash_uniform(key, f"{seed}b:"))


def random_rotation(key: Column, seed: str) -> Column:
    """Nine numbers, row by row, of a uniform rotation: four normal numbers of
    the key make a quaternion of uniform direction. The same for a key under any
    partitioning."""
    four = F.array(*[random_normal(key, f"{seed}{k}") for k in range(4)])

    def turned(q: Column) -> Column:
        w, x, y, z = (F.get(q, F.lit(k)) for k in range(4))
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
            2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
            2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
        )

    return bind(bind(four, lambda q: bind(F.sqrt(dot(q, q)), lambda size: F.transform(q, lambda v: v / size))), turned)


def moved(point: Column, turn: Column, shift: Column) -> Column:
    """``turn`` (nine numbers, row by row) times ``point``, plus ``shift``."""
    row = lambda k: sum((F.get(turn, F.lit(3 * k + i)) * F.get(point, F.lit(i)) for i in range(3)), F.get(shift, F.lit(k)))
    return F.array(*[row(k) for k in range(3)])


def random_motion(df: DataFrame, key: str, points: str, seed: str, scale: float = 1.0) -> DataFrame:
    """``df`` with each row's ``points`` (arrays of three, null where none)
    turned about their centre by a random rotation and shifted by normal numbers
    of size ``scale``; ``turn`` and ``shift`` are added."""
    known = F.filter(points, lambda p: p.isNotNull())
    total = lambda ps, k: F.aggregate(ps, F.lit(0.0), lambda s, p: s + F.get(p, F.lit(k)))
    middle = lambda ps: F.array(*[total(ps, k) / F.greatest(F.size(ps), F.lit(1)) for k in range(3)])
    shift = F.array(*[random_normal(F.col(key), f"{seed}s{k}") * F.lit(scale) for k in range(3)])
    made = df.withColumn("__centre", bind(known, middle)).withColumn("turn", random_rotation(F.col(key), seed)).withColumn("shift", shift)
    at = F.transform(points, lambda p: F.when(p.isNotNull(), moved(F.zip_with(p, "__centre", lambda a, b: a - b), F.col("turn"), F.col("shift"))))
    return made.withColumn(points, at).drop("__centre")


def fitted_motion(df: DataFrame, keys: list[str], predicted: list[str], true: list[str], weight: str | None = None) -> DataFrame:
    """(keys, turn, shift) of the motion without reflection that carries the
    predicted points to the true best; the sums of a group are partial
    aggregates, and only they go through an Arrow batch. Rows with a null number
    do not count; a group without others keeps its points where they are."""
    import numpy as np
    import pandas as pd

    every = [F.col(c) for c in [*predicted, *true]]
    usable = df.filter(~sum((c.isNull().cast("int") for c in every), F.lit(0)).cast("boolean"))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    p, t = [F.col(c).cast("double") for c in predicted], [F.col(c).cast("double") for c in true]
    aggs = [F.sum(w).alias("w"), *[F.sum(w * x).alias(f"p{i}") for i, x in enumerate(p)], *[F.sum(w * x).alias(f"t{i}") for i, x in enumerate(t)]]
    aggs += [F.sum(w * p[i] * t[j]).alias(f"c{i}{j}") for i in range(3) for j in range(3)]
    sums = usable.groupBy(*keys).agg(*aggs)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w_ = np.maximum(pdf["w"].to_numpy(), 1e-300)
            mp, mt = (pdf[[f"{s}{i}" for i in range(3)]].to_numpy() / w_[:, None] for s in "pt")
            cov = pdf[[f"c{i}{j}" for i in range(3) for j in range(3)]].to_numpy().reshape(-1, 3, 3) / w_[:, None, None] - mp[:, :, None] * mt[:, None, :]
            u, _, v = np.linalg.svd(cov)
            u[:, :, 2] *= np.sign(np.linalg.det(u) * np.linalg.det(v))[:, None]
            turn = np.transpose(u @ v, (0, 2, 1))
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "turn": list(turn.reshape(-1, 9)), "shift": list(mt - (turn @ mp[:, :, None])[:, :, 0])})

    types = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(fit, f"{types}, turn array<double>, shift array<double>")


def local_angles(a: Column, b: Column, c: Column, y: Column) -> Column:
    """Four numbers of the point ``y`` as seen from ``b``, in the frame whose
    first axis leads to ``a`` and whose second is in the plane of ``c``: cosine
    and sine of its azimuth, and of its elevation."""
    minus = lambda p, q: F.zip_with(p, q, lambda u, v: u.cast("double") - v.cast("double"))
    unit = lambda v: bind(F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)), lambda size: F.transform(v, lambda x: x / size))
    g = lambda v, i: F.get(v, F.lit(i))
    cross = lambda p, q: F.array(*[g(p, i) * g(q, j) - g(p, j) * g(q, i) for i, j in ((1, 2), (2, 0), (0, 1))])

    def of_axes(e1: Column, e2: Column) -> Column:
        away = minus(y, b)
        local = F.array(dot(e1, away), dot(e2, away), dot(cross(e1, e2), away))

        def numbers(v: Column) -> Column:
            flat = F.sqrt(g(v, 0) * g(v, 0) + g(v, 1) * g(v, 1) + F.lit(1e-8))
            size = F.sqrt(dot(v, v)) + F.lit(1e-8)
            return F.array(g(v, 0) / flat, g(v, 1) / flat, flat / size, g(v, 2) / size)

        return bind(local, numbers)

    second = lambda e1, v: bind(dot(e1, v), lambda along: unit(F.zip_with(v, e1, lambda x, e: x - e * along)))
    return bind(unit(minus(a, b)), lambda e1: bind(second(e1, minus(c, b)), lambda e2: of_axes(e1, e2)))


