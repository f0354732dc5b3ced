"""Radius and nearest-neighbour joins and their metrics."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import dense_number
from .shared import stored

#: Queries and points of a structure that meet in one group, about.
BLOCK = 2048
#: Queries of a group that are compared with its points at once.
TOGETHER = 256
#: A table of so many large structures (about 40 bytes each) is broadcast.
BROADCAST_GROUPS = 200_000


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, keys: list[str] | None = None, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """All (left, right) rows within ``radius``, with ``distance``.

    Both sides have ``axes`` and the columns ``keys``; other columns must differ
    in name. Cells of one radius: each left row goes to its own and the
    neighbouring cells, so an equi-join on the cell replaces a nested loop, and
    the exact distance removes the rest. A crowded cell's pairs are all within
    two radii, so most of them are results; adaptive execution splits its join."""
    keys = keys or []
    cell = [F.floor(F.col(a) / F.lit(radius)).cast("long") for a in axes]
    offsets = F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])
    a = left.withColumns({f"__c{i}": c for i, c in enumerate(cell)})
    for i in range(len(axes)):
        a = a.withColumn("__o", F.explode(offsets)).withColumn(f"__c{i}", F.col(f"__c{i}") + F.col("__o")).drop("__o")
    a = a.withColumnsRenamed({x: f"__l{x}" for x in axes})
    b = right.withColumns({f"__c{i}": c for i, c in enumerate(cell)})
    joined = a.join(b, [*keys, *[f"__c{i}" for i in range(len(axes))]])
    total = sum(((F.col(f"__l{x}") - F.col(x)) * (F.col(f"__l{x}") - F.col(x)) for x in axes), F.lit(0.0))
    return joined.withColumn("distance", F.sqrt(total)).filter(F.col("distance") <= radius).drop(*axes, *[f"__l{x}" for x in axes], *[f"__c{i}" for i in range(len(axes))])


def knn(queries: DataFrame, points: DataFrame, k: int, keys: list[str], query_id: str, point_id: str, query_vec: str, point_vec: str, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest points of each query within the same ``keys`` (a
    structure), itself included if it is among them; ties to the smaller id.
    Rows whose keys are null meet nothing.

    Structures of more than ``block`` queries or points are cut into blocks by a
    hash of the id, as many as their counts ask for, and each block of queries
    meets each block of points in a group of its own. So work is dealt in equal
    pieces whatever the size of a structure, and no pair is a row: a group
    passes on each query's ``k`` best only. A matrix product leaves out what is
    farther than these by more than its error, and the rest is summed place by
    place. Distances that are not a number come after all others, and those of
    vectors that are null, hold nulls or differ in length, null, last."""
    of_queries, of_points = block_counts(queries, keys, block, "__qn"), block_counts(points, keys, block, "__pn")
    number = lambda n: F.coalesce(F.col(n), F.lit(1))
    own = lambda i, n, seed: F.pmod(F.xxhash64(i, F.lit(seed)), number(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), number(n) - 1))
    counted = lambda df: df.join(of_queries, keys, "left").join(of_points, keys, "left")
    asked = counted(queries).withColumn("__q", own(query_id, "__qn", 3)).withColumn("__p", each("__pn"))
    found = counted(points).withColumn("__p", own(point_id, "__pn", 5)).withColumn("__q", each("__qn"))
    side = lambda df, i, v: df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in keys)).select(*[F.col(c).alias(c) for c in (*keys, "__q", "__p", i)], F.col(v).cast("array<double>").alias(v)).groupBy(*keys, "__q", "__p")
    kinds = [(c, df.schema[c].dataType.simpleString()) for df, names in ((queries, [*keys, query_id]), (points, [point_id])) for c in names]
    schema = ", ".join([*[f"`{c}` {kind}" for c, kind in kinds], "d2 double"])
    pairs = side(asked, query_id, query_vec).cogroup(side(found, point_id, point_vec)).applyInArrow(_nearest(k, keys, query_id, point_id, query_vec, point_vec), schema)
    order = Window.partitionBy(query_id).orderBy(F.asc_nulls_last("d2"), point_id)
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*keys, query_id, point_id, "d2", "rank")


def _nearest(k: int, keys: list[str], query_id: str, point_id: str, query_vec: str, point_vec: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def matrix(rows: pa.Table, name: str, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors in rows of ``width``, and the length of each, -1 without one."""
        lists = rows.column(name).combine_chunks()
        size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), pc.list_value_length(lists).fill_null(0).to_numpy(), -1)
        if (size == width).all() and not lists.flatten().null_count:
            return lists.flatten().to_numpy().reshape(-1, width), size
        out = np.zeros((len(lists), width))
        for at, x in enumerate(lists.to_pylist()):
            if x is None or None in x:
                size[at] = -1
            else:
                out[at, : len(x)] = x
        return out, size

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*keys, query_id, point_id, "d2"]
        types = [*[left.schema.field(c).type for c in (*keys, query_id)], right.schema.field(point_id).type, pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.schema(list(zip(names, types))).empty_table()
        width = max(pc.max(pc.list_value_length(t.column(v))).as_py() or 0 for t, v in ((left, query_vec), (right, point_vec)))
        (q, q_size), (p, p_size) = matrix(left, query_vec, width), matrix(right, point_vec, width)
        place = pc.rank(right.column(point_id).combine_chunks(), null_placement="at_start", tiebreaker="dense").to_numpy()
        # others are few: they meet all, and are summed place by place at once
        plain_q, plain_p = ((size == width) & (np.abs(x) < 1e100).all(1) for x, size in ((q, q_size), (p, p_size)))
        every = bool((~plain_p & np.isfinite(p).all(1) & (p_size == width)).any()) or plain_p.sum() < k
        clean = np.where(plain_p[:, None], p, 0.0)
        with np.errstate(all="ignore"):
            pp = (clean * clean).sum(1)
        found = []
        for start in range(0, len(q), TOGETHER):
            x, plain = q[start : start + TOGETHER], plain_q[start : start + TOGETHER]
            if every or not plain.any():
                near = np.ones((len(x), len(p)), bool)
            else:
                with np.errstate(all="ignore"):
                    zeroed = np.where(plain[:, None], x, 0.0)
                    qq = (zeroed * zeroed).sum(1)
                    about = qq[:, None] + pp[None] - 2 * (zeroed @ clean.T)
                    about[:, ~plain_p] = np.inf
                    error = 1e-14 * (width + 8) * (qq + pp.max())
                    near = about <= (np.partition(about, k - 1, 1)[:, k - 1] + 2 * error)[:, None]
                near[~plain] = True
            i, j = np.nonzero(near)
            total = np.zeros(len(i))
            with np.errstate(all="ignore"):
                for c in range(width):  # in the order of the places, as a sum of one pair goes
                    away = x[i, c] - p[j, c]
                    total += away * away
            none = (q_size[start + i] != p_size[j]) | (q_size[start + i] < 0)
            order = np.lexsort((place[j], np.where(none, 0.0, total), none, i))
            i, j, total, none = i[order], j[order], total[order], none[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((start + i[first], j[first], total[first], none[first]))
        i, j, total, none = (np.concatenate(parts) for parts in zip(*found))
        rows, others = left.take(pa.array(i)), right.take(pa.array(j))
        return pa.table([*[rows.column(c) for c in (*keys, query_id)], others.column(point_id), pa.array(total, mask=none)], schema=pa.schema(list(zip(names, types))))

    return work


def block_counts(rows: DataFrame, keys: list[str], block: int, name: str) -> DataFrame:
    """(keys, ``name``): the blocks that groups of more than ``block`` rows are
    cut into; smaller groups are not listed. Broadcast up to a size."""
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > block)
    large = stored(large.select(*keys, F.ceil(F.col("__n") / F.lit(float(block))).cast("int").alias(name)), "large-groups")
    return F.broadcast(large) if large.count() <= BROADCAST_GROUPS else large


def nearest_centre(rows: DataFrame, centres: DataFrame, row_id: str, signs: str, centre_id: str, centre_signs: str, block: int = 1000) -> DataFrame:
    """(row, cluster, agree): of any number of centres the one that most columns
    agree with, the smaller id on ties. Centres meet the rows in blocks of
    bounded size, and a row's blocks are joined by a partial maximum."""
    numbered = dense_number(centres.select(F.col(centre_id).alias("__id"), F.col(centre_signs).alias("__signs")), [F.col("__id")], "__at").withColumn("__block", F.floor(F.col("__at") / block))
    listed = numbered.groupBy("__block").agg(F.collect_list(F.struct("__id", "__signs")).alias("__centres"))
    blocks = -(-centres.count() // block)
    each = rows.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(blocks, 1) - 1).cast("long")))).join(listed, "__block")
    agree = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v)).cast("long")
    best = F.array_max(F.transform("__centres", lambda c: F.struct(agree(F.col(signs), c["__signs"]).alias("agree"), (-c["__id"]).alias("minus"))))
    return each.groupBy(row_id).agg(F.max(best).alias("__best")).select(row_id, (-F.col("__best.minus")).alias("cluster"), F.col("__best.agree").alias("agree"))


def lddt(pairs: DataFrame, keys: list[str], true: Column, predicted: Column, radius: float = 15.0) -> DataFrame:
    """Share of the true distances below ``radius`` kept within 0.5, 1, 2, 4."""
    error = F.abs(true - predicted)
    score = sum(((error < t).cast("double") for t in (0.5, 1.0, 2.0, 4.0)), F.lit(0.0)) / 4
    return pairs.filter(true < radius).groupBy(*keys).agg(F.avg(score).alias("lddt"), F.count(F.lit(1)).alias("n_pairs"))


def angle_at(a: Column, b: Column, c: Column) -> Column:
    """Degrees between b - a and c - b, arrays of three: 0 on a line."""
    u = F.zip_with(a, b, lambda x, y: y - x)
    v = F.zip_with(b, c, lambda x, y: y - x)
    sum_ = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    top = sum_(F.zip_with(u, v, lambda x, y: x * y))
    size = lambda w: F.sqrt(sum_(F.transform(w, lambda x: x * x)))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), top / (size(u) * size(v) + F.lit(1e-4))))))


def kabsch_rmsd(df: DataFrame, keys: list[str], predicted: list[str], true: list[str], weight: str | None = None) -> DataFrame:
    """(keys, n, rmsd) after the rigid motion, reflections excluded, that fits
    the predicted to the true points best.

    Native up to the last step: the sums that define each group's 3 x 3
    covariance are partial aggregates, so no group is gathered; only these 18
    numbers go through an Arrow batch for the singular values."""
    import numpy as np
    import pandas as pd

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    p, t = [F.col(c).cast("double") for c in predicted], [F.col(c).cast("double") for c in true]
    aggs = [F.sum(w).alias("w"), F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(w * x).alias(f"p{i}") for i, x in enumerate(p)] + [F.sum(w * x).alias(f"t{i}") for i, x in enumerate(t)]
    aggs += [F.sum(w * sum((x * x for x in p), F.lit(0.0))).alias("pp"), F.sum(w * sum((x * x for x in t), F.lit(0.0))).alias("tt")]
    aggs += [F.sum(w * p[i] * t[j]).alias(f"c{i}{j}") for i in range(3) for j in range(3)]
    sums = df.groupBy(*keys).agg(*aggs)

    def fit(batches):
        for pdf in batches:
            w_ = pdf["w"].to_numpy()
            mp, mt = pdf[["p0", "p1", "p2"]].to_numpy() / w_[:, None], pdf[["t0", "t1", "t2"]].to_numpy() / w_[:, None]
            cov = pdf[[f"c{i}{j}" for i in range(3) for j in range(3)]].to_numpy().reshape(-1, 3, 3) / w_[:, None, None] - mp[:, :, None] * mt[:, None, :]
            u, s, v = np.linalg.svd(cov)
            s[:, 2] *= np.sign(np.linalg.det(u) * np.linalg.det(v))
            spread = pdf["pp"].to_numpy() / w_ - (mp**2).sum(1) + pdf["tt"].to_numpy() / w_ - (mt**2).sum(1)
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "n": pdf["n"], "rmsd": np.sqrt(np.maximum(spread - 2 * s.sum(1), 0))})

    types = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(fit, f"{types}, n long, rmsd double")


def box_muller(u1: Column, u2: Column) -> Column:
    """A standard normal number from two uniforms."""
    return F.sqrt(-2 * F.log(F.greatest(u1, F.lit(1e-12)))) * F.cos(F.lit(2 * math.pi) * u2)
