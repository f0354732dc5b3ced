"""Embedding near-dedup with spherical-cap filters.

A filter is a direction on the sphere and a vector passes it if its inner
product with the direction exceeds a height. Directions form a structured
random product code: after a random rotation the coordinates are cut into two
blocks, each block has a small random codebook, and every pair of codewords is
a direction. Several rotations with codes of their own even out the blocks'
shares of a vector's length. A vector's filters are list-decoded from its two short rows of
inner products, without visiting the directions one by one. Vectors that share
a filter meet in that filter's bucket and are verified in double precision; a
pair counts in its first common filter only, so nothing is counted twice and no
pair leaves the task: a bucket returns counts for its members and a spanning
forest of its links. Buckets above a size are cut into blocks.

Equal vectors of one label collapse to a node first, and vectors that make up a
thousandth of all rows or more find their node by a broadcast of a thousand rows
at most. Each node is decoded once and stored with its list of filters; bucket
sizes and the rows that are dealt to buckets are both read from that table. A
vector travels to each of its filters, some 28 with the parameters as they are:
its pairs are verified where they meet, since the pairs themselves, within dense
groups, would be far more. The code's size grows with
the number of nodes so that buckets stay of one expected size, and the height
follows from the wanted expected number of common filters of a pair at exactly
the threshold (``shared``; a pair is missed with chance about exp(-shared), less
the closer it is).

Up to seven dimensions caps tell little apart: there is one filter, a bucket of
each label, cut into blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label, link with nothing: n_links 0, their own
component, kept. Vectors of different lengths never link. Repeated rows are
vectors of their own and link; a null id is never a component's unless all its
ids are null. A cosine equal to the threshold links. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_blocks, components, stored

#: Expected members of a bucket under random directions.
BUCKET = 24
#: Expected common filters of two vectors at exactly the threshold.
SHARED = 16.0
#: Independent rotations; their codes share out the directions.
ROTATIONS = 12
SEED = 20
#: A vector of so large a share of all rows finds its node by broadcast.
HEAVY_SHARE = 1 / 1000


def _tail(dim: int, height: np.ndarray | float) -> np.ndarray:
    """P(a coordinate of a random unit vector >= height), by integration."""
    grid = np.linspace(-1, 1, 20001)
    density = np.maximum(1 - grid * grid, 0) ** ((dim - 3) / 2)
    upper = np.cumsum(density[::-1])[::-1]
    return np.interp(height, grid, upper / upper[0], left=1.0, right=0.0)


def _both(dim: int, height: float, cosine: float) -> float:
    """P(a random direction is within the cap of both of two vectors)."""
    u = np.linspace(height, 1, 4000)[:-1]
    density = np.maximum(1 - u * u, 0) ** ((dim - 3) / 2)
    whole = np.maximum(1 - np.linspace(-1, 1, 20001) ** 2, 0) ** ((dim - 3) / 2)
    need = (height - u * cosine) / (np.sqrt(1 - cosine**2) * np.sqrt(1 - u * u))
    chance = _tail(max(dim - 1, 3), np.clip(need, -1, 1))
    return float((density * chance).sum() * (u[1] - u[0]) / (whole.sum() * 2 / 20000))


def plan_code(nodes: int, dim: int, cosine: float, shared: float = SHARED, bucket: float = BUCKET) -> tuple[int, float]:
    """(codewords a block, height): the smallest code whose buckets hold about
    ``bucket`` of ``nodes`` vectors while a pair at the threshold is expected in
    ``shared`` common filters."""
    if dim < 8:  # too few dimensions for caps: one direction that all pass
        return 1, -2.0
    words = 4
    while True:
        low, high = -1.0, 1.0
        for _ in range(40):
            height = (low + high) / 2
            low, high = (height, high) if ROTATIONS * words * words * _both(dim, height, cosine) >= shared else (low, height)
        if nodes * float(_tail(dim, low)) <= bucket or words >= 2048:
            return words, low
        words = -(-words * 5 // 4)


class ProductCode:
    """Random codebooks after random rotations; the same for a seed."""

    def __init__(self, dim: int, words: int, height: float, seed: int = SEED):
        draw = np.random.default_rng([seed, dim, words])
        self.cut = dim // 2
        self.words, self.need = words, height * np.sqrt(2.0 if self.cut else 1.0)
        self.codes = []
        for _ in range(ROTATIONS):
            rotation = np.linalg.qr(draw.standard_normal((dim, dim)))[0]
            sides = []
            for block in (rotation[:, : self.cut], rotation[:, self.cut :]):
                book = draw.standard_normal((block.shape[1], words))
                sides.append(block @ (book / np.maximum(np.linalg.norm(book, axis=0), 1e-300)))
            self.codes.append(sides)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of each filter that each row exceeds, by row."""
        rows, filters = [], []
        for k, (first, second) in enumerate(self.codes):
            one, two = unit @ first, unit @ second
            best = two.max(1)
            n, i = np.nonzero(one >= self.need - best[:, None])  # codewords that some partner lifts over the height
            for start in range(0, len(n), 65536):
                m, c = n[start : start + 65536], i[start : start + 65536]
                hit, j = np.nonzero(two[m] >= self.need - one[m, c][:, None])
                rows.append(m[hit])
                filters.append((k * self.words + c[hit]) * self.words + j)
        row, number = np.concatenate(rows), np.concatenate(filters).astype(np.int64)
        order = np.argsort(row, kind="stable")
        return row[order], number[order]


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: str) -> F.Column:
    """True for a vector of finite components that are not all zero."""
    x = F.col(vector)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.coalesce((F.size(x) > 0) & ~F.exists(x, bad) & F.exists(x, lambda v: v != 0), F.lit(False))


def links(nodes: DataFrame, dim: int, count: int, cosine: float, shared: float, bucket: float, seed: int) -> DataFrame:
    """(node, other, weight) for each member of a bucket that has links there:
    the rows of other nodes that it is linked with, and a member that its links
    in the bucket lead to, the same for all that they connect."""
    words, height = plan_code(count, dim, cosine, shared, bucket)

    def code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = ProductCode(dim, words, height, seed)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                rows, filters = code.decode(_unit(part.column(1), dim))
                per = np.bincount(rows, minlength=part.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), pa.array(filters.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["label", "vec", "node", "weight", "filters"])

    label = nodes.schema["label"].dataType.simpleString()
    vec = nodes.schema["vec"].dataType.simpleString()
    decoded = stored(nodes.select("label", "vec", "node", "weight").mapInArrow(code_rows, f"label {label}, vec {vec}, node bigint, weight bigint, filters array<int>"), "decoded")
    dealt = bucket_blocks(decoded.select("label", F.explode("filters").alias("filter"), "node", "weight", "vec", "filters"), ["label", "filter"], "node")
    keys = ["label", "filter", "lo", "hi"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "own", "node", "weight", "vec", "filters")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            change = _changes(table, keys)
            if len(change) > 1:
                yield from _verify(table.slice(0, change[-1]), change[:-1])
                table = table.slice(change[-1])
            rest = table
        if rest is not None and rest.num_rows:
            yield from _verify(rest, _changes(rest, keys))

    def _verify(table: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        unit = _unit(table["vec"].chunk(0), dim)
        node, weight, own = (table[c].to_numpy().astype(np.int64) for c in ("node", "weight", "own"))
        cross = table["lo"].to_numpy() != table["hi"].to_numpy()
        here = table["filter"].to_numpy()
        offsets = np.asarray(table["filters"].chunk(0).offsets)
        offsets = offsets - offsets[0]
        every = np.asarray(table["filters"].chunk(0).flatten())
        out_node, out_other, out_weight = [], [], []
        for at, to in zip(begins, np.r_[begins[1:], table.num_rows]):
            if to - at < 2:
                continue
            gained, low = np.zeros(to - at, np.int64), np.arange(to - at)
            for a, b, near in _pairs(unit[at:to], cosine):
                keep = near & (node[at:to][a][:, None] != node[at:to][b][None, :])
                if cross[at]:
                    keep &= own[at:to][a][:, None] != own[at:to][b][None, :]
                if not keep.any():
                    continue
                # a pair counts in its first common filter: none of those before this one may be common
                earlier = []
                for side in (a, b):
                    lists = [every[offsets[at + k] : offsets[at + k + 1]] for k in side]
                    earlier.append([x[x < here[at]] for x in lists])
                names, place = np.unique(np.concatenate([*earlier[0], *earlier[1]]), return_inverse=True)
                if len(names):
                    sizes = [len(x) for x in (*earlier[0], *earlier[1])]
                    has = np.zeros((len(sizes), len(names)), np.float32)
                    has[np.repeat(np.arange(len(sizes)), sizes), place] = 1
                    keep &= has[: len(a)] @ has[len(a) :].T == 0
                if not keep.any():
                    continue
                gained[a] += keep @ weight[at:to][b]
                i, j = np.nonzero(keep)
                low = _joined(low, a[i], b[j])
            some = np.flatnonzero(gained)
            out_node.append(node[at:to][some])
            out_other.append(node[at:to][low[some]])
            out_weight.append(gained[some])
        if out_node:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_node, out_other, out_weight)], names=["node", "other", "weight"])

    return dealt.mapInArrow(verify, "node bigint, other bigint, weight bigint")


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for k in keys:
        x = table[k].to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def _joined(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``low`` (a smaller member of the same component for each member) after
    the links a-b are added."""
    while True:
        least = np.minimum(low[a], low[b])
        if (low[a] == least).all() and (low[b] == least).all():
            return low
        low = low.copy()
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        while (low[low] != low).any():
            low = low[low]


def _pairs(unit: np.ndarray, cosine: float, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows against all members: row numbers and which are near."""
    everyone = np.arange(len(unit))
    for start in range(0, len(unit), block):
        rows = everyone[start : start + block]
        for other in range(0, len(unit), block):
            columns = everyone[other : other + block]
            yield rows, columns, unit[rows] @ unit[columns].T >= cosine


def joined_back(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (id, label, vec) with what is known of their vector. At most
    1 / HEAVY_SHARE vectors make up that share of all rows each; they are
    broadcast, and their rows are not shuffled."""
    known = stored(known, "known")
    most = (known.agg(F.sum("weight")).first()[0] or 0) * HEAVY_SHARE
    heavy = F.broadcast(known.filter(F.col("weight") > F.greatest(F.lit(most), F.lit(1.0))).select(F.col("label").alias("of"), F.col("vec").alias("vec_of"), F.struct("n_links", "component").alias("heavy")))
    met = rows.join(heavy, (F.col("label") == F.col("of")) & (F.col("vec") == F.col("vec_of")), "left").drop("of", "vec_of")
    rest = met.filter("heavy IS NULL").drop("heavy").join(known, ["label", "vec"])
    return met.filter("heavy IS NOT NULL").select("id", "heavy.*").unionByName(rest.select("id", "n_links", "component"))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.93,
    shared: float = SHARED,
    bucket: float = BUCKET,
    seed: int = SEED,
) -> DataFrame:
    """Columns: ``id_col``, n_links, component_id, kept."""
    source = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec")).withColumn("ok", usable("vec") & F.col("label").isNotNull())
    nodes = source.filter("ok").groupBy("label", "vec").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("weight"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    sizes = nodes.groupBy(F.size("vec").alias("dim"), "label").count().groupBy("dim").agg(F.max("count").alias("n")).collect()  # one row for each vector length
    found = None
    for dim, count in sizes:
        part = links(nodes.filter(F.size("vec") == dim), dim, count, cosine, shared, bucket, seed)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return source.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "links")
    roots = stored(components(found.select(F.col("node").alias("a"), F.col("other").alias("b")), "embedding"), "roots")
    gained = found.groupBy("node").agg(F.sum("weight").alias("gained"))
    labelled = (
        nodes.join(gained, "node", "left")
        .join(roots, "node", "left")
        .select("label", "vec", "low", "weight", F.coalesce("gained", F.lit(0)).alias("gained"), F.coalesce("root", "node").alias("root"))
    )
    least = labelled.groupBy("root").agg(F.min("low").alias("component"))
    known = labelled.join(least, "root").select("label", "vec", "weight", (F.col("gained") + F.col("weight") - 1).alias("n_links"), "component")
    linked = joined_back(source.filter("ok").select("id", "label", "vec"), known).select("id", "n_links", "component")
    alone = source.filter("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("component").cast("long").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )
