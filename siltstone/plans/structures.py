"""Queries on slots, frames, torsions, clashes and block deletion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import spatial as P
from ..operators import structure as S
from . import groups
from .registry import query, table as t


def part(k):
    """The k-th point of three components."""
    return F.slice("embedding", 3 * k + 1, 3)


def axes_sql(negative_x: int, origin: int, plane: int, eps: str = "1e-8") -> str:
    """CTEs whose last, ``f``, has vec_id, embedding and axes e0, e1, e2."""
    at = lambda k, i: f"embedding[{3 * k + i}]::DOUBLE"
    minus = lambda a, b: "[" + ", ".join(f"{at(a, i)} - {at(b, i)}" for i in (1, 2, 3)) + "]"
    unit = lambda v: "[" + ", ".join(f"{v}[{i}] / sqrt(list_dot_product({v}, {v}) + {eps})" for i in (1, 2, 3)) + "]"
    return (
        f"WITH a AS (SELECT *, {minus(origin, negative_x)} AS u, {minus(plane, origin)} AS v FROM embeddings), b AS (SELECT *, {unit('u')} AS e0 FROM a), "
        "c AS (SELECT *, [v[1] - e0[1] * list_dot_product(e0, v), v[2] - e0[2] * list_dot_product(e0, v), v[3] - e0[3] * list_dot_product(e0, v)] AS w FROM b), "
        f"d AS (SELECT *, {unit('w')} AS e1 FROM c), "
        "f AS (SELECT vec_id, embedding, e0, e1, [e0[2] * e1[3] - e0[3] * e1[2], e0[3] * e1[1] - e0[1] * e1[3], e0[1] * e1[2] - e0[2] * e1[1]] AS e2 FROM d) "
    )


@query(axes_sql(2, 1, 0) + "SELECT vec_id, list_transform(e0 || e1 || e2, lambda x: round(x, 6)) AS axes, list_transform(embedding[4:6], lambda x: round(x::DOUBLE, 6)) AS origin FROM f")
def rigid_frames(spark, d):
    """Backbone frames: first axis from C to CA, N in the plane."""
    f = S.with_frame(t(spark, d, "embeddings").select("vec_id", "embedding"), part(2), part(1), part(0), "f")
    short = lambda a: F.transform(a, lambda x: X.rounded(x, 6))
    return f.select("vec_id", short(F.concat("f.e0", "f.e1", "f.e2")).alias("axes"), short(F.col("f.origin")).alias("origin"))


@query(
    axes_sql(1, 2, 0)
    + """, g AS (SELECT vec_id, e1, e2, [embedding[10]::DOUBLE - embedding[7]::DOUBLE, embedding[11]::DOUBLE - embedding[8]::DOUBLE, embedding[12]::DOUBLE - embedding[9]::DOUBLE] AS m FROM f),
h AS (SELECT vec_id, list_dot_product(e1, m) AS y, list_dot_product(e2, m) AS z FROM g)
SELECT vec_id, round(z / sqrt(y * y + z * z + 1e-8), 6) AS sin, round(y / sqrt(y * y + z * z + 1e-8), 6) AS cos FROM h"""
)
def torsions(spark, d):
    """Sine and cosine of the torsion of four points."""
    f = S.with_torsion(t(spark, d, "embeddings").select("vec_id", "embedding"), part(0), part(1), part(2), part(3), "angle")
    return f.select("vec_id", X.rounded(F.col("angle.sin"), 6).alias("sin"), X.rounded(F.col("angle.cos"), 6).alias("cos"))


@query(
    "SELECT l_orderkey, ["
    + ", ".join(f"max([l_extendedprice::DOUBLE, l_quantity::DOUBLE]) FILTER (WHERE l_linenumber = {k})" for k in range(1, 8))
    + "] AS slots, ["
    + ", ".join(f"count(*) FILTER (WHERE l_linenumber = {k}) > 0" for k in range(1, 8))
    + "] AS mask FROM lineitem GROUP BY 1"
)
def slot_values(spark, d):
    """Each order's lines in seven slots; of repeated ones the largest."""
    value = F.array(F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double"))
    return S.slot_values(t(spark, d, "lineitem"), ["l_orderkey"], F.col("l_linenumber"), value, F.struct(F.get(value, F.lit(0)), F.get(value, F.lit(1))), list(range(1, 8)))


@query()
def clash_removals(spark, d):
    """Labels as chains of one structure; held against a plain scan in the tests."""
    p = groups.points(spark, d)
    a = p.select(F.col("vec_id").alias("a"), F.col("label").alias("i"), "x", "y", "z")
    near = P.radius_pairs(a, p.select(F.col("vec_id").alias("b"), F.col("label").alias("j"), "x", "y", "z"), 0.9).filter("i < j")
    hits = near.groupBy("i", "j").agg(F.count_distinct("a").alias("hits_i"), F.count_distinct("b").alias("hits_j"))
    n = p.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    of = lambda side: n.select(F.col("label").alias(side), F.col("n").alias(f"atoms_{side}"), (F.col("label") == 3).alias(f"core_{side}"))
    records = hits.join(of("i"), "i").join(of("j"), "j").withColumn("structure", F.lit(1))
    return S.clash_removals(records, "structure", "i", "j", "hits_i", "hits_j", "atoms_i", "atoms_j", "core_i", "core_j")


START = "floor(('0x' || substr(md5('b{}:' || user_id), 1, 8))::BIGINT / 4294967296.0 * n)"


@query(
    "WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS row, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id, user_id FROM r WHERE row = 0 OR NOT ("
    + " OR ".join(f"(row >= {START.format(k)} AND row < {START.format(k)} + floor(n * 0.3))" for k in range(2))
    + ")"
)
def block_delete(spark, d):
    return S.delete_blocks(t(spark, d, "events").select("event_id", "user_id"), "user_id", [F.col("event_id")], 2, 0.3, "b")
