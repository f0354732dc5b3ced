"""Queries on arrays, nested values and per-row mathematics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import exprs as X
from .registry import query, table as t


def component(i):
    return F.get("embedding", F.lit(i)).cast("double")


@query("""SELECT vec_id, [round(-0.58273431 * (b2 * c3 - b3 * c2) + 0.56802827 * b1 - 0.54067466 * c1 + y1, 6), round(-0.58273431 * (b3 * c1 - b1 * c3) + 0.56802827 * b2 - 0.54067466 * c2 + y2, 6),
round(-0.58273431 * (b1 * c2 - b2 * c1) + 0.56802827 * b3 - 0.54067466 * c3 + y3, 6)] AS cb FROM (SELECT vec_id, embedding[4]::DOUBLE AS y1, embedding[5]::DOUBLE AS y2, embedding[6]::DOUBLE AS y3,
embedding[4]::DOUBLE - embedding[1]::DOUBLE AS b1, embedding[5]::DOUBLE - embedding[2]::DOUBLE AS b2, embedding[6]::DOUBLE - embedding[3]::DOUBLE AS b3,
embedding[7]::DOUBLE - embedding[4]::DOUBLE AS c1, embedding[8]::DOUBLE - embedding[5]::DOUBLE AS c2, embedding[9]::DOUBLE - embedding[6]::DOUBLE AS c3 FROM embeddings)""")
def virtual_point(spark, d):
    """The virtual CB of (N, CA, C)."""
    part = lambda k: F.slice("embedding", 1 + 3 * k, 3)
    return t(spark, d, "embeddings").select("vec_id", F.transform(X.virtual_cb(part(0), part(1), part(2)), lambda x: X.rounded(x, 6)).alias("cb"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding[1:32], embedding[33:64]), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))), 6) AS distance FROM embeddings")
def l2(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.round(X.l2(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)), 6).alias("distance"))


@query("SELECT event_id, list_transform(range(16), lambda i: round(exp(-(((value / 5 - (2 + i * (20.0::DOUBLE / 15))) / 1.25) ** 2)), 6)) AS features FROM events")
def rbf(spark, d):
    return t(spark, d, "events").select("event_id", F.transform(X.rbf(F.col("value") / 5), lambda x: F.round(x, 6)).alias("features"))


@query(f"SELECT l_orderkey, l_linenumber, round({2 / math.pi!r} * atan(l_quantity / 3), 6) AS scaled, least(greatest(l_quantity, 0), 1) AS has FROM lineitem")
def atan_scale(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(2 / math.pi * F.atan(F.col("l_quantity") / 3), 6).alias("scaled"), F.least(F.greatest("l_quantity", F.lit(0.0)), F.lit(1.0)).alias("has"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: exp(v::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(list_sum(list_transform(list_zip(e, range(len(e))), lambda z: z[1] * (z[2] + 0.5::DOUBLE) * 100.0::DOUBLE / len(e))) / list_sum(e), 6) AS score FROM e""")
def softmax_expect(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.round(X.softmax_expect(F.col("embedding"), 0.0, 100.0), 6).alias("score"))


@query("SELECT doc_id, round(1.24 * cbrt(greatest(n_chars, 19) - 15) - 1.8, 6) AS norm FROM documents")
def tm_norm(spark, d):
    return t(spark, d, "documents").select("doc_id", F.round(1.24 * F.cbrt(F.greatest("n_chars", F.lit(19)) - 15) - 1.8, 6).alias("norm"))


@query("SELECT o_orderkey, round(2.0 * pow(128, -0.5) * least(pow(o_orderkey + 1, -0.5), (o_orderkey + 1) * pow(4000, -1.5)), 9) AS rate FROM orders")
def noam(spark, d):
    step = (F.col("o_orderkey") + 1).cast("double")
    return t(spark, d, "orders").select("o_orderkey", F.round(2.0 * 128**-0.5 * F.least(F.pow(step, F.lit(-0.5)), step * 4000**-1.5), 9).alias("rate"))


@query("SELECT vec_id, CASE WHEN label = 7 THEN embedding[1:3] ELSE embedding[4:6] END AS point FROM embeddings")
def pseudo_beta(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.when(F.col("label") == 7, F.slice("embedding", 1, 3)).otherwise(F.slice("embedding", 4, 3)).alias("point"))


@query("SELECT vec_id, list_transform(range(10), lambda i: (i = label)::INTEGER) AS hot FROM embeddings")
def one_hot(spark, d):
    return t(spark, d, "embeddings").select("vec_id", X.one_hot(F.col("label"), 10).alias("hot"))


@query("""WITH b AS (SELECT n_regionkey AS block, n_nationkey AS value, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation), s AS (SELECT block, count(*) AS n FROM b GROUP BY 1), o AS (SELECT block, n, coalesce(sum(n) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
SELECT (o.block)::INTEGER AS row, c.k::INTEGER AS col, coalesce(b.value, -1)::INTEGER AS value FROM o, range(1, (SELECT count(*) + 1 FROM nation)) c(k) LEFT JOIN b ON b.block = o.block AND b.k = c.k - o.start""")
def block_diag(spark, d):
    """Rows of blocks beside one another, -1 off the diagonal. The matrix is
    small by meaning: one row a block."""
    n = t(spark, d, "nation")
    a = n.groupBy(F.col("n_regionkey").alias("row")).agg(F.array_sort(F.collect_list("n_nationkey")).alias("v"))
    every = a.agg(F.array_sort(F.collect_list(F.struct("row", F.size("v").alias("n")))).alias("sizes"))
    before = F.aggregate(F.filter("sizes", lambda s: s["row"] < F.col("row")), F.lit(0), lambda x, s: x + s["n"])
    total = F.aggregate("sizes", F.lit(0), lambda x, s: x + s["n"])
    line = F.concat(F.array_repeat(F.lit(-1), F.col("before")), F.col("v"), F.array_repeat(F.lit(-1), F.col("total") - F.col("before") - F.size("v")))
    e = a.join(F.broadcast(every)).withColumn("before", before).withColumn("total", total).select("row", F.posexplode(line).alias("col", "value"))
    return e.select("row", (F.col("col") + 1).alias("col"), "value")


@query("SELECT vec_id, list_transform(range(1, 6 + vec_id % 3 + 1), lambda i: CASE WHEN i <= 6 THEN round(embedding[i]::DOUBLE, 6) ELSE 0 END) AS padded, len(embedding[1:4 + vec_id % 3])::INTEGER AS cut FROM embeddings")
def pad_truncate(spark, d):
    head = F.transform(F.slice("embedding", 1, 6), lambda x: X.rounded(x.cast("double"), 6))
    size = (F.lit(6) + F.col("vec_id") % 3).cast("int")
    return t(spark, d, "embeddings").select("vec_id", X.pad_to(head, size, F.lit(0.0)).alias("padded"), F.size(F.slice("embedding", F.lit(1), (F.lit(4) + F.col("vec_id") % 3).cast("int"))).alias("cut"))


@query("""WITH g AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS parts, sum(l_quantity) AS total, count(*) AS n, arg_min(l_shipdate, (l_linenumber, l_shipdate)) AS first FROM lineitem GROUP BY 1) SELECT l_orderkey, list_concat(parts, [n]) AS features, total, first FROM g""")
def concat_kinds(spark, d):
    """Sequences concatenated, counts summed, others by their first."""
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"), F.sum("l_quantity").alias("total"), F.count(F.lit(1)).alias("n"), F.min_by("l_shipdate", F.struct("l_linenumber", "l_shipdate")).alias("first"))
    return g.select("l_orderkey", F.concat(F.col("p.l_partkey"), F.array("n")).alias("features"), "total", "first")


@query("""WITH n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS filled FROM conversations GROUP BY 1) SELECT conv_id, least(n, 8 // 2) AS paired, greatest(8 - least(filled, 8 // 2), 0) AS unpaired FROM n""")
def crop_budget(spark, d):
    n = t(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("filled"))
    half = F.lit(4).cast("long")
    return n.select("conv_id", F.least("n", half).alias("paired"), F.greatest(F.lit(8) - F.least("filled", half), F.lit(0).cast("long")).alias("unpaired"))


@query("SELECT vec_id, CASE label WHEN 0 THEN 9 WHEN 1 THEN 3 WHEN 2 THEN 7 WHEN 5 THEN 1 ELSE 31 END AS mapped FROM embeddings")
def remap(spark, d):
    m = F.create_map(*[F.lit(x) for kv in {0: 9, 1: 3, 2: 7, 5: 1}.items() for x in kv])
    return t(spark, d, "embeddings").select("vec_id", F.coalesce(F.try_element_at(m, F.col("label")), F.lit(31)).alias("mapped"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(s_nationkey, -1 - l_linenumber)::INTEGER AS residue, CASE WHEN s_nationkey IS NULL THEN 0 ELSE l_quantity END AS deletions FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0""")
def token_gather(spark, d):
    """Tokens take the column that matches, else their own class and zeros."""
    s = t(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    j = t(spark, d, "lineitem").join(s, "l_suppkey", "left")
    return j.select("l_orderkey", "l_linenumber", F.coalesce("s_nationkey", -1 - F.col("l_linenumber")).alias("residue"), F.when(F.col("s_nationkey").isNull(), 0.0).otherwise(F.col("l_quantity")).alias("deletions"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) = 64) AS right_shape, min(len(embedding))::INTEGER AS least FROM embeddings")
def shape_check(spark, d):
    return t(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") == 64).alias("right_shape"), F.min(F.size("embedding")).alias("least"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, ('0x' || substr(md5('aug' || l_orderkey || '_' || l_linenumber), 1, 8))::BIGINT / 4294967296.0 < 0.03 AS picked FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN picked THEN 0 ELSE 1 END AS mask, 'row' AS origin FROM m UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 1, 'context' FROM m WHERE picked""")
def augment_union(spark, d):
    """Hash-picked rows lose their mask and join the context."""
    u = X.hash_uniform(F.concat_ws("_", "l_orderkey", "l_linenumber"), "aug")
    m = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (u < 0.03).alias("picked"))
    context = F.when(F.col("picked"), F.array(F.struct(F.lit(0).alias("mask"), F.lit("row").alias("origin")), F.struct(F.lit(1).alias("mask"), F.lit("context").alias("origin")))).otherwise(F.array(F.struct(F.lit(1).alias("mask"), F.lit("row").alias("origin"))))
    return m.select("l_orderkey", "l_linenumber", "l_partkey", F.inline(context))


@query("""WITH a AS (SELECT conv_id, list(length(text) ORDER BY turn) AS lens, conv_id // 16 AS batch FROM conversations GROUP BY 1), m AS (SELECT *, max(len(lens)) OVER (PARTITION BY batch) AS top FROM a) SELECT conv_id, batch, list_concat(lens, list_transform(range(top - len(lens)), lambda x: 0)) AS padded FROM m""")
def pad_batch(spark, d):
    """Rows padded with zeros to the longest of their batch."""
    a = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("s")).select("conv_id", F.col("s.n").alias("lens"), F.floor(F.col("conv_id") / 16).alias("batch"))
    top = a.groupBy("batch").agg(F.max(F.size("lens")).alias("top"))
    return a.join(top, "batch").select("conv_id", "batch", X.pad_to(F.col("lens"), F.col("top"), F.lit(0).cast("long")).alias("padded"))


@query("SELECT o_orderkey, round(least(abs(o_totalprice - 1000), abs(o_totalprice - o_custkey)), 6) AS least_error FROM orders")
def least_of(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.round(F.least(F.abs(F.col("o_totalprice") - 1000), F.abs(F.col("o_totalprice") - F.col("o_custkey"))), 6).alias("least_error"))


@query("""WITH p AS (SELECT l_orderkey, list(l_linenumber - 1 ORDER BY l_partkey, l_linenumber) AS p FROM lineitem GROUP BY 1) SELECT l_orderkey, list_sort(p) = list_transform(range(len(p)), lambda i: i::INTEGER) AS valid, p = list_sort(p) AS identity FROM p""")
def perm_check(spark, d):
    p = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", (F.col("l_linenumber") - 1).alias("i")))).alias("s")).select("l_orderkey", F.col("s.i").alias("p"))
    return p.select("l_orderkey", X.is_permutation(F.col("p")).alias("valid"), (F.col("p") == F.array_sort("p")).alias("identity"))
