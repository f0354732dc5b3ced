"""Queries on groups, order, space, graphs and metrics."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import graph as G
from ..operators import ordered as O
from ..operators import relational as R
from ..operators import spatial as P
from ..operators.quantiles import exact_quantiles
from ..operators.shared import by_shuffle, dealt, stored, stored_by
from .registry import query, table as t

# cells of the hash-picked stand-in coordinates: the first three components, in units of ten
XYZ = "embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z"


def points(spark, d, *extra):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 10
    return t(spark, d, "embeddings").select("vec_id", "label", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), *extra)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag = 'N'))")
def group_all(spark, d):
    l = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")  # noqa: E741
    return R.groups_where(l, ["l_orderkey"], ~F.bool_and(F.col("l_returnflag") == "N")).drop("l_returnflag")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 4)")
def group_min_distinct(spark, d):
    l = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")  # noqa: E741
    return R.groups_where(l, ["l_orderkey"], F.count_distinct("l_suppkey") >= 4).drop("l_suppkey")


@query("""WITH g AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM g WHERE gap > 150)""")
def adjacent_gap(spark, d):
    """Groups without a jump between neighbours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    bad = t(spark, d, "events").withColumn("gap", F.abs(F.col("value") - F.lag("value").over(w))).filter("gap > 150").select("user_id").distinct()
    return t(spark, d, "events").select("event_id", "user_id").join(bad, "user_id", "left_anti")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def group_any(spark, d):
    any_ = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_quantity") > 45).alias("any")).filter("any")
    return t(spark, d, "orders").select("o_orderkey").join(any_, "o_orderkey", "left_semi")


@query(f"""WITH p AS (SELECT vec_id, label, {XYZ} FROM embeddings), n AS (SELECT label, count(*) AS n FROM p GROUP BY 1),
h AS (SELECT a.label AS la, b.label AS lb, count(DISTINCT a.vec_id) AS hits FROM p a JOIN p b ON a.label <> b.label AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.5 GROUP BY 1, 2)
SELECT la, lb, round(hits / n.n::DOUBLE, 6) AS ratio FROM h JOIN n ON n.label = la""")
def clash_ratio(spark, d):
    """Share of a chain's points within the clash radius of another chain."""
    p = points(spark, d)
    a = p.select(F.col("vec_id").alias("a"), F.col("label").alias("la"), "x", "y", "z")
    near = P.radius_pairs(a, p.select(F.col("vec_id").alias("b"), F.col("label").alias("lb"), "x", "y", "z"), 0.5).filter("la <> lb")
    hits = near.groupBy("la", "lb").agg(F.count_distinct("a").alias("hits"))
    n = p.groupBy(F.col("label").alias("la")).agg(F.count(F.lit(1)).alias("n"))
    return hits.join(n, "la").select("la", "lb", F.round(F.col("hits") / F.col("n"), 6).alias("ratio"))


@query(f"""WITH p AS (SELECT vec_id, label, {XYZ} FROM embeddings), c AS (SELECT x, y, z FROM p ORDER BY ('0x' || substr(md5('c' || vec_id), 1, 8))::BIGINT, vec_id LIMIT 1),
g AS (SELECT p.label, min(sqrt((p.x - c.x) ** 2 + (p.y - c.y) ** 2 + (p.z - c.z) ** 2)) AS dist, count(*) AS tokens FROM p, c GROUP BY 1),
r AS (SELECT label, sum(tokens) OVER (ORDER BY dist, label)::BIGINT AS running FROM g) SELECT label, running FROM r WHERE running <= (SELECT count(*) * 0.6 FROM p)""")
def nearest_groups(spark, d):
    """Groups by their nearest member to a hash-picked centre, within a budget."""
    p = points(spark, d)
    centre = p.orderBy(X.hash_int(F.col("vec_id"), "c"), "vec_id").select(F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz")).limit(1)
    dist = F.sqrt(sum(((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in "xyz"), F.lit(0.0)))
    g = p.join(F.broadcast(centre)).groupBy("label").agg(F.min(dist).alias("dist"), F.count(F.lit(1)).alias("tokens"))
    return O.running_quota(g.withColumn("one", F.lit(1)), ["one"], [F.col("dist"), F.col("label")], "tokens", p.count() * 0.6).select("label", "running")


@query("""WITH e AS (SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, a.l_returnflag AS ea, b.l_linestatus AS eb FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
c AS (SELECT ea, eb, i, j, count(DISTINCT l_orderkey) AS have FROM e GROUP BY ALL), n AS (SELECT l_returnflag AS ea, count(DISTINCT l_orderkey) AS copies FROM lineitem GROUP BY 1)
SELECT ea, eb, i, j, have FROM c JOIN n USING (ea) WHERE have * 20 >= copies""")
def symmetric_edges(spark, d):
    """Edges that a set share of their entity's copies have."""
    l = t(spark, d, "lineitem")  # noqa: E741
    a = l.select("l_orderkey", F.col("l_linenumber").alias("i"), (F.col("l_linenumber") + 1).alias("j"), F.col("l_returnflag").alias("ea"))
    e = a.join(l.select("l_orderkey", F.col("l_linenumber").alias("j"), F.col("l_linestatus").alias("eb")), ["l_orderkey", "j"])
    have = e.groupBy("ea", "eb", "i", "j").agg(F.count_distinct("l_orderkey").alias("have"))
    copies = l.groupBy(F.col("l_returnflag").alias("ea")).agg(F.count_distinct("l_orderkey").alias("copies"))
    return have.join(copies, "ea").filter("have * 20 >= copies").select("ea", "eb", "i", "j", "have")


@query(f"""WITH p AS (SELECT vec_id, {XYZ} FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS distance
FROM p a JOIN p b ON a.vec_id < b.vec_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.8""")
def radius_pairs(spark, d):
    p = points(spark, d).drop("label")
    near = P.radius_pairs(p.withColumnRenamed("vec_id", "a"), p.withColumnRenamed("vec_id", "b"), 0.8).filter("a < b")
    return near.select("a", "b", F.round("distance", 6).alias("distance"))


SQ = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


@query("""WITH p AS (SELECT vec_id, label, embedding[1:32] AS q, embedding[33:64] AS p FROM embeddings), d AS (SELECT a.vec_id AS query_id, b.vec_id AS point_id, list_sum(list_transform(list_zip(a.q, b.p), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d2 FROM p a JOIN p b ON a.label = b.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, point_id) AS rank FROM d) SELECT query_id, point_id, round(d2, 6) AS d2, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def knn(spark, d):
    """Residues (first halves of all vectors) to their nearest ligand atoms
    (second halves of all vectors) in the same structure."""
    e = t(spark, d, "embeddings")
    q = e.select("label", F.col("vec_id").alias("query_id"), F.slice("embedding", 1, 32).alias("qv"))
    p = e.select("label", F.col("vec_id").alias("point_id"), F.slice("embedding", 33, 32).alias("pv"))
    return P.knn(q, p, 5, ["label"], "query_id", "point_id", "qv", "pv").select("query_id", "point_id", F.round("d2", 6).alias("d2"), "rank")


@query(f"""WITH r AS (SELECT a.vec_id AS query_id, b.vec_id AS point_id, {SQ} AS d2, row_number() OVER (PARTITION BY a.vec_id ORDER BY {SQ}, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label)
SELECT query_id, point_id, round(d2, 6) AS d2, rank::INTEGER AS rank FROM r WHERE rank <= 4""")
def knn_self(spark, d):
    e = t(spark, d, "embeddings")
    side = lambda i, v: e.select("label", F.col("vec_id").alias(i), F.col("embedding").alias(v))
    return P.knn(side("query_id", "qv"), side("point_id", "pv"), 4, ["label"], "query_id", "point_id", "qv", "pv").select("query_id", "point_id", F.round("d2", 6).alias("d2"), "rank")


@query("SELECT lang, source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY 1, 2")
def value_counts(spark, d):
    docs = t(spark, d, "documents")
    total = docs.agg(F.count(F.lit(1)).alias("all"))
    return docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("lang", "source", "n", F.round(100.0 * F.col("n") / F.col("all"), 6).alias("percent"))


@query("SELECT source, count(DISTINCT lang) AS langs, count(DISTINCT n_chars) AS lengths FROM documents GROUP BY 1")
def count_distinct(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.count_distinct("lang").alias("langs"), F.count_distinct("n_chars").alias("lengths"))


@query("SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1")
def min_max_avg(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


AGGREGATORS = {"avg": F.avg, "max": F.max, "min": F.min}
QUANTILES = {"median": 0.5, "pct90": 0.9, "pct99": 0.99}


@query("SELECT event_type, round(avg(value), 6) AS avg, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS pct90, round(quantile_cont(value, 0.99), 6) AS pct99, round(max(value), 6) AS max, round(min(value), 6) AS min FROM events GROUP BY 1")
def metric_summary(spark, d):
    e = t(spark, d, "events")
    plain = e.groupBy("event_type").agg(*[F.round(f("value"), 6).alias(k) for k, f in AGGREGATORS.items()])
    quantiles = exact_quantiles(e, ["event_type"], "value", QUANTILES)
    return plain.join(quantiles, "event_type", "left").withColumns({k: F.round(k, 6) for k in QUANTILES})


@query("SELECT event_type, round(sum(value * m) / greatest(sum(m), 1e-8), 6) AS mean, round(exp(least(sum(value / 100 * m) / greatest(sum(m), 1e-8), 50)), 6) AS perplexity FROM (SELECT *, (event_id % 3 <> 0)::INTEGER AS m FROM events) GROUP BY 1")
def masked_mean(spark, d):
    e = t(spark, d, "events").withColumn("m", (F.col("event_id") % 3 != 0).cast("int"))
    mean = lambda x: F.sum(x * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-8))
    return e.groupBy("event_type").agg(F.round(mean(F.col("value")), 6).alias("mean"), F.round(F.exp(F.least(mean(F.col("value") / 100), F.lit(50.0))), 6).alias("perplexity"))


@query("SELECT c_mktsegment, round(avg(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 6) AS mean, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS n FROM customer GROUP BY 1")
def nan_mean(spark, d):
    v = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(F.lit(float("nan")))
    clean = F.nanvl(v, F.lit(None).cast("double"))
    return t(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.avg(clean), 6).alias("mean"), F.count(clean).alias("n"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM c) SELECT user_id, event_type FROM r WHERE k = 1""")
def mode_first_seen(spark, d):
    return R.mode_first(t(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("""WITH e AS (SELECT generate_subscripts(string_split(n_name, ''), 1) AS pos, unnest(string_split(n_name, '')) AS ch FROM nation) SELECT pos::INTEGER AS pos, ch, round(count(*) / (SELECT count(*) FROM nation)::DOUBLE, 6) AS share FROM e GROUP BY 1, 2""")
def column_profile(spark, d):
    n = t(spark, d, "nation")
    total = n.agg(F.count(F.lit(1)).alias("all"))
    e = n.select(F.posexplode(F.filter(F.split("n_name", ""), lambda c: c != "")).alias("pos", "ch"))
    return e.groupBy((F.col("pos") + 1).alias("pos"), "ch").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("pos", "ch", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("""WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS v FROM embeddings) SELECT label, pos::INTEGER AS pos, round(count(*) FILTER (WHERE v > 0) / (1e-6 + count(*)), 6) AS share FROM e GROUP BY 1, 2""")
def cluster_profile(spark, d):
    e = t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    return e.groupBy("label", (F.col("pos") + 1).alias("pos")).agg(F.round(F.count_if(F.col("v") > 0) / (F.lit(1e-6) + F.count(F.lit(1))), 6).alias("share"))


@query("""WITH g AS (SELECT l_linenumber AS i, sum(l_quantity) AS s, count(*) AS c, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1) SELECT r AS idx, coalesce(s, 0) AS sum, round(coalesce(s, 0) / greatest(coalesce(c, 0), 1), 6) AS mean, lo, hi FROM range(0, 10) t(r) LEFT JOIN g ON i = r""")
def scatter_agg(spark, d):
    """Index-keyed reductions with a dense result."""
    g = t(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("idx")).agg(F.sum("l_quantity").alias("s"), F.count(F.lit(1)).alias("c"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    dense = spark.range(10).withColumnRenamed("id", "idx").join(g, "idx", "left")
    s = F.coalesce("s", F.lit(0.0))
    return dense.select("idx", s.alias("sum"), F.round(s / F.greatest(F.coalesce("c", F.lit(0)), F.lit(1)), 6).alias("mean"), "lo", "hi")


@query("WITH e AS (SELECT generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT pos::INTEGER AS pos, round(avg(v), 6) AS mean FROM e GROUP BY 1")
def column_mean(spark, d):
    e = t(spark, d, "embeddings").select(F.posexplode("embedding").alias("pos", "v"))
    return e.groupBy((F.col("pos") + 1).alias("pos")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("SELECT n_regionkey, list_sort(list(n_nationkey)) AS members FROM nation GROUP BY 1")
def collect_members(spark, d):
    return t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_set("n_nationkey")).alias("members"))


@query("SELECT label, " + ", ".join(f"round(sum(embedding[{i + 1}]::DOUBLE), 6) AS f{i}" for i in range(12)) + ", round(avg((embedding[1] > 0)::INTEGER), 6) AS fraction FROM embeddings GROUP BY 1")
def feature_sums(spark, d):
    e = t(spark, d, "embeddings")
    return e.groupBy("label").agg(*[F.round(F.sum(F.get("embedding", F.lit(i)).cast("double")), 6).alias(f"f{i}") for i in range(12)], F.round(F.avg((F.get("embedding", F.lit(0)) > 0).cast("int")), 6).alias("fraction"))


@query(f"SELECT label, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM (SELECT label, {XYZ} FROM embeddings) GROUP BY 1")
def centroid(spark, d):
    return points(spark, d).groupBy("label").agg(*[F.round(F.avg(a), 6).alias(a) for a in "xyz"])


@query("""WITH g AS (SELECT user_id, list_reverse_sort(list(value)) AS v, arg_max(value, (event_id)) AS ranked FROM events GROUP BY 1) SELECT user_id, round(v[1], 6) AS best, round(v[len(v)], 6) AS worst, round(v[len(v) // 2 + 1], 6) AS median, round(v[1] - ranked, 6) AS gap FROM g""")
def sample_rankers(spark, d):
    """Best, worst, upper median and distance to another score's pick."""
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)")  # of an even number the lower is the upper from above
    g = t(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("best"), F.min("value").alias("worst"), middle.alias("median"), F.max_by("value", "event_id").alias("ranked"))
    return g.select("user_id", F.round("best", 6).alias("best"), F.round("worst", 6).alias("worst"), F.round("median", 6).alias("median"), F.round(F.col("best") - F.col("ranked"), 6).alias("gap"))


@query("""WITH c AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS change FROM events), i AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM c)
SELECT user_id, island::BIGINT AS island, any_value(event_type) AS event_type, min(event_id) AS first, count(*) AS n FROM i GROUP BY 1, 2""")
def islands(spark, d):
    """Runs of equal values in order."""
    i = O.islands(t(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type"))
    return i.groupBy("user_id", "island").agg(F.first("event_type").alias("event_type"), F.min("event_id").alias("first"), F.count(F.lit(1)).alias("n"))


BUCKETS = """l AS (SELECT DISTINCT n_chars AS len FROM documents), b AS (SELECT min(len) AS anchor, 0 AS bucket FROM l UNION ALL SELECT (SELECT min(len) FROM l WHERE len > anchor + 100), bucket + 1 FROM b WHERE (SELECT min(len) FROM l WHERE len > anchor + 100) IS NOT NULL)"""


@query(f"""WITH RECURSIVE {BUCKETS} SELECT doc_id, n_chars, (SELECT max(bucket) FROM b WHERE anchor <= n_chars)::BIGINT AS bucket FROM documents WHERE n_chars IS NOT NULL""")
def length_buckets(spark, d):
    return O.length_buckets(t(spark, d, "documents").select("doc_id", "n_chars"), "n_chars")


@query(f"""WITH RECURSIVE {BUCKETS}, a AS (SELECT doc_id, n_chars, (SELECT max(bucket) FROM b WHERE anchor <= n_chars) AS bucket FROM documents WHERE n_chars > 0),
s AS (SELECT *, least(20, 45000000 // (max(n_chars) OVER (PARTITION BY bucket) * max(n_chars) OVER (PARTITION BY bucket)) + 1) AS size, count(*) OVER (PARTITION BY bucket) AS n, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS rn FROM a)
SELECT doc_id, bucket::BIGINT AS bucket, (rn // (size * 2))::BIGINT AS batch, ((rn // size) % 2)::BIGINT AS replica FROM s WHERE rn < (n // (size * 2)) * size * 2""")
def batch_assign(spark, d):
    b = O.length_buckets(t(spark, d, "documents").select("doc_id", "n_chars").filter("n_chars > 0"), "n_chars")
    return O.batch_assign(b, "bucket", "n_chars", [F.col("doc_id")], 20, 45_000_000, 2).select("doc_id", "bucket", "batch", "replica")


@query("SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) = 1 AS single FROM lineitem GROUP BY 1, 2")
def first_last(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last"), (F.count(F.lit(1)) == 1).alias("single"))


@query("SELECT l_orderkey, l_linenumber, running FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS running FROM lineitem) WHERE running <= 60")
def running_quota(spark, d):
    return O.running_quota(t(spark, d, "lineitem"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], "l_quantity", 60).select("l_orderkey", "l_linenumber", "running")


@query("SELECT event_type, arg_max(event_id, (value, -event_id)) AS best, arg_max(round(value, 6), event_id) AS last FROM events GROUP BY 1")
def best_last(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"), F.max_by(F.round("value", 6), "event_id").alias("last"))


@query(None)
def balanced_assign(spark, d):
    """Greedy balance of squared sums; held against a plain loop in the tests."""
    return O.balanced_assign(t(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("size")), "o_orderkey", "size", 7)


EDGES = "SELECT DISTINCT o_custkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


def edges(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("a"))
    l = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") * 2 + 1).alias("b"))  # noqa: E741
    size = l.count()
    return dealt(o, size, "o_orderkey").join(by_shuffle(dealt(l, size, "o_orderkey")), "o_orderkey").select("a", "b")


#: Rounds of the smallest label across edges; the driver tables settle in far fewer.
COMPONENTS = f"e AS MATERIALIZED ({EDGES}), s AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), r0 AS MATERIALIZED (SELECT DISTINCT a AS node, a AS component FROM s)" + "".join(
    f", r{k + 1} AS MATERIALIZED (SELECT r.node, least(any_value(r.component), min(o.component)) AS component FROM r{k} r JOIN s ON s.a = r.node JOIN r{k} o ON o.node = s.b GROUP BY 1)" for k in range(12)
)


@query(f"WITH {COMPONENTS} SELECT node, component FROM r12")
def components(spark, d):
    """Customers and suppliers joined by the lines of all orders."""
    e = stored(edges(spark, d), "lines")
    return G.components(e.select("a").union(e.select("b")), e)


@query(f"WITH {COMPONENTS}, n AS (SELECT a AS node, count(*) AS size FROM s GROUP BY 1) SELECT component, arg_max(node, (size, -node)) AS node, count(*) AS members FROM r12 JOIN n USING (node) GROUP BY 1")
def component_rep(spark, d):
    """The member of each component with most links, the smallest id on ties."""
    lines = stored(edges(spark, d), "lines")
    e = stored(dealt(lines, lines.count(), "a", "b").distinct(), "distinct-lines")
    links = e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    c = G.components(e.select("a").union(e.select("b")), e).join(by_shuffle(links), "node")
    return G.representatives(c, "node", "component", "size")


@query("""WITH s AS (SELECT o_orderkey, string_agg(l_returnflag || l_linestatus, ',' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS sig FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), m AS (SELECT *, min(o_orderkey) OVER (PARTITION BY sig) AS first FROM s) SELECT o_orderkey, sig, dense_rank() OVER (ORDER BY first) - 1 AS equivalent FROM m""")
def signature_group(spark, d):
    """Equal ordered signatures share an id, by first seen."""
    l = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("s")))).alias("a"))  # noqa: E741
    s = t(spark, d, "orders").select("o_orderkey").join(l, "o_orderkey").select("o_orderkey", F.array_join(F.col("a.s"), ",").alias("sig"))
    first = R.dense_number(s.groupBy("sig").agg(F.min("o_orderkey").alias("first")), [F.col("first")], "equivalent").drop("first")
    return s.join(first, "sig")


@query(None)
def minhash_clusters(spark, d):
    """Texts joined by links of Jaccard 0.8 or more over five-word shingles; a
    text of one to four words is one shingle, a text without words its own
    cluster. Candidates share one of 24 MinHash bands of 4, which misses a pair
    at 0.8 with chance 3e-6; each is verified over the 64-bit shingle hashes."""
    return near_text_clusters(t(spark, d, "documents").select("doc_id", "text"))


def near_text_clusters(docs):
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    made = docs.select("doc_id", F.transform(words, lambda w: F.xxhash64(w)).alias("words")).mapInArrow(shingle_bands, "doc_id bigint, shingles array<bigint>, same binary, keys array<bigint>")
    # written by id, so that the sets, as large as the texts, are never shuffled
    sets = stored_by(made.filter(F.size("shingles") > 0).withColumn("size", F.size("shingles")), "shingles", "doc_id")
    # equal sets are joined to their smallest id and only that one is compared
    low = sets.groupBy("same").agg(F.min("doc_id").alias("low"))
    equal = sets.select("doc_id", "same").join(by_shuffle(low), "same").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    one = stored(low.groupBy(F.col("low").alias("doc_id")).agg(F.min("same").alias("least")), "shingle-sets")
    # by two bounds: an equality would become a second key of the join, and the sets be shuffled for it
    alone = lambda *columns: sets.select("doc_id", "same", *columns).join(by_shuffle(one), "doc_id").filter("same >= least AND same <= least").select("doc_id", *columns)
    keyed = stored(alone("size", "keys").select("doc_id", "size", F.posexplode("keys").alias("band", "key")), "bands")
    first = keyed.groupBy("band", "key").agg(F.min("doc_id").alias("low"), F.min_by("size", "doc_id").alias("low_size"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    near = stored(keyed.join(by_shuffle(first), ["band", "key"]), "buckets")
    # sets whose sizes differ by more than the bound cannot be so alike
    sized = lambda x, y: F.least(x, y) >= 0.8 * F.greatest(x, y)
    star = verified(near.filter("doc_id <> low").filter(sized("size", "low_size")).select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct(), alone)
    # members that are not like their bucket's first are compared with all others of it
    apart = near.filter("doc_id <> low").join(by_shuffle(star), (F.col("low") == star["a"]) & (F.col("doc_id") == star["b"]), "left_anti").select("band", "key", F.col("doc_id").alias("u"), F.col("size").alias("u_size"))
    rest = apart.join(by_shuffle(near.select("band", "key", "doc_id", "low", "size")), ["band", "key"]).filter("u <> doc_id AND doc_id <> low").filter(sized("u_size", "size"))
    more = verified(rest.select(F.least("u", "doc_id").alias("a"), F.greatest("u", "doc_id").alias("b")).distinct(), alone)
    links = equal.unionByName(star).unionByName(more)
    return G.components(docs.select("doc_id"), links).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster_id"))


def verified(pairs, sets, least=0.8):
    """The pairs whose shingle sets have a Jaccard index of ``least`` or more;
    only the first set of each pair travels."""
    side = lambda i, v: by_shuffle(sets("shingles").select(F.col("doc_id").alias(i), F.col("shingles").alias(v)))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return stored(both.filter(common >= least * (F.size("x") + F.size("y") - common)).select("a", "b"), "near-texts")


def shingle_bands(batches, rows=4, bands=24, width=5):
    """(id, sorted shingle hashes, digest of them, band keys) from word hashes."""
    draw = np.random.default_rng(8)
    odd, add = draw.integers(0, 2**63, (2, rows * bands), np.uint64)
    odd |= np.uint64(1)

    def mixed(x):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    for batch in batches:
        sets, same, keys = [], [], []
        for hashes in batch.column(1):
            w = hashes.values.to_numpy(zero_copy_only=False).view(np.uint64)
            n = min(width, len(w))
            h = np.full(max(len(w) - n + 1, 0) if n else 0, n, np.uint64)
            for k in range(n):
                h = mixed(h * np.uint64(31) + w[k : k + len(h)])
            h = np.unique(h)
            sets.append(h.view(np.int64))
            same.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
            low = np.array([mixed(h * a + c).min() for a, c in zip(odd, add)], np.uint64) if len(h) else np.zeros(rows * bands, np.uint64)
            key = np.zeros(bands, np.uint64)
            for r in range(rows):
                key = mixed(key * np.uint64(31) + low[r::rows])
            keys.append(key.view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "shingles", "same", "keys"])


@query("""WITH c AS (SELECT label, min(vec_id) AS centre FROM embeddings GROUP BY 1), m AS (SELECT e.vec_id, c.centre, len(list_filter(list_zip(e.embedding, k.embedding), lambda z: (z[1] > 0) = (z[2] > 0))) AS agree FROM embeddings e, c JOIN embeddings k ON k.vec_id = c.centre)
SELECT vec_id, arg_max(centre, (agree, -centre)) AS cluster, max(agree) AS agree FROM m GROUP BY 1""")
def agreement_assign(spark, d):
    """Nearest of a few centres by agreeing columns, the first on ties."""
    e = t(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x > 0).alias("s"))
    centres = e.groupBy("label").agg(F.min("vec_id").alias("vec_id")).join(e.select("vec_id", "s"), "vec_id").select(F.col("vec_id").alias("centre"), F.col("s").alias("v"))
    return P.nearest_centre(e.select("vec_id", "s"), centres, "vec_id", "s", "centre", "v").select("vec_id", "cluster", "agree")


@query("""WITH p(perm, i, j) AS (VALUES (0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 1, 2), (1, 2, 1), (1, 3, 3), (2, 1, 3), (2, 2, 2), (2, 3, 1)), r AS (SELECT vec_id, perm, sqrt(sum((embedding[i]::DOUBLE - embedding[3 + j]::DOUBLE) ** 2) / 3) AS rmsd FROM embeddings, p GROUP BY 1, 2)
SELECT vec_id, arg_min(perm, (rmsd, perm)) AS perm, round(min(rmsd), 6) AS rmsd FROM r GROUP BY 1""")
def best_permutation(spark, d):
    """The symmetric permutation of least deviation."""
    perms = [(0, 1, 2), (1, 0, 2), (2, 1, 0)]
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rmsd = lambda p: F.sqrt(sum(((at(i) - at(3 + j)) * (at(i) - at(3 + j)) for i, j in enumerate(p)), F.lit(0.0)) / 3)
    best = F.array_min(F.array(*[F.struct(rmsd(p).alias("rmsd"), F.lit(k).alias("perm")) for k, p in enumerate(perms)]))
    return t(spark, d, "embeddings").select("vec_id", best.alias("b")).select("vec_id", "b.perm", F.round("b.rmsd", 6).alias("rmsd"))


@query(f"""WITH p AS (SELECT vec_id, label, {XYZ}, embedding FROM embeddings), q AS (SELECT a.label, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS t, sqrt((a.embedding[4]::DOUBLE * 10 - b.embedding[4]::DOUBLE * 10) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS p FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, round(avg(((abs(t - p) < 0.5)::INTEGER + (abs(t - p) < 1)::INTEGER + (abs(t - p) < 2)::INTEGER + (abs(t - p) < 4)::INTEGER) / 4.0), 6) AS lddt, count(*) AS n_pairs FROM q WHERE t < 2 GROUP BY 1""")
def lddt(spark, d):
    """Kept distances among the true ones within the radius, by group."""
    p = points(spark, d, (F.get("embedding", F.lit(3)).cast("double") * 10).alias("w"))
    a = p.select("label", F.col("vec_id").alias("a"), "x", "y", "z", F.col("w").alias("wa"), F.col("y").alias("ya"), F.col("z").alias("za"))
    b = p.select("label", F.col("vec_id").alias("b"), "x", "y", "z", F.col("w").alias("wb"), F.col("y").alias("yb"), F.col("z").alias("zb"))
    pairs = P.radius_pairs(a, b, 2.0, ["label"]).filter("a < b")
    square = lambda u, v: (F.col(u) - F.col(v)) * (F.col(u) - F.col(v))
    predicted = F.sqrt(square("wa", "wb") + square("ya", "yb") + square("za", "zb"))
    return P.lddt(pairs, ["label"], F.col("distance"), predicted, 2.0).withColumn("lddt", F.round("lddt", 6))


@query("""SELECT user_id, round(0.8 * a + 0.2 * b + 0.5 * c - 100 * e, 6) AS score FROM (SELECT user_id, avg(value) / 100 AS a, max(value) / 1000 AS b, avg((event_type = 'view')::INTEGER) AS c, max((value > 1e6)::INTEGER) AS e FROM events GROUP BY 1)""")
def ranking_score(spark, d):
    g = t(spark, d, "events").groupBy("user_id").agg((F.avg("value") / 100).alias("a"), (F.max("value") / 1000).alias("b"), F.avg((F.col("event_type") == "view").cast("int")).alias("c"), F.max((F.col("value") > 1e6).cast("int")).alias("e"))
    return g.select("user_id", F.round(0.8 * F.col("a") + 0.2 * F.col("b") + 0.5 * F.col("c") - 100 * F.col("e"), 6).alias("score"))


@query("SELECT round(avg(m), 6) AS mean, count(*) AS groups FROM (SELECT l_orderkey, avg((l_extendedprice - l_quantity * 1000) ** 2) / 1e6 AS m FROM lineitem GROUP BY 1)")
def two_level_mean(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg((F.avg((F.col("l_extendedprice") - F.col("l_quantity") * 1000) * (F.col("l_extendedprice") - F.col("l_quantity") * 1000)) / 1e6).alias("m"))
    return g.agg(F.round(F.avg("m"), 6).alias("mean"), F.count(F.lit(1)).alias("groups"))


@query(f"""WITH p AS (SELECT vec_id, label, {XYZ} FROM embeddings), h AS (SELECT a.label AS ligand, b.label AS chain, count(DISTINCT b.vec_id) AS atoms FROM p a JOIN p b ON a.label < b.label AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 1.0 GROUP BY 1, 2)
SELECT ligand, arg_max(chain, (atoms, -chain)) AS chain, max(atoms) AS atoms FROM h GROUP BY 1""")
def primary_group(spark, d):
    """The chain with most atoms in the pocket, the first on ties."""
    p = points(spark, d)
    a = p.select(F.col("label").alias("ligand"), "x", "y", "z")
    near = P.radius_pairs(a, p.select("vec_id", F.col("label").alias("chain"), "x", "y", "z"), 1.0).filter("ligand < chain")
    atoms = near.groupBy("ligand", "chain").agg(F.count_distinct("vec_id").alias("atoms"))
    return atoms.groupBy("ligand").agg(F.max_by("chain", F.struct("atoms", -F.col("chain"))).alias("chain"), F.max("atoms").alias("atoms"))


@query("SELECT l_orderkey, l_linenumber, len(list_filter(list_transform(range(15), lambda i: 2.0 + i * (50.0 - 2.0) / 14), lambda b: l_quantity > b))::INTEGER AS bin FROM lineitem")
def bucketise(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.bins_below(F.col("l_quantity"), 2.0, 50.0, 15).alias("bin"))


@query("SELECT round(sum((quality = toxic)::INTEGER * m)::DOUBLE / sum(m), 6) AS recovery, round(exp(sum(-ln(CASE WHEN quality = 1 THEN 0.9 ELSE 0.1 END) * m) / sum(m)), 6) AS perplexity FROM (SELECT *, (doc_id % 5 <> 0)::INTEGER AS m FROM labels)")
def recovery(spark, d):
    m = (F.col("doc_id") % 5 != 0).cast("int")
    nll = -F.log(F.when(F.col("quality") == 1, 0.9).otherwise(0.1))
    return t(spark, d, "labels").agg(F.round(F.sum((F.col("quality") == F.col("toxic")).cast("int") * m) / F.sum(m), 6).alias("recovery"), F.round(F.exp(F.sum(nll * m) / F.sum(m)), 6).alias("perplexity"))


@query(None)
def rmsd(spark, d):
    """Deviation after the best rigid motion, by group; numpy in the tests."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    e = t(spark, d, "embeddings").select("label", *[at(i).alias(f"p{i}") for i in range(3)], *[at(3 + i).alias(f"t{i}") for i in range(3)])
    return P.kabsch_rmsd(e, ["label"], ["p0", "p1", "p2"], ["t0", "t1", "t2"]).withColumn("rmsd", F.round("rmsd", 6))


@query(f"SELECT vec_id, round(degrees(acos(greatest(-1, least(1, {{dot}} / ({{u}} * {{v}} + 1e-4))))), 4) AS angle FROM embeddings".format(
    dot=" + ".join(f"(embedding[{i + 4}]::DOUBLE - embedding[{i + 1}]::DOUBLE) * (embedding[{i + 7}]::DOUBLE - embedding[{i + 4}]::DOUBLE)" for i in range(3)).join("()"),
    u="sqrt(" + " + ".join(f"(embedding[{i + 4}]::DOUBLE - embedding[{i + 1}]::DOUBLE) ** 2" for i in range(3)) + ")",
    v="sqrt(" + " + ".join(f"(embedding[{i + 7}]::DOUBLE - embedding[{i + 4}]::DOUBLE) ** 2" for i in range(3)) + ")",
))
def angles(spark, d):
    three = lambda s: F.transform(F.slice("embedding", s, 3), lambda x: x.cast("double"))
    return t(spark, d, "embeddings").select("vec_id", F.round(P.angle_at(three(1), three(4), three(7)), 4).alias("angle"))


@query(f"SELECT event_id, round(least(abs(d), abs(abs(d) - {2 * math.pi!r})), 6) AS error FROM (SELECT event_id, value / 100 - user_id % 3 AS d FROM events)")
def angle_error(spark, d):
    return t(spark, d, "events").select("event_id", F.round(X.angle_error(F.col("value") / 100, (F.col("user_id") % 3).cast("double")), 6).alias("error"))


@query(f"SELECT doc_id, round(sqrt(-2 * ln(greatest(('0x' || substr(md5('n1' || doc_id), 1, 8))::BIGINT / 4294967296.0, 1e-12))) * cos({2 * math.pi!r} * (('0x' || substr(md5('n2' || doc_id), 1, 8))::BIGINT / 4294967296.0)), 6) AS noise FROM documents")
def hash_noise(spark, d):
    """Normal noise that any partitioning repeats."""
    return t(spark, d, "documents").select("doc_id", F.round(P.box_muller(X.hash_uniform(F.col("doc_id"), "n1"), X.hash_uniform(F.col("doc_id"), "n2")), 6).alias("noise"))
