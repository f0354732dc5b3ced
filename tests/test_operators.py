"""Micro cases worked by hand, and plain-Python versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import exprs as X
from siltstone.operators import nested as nested_ops
from siltstone.operators import graph, ordered, relational, sampling, spatial
from siltstone.operators.quantiles import exact_quantiles
from siltstone.plans.queries import queries

SF = "/root/testdata/sf0.001"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_a3m(spark):
    assert one(spark, X.strip_lowercase(F.lit("ABcdEfg"))) == "ABE"
    assert one(spark, X.deletion_counts(F.lit("ABcdEfg"))) == [0, 0, 2]


def test_letters(spark):
    assert [one(spark, X.base26(F.lit(n))) for n in (1, 26, 27, 52, 53, 702, 703)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]


def test_angles(spark):
    assert abs(one(spark, X.angle_error(F.lit(3.0), F.lit(-3.0))) - (2 * math.pi - 6)) < 1e-9


def test_sampling_weight(spark):
    w = sampling.sampling_weight(F.lit("chain"), {"p": F.lit(1)}, {"p": 3.0}, {"chain": 0.5}, F.lit(2), F.lit(1))
    assert abs(one(spark, w) - 0.75) < 1e-6
    assert one(spark, sampling.keep_probability(F.lit(128), F.lit(4))) == 0.125


def test_split_sizes(spark):
    split = sampling.split_rows(spark.range(33), "id", {"train": 14 / 16, "val": 1 / 16, "test": 1 / 16}, "s")
    assert dict(split.groupBy("split").count().collect()) == {"train": 28, "val": 2, "test": 3}


def test_length_buckets(spark):
    df = spark.createDataFrame([(x,) for x in (10, 100, 110, 111, 250)], "n long")
    got = {r.n: r.bucket for r in ordered.length_buckets(df, "n").collect()}
    assert got == {10: 0, 100: 0, 110: 0, 111: 1, 250: 2}


def test_lddt_pair(spark):
    df = spark.createDataFrame([(1, 5.0, 5.7)], "k int, t double, p double")
    assert spatial.lddt(df, ["k"], F.col("t"), F.col("p")).first().lddt == 0.75


def test_dense_number_is_total(spark):
    df = relational.dense_number(spark.range(1000).repartition(7), [F.desc("id")], "n")
    assert sorted(r.n for r in df.collect()) == list(range(1000))
    assert all(r.n == 999 - r.id for r in df.collect())


def test_dense_number_of_many_wide_rows(spark, tmp_path):
    """Written out, with adaptive execution on: no row lost, no number twice."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        n = 2_000_000
        rows = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        order = [F.col("wide"), F.col("id")]
        relational.dense_number(rows, order, "n", 5).write.parquet(f"{tmp_path}/numbered")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = spark.read.parquet(f"{tmp_path}/numbered")
    assert got.agg(F.count(F.lit(1)), F.count_distinct("n"), F.count_distinct("id"), F.min("n"), F.max("n")).first() == (n, n, n, 5, n + 4)
    # a larger number never has a smaller key: by ranges of numbers, then within each
    part = got.groupBy(F.floor(F.col("n") / 1000).alias("part")).agg(F.min("wide").alias("least"), F.max("wide").alias("most"), F.array_sort(F.collect_list(F.struct("n", "wide"))).alias("rows"))
    inside = F.transform("rows", lambda r: r["wide"])
    parts = part.select("part", "least", "most", (inside == F.array_sort(inside)).alias("sorted")).orderBy("part").collect()
    assert all(p.sorted for p in parts) and all(a.most < b.least for a, b in zip(parts, parts[1:]))


def test_balanced_assign(spark):
    got = {r.o_orderkey: r.worker for r in queries()["balanced_assign"](spark, SF).collect()}
    rows = sorted(((int(r.o_totalprice // 1000), r.o_orderkey) for r in spark.read.parquet(f"{SF}/orders.parquet").collect()), key=lambda x: (-x[0], x[1]))
    load, count, spare, cap = [0.0] * 7, [0] * 7, 0, len(rows) // 7
    for value, key in rows:
        able = [k for k in range(7) if count[k] < cap]
        if able:
            w = min(able, key=lambda k: (load[k], k))
            load[w] += value**2
            count[w] += 1
        else:
            w, spare = spare % 7, spare + 1
        assert got[key] == w


def test_kabsch(spark):
    got = {r.label: r.rmsd for r in queries()["rmsd"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    for label in got:
        x = np.array([r.embedding[:3] for r in rows if r.label == label])
        y = np.array([r.embedding[3:6] for r in rows if r.label == label])
        x, y = x - x.mean(0), y - y.mean(0)
        u, _, v = np.linalg.svd(x.T @ y)
        flip = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(v))])
        assert abs(np.sqrt(((x @ u @ flip @ v - y) ** 2).sum(1).mean()) - got[label]) < 1e-5


def test_minhash_clusters_are_brute_force(spark):
    import random

    from siltstone.plans.groups import near_text_clusters

    draw, texts = random.Random(4), ["", "  ", None, "one two", "one  TWO", "one two three"]
    for _ in range(12):
        base = [f"w{draw.randrange(4000)}" for _ in range(120)]
        for edits in (0, 1, 1, 2, 2, 3, 4, 6, 9):
            copy = list(base)
            for _ in range(edits):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(4000)}"
            texts.append(" ".join(copy))
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    sets = [shingles((x or "").lower().split()) for x in texts]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            common = len(sets[i] & sets[j])
            if common and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert len(set(root)) > 30  # some copies are not near enough
    got = near_text_clusters(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.cluster_id for r in got} == dict(enumerate(root))


def test_minhash_groups_equal_texts(spark):
    got = {r.doc_id: r.cluster_id for r in queries()["minhash_clusters"](spark, SF).collect()}
    first = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        if r.text.strip():
            assert got[r.doc_id] == got[first.setdefault(r.text, r.doc_id)]


def test_wrong_names_and_biases_fail(spark):
    assert one(spark, X.entry_and_chain(F.lit("1aBc_A.2 x"))).asDict() == {"entry": "1abc", "chain": "A.2"}
    assert one(spark, X.bias_of(F.array(F.lit("ALA:-0.5"), F.lit(" PRO : 1"), F.lit("ALA:2")))) == {"ALA": 2.0, "PRO": 1.0}
    for wrong in (X.entry_and_chain(F.lit("nothing here")), X.bias_of(F.array(F.lit("ALA"))), X.bias_of(F.array(F.lit("ALA:x")))):
        with pytest.raises(Exception, match="no entry|not name:value"):
            one(spark, wrong)
    with pytest.raises(NotImplementedError):
        X.species_of("other")


def test_flatten_and_merge(spark):
    nested = spark.sql("SELECT 1 AS a, named_struct('b', 2, 'c', named_struct('d', 'x', 'e.f', 3)) AS s")
    assert nested_ops.flatten_columns(nested).columns == ["a", "s:b", "s:c:d", "s:c:e.f"]
    assert tuple(nested_ops.flatten_columns(nested).first()) == (1, 2, "x", 3)
    df = spark.sql("SELECT * FROM VALUES (1, 2, map('a', 1)), (1, 1, map('a', 5, 'b', 6)), (2, 1, map()) AS t(k, o, m)")
    assert {(r.k, r.key): r["values"] for r in nested_ops.merge_maps(df, ["k"], "m", ["o"]).collect()} == {(1, "a"): [5, 1], (1, "b"): [6]}
    assert {(r.k, r.key): r["values"] for r in nested_ops.merge_maps(df, ["k"], "m", ["o"], F.array_max).collect()} == {(1, "a"): 5, (1, "b"): 6}


def test_exact_quantiles(spark):
    draw = np.random.default_rng(3)
    big = draw.normal(size=60_000).round(3)
    small = draw.normal(size=7)
    rows = spark.createDataFrame([("big", float(v)) for v in big] + [("small", float(v)) for v in small] + [("one", 2.0), ("one", None), (None, 5.0)], "k string, v double")
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    got = {r.k: [r[n] for n in wanted] for r in exact_quantiles(rows, ["k"], "v", wanted).collect()}
    assert set(got) == {"big", "small", "one", None} and got["one"] == [2.0] * 5 and got[None] == [5.0] * 5
    for k, values in (("big", big), ("small", small)):
        assert np.allclose(got[k], np.quantile(values, list(wanted.values())), atol=1e-12)
    # the lines above the bracket's accuracy go through the sketch
    hot = spark.range(100_000).select(F.lit("k").alias("k"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).cast("double").alias("v"))
    want = np.quantile([7.0 if i % 3 == 0 else i % 1000 for i in range(100_000)], [0.3, 0.5])
    assert np.allclose(list(exact_quantiles(hot, ["k"], "v", {"x": 0.3, "y": 0.5}).select("x", "y").first()), want)


def test_components_are_union_find(spark):
    got = {r.node: r.component for r in queries()["components"](spark, SF).collect()}
    orders = {r.o_orderkey: r.o_custkey * 2 for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        a, b = find(orders[r.l_orderkey]), find(r.l_suppkey * 2 + 1)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(root)}
    # many components, chains and a hub
    edges = [(i, i + 1) for i in range(0, 90) if i % 10] + [(1000, 1000 + i) for i in range(1, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    root.clear()
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {r.node: r.component for r in graph.components(df.select("a").union(df.select("b")), df).collect()} == {x: find(x) for x in list(root)}


def test_knn_in_blocks_is_brute_force(spark, monkeypatch):
    """One structure of many blocks, one of one, one without points; ties and
    null keys; the same with and without a broadcast of the counts."""
    draw = np.random.default_rng(4)
    place = {n: draw.integers(0, 6, 3).astype(float).tolist() for n in range(160)}
    home = {n: "big" if n < 120 else "small" if n < 150 else None for n in place}
    points = spark.createDataFrame([(home[n], n, v) for n, v in place.items()], "s string, p long, pv array<double>")
    asked = spark.createDataFrame([*[(home[n], n, v) for n, v in place.items() if n % 3 == 0], ("alone", 999, [0.0] * 3)], "s string, q long, qv array<double>")
    want = set()
    for n in [n for n in place if n % 3 == 0 and home[n]]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(place[n], place[m])), m) for m in place if home[m] == home[n])[:4]
        want |= {(home[n], n, m, d, r) for r, (d, m) in enumerate(near, 1)}
    for bound in (spatial.BROADCAST_GROUPS, 0):
        monkeypatch.setattr(spatial, "BROADCAST_GROUPS", bound)
        got = spatial.knn(asked, points, 4, ["s"], "q", "p", "qv", "pv", block=16)
        assert {tuple(r) for r in got.collect()} == want
    assert spatial.knn(asked, points.limit(0), 4, ["s"], "q", "p", "qv", "pv").count() == 0


def test_a_hub_and_many_edges_are_dealt_to_tasks_by_rows(spark, monkeypatch):
    """Tasks of 50 rows: a hub of 700 edges, chains, loops, repeated and null edges; no task groups more than its rows."""
    from siltstone.operators import shared

    for module in (shared, graph):
        monkeypatch.setattr(module, "TASK_ROWS", 50)
    edges = [(5000, 1000 + i) for i in range(700)] * 2 + [(i, i + 1) for i in range(0, 90) if i % 10] + [(3, 3), (None, 4), (7, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    nodes = df.select("a").union(df.select("b")).filter("a IS NOT NULL")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {r.node: r.component for r in graph.components(nodes, df).collect()} == {x: find(x) for x in [*root, 4, 7]}
    spread = shared.dealt(df, 1448, "a", "b").select("a", F.spark_partition_id().alias("p"))
    assert spread.select("p").distinct().count() > 20
    assert shared.dealt(df, 50, "a").rdd.getNumPartitions() == df.rdd.getNumPartitions()


def test_shingle_sets_are_not_shuffled(spark, monkeypatch):
    """What is as large as the texts meets its pairs where it is stored; an id with two texts has one set."""
    from siltstone.plans import groups

    kept, plain = [], groups.verified

    def seen(pairs, sets, *rest):
        kept.append(sets("shingles"))
        return plain(pairs, sets, *rest)

    monkeypatch.setattr(groups, "verified", seen)
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text), (6, text), (7, text + " tail"), (8, "other words of a text that is alone"), (8, text + " tail"), (9, None)]
    found = {r.doc_id: r.cluster_id for r in groups.near_text_clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {5: 5, 6: 5, 7: 5, 8: 5, 9: 9}
    for df in kept:
        plan = df._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("SortMergeJoin") :].split("Exchange")[0]
        assert "Bucketed: true" in side and df.groupBy("doc_id").count().filter("count > 1").isEmpty()
