"""Pairs in blocks, against the operators that have a row a pair."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import exprs as X
from siltstone.operators import confidence as C
from siltstone.operators import spatial


def token_rows(n=90, width=8):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(n):
        v = [float(x) for x in rng.normal(0, 2, width)]
        v = None if k == 11 else [*v[:-1], None] if k == 17 else v[:-2] if k in (3, 8) else v
        rows.append((None if k == 5 else k % 2, k, None if k == 6 else "abc"[k % 3], k % 5 != 0, k % 4 == 0, v))
    far = [[900.0, *[-900.0] * 7], [*[-900.0] * 7, 900.0]]  # powers of their sum are far below a double's range
    return rows + [(0, n + k, "a", True, False, v) for k, v in enumerate(far)]


@pytest.mark.parametrize("block", [7, 4096])
def test_terms_of_blocks_equal_terms_of_pairs(spark, block):
    tokens = spark.createDataFrame(token_rows(), "s int, token long, chain string, has_frame boolean, ligand boolean, logits array<double>")
    a, b = (tokens.select("s", F.col("token").alias(i), F.col("logits").alias(v)) for i, v in (("i", "u"), ("j", "v")))
    pairs = a.join(b, "s").select("s", "i", "j", X.softmax(F.zip_with("u", "v", lambda x, y: x + y)).alias("prob"))
    order = ["s", "i", "chain_j"]
    want = C.pair_terms(pairs, tokens, ["s"], 0.0, 32.0).orderBy(*order).collect()
    got = C.summed_logit_terms(tokens, ["s"], 0.0, 32.0, block=block).select(*want[0].__fields__).orderBy(*order).collect()
    assert len(got) == len(want) and [r[:8] for r in got] == [r[:8] for r in want]
    for g, w in zip(got, want):
        for x, y in zip(g[8:], w[8:]):
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12))


def test_confidence_makes_no_row_a_pair(spark):
    tokens = spark.createDataFrame(token_rows(), "s int, token long, chain string, has_frame boolean, ligand boolean, logits array<double>")
    made = C.summed_logit_terms(tokens, ["s"], 0.0, 32.0).collect()
    assert len(made) <= 3 * len(token_rows())
    assert C.summed_logit_terms(tokens.limit(0), ["s"], 0.0, 32.0).count() == 0


def vector_rows(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = [float(x) for x in rng.integers(-2, 3, 5) * 0.3]  # many ties
        v = {4: None, 9: [*v[:-1], None], 14: v[:-1], 19: [math.nan, *v[1:]], 24: [math.inf, *v[1:]], 29: [1e120, *v[1:]]}.get(k, v) if seed % 2 else v
        rows.append((None if k == 7 else k % 3 if k < n - 3 else 9, k * 7 % n, v))
    return rows


def plain_nearest(spark, q, p, k):
    kind = "s int, {} long, {} array<double>"
    a, b = spark.createDataFrame(q, kind.format("q", "qv")), spark.createDataFrame(p, kind.format("p", "pv"))
    pairs = a.join(b, "s").withColumn("d2", X.squared_distance(F.col("qv"), F.col("pv")))
    by = {}
    for r in pairs.collect():
        by.setdefault(r.q, []).append((r.d2 is None, math.isnan(r.d2 or 0.0), 0.0 if r.d2 is None or math.isnan(r.d2) else r.d2, r.p, r.s))
    return a, b, sorted((x[4], i, x[3], None if x[0] else "nan" if x[1] else x[2], n) for i, xs in by.items() for n, x in enumerate(sorted(xs)[:k], 1))


@pytest.mark.parametrize("seeds", [(2, 4), (3, 5), (2, 5), (3, 4)])
@pytest.mark.parametrize("block", [6, 2048])
def test_nearest_of_blocks_equal_all_pairs(spark, seeds, block):
    a, b, want = plain_nearest(spark, vector_rows(60, seeds[0]), vector_rows(50, seeds[1]), 4)
    found = spatial.knn(a, b, 4, ["s"], "q", "p", "qv", "pv", block=block).collect()
    assert sorted(((r.s, r.q, r.p, "nan" if r.d2 is not None and math.isnan(r.d2) else r.d2, r.rank) for r in found), key=lambda r: (r[0], r[1], r[4])) == sorted(want, key=lambda r: (r[0], r[1], r[4]))


def test_toxicity_learns_from_every_labelled_row(spark):
    """Word, label and counts of rows that a bounded sample would have left out."""
    from siltstone.llm import toxicity

    rows = [(k, f"plain text number {k}" + (" villainous" if k % 3 == 0 else " benign"), int(k % 3 == 0)) for k in range(9000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    taken, positive, negative = toxicity.training_sample(docs, labels, "doc_id", "text", "toxic", None)
    assert (taken.count(), positive, negative) == (9000, 3000, 6000)
    model = toxicity.fit(docs, labels)
    assert model.gram_counts["  v"] == 3000 and model.gram_counts["  b"] == 6000
    scored = toxicity.score_documents(docs, model).join(labels, "doc_id")
    assert scored.filter("predicted <> toxic").count() == 0


def test_logistic_weights_are_the_optimum(spark):
    """Against proximal gradient on the same rows, dense and in memory."""
    from siltstone.llm import toxicity

    rng = np.random.default_rng(2)
    rows = [(sorted({f"w{int(x)}" for x in rng.zipf(1.3, 12) if x < 60} | ({"bad"} if y and rng.random() < 0.8 else set())), y) for y in rng.integers(0, 2, 600).tolist()]
    words = spark.createDataFrame(rows, "words array<string>, y int")
    bias, weights = toxicity.fit_logistic(words)
    counts = {r.feature: (r.positive, r.negative) for r in toxicity.feature_counts(words).collect()}
    n1 = sum(y for _, y in rows)
    names = sorted(f for f, (p, n) in counts.items() if p >= 2 and p / n1 > 3 * n / (len(rows) - n1))
    x = np.array([[min(sum(f in toxicity.word_features(w) for w in ws), 4) for f in names] for ws, _ in rows], float)
    y = np.array([r[1] for r in rows], float)
    w, b = np.zeros(len(names)), 0.0
    step = 1 / (0.25 * (np.linalg.norm(x, 2) ** 2 + len(y)) + 0.02)
    for _ in range(20000):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        v = w - step * (x.T @ e + 0.02 * w)
        w, b = np.sign(v) * np.maximum(abs(v) - step * 0.4, 0), b - step * e.sum()
    got = np.array([weights.get(f, 0.0) for f in names])
    assert "w:bad" in weights and np.abs(x @ got + bias - x @ w - b).max() < 0.02
