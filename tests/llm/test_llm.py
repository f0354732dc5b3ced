"""The training-data operators against brute force, round trips, the library
and held-out labels, with nulls, empty and long texts, ties and empty tables."""

import base64
import hashlib
import math
import os
import random
import re
import sys
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import check, connect  # noqa: E402
from siltstone.llm import anisotropic_ann, embedding_dedup, kneser_ney, mixing, queries, secret_scan, sentencepiece_bpe, simhash, toxicity, url_filter, warc  # noqa: E402
from siltstone.llm.oracles import oracle_sql  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, id int"


def docs(spark, texts):
    return spark.createDataFrame([(n, t, "en", "s", len(t or ""), 0.0, "x", 1) for n, t in enumerate(texts)], DOCS)


ODD = [None, "", " ", "one", "one", "a b c d e f", "x" * 50_000, "word " * 20_000, "\n\t\x0b", "😀 é ▁ \x00"]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    check(queries.queries()[name](spark, SF), connect(SF), oracle_sql()[name])


# 1 mixing
def test_mixing_margins_and_edges(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.prepared(d, "doc_id", "text", "source", "lang", None)
    cells = rows.groupBy(*mixing.DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    goals = spark.createDataFrame([("en", 0.25), ("de", 0.25), ("fr", 0.25), ("es", 0.25)], "value string, share double")
    raked = mixing.rake(cells, {"lang": goals})
    total = raked.agg(F.sum("weight")).first()[0]
    assert all(abs(r[1] / total - 0.25) < 1e-9 for r in raked.groupBy("lang").agg(F.sum("weight")).collect())
    assert raked.first().residual < 1e-9
    sources = cells.select("source").distinct().withColumn("share", F.when(F.col("source") == "src0", 0.5).otherwise(0.1)).withColumnRenamed("source", "value")
    both = mixing.rake(cells, {"lang": goals, "source": sources})
    want = {(r.source, r.lang, r.topic): float(r.tokens) for r in cells.collect()}
    lang, share = {r.value: 0.25 for r in goals.collect()}, {r.value: r.share for r in sources.collect()}
    share = {k: v / sum(share.values()) for k, v in share.items()}
    whole = sum(want.values())
    for _ in range(400):
        for k, goal in ((1, lang), (0, share)):
            have = {}
            for c, w in want.items():
                have[c[k]] = have.get(c[k], 0) + w
            want = {c: w * goal[c[k]] * whole / have[c[k]] for c, w in want.items()}
    assert all(abs(r.weight - want[r.source, r.lang, r.topic]) < 1e-6 * whole for r in both.collect()) and both.first().residual < 1e-8
    # targets that no weights meet: the residual says so
    odd = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "source string, lang string, tokens long").withColumn("topic", F.lit(""))
    half = lambda a, b: spark.createDataFrame([(a, 0.5), (b, 0.5)], "value string, share double")
    odd_goals = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "value string, share double"), "lang": half("x", "y")}
    assert abs(mixing.rake(odd, odd_goals).first().residual - 4) < 1e-6
    shares = mixing.calibrate(spark.createDataFrame([(n, 10, 10.0 * 2**n) for n in range(8)], "cell int, tokens long, weight double"), 0.6).collect()
    assert abs(sum(r.probability * r.tokens for r in shares) - 48) < 1e-4 and max(r.probability for r in shares) == 1
    assert mixing.mix(docs(spark, ODD)).count() == len(ODD)
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.sampled(docs(spark, ODD), share=1.0).columns == docs(spark, []).columns


# 2 embeddings
def test_embedding_links(spark):
    draw = np.random.default_rng(1)
    base = draw.standard_normal((40, 32))
    near = np.repeat(base[:4], 60, 0) + 0.04 * draw.standard_normal((240, 32))
    vectors = [*base.tolist(), *near.tolist(), base[0].tolist(), [0.0] * 32, [float("nan")] * 32, None, [], [1.0, 2.0]]
    rows = [(n, v, None if n == 3 else 1) for n, v in enumerate(vectors)]
    rows.append((5, rows[5][1], 1))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).select("vec_id", "n_links", "component_id").collect()))
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, label in rows if label is not None and v and len(v) == 32 and np.isfinite(v).all() and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in ok])
    link = unit @ unit.T >= 0.93
    np.fill_diagonal(link, False)
    root = np.arange(len(ok))
    i, j = np.nonzero(link)
    root = embedding_dedup._joined(root, i, j)
    ids = np.array([i for i, _ in ok])
    least = {r: ids[root == r].min() for r in set(root)}
    want = [(int(ids[k]), int(link[k].sum()), int(least[root[k]])) for k in range(len(ok))]
    rest = [(i, 0, i) for i, v, label in rows if not (label is not None and v and len(v) == 32 and np.isfinite(v).all() and any(v))]
    assert got == sorted(want + rest)
    clash = df.selectExpr("*", "1 id", "2 node", "3 weight", "4 vec", "5 filter", "6 heavy", "7 ok")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(clash).select("vec_id", "n_links", "component_id").collect())) == got
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# 3 quality
def units(text):
    """UTF-16 units, two for a code point beyond U+FFFF."""
    return [u for c in map(ord, text) for u in ([c] if c < 0x10000 else [0xD800 + (c - 0x10000 >> 10), 0xDC00 + (c - 0x10000 & 0x3FF)])]


def kneser_ney_by_hand(texts):
    """(first three symbols, symbol) -> probability, from plain dictionaries."""
    count = [{} for _ in range(5)]
    for text in texts:
        symbols = [1, 1, 1, *units(text), 2]
        for at in range(3, len(symbols)):
            gram = tuple(symbols[at - 3 : at + 1])
            count[4][gram] = count[4].get(gram, 0) + 1
    raw = {4: count[4]}
    for k in (3, 2, 1):
        raw[k], after = {}, {}
        for gram, n in raw[k + 1].items():
            raw[k][gram[1:]] = raw[k].get(gram[1:], 0) + n
            after.setdefault(gram[1:], set()).add(gram[0])
        count[k] = {g: raw[k][g] if g[0] == 1 else len(after[g]) for g in raw[k]}

    def cut(k, n):
        have = [sum(v == i for v in count[k].values()) for i in (1, 2, 3, 4)]
        return kneser_ney.discounts(*have)[min(n, 3) - 1]

    def probability(context, symbol):
        k = len(context) + 1
        if k == 1:
            total = sum(count[1].values())
            gamma = sum(cut(1, n) for n in count[1].values()) / total
            n = count[1].get((symbol,), 0)
            return (max(n - cut(1, n), 0) / total if n else 0) + gamma / (len(count[1]) + 1)
        seen = {g: n for g, n in count[k].items() if g[:-1] == context}
        if not seen:
            return probability(context[1:], symbol)
        n = seen.get((*context, symbol), 0)
        gamma = sum(cut(k, v) for v in seen.values()) / sum(seen.values())
        return (max(n - cut(k, n), 0) / sum(seen.values()) if n else 0) + gamma * probability(context[1:], symbol)

    return probability


def test_kneser_ney_is_brute_force(spark):
    draw = np.random.default_rng(5)
    words = ["abra", "cad", "bar", "dab", "card", "a", "zé", "😀", "😁🀄x"]
    texts = [" ".join(draw.choice(words, draw.integers(1, 12))) for _ in range(60)]
    other = ["", "xyz abra", "zzzz", "card " * 40, "\x00\U0001f600", None, texts[0], "🀄" * 30 + "a", "\uffff😁"]
    every = [*texts, *other]
    labels = spark.createDataFrame([(n, 1, 0) for n in range(len(texts))], "doc_id long, quality int, toxic int")
    df = docs(spark, every)
    fold = {r.doc_id: r.f for r in df.select("doc_id", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2)).alias("f")).collect()}
    by_fold = [kneser_ney_by_hand([t for n, t in enumerate(texts) if fold[n] == f]) for f in (0, 1)]
    for size in (kneser_ney.PILE, 7):  # whole texts, and pieces of seven symbols
        got = {r.doc_id: r for r in kneser_ney.classify(df, labels, size=size).collect()}
        assert len(got) == len(every)
        for n, text in enumerate(every):
            symbols = [1, 1, 1, *units(text or ""), 2]
            p = by_fold[1 - fold[n]]
            want = -sum(math.log(p(tuple(symbols[k - 3 : k]), symbols[k])) for k in range(3, len(symbols))) / (len(symbols) - 3)
            assert got[n].n_symbols == len(symbols) - 3 and abs(got[n].perplexity - math.exp(want)) <= 1e-4 + 1e-6 * math.exp(want), (size, text)
    p = kneser_ney_by_hand(["abcab", "abd", "bca"])
    assert abs(sum(p(tuple(map(ord, "cab")), s) for s in (*map(ord, "abcd"), 2, ord("z"))) - 1) < 1e-9


def test_kneser_ney_rejects_junk_and_keeps_edges(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    j = kneser_ney.classify(d, labels).join(labels, "doc_id").select("quality", "kept").collect()
    good = [r.kept for r in j if r.quality == 1]
    bad = [r.kept for r in j if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.5
    none = kneser_ney.classify(docs(spark, ODD), labels.limit(0))
    assert none.filter("kept").count() == len(ODD)
    assert kneser_ney.classify(docs(spark, ["a😀\uffff"]), labels.limit(0)).first().n_symbols == 5
    some = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert kneser_ney.classify(docs(spark, ODD), some).count() == len(ODD)
    assert kneser_ney.classify(docs(spark, []), some).count() == 0


# 4 toxicity
def test_toxicity(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(d, labels, usable=~F.expr("pmod(crc32(cast(id as string)), 4) = 2"))
    r = toxicity.score_documents(d, model).join(labels, "doc_id").filter("pmod(crc32(cast(doc_id as string)), 4) = 2").select("predicted", "toxic").collect()
    hit = sum(x.predicted and x.toxic for x in r)
    assert hit / sum(x.toxic for x in r) > 0.85 and hit / sum(x.predicted for x in r) > 0.9
    chars = toxicity.CharModel(model.gram_counts)
    for odd, word in (("1d10t", "idiot"), ("st.u.p.i.d", "stupid"), ("stuuuupid", "stupid"), ("tr@sh", "trash"), ("m0r0n", "moron")):
        assert word in toxicity.readings(odd, chars)
    assert "stupid" in toxicity.spaced("so s t u p i d it is", chars)
    scores = toxicity.score_documents(docs(spark, ODD), model)
    assert scores.count() == len(ODD) and scores.filter("predicted = 1").count() == 0
    assert toxicity.accepted(docs(spark, ODD), model).columns == docs(spark, []).columns
    nothing = toxicity.fit(docs(spark, ODD), labels.limit(0))
    assert toxicity.score_documents(docs(spark, ODD), nothing).agg(F.max("score")).first()[0] < 0.01


def test_toxicity_reads_every_disguise(spark):
    words = ["idiot", "stupid", "trash", "scum", "letter", "moron", "follow"]
    grams = toxicity.grams(w for w in words for _ in range(50))
    chars = toxicity.CharModel(grams)
    disguised = {"idi07": "idiot", "1d10t": "idiot", "tra$#": "trash", "tr45#": "trash", "57upid": "stupid", "5(um": "scum", "scu/\\/\\": "scum", "stuupid": "stupid", "sscumm": "scum", "m0r0n": "moron"}
    for odd, word in disguised.items():
        assert word in toxicity.readings(odd, chars), odd
    for odd, found in (("you are a s t u p i d", {"stupid"}), ("s c u m t r a s h", {"scum", "trash"}), ("so s / t / u / p / i / d it", {"stupid"}), ("t r 4 $ h", {"trash"})):
        assert found <= set(toxicity.spaced(odd, chars)), odd
    assert toxicity.readings("letter", chars) == ["letter"] and toxicity.readings("follow", chars) == ["follow"]
    model = toxicity.ToxicityModel(grams, -3.0, {"w:idiot": 5.0, "w:stupid": 5.0, "w:trash": 5.0, "w:scum": 5.0, "w:moron": 5.0})
    texts = [*disguised, "you are a s t u p i d", "s c u m t r a s h", "letter follow", ""]
    kept = toxicity.accepted(docs(spark, texts), model)
    assert [r.text for r in kept.collect()] == ["letter follow", ""]


def cheapest_by_hand(chars, observed, letter_gone):
    """Every path through the lattice, one by one."""
    best = math.inf

    def walk(at, state, spent):
        nonlocal best
        if at == len(observed):
            best = min(best, spent + (chars.cost(state + " ") if state[1] != " " else 0.0))
            return
        c = observed[at]
        blank, mark = c in toxicity.BLANKS, c in toxicity.SEPARATORS
        letters = [] if blank or (mark and c != "'") else [(c, 6.0 if mark else 5.0 if c in toxicity.LOOKS_LIKE else 0.0)]
        letters += [(x, 1.0) for x in toxicity.LOOKS_LIKE.get(c, "")] if not blank and not mark else []
        for x, price in letters:
            walk(at + 1, state[1] + x, spent + price + chars.cost(state + x))
            if x == state[1]:
                walk(at + 1, state, spent + 1.2)
        if blank and state[1] != " ":
            walk(at + 1, "  ", spent + 0.3 + chars.cost(state + " "))
        gone = 0.3 if blank or mark else toxicity.MARK_GONE if c in toxicity.LOOKS_LIKE else letter_gone
        if gone < math.inf:
            walk(at + 1, state, spent + gone)

    walk(0, "  ", 0.0)
    return best


def test_restoring_is_exhaustive_search(spark, monkeypatch):
    words = ["idiot", "stupid", "trash", "scum", "letter", "moron", "follow", "hill", "illicit"]
    chars = toxicity.CharModel(toxicity.grams(w for w in words for _ in range(50)))
    draw = random.Random(6)
    seen = [0, 0]
    for beam in (16, 2):  # with two states the first pass leaves most out, and the second has to make up for it
        monkeypatch.setattr(toxicity, "BEAM", beam)
        for _ in range(150):
            observed = "".join(draw.choice("idtsl1!|0@$3 .-'aor7") for _ in range(draw.randrange(1, 8)))
            for gone in (math.inf, 12.0):
                want = cheapest_by_hand(chars, observed, gone)
                cost, text, exact = chars.search(observed, gone, math.inf)
                if want == math.inf:
                    continue
                seen[exact] += 1
                if not exact:
                    cost, text, _ = chars.search(observed, gone, cost)
                assert abs(cost - want) < 1e-9, observed
    assert min(seen) > 50
    for _ in range(300):  # letters only: run by run
        observed = "".join(draw.choice("idotsulx") * draw.choice([1, 1, 2, 2, 3]) for _ in range(draw.randrange(1, 5)))
        cost, text, _ = chars.search(observed, math.inf, cheapest_by_hand(chars, observed, math.inf))
        assert abs(cost - cheapest_by_hand(chars, observed, math.inf)) < 1e-9 and chars.undoubled(observed) == text, observed


def test_toxicity_fit_of_repeated_ids(spark):
    df = docs(spark, ["you idiot", "fine day", "you idiot again", "lovely day"]).unionByName(docs(spark, ["you idiot", "fine day"] * 3).withColumn("doc_id", F.lit(0).cast("long")))
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (2, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    sample, positive, negative = toxicity.training_sample(df.withColumn("y", F.lit("clash")), labels, "doc_id", "text", "toxic", None)
    assert sorted((r.id, r.y) for r in sample.collect()) == [(0, 1), (1, 0), (2, 1), (3, 0)] and (positive, negative) == (2, 2)


def test_toxicity_searches_only_where_a_feature_may_hide(spark, monkeypatch):
    chars_of = {w: 50 for w in ["idiot", "stupid", "letter", "moron", "follow"]}
    counted = toxicity.gram_batch({**chars_of, "llle": 3, "a-b": 2, "12": 1, '"Fine.': 4})
    by_hand = toxicity.grams(w for w, n in {**chars_of, "Fine": 4}.items() for _ in range(n))
    assert dict(zip(*[c.to_pylist() for c in counted.columns])) == by_hand
    model = toxicity.ToxicityModel(dict(by_hand), -3.0, {"w:idiot": 5.0, "4:stup": 5.0})
    calls, search = [], toxicity.CharModel.search
    monkeypatch.setattr(toxicity.CharModel, "search", lambda self, *how: calls.append(how) or search(self, *how))
    score = model.scorer()
    assert score("aubebe$$$ rowhn### letter, ab12cd 0405bce1 foll-ow") < 0.1 and not calls
    chars = toxicity.CharModel(model.gram_counts)
    for odd in ("1d10t", "st.u.p1d###", "$tuupid", "idi\u00a10t", "x-1d107"):
        words = [w for w in toxicity.readings(odd, chars) if w == "idiot" or w.startswith("stup") and len(w) > 4]
        assert (score(odd) > 0.5) == bool(words), odd
    assert calls
    for observed in ("1d10t", "st.u.p1d", "a$$ b", "moor0n"):
        steps = [toxicity.options(c, 12.0) for c in observed]
        assert chars.rests(steps)[0] <= cheapest_by_hand(chars, observed, 12.0) + 1e-9


def test_features_are_counted_by_texts(spark):
    rows = [(["idiot", "idioms", "id", "été"], 1), (["idiotic", "idiot"], 0), ([], 1), (["étés", "x" * 9], 0)]
    got = toxicity.feature_counts(spark.createDataFrame(rows, "words array<string>, y int")).collect()
    want = {}
    for found, y in rows:
        for f in {f for w in found for f in toxicity.word_features(w)}:
            want.setdefault(f, [0, 0])[1 - y] += 1
    assert {r.feature: [r.positive, r.negative] for r in got} == want


def test_toxicity_counts_in_little_memory(monkeypatch):
    """What a task holds depends on neither its rows nor their length."""
    import tracemalloc

    import pyarrow as pa

    draw = random.Random(8)
    tokens = {"".join(draw.choices("abcdefghijklmnop", k=12)): 1 + k % 3 for k in range(200_000)}
    tracemalloc.start()
    try:
        got = toxicity.gram_batch(tokens)
        assert tracemalloc.get_traced_memory()[1] < 60e6  # 210 MB when all characters were one array
    finally:
        tracemalloc.stop()
    assert dict(zip(*[c.to_pylist() for c in got.columns])) == toxicity.grams(w for w, n in tokens.items() if not toxicity.ODD.search(w) for _ in range(n))
    long = "".join(draw.choices(["ab", "bc", "ac"], k=toxicity.GRAM_CHARS + 5))
    got = toxicity.gram_batch({long: 2, "ab": 1})
    assert dict(zip(*[c.to_pylist() for c in got.columns])) == toxicity.grams([long, long, "ab"])

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([[f"x{k % 40}y{j}" for j in range(k % 30)] for k in range(3000)], pa.list_(pa.string())), pa.array([k % 3 == 0 for k in range(3000)]).cast("int32")], names=["words", "y"])

    whole = toxicity.counted_features(rows())
    want = {f: (p, n) for f, p, n in zip(*[c.to_pylist() for c in whole.columns])}
    at_once, counted = [], toxicity.counted_features
    monkeypatch.setattr(toxicity, "counted_features", lambda b: at_once.append(len(b.column(0).flatten())) or counted(b))
    monkeypatch.setattr(toxicity, "AT_ONCE", 500)
    monkeypatch.setattr(toxicity, "COUNTED", 300)
    found, sizes = {}, []
    for part in toxicity.feature_parts(iter([rows()])):
        sizes.append(part.num_rows)
        for f, p, n in zip(*[c.to_pylist() for c in part.columns]):
            had = found.get(f, (0, 0))
            found[f] = (had[0] + p, had[1] + n)
    assert found == want and max(at_once) <= 500 and max(sizes) <= 300 and len(at_once) > 50


# 5 urls
def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "HTTP://A.Example.COM/en/x?q#f"), (2, "https://www.example.com/en/"), (3, "http://x.net/es"), (4, "http://x.net/es/1"), (5, None), (6, "mailto:a"), (7, "http://Bad.org/p/?utm_source=x"), (8, "http://com"), (9, "http://com/")],
        "page_id long, url string",
    )
    listed = spark.createDataFrame([("https://bad.org/p",), (None,)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed, queries.RULES).collect()}
    assert got == {
        1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 3: ("x.net", "/es", None, "allow"),
        4: ("x.net", "/es/1", "net/es/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("bad.org", "/p/", None, "block"), 8: ("com", "", None, "allow"), 9: ("com", "/", "com/", "allow"),
    }
    assert url_filter.judge(pages.limit(0), listed.limit(0), queries.RULES).count() == 0


def test_list_decides_verdicts_outside_the_rules(spark):
    sf = "/root/testdata/sf0.1"
    listed = {r.url for r in queries.blocklist(spark).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in url_filter.judge(pages, queries.blocklist(spark), queries.RULES).collect()}
    plain = {r.page_id: re.sub(r"/+$", "", re.sub(r"#.*$|[?]utm_source=feed$", "", r.url)) for r in pages.select("page_id", "url").collect()}
    on_list = {k for k, u in plain.items() if "http://" + u.partition("://")[2] in listed}
    assert got.keys() == plain.keys() and {k for k, r in got.items() if r.listed} == on_list and all(got[k].maybe for k in on_list)
    decided = [k for k, r in got.items() if r.rule is None and r.verdict == "block"]
    assert set(decided) == {k for k in on_list if got[k].rule is None} and decided
    assert len(listed) > 50 * len(on_list)  # most of the list is of no page
    # Bloom: a few false positives, all removed by the exact join
    many = spark.range(200_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x.org/"), F.col("id").cast("string")).alias("url"))
    passed = url_filter.judge(many, queries.blocklist(spark), queries.RULES).filter("maybe")
    assert 0 < passed.count() < 4000 and passed.filter("listed OR verdict = 'block'").count() == 0


def test_urls_of_clashing_columns_repeats_and_long_urls(spark):
    df = spark.createDataFrame([(1, "http://a.org/" + "p" * 100_000), (1, "http://a.org/" + "p" * 100_000), (None, "http://b.org/"), (2, "://"), (3, "x://?://y/z")], "page_id long, url string")
    df = df.selectExpr("*", "1 id", "2 host", "3 listed", "4 maybe", "5 block", "6 at", "7 raw", "8 fit")
    got = sorted(((r.page_id or 0), r.host, len(r.path), r.verdict) for r in url_filter.judge(df, df.select("url").limit(1), queries.RULES).collect())
    assert got == [(0, "b.org", 1, "allow"), (1, "a.org", 100_001, "block"), (1, "a.org", 100_001, "block"), (2, "", 0, "allow"), (3, "", 0, "allow")]


# 6 nearest neighbours
def test_ann_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    extra = spark.createDataFrame([(1000, None, 1), (1050, [0.0] * 64, 1), (1001, [float("inf")] * 64, 1), (1002, [1.0], 1)], df.schema)
    got = anisotropic_ann.nearest(df.unionByName(extra), F.col("vec_id") % 50 == 0).collect()
    rows = df.collect()
    ids = np.array([r.vec_id for r in rows])
    unit = np.array([r.embedding for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    hit = 0
    for q in ids[ids % 50 == 0]:
        s = unit @ unit[ids == q][0]
        s[ids == q] = -2
        best = ids[np.lexsort((ids, -s))[:5]]
        mine = sorted([(r.rank, r.vec_id, r.score) for r in got if r.query_id == q])
        hit += len({m[1] for m in mine} & set(best.tolist()))
        assert all(abs(m[2] - s[ids == m[1]][0]) < 1e-9 for m in mine)
    assert hit / (5 * (ids % 50 == 0).sum()) >= 0.9
    assert anisotropic_ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_ann_in_many_groups_and_chunks(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = lambda: {(r.query_id, r["rank"], r.vec_id) for r in anisotropic_ann.nearest(df, F.col("vec_id") % 20 == 0, rerank=10_000).collect()}
    one = found()
    monkeypatch.setattr(anisotropic_ann, "GROUP", 60)
    monkeypatch.setattr(anisotropic_ann, "QUERY_CHUNK", 4)
    assert found() == one and len(one) == 5 * df.filter("vec_id % 20 = 0").count()


def test_ann_of_repeated_rows_ties_and_clashing_columns(spark):
    draw = np.random.default_rng(2)
    x = np.round(draw.standard_normal((120, 9)), 2)
    x[60:90] = x[:30]  # ties
    rows = [(n, v.tolist(), n, 0.0) for n, v in enumerate(x)] + [(0, x[0].tolist(), 1, 0.0)] * 3 + [(7, x[7].tolist(), 1, 0.0), (7, x[8].tolist(), 1, 0.0), (None, x[0].tolist(), 1, 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, chunk long, score double").withColumn("id", F.lit(1)).withColumn("group", F.lit("g"))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in anisotropic_ann.nearest(df, F.col("vec_id") % 50 == 0).collect())
    best: dict = {}
    unit = lambda v: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float))
    for q in (0, 50, 100):
        for i, v, *_ in rows:
            if i is not None and i != q:
                best[q, i] = max(best.get((q, i), -2), round(float(unit(v) @ unit(x[q])), 9))
    want = [(q, r, i) for q in (0, 50, 100) for r, (_, i) in enumerate(sorted((-s, i) for (k, i), s in best.items() if k == q)[:5], 1)]
    assert got == want
    assert anisotropic_ann.nearest(df.filter("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


# 7 secrets
ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_by_hand(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secrets(spark):
    texts = [*ODD, "😀 password = 'abcdefgh12' token: secret = abcdefghij", "token:token=abcd", "PASSWD=aaaaaaaaAKIA" + "A" * 20 + " " + "a" * 40, "Ab3" * 12]
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang").unionByName(docs(spark, texts).selectExpr("doc_id + 100000 doc_id", "text", "source", "lang"))
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(d)).collect()}
    for r in d.collect():
        assert got[r.doc_id].base_sha256 == hashlib.sha256(base_by_hand(r.text or "").encode()).hexdigest()
    copied = spark.createDataFrame([(n, "AKIA" + "B" * 16, f"s{n}", "en") for n in range(5)] + [(9, "AKIA" + "C" * 16, "s1", "en")], "doc_id long, text string, source string, lang string")
    live = {r.doc_id: r.n_live for r in secret_scan.digest(secret_scan.scan(copied)).collect()}
    assert live == {**dict.fromkeys(range(5), 0), 9: 1}
    clean = {r.doc_id: r.text for r in secret_scan.redact_live(copied.withColumn("n_chars", F.lit(1).cast("long"))).collect()}
    assert clean[9] == "<SECRET>" and clean[0] == "AKIA" + "B" * 16
    assert secret_scan.redact_live(docs(spark, ODD)).count() == len(ODD)
    assert secret_scan.scan(docs(spark, [])).count() == 0


def test_secrets_with_many_matches(spark):
    draw = random.Random(1)
    kinds = [lambda: f"token={draw.randbytes(8).hex()}A{draw.randrange(10)}", lambda: draw.randbytes(20).hex(), lambda: "AKIA" + "Z" * draw.randrange(11, 20), lambda: "aB3" * 9, lambda: "é😀 plain"]
    texts = [" ".join(draw.choice(kinds)() for _ in range(n)) for n in (3, 300, 700)]
    many = " ".join(draw.randbytes(20).hex() for _ in range(50_000))
    every = docs(spark, [*texts, many])
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(every)).collect()}
    for n, text in enumerate([*texts, many]):
        assert got[n].base_sha256 == hashlib.sha256(base_by_hand(text).encode()).hexdigest()
    assert got[3].n_hex == 50_000
    clean = {r.doc_id: r.text for r in secret_scan.redact_live(every).collect()}
    assert clean[3] == " ".join(["<SECRET>"] * 50_000)
    for n, text in enumerate(texts):
        live = sorted((s["start"], s["end"]) for s in secret_scan.scan(every).filter(F.col("doc_id") == n).first().found if s["live"])
        out, at = "", 0
        for start, end in live:
            if start >= at:
                out += text[at:start] + "<SECRET>"
            at = max(at, end)
        assert clean[n] == out + text[at:]
    # a mixed token counts unless a base span touches it
    mixed = {tuple(map(int, x.split(":")[1:])) for x in got[1].spans.split(",") if x.startswith("mixed")}
    base = [tuple(map(int, x.split(":")[1:])) for x in got[1].spans.split(",") if not x.startswith("mixed")]
    looks = [m.span() for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}", texts[1]) if all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))]
    assert mixed == {m for m in looks if not any(a < m[1] and m[0] < b for a, b in base)} and mixed


def test_secrets_of_clashing_and_missing_columns(spark):
    row = ("password = abcdefgh12", "v")
    df = spark.createDataFrame([(1, *row), (1, *row), (2, None, "v"), (None, *row)], "doc_id long, text string, value string").withColumn("row", F.lit(3)).withColumn("heavy", F.lit(1)).withColumn("base", F.lit("b"))
    got = sorted((r.doc_id or 0, r.n_assign, r.n_live) for r in secret_scan.digest(secret_scan.scan(df)).collect())
    assert got == [(0, 1, 1), (1, 1, 1), (1, 1, 1), (2, 0, 0)]
    out = secret_scan.redact_live(df)
    assert out.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "<SECRET>"), (1, "<SECRET>"), (1, "<SECRET>"), (2, None)]


# 8 WARC
def test_warc_round_trip_and_salvage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/\n", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "u", ""), (None, "u", "z")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).filter("ok").collect()}
    assert got[2].record_type == "response" and (got[1].record_type, got[1].refers_to) == ("revisit", 2)
    assert (got[3].record_type, got[3].refers_to, got[4].payload_bytes) == ("revisit", 4, 0)
    assert got[1].payload_digest == base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
    assert warc.round_trip(pages.limit(0)).count() == 0
    records = [warc.record_bytes(k, "u", bytes([65 + k]) * 50, base64.b32encode(hashlib.sha1(bytes([65 + k]) * 50).digest()).decode(), None) for k in range(4)]
    for data in (b"".join(records), b"".join(map(warc.gzip_member, records))):
        sizes = [len(records[k]) if data[:4] == b"WARC" else len(warc.gzip_member(records[k])) for k in range(4)]
        broken = bytearray(data)
        at = sizes[0] + sizes[1] - 20
        broken[at : at + 4] = b"\xff\x00\xff\x00"
        found = list(warc.salvage(bytes(broken)))
        assert [f[3]["warc-record-id"][-2] for f in found if f[3]] == ["0", "2", "3"]
        gap = [f for f in found if f[3] is None]
        assert [(g[0], g[1]) for g in gap] == [(sizes[0], sizes[1])]
        cut = list(warc.salvage(data[: len(data) - 7]))
        assert sum(1 for f in cut if f[3]) == (3 if data[:4] == b"WARC" else 4) and cut[-1][3] is None  # a member whose end is cut decodes
    assert zlib.decompress(warc.EMPTY_MEMBER, 31) == b""


def warc_record(k, size=50):
    payload = random.Random(k).randbytes(size)
    return warc.record_bytes(k, "u", payload, base64.b32encode(hashlib.sha1(payload).digest()).decode(), None)


def test_warc_salvage_within_members():
    records = [warc_record(k, 400) for k in range(100)]
    numbers = lambda found: [int(f[3]["warc-record-id"][len("<urn:page:") : -1]) for f in found if f[3]]
    whole = b"".join(records)
    member = warc.gzip_member(whole)
    assert numbers(warc.salvage(member)) == list(range(100)) and all(f[3] for f in warc.salvage(member))
    for cut in (10, 200):  # cut short: all but the last records
        found = list(warc.salvage(member[:-cut]))
        assert numbers(found) == list(range(100)) if cut == 10 else numbers(found)[:99] == list(range(99))
        assert found[-1][2:4] == (None, None) and (found[-1][0], found[-1][1]) == (0, len(member) - cut)
    at = len(b"".join(records[:40])) + 600  # one bad record in a sound member: 99 come back
    bad = warc.gzip_member(whole[:at] + b"???" + whole[at + 3 :])
    found = list(warc.salvage(bad + warc.gzip_member(warc_record(100))))
    assert numbers(found) == [k for k in range(101) if k != 40]
    assert [(f[1], f[2]) for f in found if f[3] is None] == [(len(records[40]), len(b"".join(records[:40])))]
    hurt = bytearray(member)  # damaged in the middle, a sound member behind
    hurt[len(hurt) // 2 : len(hurt) // 2 + 40] = bytes(40)
    found = list(warc.salvage(bytes(hurt) + warc.gzip_member(warc_record(100))))
    got = numbers(found)
    assert got[-1] == 100 and got[:-1] == list(range(len(got) - 1)) and len(got) > 40
    assert sum(f[1] for f in found if f[2] is None) == len(hurt) + len(warc.gzip_member(warc_record(100)))
    assert list(warc.salvage(b"")) == [] and [f[3] for f in warc.salvage(b"no record")] == [None]


def test_warc_reader_is_linear(spark, tmp_path):
    data = b"".join(warc.gzip_member(warc_record(k, 4000)) for k in range(25_000))
    assert len(data) > 100_000_000
    began = time.time()
    assert sum(1 for f in warc.salvage(data) if f[3]) == 25_000
    assert time.time() - began < 30
    # files are bounded by bytes, one record beyond
    pages = spark.range(3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.base64(F.encode(F.repeat(F.sha2(F.col("id").cast("string"), 512), F.lit(1)), "utf-8")).alias("html"))
    warc.write_archives(pages.coalesce(1), f"{tmp_path}/w")
    assert warc.read_archives(spark, f"{tmp_path}/w").filter("ok").count() == 3


def test_warc_clashing_columns_and_null_ids(spark):
    pages = spark.createDataFrame([(1, "u", "a", b"p", "d", 9), (1, "u", "a", b"p", "d", 9), (None, "v", "a", None, None, None), (2, "w", "b", None, None, None)], "page_id long, url string, html string, payload binary, digest string, first int")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert got == [(0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "response", None)]


# 9 SentencePiece
def test_sentencepiece_is_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.located(queries.MODEL))
    encoder = sentencepiece_bpe.MergeEncoder(queries.MODEL, memo_runs=500)
    draw = np.random.default_rng(3)
    texts = ["".join(draw.choice(list("ab e\nth▁é😀  0xin,."), 60)) for _ in range(800)] + [t or "" for t in ODD]
    assert encoder.encode_batch(texts) == [library.encode(t) for t in texts]
    assert [encoder.merge(r) for r in encoder.split(texts[0])] == [tuple(encoder.memo[r]) for r in encoder.split(texts[0])]
    got = sentencepiece_bpe.encode_documents(docs(spark, ODD), queries.MODEL)
    for r in got.collect():
        ids = library.encode(ODD[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == (library.decode(ids) if ids else "")
    back = sentencepiece_bpe.decode_documents(got, queries.MODEL).collect()
    assert {r.doc_id: r.text for r in back} == {r.doc_id: r.decoded for r in got.collect()}
    assert sentencepiece_bpe.encode_documents(docs(spark, []), queries.MODEL).count() == 0


# 10 SimHash
def fingerprint_by_hand(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash(spark):
    base = " ".join(f"w{k}" for k in range(400))
    texts = [*ODD, base, base.upper(), *(f"{base} tail{k}" for k in range(70)), *(f"head{k} {base}" for k in range(20))]
    got = simhash.simhash_components(docs(spark, texts)).orderBy("doc_id").collect()
    prints = [fingerprint_by_hand(t) for t in texts]
    assert [r.fingerprint for r in got] == [f"{p:016x}" for p in prints]
    root = np.arange(len(texts))
    x = np.array(prints, np.uint64)
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 4)
    root = embedding_dedup._joined(root, i, j)
    assert [r.component_id for r in got] == root.tolist()
    assert simhash.simhash_components(docs(spark, [])).count() == 0
    for limit in (1, 2, 4, 6):
        draw = np.random.default_rng(limit)
        bits = (draw.random((500, 64)) < 0.5).astype(float)
        plan = simhash.plan_partitions(500, bits.T @ bits, limit)
        for _ in range(200):
            gone = set(draw.choice(64, limit, replace=False).tolist())
            assert any(len(gone & set(b)) <= t for b, t in plan)


def kept_by_hand(rows):
    """Of rows (id, text) the (id, text) kept by SimHash, one a component."""
    prints = np.array([fingerprint_by_hand(t) for _, t in rows], np.uint64)
    root = np.arange(len(rows))
    i, j = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None]) <= 4)
    root = embedding_dedup._joined(root, i, j)
    best: dict = {}
    for (number, text), r in zip(rows, root):
        key = (number is None, number or 0, hashlib.md5((text or "").encode()).digest())
        if r not in best or key < best[r][0]:
            best[r] = key, (number, text or "")
    return sorted(((n is None, n or 0, t) for _, (n, t) in best.values()))


# pipeline
NASTY = "doc_id long, text string, lang string, source string, n_chars long, gone string, row int, id int, same string, kept boolean, weight double"


def nasty(spark):
    """Repeated, null and shared ids, null and empty texts, clashing columns."""
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine"
    rows = [(1, a), (5, a), (5, b), (5, b), (None, a), (None, "quite another text with no copy anywhere at all"), (None, "quite another text with no copy anywhere at all"), (7, None), (8, ""), (9, " "), (9, "password = hunter2hunter2 for the one and only machine here"), (10, "you stupid idiot scum"), (11, "long " * 30_000)]
    return spark.createDataFrame([(n, t, None if n == 7 else "en", None if n == 8 else f"s{(n or 0) % 2}", len(t or ""), "g", 1, 2, "s", False, 0.5) for n, t in rows], NASTY)


def test_pipeline_stages_with_nasty_rows(spark):
    import corpus_pipeline

    d = nasty(spark)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    every = sorted(map(key, d.collect()))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(spark, d, SF)
        assert name == "sentencepiece" or out[name].columns == d.columns, name
        assert stage(spark, d.limit(0), SF).count() == 0, name
    assert sorted(map(key, out["simhash"].collect())) == kept_by_hand([(r.doc_id, r.text) for r in d.collect()])
    kept = sorted(map(key, out["simhash"].collect()))
    assert len(kept) == 7 and (False, 5, "one two three four five six seven eight nine") in kept
    # every row stays, live-looking secrets go, null texts stay null
    redacted = out["secrets"].collect()
    want = sorted((n, i, re.sub("password = [a-z0-9]+", "<SECRET>", t)) for n, i, t in every)
    assert sorted(map(key, redacted)) == want and sum(r.text is None for r in redacted) == 1
    # toxicity: rows go by the score of their own text, whatever their ids
    from siltstone.llm.queries import HELD_OUT

    model = toxicity.fit(d, spark.read.parquet(f"{SF}/labels.parquet"), usable=~F.expr(HELD_OUT.format("id")))
    score = model.scorer()
    assert sorted(map(key, out["toxicity"].collect())) == [k for k in every if score(k[2]) < 0.3]
    mixed = mixing.mix(d).filter("kept")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out["mixing"].collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in mixed.collect())
    assert out["sentencepiece"].count() == d.count()


def test_pipeline(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns and out.count() <= d.count(), name
        if name == "simhash":
            want = {r.component_id for r in simhash.simhash_components(d).collect()}
            assert {r.doc_id for r in out.select("doc_id").collect()} == want
        if name == "mixing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in mixing.mix(d).filter("kept").collect()}
    assert corpus_pipeline.run(spark, SF).count() > 0
