"""Keyed upsert, vector codes and sharding against plain versions."""

import bisect
import collections
import glob
import hashlib
import math
import os
import sys
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siltstone.llm import keyed_upsert, queries, sharding, vector_code  # noqa: E402

SF = "/root/testdata/sf0.001"


def crc(x):
    return zlib.crc32(str(x).encode())


def cut_and_joined(files, after, most):
    """(rows, rewritten) of the final files, by a plain loop."""
    cuts = []
    for old, new in zip(files, after):
        if old == new:
            cuts.append((old, False))
            continue
        k, at = -(-len(new) // most), 0
        for p in range(k):
            size = len(new) // k + (p < len(new) % k)
            cuts.append((new[at : at + size], True))
            at += size
    final = []
    for rows, fresh in cuts:
        if fresh and final and final[-1][1] and len(final[-1][0]) + len(rows) <= most:
            final[-1] = (final[-1][0] + rows, True)
        else:
            final.append((rows, fresh))
    return final


def home_of(firsts, key):
    return max(bisect.bisect_right(firsts, key) - 1, 0)


# 11 keyed upsert
def test_upsert_of_clients_is_brute_force(spark):
    plain = lambda r: {k: None if v is None or v != v else v for k, v in r.items()}
    clients = [plain(r.asDict()) for r in spark.read.parquet(f"{SF}/clients.parquet").collect()]
    changes = [r.asDict() for r in spark.read.parquet(f"{SF}/client_changes.parquet").collect()]
    most = 1 + len(clients) // 1500
    rows = sorted((r for r in clients if crc(r["client_id"]) % 7 > 3), key=lambda r: r["client_id"])
    files = [rows[i : i + most] for i in range(0, len(rows), most)]
    firsts, after, last = [f[0]["client_id"] for f in files], [{r["client_id"]: r for r in f} for f in files], {}
    for r in changes:
        if r["client_id"] not in last or (r["seq"], r["change_id"]) > (last[r["client_id"]]["seq"], last[r["client_id"]]["change_id"]):
            last[r["client_id"]] = r
    for i, r in last.items():
        home = home_of(firsts, i)
        h = crc(firsts[home]) % 10
        if h > 7:
            continue
        if r["op"] == "D" or crc(r["change_id"]) % 8 < h:
            after[home].pop(i, None)
        else:
            old = after[home].get(i, dict.fromkeys(clients[0]) | {"client_id": i})
            after[home][i] = plain(old | {c: r[c] for c in queries.CLIENT_VALUES})
    final = cut_and_joined(files, [[f[i] for i in sorted(f)] for f in after], most)
    text = lambda r: "|".join(r[c] or "" for c in ("source", "segment", "city"))
    cents = lambda r: 0 if r["balance"] is None else math.floor(100 * r["balance"] + 0.5)
    ids = lambda f: hashlib.sha256(",".join(str(r["client_id"]) for r in f).encode()).hexdigest()
    want = sorted((f[0]["client_id"], len(f), sum(map(cents, f)), sum(crc(text(r)) for r in f), ids(f), ",".join(clients[0]), fresh) for f, fresh in final)
    got = queries.op11_keyed_upsert(spark, SF).collect()
    assert sorted((r.first_id, r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.columns, r.rewritten) for r in got) == want
    on_disk = {p.removeprefix("file:").replace("///", "/") for p in (r.path for r in got)}
    folder = os.path.dirname(next(iter(on_disk)))
    assert on_disk == set(glob.glob(f"{folder}/*.parquet"))
    for f, _ in final:
        path = next(r.path for r in got if r.first_id == f[0]["client_id"]).removeprefix("file:").replace("///", "/")
        assert [plain(r) for r in pq.ParquetFile(path).read().to_pylist()] == f


COLUMNS = "k long, `a.b` string, row string, home int, v double"


@pytest.mark.parametrize("most,first,changed", [(3, range(0, 60, 2), range(0, 70)), (4, range(10, 50), [*range(5), *range(100, 160)]), (5, [], range(12)), (2, range(9), []), (7, range(40), [*range(0, 40, 3)])])
def test_upsert_of_names_nulls_and_ends(spark, most, first, changed):
    base = [(i, f"x{i}", None, i % 3, float(i)) for i in first]
    folder = keyed_upsert.new_folder(spark, "test")
    df = spark.createDataFrame(base, COLUMNS)
    keyed_upsert.write_sorted(df.repartition(3), "k", most, folder)
    news = [(i, s, None if i % 5 == 0 else f"y{i}", "D" if i % 4 == 1 else "U", None if i % 7 == 0 else float(i)) for i in changed for s in (1, None)] + [(None, 9, "z", "U", 0.0)]
    table = spark.createDataFrame(news, "k int, seq long, `a.b` string, op string, v double")
    winners = keyed_upsert.latest(table, "k", ["seq"], ["op", "a.b", "v"])
    decide = lambda start, change: F.when(F.coalesce(start, F.lit(0)) % 11 == 4, "ignore").when(change["op"] == "D", "delete").otherwise("set")
    left = keyed_upsert.upsert(spark, folder, df.schema, "k", winners, ["a.b", "v"], most, decide)
    files = [base[i : i + most] for i in range(0, len(base), most)] or [[]]
    firsts, after = [f[0][0] if f else 0 for f in files], [{r[0]: r for r in f} for f in files]
    for k, s, ab, op, v in news:
        if k is None or s is None:
            continue
        home = home_of(firsts, k)
        if firsts[home] % 11 == 4:
            continue
        if op == "D":
            after[home].pop(k, None)
        else:
            old = after[home].get(k, (k, None, None, None, None))
            after[home][k] = (k, ab, old[2], old[3], v)
    want = cut_and_joined(files, [[f[k] for k in sorted(f)] for f in after], most)
    got = sorted((([tuple(r.values()) for r in pq.ParquetFile(x.path.removeprefix("file:").replace("///", "/")).read().to_pylist()], x.rewritten) for x in left.collect()), key=lambda x: x[0][0][0])
    assert got == [w for w in want if w[0]]
    assert len(glob.glob(f"{folder}/*.parquet")) == len(got)


def test_upsert_of_repeated_and_null_keys(spark):
    folder = keyed_upsert.new_folder(spark, "test")
    df = spark.createDataFrame([(None, 1), (None, 2), *[(5, n) for n in range(7)], (6, 0)], "k long, v long")
    keyed_upsert.write_sorted(df, "k", 3, folder)
    winners = keyed_upsert.latest(spark.createDataFrame([(5, 1, 50), (6, 1, 60)], "k long, seq long, v long"), "k", ["seq"], ["v"])
    keyed_upsert.upsert(spark, folder, df.schema, "k", winners, ["v"], 3, lambda first, change: F.lit("set"))
    got = sorted(((r.k, r.v) for r in spark.read.parquet(folder).collect()), key=str)
    assert len(got) == 10 and (6, 60) in got and sum(r == (5, 50) for r in got) >= 1 and {(None, 1), (None, 2)} <= set(got)


def test_groups_of_cuts(spark):
    draw = np.random.default_rng(3)
    most, at, rows, want = 10, 0, [], set()
    for chain in range(12):
        total = None
        for _ in range(int(draw.integers(1, 60))):
            size = int(draw.choice([1, 1, 2, 3, 5, 9, 10]))
            if total is None or total + size > most:
                want.add(at)
                total = 0
            total += size
            rows.append((chain, size, at, at + size))
            at += size
    cuts = spark.createDataFrame(rows, "chain long, size long, s long, e long")
    assert {r.s for r in keyed_upsert.group_starts(cuts, most).collect()} == want


# 12 vector codes
def codes_by_hand(rows, parts, words, rounds):
    """{row place: (code, error)}, codebooks; rows: (id, vector) of one length."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    whole = np.array([[math.floor(256 * x) for x in v] + [0] * (-len(v) % parts) for _, v in rows])
    cut = whole.reshape(len(rows), parts, -1)
    codes, errors, books = [""] * len(rows), [0] * len(rows), []
    for p in range(parts):
        book = [list(cut[i, p]) for i in order[:words]]
        for turn in range(rounds + 1):
            best = [min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book)) for v in cut[:, p].tolist()]
            if turn == rounds:
                break
            for k in range(len(book)):
                own = [cut[i, p].tolist() for i in range(len(rows)) if best[i][1] == k]
                if own:
                    book[k] = [sum(c) // len(own) for c in zip(*own)]
        books += [x for e in book for x in e]
        codes = [c + f"{k:02x}" for c, (_, k) in zip(codes, best)]
        errors = [e + d for e, (d, _) in zip(errors, best)]
    return codes, errors, hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()


def test_codes_of_embeddings(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    codes, errors, sha = codes_by_hand([r[:2] for r in rows], 16, 64, 2)
    by_label = collections.Counter()
    for r, e in zip(rows, errors):
        by_label[r[2]] += e
    want = sorted((r[0], c, e, by_label[r[2]], sha) for r, c, e in zip(rows, codes, errors))
    assert sorted(map(tuple, queries.op12_vector_code(spark, SF).collect())) == want


def test_codes_of_odd_vectors(spark):
    draw = np.random.default_rng(2)
    some = np.round(draw.standard_normal((60, 10)), 2)
    vectors = [*some.tolist(), *[some[0].tolist()] * 40, [0.0] * 10, [-0.001] * 10]
    rows = [(n % 90 if n % 17 else None, v, None if n % 3 == 0 else f"l{n % 4}") for n, v in enumerate(vectors)]
    bad = [(1, None, "x"), (2, [], "x"), (3, [1.0], "x"), (4, [float("nan")] * 10, "x"), (5, [float("inf")] + [0.0] * 9, "x"), (6, [None] * 10, "x")]
    df = spark.createDataFrame([(*r, "part", 1, 2, 3) for r in [*rows, *bad]], "vec_id long, embedding array<double>, label string, part string, row int, n int, code int")
    got = sorted(map(tuple, vector_code.compress(df, parts=4, words=6, rounds=3).collect()), key=str)
    codes, errors, sha = codes_by_hand([r[:2] for r in rows], 4, 6, 3)
    by_label = collections.Counter()
    for r, e in zip(rows, errors):
        by_label[r[2]] += e
    assert got == sorted(((r[0], c, e, by_label[r[2]], sha) for r, c, e in zip(rows, codes, errors)), key=str)
    huge = spark.createDataFrame([(1, [1e30] * 4, 1), (2, [-1e30] * 4, 1), (3, [0.0] * 4, 1)], "vec_id long, embedding array<double>, label int")
    assert vector_code.compress(huge, parts=2, words=1).count() == 3
    assert vector_code.compress(df.limit(0)).count() == 0


# 13 sharding
def shards_by_hand(rows, shards, law):
    """Counter of (id, size, crc, shard, slot)."""
    keyed = sorted((hashlib.md5((t or "").encode()).hexdigest(), -1 if i is None else i, i, len((t or "").encode()) + 1, crc(t or "")) for i, t in rows)
    weights = [r[3] if law == "bytes" else 1 for r in keyed]
    at, out, slots = 0, collections.Counter(), collections.Counter()
    for r, w in zip(keyed, weights):
        shard = min((2 * at + w) * shards // (2 * sum(weights)), shards - 1)
        out[r[2], r[3], r[4], shard, slots[shard]] += 1
        slots[shard] += 1
        at += w
    return out


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(spark, law, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 20)
    texts = [None, "", "é" * 9, "long " * 20_000, *["copy"] * 700, *[""] * 600, *[f"text {n} " * (n % 40) for n in range(400)]]
    rows = [(None if n % 50 == 3 else n // 2, t) for n, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, key int, shard int, `row` int")
    got = sharding.assign(df.repartition(5), 7, law, carry=["shard", "row"]).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == shards_by_hand(rows, 7, law)
    ranged, totals = sharding.ranges_of(sharding.stored(df.select(F.concat_ws(" ", F.md5(F.coalesce("text", F.lit(""))), F.monotonically_increasing_id()).alias("key"), F.lit(1).cast("long").alias("weight")), "t"))
    counts = [r.n for r in totals.collect()]
    assert sum(counts) == len(rows) and max(counts) <= sharding.OVERFULL * len(rows) / 16
    assert sharding.assign(df.limit(0)).count() == 0


def test_shards_are_written_in_order(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumn("shard", F.lit("x"))
    sharding.write_shards(df, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted([*df.columns, "shard_"]) and back.count() == df.count()
    want = {r.doc_id: r.shard for r in sharding.assign(df, 3).collect()}
    assert {r.doc_id: r.shard_ for r in back.collect()} == want


# mended operators
def test_near_copies_go_without_a_shuffle_of_texts(spark):
    from siltstone.llm import simhash

    df = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("lang", "a.b").withColumn("cell", F.lit(1)).withColumn("place", F.lit("x"))
    kept = simhash.distinct_documents(df)
    plan = kept._jdf.queryExecution().explainString(kept.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanges = [block for block in plan.split("\n\n") if " Exchange" in block.split("\n")[0]]
    assert exchanges and not any("row#" in block for block in exchanges)
    assert "Sort [cell" not in plan and kept.columns == df.columns
    assert kept.count() == simhash.simhash_components(df).select("component_id").distinct().count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("siltstone")]


def test_damaged_numbers_of_records_are_gaps_or_null():
    from siltstone.llm import warc

    revisit = warc.record_bytes(5, "http://x", b"abc", "A" * 32, 3)
    good = warc.record_bytes(6, "http://y", b"", "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ", None)
    for old, new in ((b"X-Payload-Length: 3", b"X-Payload-Length: 1x"), (b"X-Payload-Length: 3", b"X-Payload-Length: " + b"9" * 20), (b"Content-Length:", b"Content-Length: " + b"9" * 5000)):
        found = list(warc.salvage(revisit.replace(old, new) + good))
        assert [h is None for _, _, _, h, _, _ in found] == [True, False]
    assert warc._page("<urn:page:" + "9" * 20 + ">") is None and warc._page("<urn:page:9223372036854775807>") == 2**63 - 1
    assert warc._page("<urn:page:٣>") is None


def test_redaction_of_any_column_names(spark):
    from siltstone.llm import secret_scan

    names = ["doc_id", "text", "lang", "source", "n_chars", "__live", "__key", "__text_key", "a.b", "live", "row", "of", "found"]
    secret = "token = Zx81Qw73Er55Ty"
    rows = [(1, f"{secret} is here", "en", "s", 5, "a", 1, "b", 2.0, "c", 3, "d", "e"), (2, "plain words", "en", "s", 5, "a", 1, "b", 2.0, "c", 3, "d", "e")]
    df = spark.createDataFrame(rows, names)
    out = secret_scan.redact_live(df)
    got = {r[0]: r for r in out.collect()}
    assert out.columns == names and got[1][1] == "<SECRET> is here" and got[1][4] == len("<SECRET> is here")
    assert tuple(got[2]) == rows[1] and tuple(got[1])[5:] == rows[0][5:]


def test_raking_at_the_border_returns_its_distance(spark):
    from siltstone.llm import mixing

    cells = spark.createDataFrame([("a", "x", "", 100), ("a", "y", "", 100), ("b", "x", "", 100)], "source string, lang string, topic string, tokens long")
    half = lambda a, b: spark.createDataFrame([(a, 0.5), (b, 0.5)], "value string, share double")
    raked = {(r.source, r.lang): r for r in mixing.rake(cells, {"source": half("a", "b"), "lang": half("x", "y")}).collect()}
    assert 0 < raked["a", "x"].residual < 0.01 and raked["a", "x"].weight < 2
    assert abs(raked["a", "y"].weight - 150) < 2 and abs(raked["b", "x"].weight - 150) < 2


@pytest.mark.parametrize("stage", [1, 2, 3, 4])
def test_pipeline_stages_take_any_column_names(spark, stage):
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars", "__live", "__key", "__text_key", "a.b"]
    df = spark.createDataFrame([(n, f"word{n} other words are here {n * n} and token = abcDEF{n}123456", "en", "s", 9, "a", n, "b", 2.0) for n in range(12)], names)
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, df, SF)
    assert out.count() and (name == "sentencepiece" or out.columns == names)


def test_salted_shards_answer_alike(spark, monkeypatch):
    from siltstone.llm import kneser_ney

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    plain = lambda: sorted(map(tuple, kneser_ney.classify(docs, labels, size=20_000).collect()))
    want = plain()
    monkeypatch.setattr(kneser_ney, "ANSWER_PILES", 3)
    assert plain() == want
