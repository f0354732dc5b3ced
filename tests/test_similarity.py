"""Sequence clusters and chain similarity against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import similarity as S

SF = "/root/testdata/sf0.001"


def plain_alignment(x, y):
    """(matches, columns, places of x, places of y): cell by cell, with whole
    tuples (score, matches, -columns) and the begin of each path."""
    none = ((-(10**9), 0, 0), (0, 0))
    add = lambda a, s, m: (a[0] + s, a[1] + m, a[2] - 1)
    alike = lambda a, b: any(a in g and b in g for g in S.ALIKE)
    best, cells, gaps = ((0, 0, 0), (0, 0), (-1, -1)), {}, {}
    for i, a in enumerate(x):
        left = none
        for j, b in enumerate(y):
            before, begin = cells.get((i - 1, j - 1), ((0, 0, 0), (i, j)))
            if before <= (0, 0, 0):
                before, begin = (0, 0, 0), (i, j)
            s = S.EQUAL if a == b else S.SIMILAR if alike(a, b) else S.OTHER
            here = (add(before, s, int(a == b)), begin)
            above = cells.get((i - 1, j), none)
            opened = (add(above[0], -S.OPEN, 0), above[1]) if above[0] > (0, 0, 0) else none
            longer = gaps.get((i - 1, j), none)
            longer = (add(longer[0], -S.EXTEND, 0), longer[1])
            gaps[i, j] = opened if opened[0] >= longer[0] else longer
            if gaps[i, j][0] > here[0]:
                here = gaps[i, j]
            cells[i, j] = here if here[0] >= left[0] else left
            if cells[i, j][0] > best[0]:
                best = (*cells[i, j], (i, j))
            opened = (add(here[0], -S.OPEN, 0), here[1]) if here[0] > (0, 0, 0) else none
            longer = (add(left[0], -S.EXTEND, 0), left[1])
            left = opened if opened[0] >= longer[0] else longer
    (_, matches, columns), begin, end = best
    return matches, -columns, end[0] - begin[0] + 1 if matches or columns else 0, end[1] - begin[1] + 1 if matches or columns else 0


def family(draw, size, members, change):
    """Copies of a random sequence with substitutions, deletions and insertions."""
    base = "".join(draw.choice(list(S.LETTERS), size))
    out = [base]
    for _ in range(members):
        copy = [c if draw.random() > change else draw.choice(list(S.LETTERS)) for c in base]
        at = int(draw.integers(2, size - 6))
        if draw.random() < 0.5:
            del copy[at : at + int(draw.integers(1, 4))]
        else:
            copy[at:at] = list(draw.choice(list(S.LETTERS), int(draw.integers(1, 4))))
        out.append("".join(copy))
    return out


def test_alignment_is_the_plain_programme():
    draw = np.random.default_rng(5)
    pairs = []
    for _ in range(60):
        f = family(draw, int(draw.integers(12, 40)), 1, draw.random() * 0.7)
        pairs.append((f[0], f[1]))
    pairs += [("A", "A"), ("A", "C"), ("XXXX", "XXXX"), ("ACDEFGHIK", "ACDEIK")]
    got = S.local_alignments([S.letter_codes(a) for a, _ in pairs], [S.letter_codes(b) for _, b in pairs], np.zeros(len(pairs), np.int64), band=50)
    for k, (a, b) in enumerate(pairs):
        if "X" not in a:
            assert tuple(int(g[k]) for g in got) == plain_alignment(a, b), (a, b)
    assert got[0][62] == 0


def test_clusters_are_the_greedy_cover(spark):
    draw = np.random.default_rng(7)
    sequences = [s for _ in range(12) for s in family(draw, int(draw.integers(50, 90)), 6, 0.35)]
    sequences += [sequences[0]] * 3 + ["", "", None, "AC", "X" * 60]
    df = spark.createDataFrame([(n, s) for n, s in enumerate(sequences)], "id long, seq string")
    plain = [s or "" for s in sequences]
    low = {}
    for n, s in enumerate(plain):
        low.setdefault(s, n)
    nodes = sorted(low.values(), key=lambda n: (-len(plain[n]), n))
    true, links = set(), {}
    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            m, c, own, other = plain_alignment(plain[a], plain[b]) if len(plain[b]) >= 0.8 * len(plain[a]) > 0 and "X" not in plain[a] + plain[b] else (0, 0, 0, 0)
            if c and m / c >= 0.3 and own >= 0.8 * len(plain[a]) and other >= 0.8 * len(plain[b]):
                true.add((a, b))
    one = df.groupBy(F.coalesce("seq", F.lit("")).alias("seq")).agg(F.min("id").alias("id")).select("id", F.length("seq").alias("size"), "seq")
    near = S.candidates(S.seeds(one, lambda batch: map(S.group_codes, batch.column(2).to_pylist()), S.PATTERNS), 0.8)
    found = {(r.a, r.b) for r in near.collect()}
    assert len(true & found) >= 0.9 * len(true) and len(true) > 100
    got = {(r.a, r.b) for r in S.aligned(near, one, 0.3, 0.8).collect()}
    assert got <= true and len(got) >= 0.9 * len(true)
    for a, b in got:
        links.setdefault(a, set()).add(b)
    want, taken = {}, set()
    for n in nodes:
        if n not in taken:
            for m in {n} | links.get(n, set()):
                if m not in taken:
                    taken.add(m)
                    want[m] = n
    clusters = {r.id: r.representative for r in S.cluster_by_identity(df, "id", "seq").collect()}
    assert clusters == {n: want[low[s]] for n, s in enumerate(plain)}
    assert S.cluster_by_identity(df.limit(0), "id", "seq").count() == 0


def test_common_seeds_do_not_multiply(spark):
    same = spark.createDataFrame([(n, "ACDEFGHIKL" * 6 + "ACDEFGHIKLMNPQRSTVWY"[n % 20] + "WY" * (n // 20)) for n in range(400)], "id long, seq string").withColumn("size", F.length("seq").cast("int")).select("id", "size", "seq")
    near = S.candidates(S.seeds(same, lambda batch: map(S.group_codes, batch.column(2).to_pylist()), S.PATTERNS), 0.8)
    assert 0 < near.count() < 400 * S.MEMBERS


def turned(draw, points):
    q = np.linalg.qr(draw.standard_normal((3, 3)))[0]
    q[:, 0] *= np.sign(np.linalg.det(q))
    return points @ q + draw.standard_normal(3) * 20


def walk(draw, n):
    step = draw.standard_normal((n, 3))
    return np.cumsum(3.8 * step / np.linalg.norm(step, axis=1, keepdims=True), 0)


def plain_tm(x, y):
    """Every run of every shift refined, with a plain matching."""
    short = min(len(x), len(y))
    scale = max(0.5, 1.24 * np.cbrt(max(short - 15, 0)) - 1.8)
    top = 0
    for shift in range(3 - len(y), len(x) - 2):
        i = np.arange(max(0, shift), min(len(x), len(y) + shift))
        for size in {len(i), max(3, len(i) // 2), max(3, len(i) // 3)}:
            for at in range(0, len(i) - size + 1, max(1, size // 2)):
                turn, move = S.superposed(x[i[at : at + size]], y[i[at : at + size] - shift])
                for _ in range(10):
                    s = 1 / (1 + (((x @ turn + move)[:, None] - y[None]) ** 2).sum(2) / scale**2)
                    best = np.zeros((len(x) + 1, len(y) + 1))
                    for a in range(len(x)):
                        for b in range(len(y)):
                            best[a + 1, b + 1] = max(best[a, b + 1], best[a + 1, b], best[a, b] + s[a, b])
                    top = max(top, best[-1, -1] / short)
                    r, c = S.matched(s)
                    if len(r) < 3:
                        break
                    turn, move = S.superposed(x[r], y[c], s[r, c])
    return top


def test_tm_score_of_turned_and_trimmed_copies():
    draw = np.random.default_rng(9)
    for n in (24, 30):
        x = walk(draw, n)
        assert S.tm_score(x, turned(draw, x)) > 0.999
        assert S.tm_score(x, turned(draw, x[2:-3])) > 0.999
        noisy = turned(draw, x[1:] + 0.3 * draw.standard_normal((n - 1, 3)))
        mirrored = turned(draw, x * [1, 1, -1])
        for other, share in ((noisy, 0.99), (mirrored, 0.8), (walk(draw, n), 0.8)):  # unlike chains are far below any limit
            plain = plain_tm(x, other)
            assert plain * share <= S.tm_score(x, other) <= max(plain, 0.5) + 1e-6
    assert S.tm_score(x[:2], x) == 0


def test_the_longest_of_similar_chains_stays(spark):
    draw = np.random.default_rng(4)
    rows, family_of = [], {}
    for k in range(8):
        base = walk(draw, 60)
        for copy in (base[:50], turned(draw, base), turned(draw, base[5:] + 0.1 * draw.standard_normal((55, 3)))):
            family_of[len(rows)] = k
            rows.append((len(rows), copy.tolist()))
    rows.append((len(rows), [[0.0, 0.0, 0.0]]))
    df = spark.createDataFrame(rows, "id long, points array<array<double>>")
    got = {r.id: (r.component, r.kept) for r in S.longest_of_similar(df, "id", "points").collect()}
    assert len(got) == len(rows) and got[24] == (24, True)
    for k in range(8):
        assert [got[3 * k + n] for n in range(3)] == [(3 * k, False), (3 * k, True), (3 * k, False)]


def test_no_seed_table_goes_through_the_driver(spark):
    """A task's output looks as small as its input: 20 sequences of some bytes have thousands of seeds."""
    rng = np.random.default_rng(3)
    one = spark.createDataFrame([(k, 400, "".join(rng.choice(list("ACDE"), 400))) for k in range(20)], "id long, size int, seq string")
    seeded = S.seeds(one, lambda batch: map(S.group_codes, batch.column(2).to_pylist()), S.PATTERNS)
    near = S.candidates(seeded, 0.8)
    joined = S.aligned(near, one, 0.3, 0.8)
    for df in (near, joined):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    counts = {(r.a, r.b): r for r in near.collect()}
    places = {}
    for r in seeded.collect():
        places.setdefault(r.key, []).append((r.id, r.pos))
    assert all(len(v) <= S.MEMBERS for v in places.values())
    want = {}
    for v in places.values():
        for i, p in v:
            for j, q in v:
                if i < j:
                    of = want.setdefault((i, j), {})
                    of[p - q] = of.get(p - q, 0) + 1
    assert set(counts) == {k for k, of in want.items() if sum(of.values()) >= 2}
    for k, r in counts.items():
        assert r.diagonal == max((n, diagonal) for diagonal, n in want[k].items())[1]


def test_seeds_of_a_pair_are_superposed_together(monkeypatch):
    draw = np.random.default_rng(5)
    x, y = (np.cumsum(draw.normal(size=(21, 3)) * 2, 0) for _ in range(2))
    calls, svd = [], np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda a, **how: calls.append(np.shape(a)) or svd(a, **how))
    score = S.tm_score(x, y)
    assert len(calls) < 60  # one a length and a round, not one a seed
    monkeypatch.setattr(S, "CELLS", 1)  # each alone
    assert abs(S.tm_score(x, y) - score) < 1e-12
    turns, moves = S.superposed(np.stack([x, y]), np.stack([y, x]))
    for k, (a, b) in enumerate(((x, y), (y, x))):
        turn, move = S.superposed(a, b)
        assert np.allclose(turn, turns[k], atol=1e-12) and np.allclose(move, moves[k], atol=1e-12)
