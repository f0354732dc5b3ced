"""Clusters of similar sequences, and one of each group of similar chains.

Candidates share spaced seeds: a few letters at the places of a pattern. A seed
that more than ``MEMBERS`` sequences have is split by the letters that follow
it, and what is still larger meets through its longest member only, so pairs
grow with the input and not with the square of a seed's share. Candidates are
verified in Arrow batches, sequences by a banded local alignment of many pairs
at once, chains by superposition; what follows is joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import TASK_ROWS, by_shuffle, dealt, stored

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
# Letters that replace each other often.
ALIKE = "AST C DE FWY G HKR ILMV NQ P".split()
#: Scores of equal, alike and other letters, of a gap and of each further place of it.
EQUAL, SIMILAR, OTHER, OPEN, EXTEND = 5, 1, -2, 7, 2
PATTERNS = ("11011", "110101", "1001101")
#: Members of a seed that are all compared with each other.
MEMBERS = 48
#: Places to either side of the seeds' diagonal.
BAND = 32
#: Pairs that are aligned together, and pairs of a task.
TOGETHER, TASK_PAIRS = 512, 4096
#: Bins of the distances of alpha carbons two and three residues apart.
SHAPE_CUTS = ((5.8, 6.6), (6.5, 8.8))


def group_codes(seq: str) -> np.ndarray:
    """Group number of each letter; other letters are a group of their own."""
    table = np.full(256, len(ALIKE), np.uint8)
    for k, letters in enumerate(ALIKE):
        for c in letters:
            table[ord(c)] = k
    return table[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]


def seeds(items: DataFrame, codes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], patterns: tuple[str, ...]) -> DataFrame:
    """(id, size, key, wide, pos) of ``items`` (id, size, ...): each seed once a
    sequence, at its first place; ``wide`` has three more letters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, wides, places, counts = [], [], [], []
            for codes in codes_of(batch):
                own_k, own_w, own_p = [], [], []
                padded = np.concatenate([codes.astype(np.int64) + 1, np.zeros(3, np.int64)])
                for number, pattern in enumerate(patterns):
                    n = len(codes) - len(pattern) + 1
                    if n <= 0:
                        continue
                    key = np.full(n, number + 1, np.int64)
                    for place, on in enumerate(pattern):
                        if on == "1":
                            key = key * 32 + padded[place : place + n]
                    wide = key
                    for more in range(3):
                        wide = wide * 32 + padded[len(pattern) + more : len(pattern) + more + n]
                    first = np.sort(np.unique(key, return_index=True)[1])
                    own_k.append(key[first])
                    own_w.append(wide[first])
                    own_p.append(first)
                counts.append(sum(map(len, own_k)))
                keys += own_k
                wides += own_w
                places += own_p
            at = np.repeat(np.arange(batch.num_rows), counts)
            join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(join(keys)), pa.array(join(wides)), pa.array(join(places).astype(np.int32))], names=["id", "size", "key", "wide", "pos"])

    return items.mapInArrow(work, "id long, size int, key long, wide long, pos int")


def candidates(seeded: DataFrame, cover: float, least: int = 2) -> DataFrame:
    """(a, b, diagonal) of pairs, a the longer (then the smaller id), that share
    ``least`` seeds or more and whose sizes allow both to be covered; the
    diagonal has most of their seeds."""

    def with_size(rows: DataFrame, key: str) -> DataFrame:
        n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("id", "size", "pos"), F.struct("size", -F.col("id"))).alias("top")).filter("n > 1")
        return rows.join(by_shuffle(n), key)

    a, b = F.col("a"), F.col("b")
    before = (a["size"] > b["size"]) | ((a["size"] == b["size"]) & (a["id"] < b["id"]))
    fits = before & (b["size"] >= F.lit(cover) * a["size"])

    def all_pairs(rows: DataFrame, key: str) -> DataFrame:
        side = rows.select(key, F.struct("id", "size", "pos").alias("a"))
        return side.join(by_shuffle(side.withColumnRenamed("a", "b")), key).filter(fits).select(F.col(key).alias("seed"), "a", "b")

    counted = stored(with_size(seeded, "key"), "seeds")
    plain = all_pairs(counted.filter(F.col("n") <= MEMBERS), "key")
    split = stored(with_size(counted.filter(F.col("n") > MEMBERS).drop("n", "top"), "wide"), "seeds")
    narrow = all_pairs(split.filter(F.col("n") <= MEMBERS), "wide")
    star = split.filter((F.col("n") > MEMBERS) & (F.col("id") != F.col("top.id"))).select(F.col("wide").alias("seed"), F.col("top").alias("a"), F.struct("id", "size", "pos").alias("b")).filter(fits)
    within = F.when(F.col("n") <= MEMBERS, (F.col("n") - 1) / 2)
    most = sum(int(df.agg(F.sum(F.coalesce(within, F.lit(beyond)))).first()[0] or 0) for df, beyond in ((counted, 0.0), (split, 1.0)))
    # dealt by pair once, both aggregates follow where they are; the most frequent diagonal, then the largest, as one number
    met = plain.unionByName(narrow).unionByName(star).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), (F.col("a.pos") - F.col("b.pos")).alias("diagonal"))
    met = met.repartition("a", "b") if most <= TASK_ROWS else dealt(met, most, "a", "b")
    hits = met.groupBy("a", "b", "diagonal").agg(F.count(F.lit(1)).alias("n"))
    best = hits.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max(F.col("n") * F.lit(1 << 32) + F.col("diagonal") + F.lit(1 << 31)).alias("top")).withColumn("diagonal", (F.col("top") % F.lit(1 << 32) - F.lit(1 << 31)).cast("int"))
    return best.filter(F.col("n") >= least).select("a", "b", "diagonal")


def local_alignments(xs: list[np.ndarray], ys: list[np.ndarray], diagonals: np.ndarray, band: int = BAND) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(matches, columns, places of x, places of y) of the best local alignment
    of each pair within ``band`` of its diagonal (place in x less place in y).

    Letters are 0 to 19 of :data:`LETTERS`, or 20. The best has the largest
    score, then most matches, then fewest columns: one whole number that adds up
    along a path. All pairs go row by row; within a row the best gap before each
    cell is a running maximum."""
    pairs, rows = len(xs), max(map(len, xs), default=0)
    size_x, size_y = np.array(list(map(len, xs))), np.array(list(map(len, ys)))
    if not pairs or not rows or not size_y.max():
        return (np.zeros(pairs, np.int64),) * 4
    longest = int((size_x + size_y).max()) + 1
    match = 2 * longest
    score = match * 2 * longest
    kinds = np.array([next((k for k, g in enumerate(ALIKE) if c in g), -1) for c in LETTERS] + [-2])
    table = np.where(kinds[:, None] == kinds[None], SIMILAR, OTHER).astype(np.int64) * score
    table[20, :] = table[:, 20] = OTHER * score
    np.fill_diagonal(table[:20, :20], EQUAL * score + match)
    table -= 1
    x = np.full((pairs, rows), 20, np.int64)
    y = np.full((pairs, int(size_y.max())), 20, np.int64)
    for k in range(pairs):
        x[k, : len(xs[k])], y[k, : len(ys[k])] = xs[k], ys[k]
    width, none = 2 * band + 1, np.int64(-(1 << 61))
    steps, each = np.arange(width), np.arange(pairs)
    step, first = EXTEND * score + 1, (OPEN - EXTEND) * score
    value, gap = np.zeros((pairs, width), np.int64), np.full((pairs, width), none)
    start, gap_start = np.zeros((pairs, width, 2), np.int32), np.zeros((pairs, width, 2), np.int32)
    best, ends, begins = np.zeros(pairs, np.int64), np.zeros((pairs, 2), np.int64), np.zeros((pairs, 2), np.int64)
    for i in range(rows):
        j = i - diagonals[:, None] + (steps - band)[None]
        inside = (j >= 0) & (j < size_y[:, None]) & (i < size_x)[:, None]
        own = np.where(inside, np.maximum(value, 0) + table[x[:, i, None], np.take_along_axis(y, np.clip(j, 0, y.shape[1] - 1), 1)], none)
        here = np.stack([np.full_like(j, i), j], 2).astype(np.int32)
        came = np.where((value > 0)[:, :, None], start, here)
        # from above: the place before in x, one further in the band
        opened = np.full_like(value, none)
        opened[:, :-1] = np.where(value[:, 1:] > 0, value[:, 1:] - OPEN * score - 1, none)
        longer = np.full_like(gap, none)
        longer[:, :-1] = gap[:, 1:] - step
        new = opened >= longer
        shifted, shifted_gap = np.roll(start, -1, 1), np.roll(gap_start, -1, 1)
        gap, gap_start = np.maximum(np.where(inside, np.maximum(opened, longer), none), none), np.where(new[:, :, None], shifted, shifted_gap)
        down = gap > own
        now, now_start = np.where(down, gap, own), np.where(down[:, :, None], gap_start, came)
        # from the left, by the best of all cells before
        lifted = np.where(now > 0, now + step * steps, none)
        top = np.maximum.accumulate(lifted, 1)
        source = np.maximum.accumulate(np.where(lifted == top, steps, 0), 1)
        left = np.full_like(now, none)
        left[:, 1:] = np.where(top[:, :-1] > 0, top[:, :-1] - step * steps[1:] - first, none)
        left = np.where(inside, left, none)
        from_left = np.concatenate([now_start[:, :1], np.take_along_axis(now_start, source[:, :-1, None].repeat(2, 2), 1)], 1)
        side = left > now
        value, start = np.where(side, left, now), np.where(side[:, :, None], from_left, now_start)
        value = np.where(inside, np.maximum(value, 0), 0)
        at = value.argmax(1)
        better = value[each, at] > best
        best = np.where(better, value[each, at], best)
        ends = np.where(better[:, None], np.stack([np.full(pairs, i), j[each, at]], 1), ends)
        begins = np.where(better[:, None], start[each, at], begins)
    columns = -best % match
    spans = np.where((best > 0)[:, None], ends - begins + 1, 0)
    return (best + columns) // match % (2 * longest), columns, spans[:, 0], spans[:, 1]


def letter_codes(seq: str) -> np.ndarray:
    table = np.full(256, 20, np.int64)
    for k, c in enumerate(LETTERS):
        table[ord(c)] = k
    return table[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]


def spread(rows: DataFrame, pairs: DataFrame, each: int = TASK_PAIRS) -> DataFrame:
    """``rows``, one for each of the stored ``pairs``, dealt to as many tasks as
    their work wants, which their bytes do not show."""
    return rows.repartition(max(1, -(-pairs.count() // each)), "a", "b")


def aligned(pairs: DataFrame, sequences: DataFrame, identity: float, cover: float) -> DataFrame:
    """(a, b, identity, cover) of the pairs whose alignment has that share of
    equal letters, and of both sequences' places, or more."""
    side = lambda i, s: by_shuffle(sequences.select(F.col("id").alias(i), F.col("seq").alias(s)))
    both = spread(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "diagonal", "x", "y"), pairs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                xs, ys = ([letter_codes(s) for s in part.column(k).to_pylist()] for k in (3, 4))
                matches, columns, own, other = local_alignments(xs, ys, part.column(2).to_numpy().astype(np.int64))
                share = matches / np.maximum(columns, 1)
                covered = np.minimum(own / np.maximum(list(map(len, xs)), 1), other / np.maximum(list(map(len, ys)), 1))
                keep = np.flatnonzero((share >= identity) & (covered >= cover))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), part.column(1).take(pa.array(keep)), pa.array(share[keep]), pa.array(covered[keep])], names=["a", "b", "identity", "cover"])

    return both.mapInArrow(work, "a long, b long, identity double, cover double")


def greedy_cover(items: DataFrame, links: DataFrame) -> DataFrame:
    """(id, representative): by falling size, then rising id, an item that no
    representative has yet becomes one and takes all it links to.

    ``items`` is (id, size), ``links`` (a, b) with a before b in that order. In
    each round the items without an open item before them become representatives
    and close their neighbours, which gives what the one-by-one scan gives."""
    links = stored(links.select("a", "b"), "links")
    open_ = stored(items.select("id"), "open")
    chosen = open_.limit(0)
    while not open_.isEmpty():
        live = links.join(by_shuffle(open_.withColumnRenamed("id", "a")), "a", "left_semi").join(by_shuffle(open_.withColumnRenamed("id", "b")), "b", "left_semi")
        fresh = stored(open_.join(by_shuffle(live.select(F.col("b").alias("id")).distinct()), "id", "left_anti"), "fresh")
        closed = live.join(by_shuffle(fresh.withColumnRenamed("id", "a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        open_ = stored(open_.join(by_shuffle(fresh), "id", "left_anti").join(by_shuffle(closed), "id", "left_anti"), "open")
        chosen = stored(chosen.unionByName(fresh), "chosen")
    taken = links.join(by_shuffle(chosen.withColumnRenamed("id", "a")), "a", "left_semi").join(by_shuffle(items.select(F.col("id").alias("a"), "size")), "a")
    first = taken.groupBy(F.col("b").alias("id")).agg(F.max_by("a", F.struct("size", -F.col("a"))).alias("first"))
    own = chosen.select("id", F.col("id").alias("own"))
    return items.select("id").join(by_shuffle(own), "id", "left").join(by_shuffle(first), "id", "left").select("id", F.coalesce("own", "first").alias("representative"))


def cluster_by_identity(df: DataFrame, id_col: str, seq_col: str, identity: float = 0.3, cover: float = 0.8, patterns: tuple[str, ...] = PATTERNS, shared: int = 2) -> DataFrame:
    """(``id_col``, representative): greedy set cover of sequences, longest
    first, over alignments of ``identity`` that cover ``cover`` of both, among
    pairs with ``shared`` seeds in common.

    A null sequence counts as empty; equal sequences are one, of its smallest
    id, so that copies of any number meet once. Sequences shorter than a seed,
    and empty ones, stay alone but for their copies."""
    rows = df.select(F.col(id_col).alias("id"), F.upper(F.coalesce(seq_col, F.lit(""))).alias("seq"))
    one = stored(rows.groupBy("seq").agg(F.min("id").alias("id")).select("id", F.length("seq").alias("size"), "seq"), "sequences")
    near = stored(candidates(seeds(one, lambda batch: map(group_codes, batch.column(2).to_pylist()), patterns), cover, shared), "candidates")
    cover_of = greedy_cover(one, aligned(near, one, identity, cover))
    named = one.select("seq", F.col("id").alias("first")).join(by_shuffle(cover_of), F.col("first") == F.col("id")).select("seq", "representative")
    return rows.join(by_shuffle(named), "seq").select(F.col("id").alias(id_col), "representative")


def superposed(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, shift) that carries the points ``x`` to ``y`` best, no
    reflection; of many sets of points at once, one of each a row."""
    w = np.ones(x.shape[:-1]) if weight is None else weight
    w = (w / w.sum(-1, keepdims=True))[..., None]
    mx, my = ((w * p).sum(-2, keepdims=True) for p in (x, y))
    u, _, v = np.linalg.svd(np.swapaxes(x - mx, -1, -2) @ ((y - my) * w))
    u[..., -1] *= np.sign(np.linalg.det(u @ v))[..., None]
    turn = u @ v
    return turn, (my - mx @ turn)[..., 0, :]


def matched(similar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the matching in order with the largest sum."""
    rows, cols = all_matched(similar[None])[0]
    return np.array(rows, int), np.array(cols, int)


def all_matched(similar: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """:func:`matched` of each of many tables of one size."""
    count, n, m = similar.shape
    total = np.zeros((count, n + 1, m + 1))
    for i in range(n):
        total[:, i + 1, 1:] = np.maximum.accumulate(np.maximum(total[:, i, 1:], total[:, i, :-1] + similar[:, i]), 1)
    out = []
    for table in total:
        sums = table.tolist()
        i, j, rows, cols = n, m, [], []
        while i and j:
            if sums[i][j] == sums[i - 1][j]:
                i -= 1
            elif sums[i][j] == sums[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                rows.append(i)
                cols.append(j)
        out.append((rows[::-1], cols[::-1]))
    return out


#: Points, or cells of tables, of a pair that are worked on together.
CELLS = 1 << 17


def tm_score(x: np.ndarray, y: np.ndarray, best_of: int = 12, rounds: int = 12) -> float:
    """Similarity in [0, 1] of two chains of points, over the shorter's length.

    Seeds are superpositions of runs of the two chains at every shift: all that
    overlaps, and windows of halves and thirds. The best few are refined: match by dynamic programming on the
    scores of all pairs, superpose by those scores, and again. Seeds of a length,
    and the few, go together."""
    short = min(len(x), len(y))
    if short < 3:
        return 0.0
    scale = max(0.5, 1.24 * np.cbrt(max(short - 15, 0)) - 1.8)
    runs: dict[int, list[tuple[int, int, int]]] = {}  # by length: number, place in x, shift
    count = 0
    for shift in range(3 - len(y), len(x) - 2):
        start, stop = max(0, shift), min(len(x), len(y) + shift)
        for size in sorted({stop - start, max(3, (stop - start) // 2), max(3, (stop - start) // 3)}):
            for at in range(start, stop - size + 1, max(1, size // 2)):
                runs.setdefault(size, []).append((count, at, shift))
                count += 1
    scores, turns, moves, shifts = np.empty(count), np.empty((count, 3, 3)), np.empty((count, 3)), np.empty(count, int)
    for size, found in runs.items():
        number, at, shift = np.array(found).T
        each = max(1, CELLS // size)
        for k in range(0, len(number), each):
            some = slice(k, k + each)
            part = at[some, None] + np.arange(size)
            turns[number[some]], moves[number[some]] = superposed(x[part], y[part - shift[some, None]])
        shifts[number] = shift
    for shift in range(3 - len(y), len(x) - 2):
        i, own = np.arange(max(0, shift), min(len(x), len(y) + shift)), np.flatnonzero(shifts == shift)
        away = ((x[i] @ turns[own] + moves[own, None] - y[i - shift]) ** 2).sum(2)
        scores[own] = (1 / (1 + away / scale**2)).sum(1)
    best = np.argsort(-scores, kind="stable")[:best_of]
    each = max(1, CELLS // (len(x) * len(y)))
    return max(refined(x, y, turns[few], moves[few], scale, rounds) for few in (best[k : k + each] for k in range(0, len(best), each)))


def refined(x: np.ndarray, y: np.ndarray, turn: np.ndarray, move: np.ndarray, scale: float, rounds: int) -> float:
    """The largest score that any of some superpositions leads to."""
    short, before, top = min(len(x), len(y)), np.full(len(turn), -1.0), 0.0
    for _ in range(rounds):
        away = ((x @ turn + move[:, None])[:, :, None] - y) ** 2
        similar = 1 / (1 + away.sum(3) / scale**2)
        pairs = all_matched(similar)
        i, j, weight = np.zeros((len(pairs), short), int), np.zeros((len(pairs), short), int), np.zeros((len(pairs), short))
        for k, (rows, cols) in enumerate(pairs):
            i[k, : len(rows)], j[k, : len(rows)], weight[k, : len(rows)] = rows, cols, similar[k, rows, cols]
        score = weight.sum(1) / short
        top = max(top, score.max())
        on = (score > before + 1e-9) & ((weight > 0).sum(1) >= 3)
        if not on.any():
            break
        before = score[on]
        turn, move = superposed(x[i[on]], y[j[on]], weight[on])
    return float(top)


def shape_codes(points: np.ndarray, cuts: tuple[tuple[float, float], tuple[float, float]]) -> np.ndarray:
    """Nine letters of a chain's local shape: distances to the second and to the
    third point on, each in three bins between ``cuts``."""
    if len(points) < 4:
        return np.zeros(0, np.uint8)
    far = (np.linalg.norm(points[k : len(points) - 3 + k] - points[: len(points) - 3], axis=1) for k in (2, 3))
    two, three = (np.searchsorted(c, d).astype(np.uint8) for c, d in zip(cuts, far))
    return 3 * two + three


def similar_chains(df: DataFrame, id_col: str, points_col: str, least: float = 0.5, cover: float = 0.5, cuts: tuple[tuple[float, float], tuple[float, float]] = SHAPE_CUTS, patterns: tuple[str, ...] = ("1111", "11011"), shared: int = 3) -> DataFrame:
    """(a, b, tm) of chains more similar than ``least``. Candidates have
    ``shared`` seeds of local shape in common, which no rigid motion changes,
    and sizes within ``cover``; points are arrays of three."""
    rows = stored(df.select(F.col(id_col).alias("id"), F.size(points_col).alias("size"), F.col(points_col).alias("points")), "chains")

    def matrix(value) -> np.ndarray:
        return np.array(value.as_py(), float).reshape(-1, 3)

    near = stored(candidates(seeds(rows, lambda batch: (shape_codes(matrix(p), cuts) for p in batch.column(2)), patterns), cover, shared), "candidates")
    side = lambda i, p: by_shuffle(rows.select(F.col("id").alias(i), F.col("points").alias(p)))
    both = spread(near.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y"), near, 256)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                scores = np.array([tm_score(matrix(x), matrix(y)) for x, y in zip(part.column(2), part.column(3))])
                keep = np.flatnonzero(scores > least)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), part.column(1).take(pa.array(keep)), pa.array(scores[keep])], names=["a", "b", "tm"])

    return both.mapInArrow(work, "a long, b long, tm double")


def longest_of_similar(df: DataFrame, id_col: str, points_col: str, **how) -> DataFrame:
    """(``id_col``, component, kept): chains joined by links of
    :func:`similar_chains`; the longest of each component stays, the smallest id
    on ties."""
    links = stored(similar_chains(df, id_col, points_col, **how), "similar")
    labelled = components(df.select(id_col), links.select("a", "b"))
    sized = labelled.join(by_shuffle(df.select(F.col(id_col).alias("node"), F.size(points_col).alias("size"))), "node")
    best = sized.groupBy("component").agg(F.max_by("node", F.struct("size", -F.col("node"))).alias("best"))
    return sized.join(by_shuffle(best), "component").select(F.col("node").alias(id_col), "component", (F.col("node") == F.col("best")).alias("kept"))
