"""SimHash near-dedup by generalised pigeonhole.

1. Fingerprints: one pass over whole texts in Arrow batches.
2. Equal fingerprints collapse to one node; everything below works on nodes.
3. Bit statistics over all nodes give each bit's balance and each pair's
   correlation; correlated bits are grouped into the same partition.
4. For a distance limit ``t`` and ``m`` partitions the thresholds may be any
   integers >= -1 that sum to ``t - m + 1``: then two fingerprints within ``t``
   are within the threshold in at least one partition. Dynamic programming
   allocates them, and picks ``m``, by estimated candidate counts.
5. Probes: two values within ``r`` of each other agree after some ``r`` bits are
   masked, so each node has one key for each choice of masked bits. Nodes that
   share a key are verified in place; buckets above a size are cut into blocks.
6. Each bucket returns a spanning forest of its links, not all its pairs, and
   connected components give the smallest id reachable.

Defined results: a null text counts as empty, and a text without words has
fingerprint zero, linked like any other; equal texts have equal fingerprints;
an empty table gives an empty result; extra columns are ignored; rows with a
null id get a result too and never are a component's id unless all its ids are
null. Texts of any length are taken whole. Where documents are dropped, a group
keeps the row of its smallest id, null last, of the least text digest where
texts share that id, and one of the rows that share both.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shared import stored_by
from .common import bucket_blocks, components, stored

BITS = 64
#: Rows of a stretch of a stored table, for which one bitmap tells which stay.
CELL_BITS = 15
#: Within a bucket up to this size, each two members are compared by shifts.
SMALL_BUCKET = 48


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Bit i is set if over half of the shingles' hashes have it set."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII blanks only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    total = np.zeros(BITS, np.int64)
    count = len(words) - shingle + 1
    for start in range(0, count, 65536):  # bounded memory for very long texts
        stop = min(start + 65536, count)
        part = words[start : stop + shingle - 1]
        hashes = [digest(b" ".join(g), seed) for g in zip(*[part[k:] for k in range(shingle)])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp long, same: digest of the text) for each row; narrow."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_digest(F.col(text_col)).alias("same"))
    kind = source.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                prints = np.array([fingerprint(t.as_py(), shingle, seed) for t in part.column(1)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64)), part.column(2)], names=["id", "fp", "same"])

    return source.mapInArrow(work, f"id {kind}, fp bigint, same binary")


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of nodes and, for each two bits, how many have both set.

    Each task returns 2,080 sums; so does the aggregate, whatever the input."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((BITS, BITS)), 0
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(prints), 65536):
                part = np.ascontiguousarray(prints[start : start + 65536])
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                count += len(part)
        i, j = np.triu_indices(BITS)
        if count:
            both = total[i, j].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[i, -1].astype(np.int32)), pa.array(np.r_[j, -1].astype(np.int32)), pa.array(np.r_[both, count])], names=["i", "j", "n"]
            )

    rows = nodes.select("fp").mapInArrow(work, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, count = np.zeros((BITS, BITS)), 0
    for i, j, n in rows:
        if i < 0:
            count = n
        else:
            both[i, j] = both[j, i] = n
    return count, both


def group_bits(count: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of nearly equal width that keep correlated bits together:
    a partition starts at the free bit of strongest correlations and takes the
    free bit most correlated with its members, again and again."""
    share = np.diag(both) / max(count, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    correlation = np.abs(both / max(count, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        ranked = sorted(free)
        group = [max(ranked, key=lambda b: (correlation[b, ranked].sum(), -b))]
        free.discard(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: (correlation[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def candidate_curve(count: int, both: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated pairs within 0..most in one partition: bits differ with their
    own probabilities, and the spread is that of fewer independent bits where
    they are correlated."""
    share = np.diag(both)[group] / max(count, 1)
    differ = 2 * share * (1 - share)
    joint = both[np.ix_(group, group)] / max(count, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    correlation = np.clip((joint - np.outer(share, share)) / np.outer(spread, spread), -1, 1)
    free = len(group) ** 2 / max((correlation**2).sum(), 1)  # effective number of independent bits
    chance = np.zeros(len(group) + 1)
    chance[0] = 1
    for p in differ:
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    within = np.cumsum(chance)[: most + 1] ** (free / len(group))
    return [0.5 * count * count * float(w) for w in within]


def allocate(curves: list[list[float]], budget: int, probe_cost: list[list[float]]) -> tuple[float, list[int]]:
    """Thresholds >= -1 with the given sum and the least estimated cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for curve, probes in zip(curves, probe_cost):
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, len(curve)):
                total = cost + (curve[t] + probes[t] if t >= 0 else 0)
                at = used + t
                if at not in after or total < after[at][0]:
                    after[at] = (total, [*chosen, t])
        best = after
    return best[budget]


#: What one key of one node costs beside one candidate pair: a shuffled row.
KEY_COST = 40.0


def plan_partitions(count: int, both: np.ndarray, limit: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, for the number of
    partitions with the least estimated cost."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(max(1, limit // 2), limit + 2):
        groups = group_bits(count, both, parts)
        most = min(limit, 2)
        curves = [candidate_curve(count, both, g, most) for g in groups]
        probes = [[KEY_COST * count * comb(len(g), t) for t in range(most + 1)] for g in groups]
        budget = limit - parts + 1
        if budget > most * parts:
            continue
        cost, chosen = allocate(curves, budget, probes)
        plan = [(g, t) for g, t in zip(groups, chosen) if t >= 0]
        if best is None or cost < best[0]:
            best = (cost, plan)
    return best[1]


def masked_keys(plan: list[tuple[list[int], int]]) -> list[tuple[int, int]]:
    """(tag, mask) of each key: a partition's bits without the masked ones."""
    out = []
    for bits, threshold in plan:
        whole = sum(1 << b for b in bits)
        for gone in combinations(bits, threshold):
            out.append((len(out), whole & ~sum(1 << b for b in gone)))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(values: np.ndarray, own: np.ndarray, limit: int, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within one large bucket: a member that is
    reached leaves the set that is searched, so dense groups cost little.
    With ``cross``, only pairs of different blocks count."""
    left = np.arange(len(values))
    a, b = [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= limit
            if cross:
                near &= own[left] != own[at]
            if near.any():
                hit = left[near]
                a.append(np.full(len(hit), at))
                b.append(hit)
                front.extend(hit.tolist())
                left = left[~near]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def links(nodes: DataFrame, plan: list[tuple[list[int], int]], limit: int) -> DataFrame:
    """(a, b) fingerprints at most ``limit`` bits apart: for each bucket enough
    of its links to connect what they connect."""
    keys = F.array(*[F.struct(F.lit(tag).alias("tag"), F.col("fp").bitwiseAND(F.lit(signed(mask)).cast("long")).alias("key")) for tag, mask in masked_keys(plan)])
    rows = nodes.select("fp", F.explode(keys).alias("k")).select("k.tag", "k.key", "fp")
    dealt = bucket_blocks(rows, ["tag", "key"], "fp")
    sorted_rows = dealt.repartition("tag", "key", "lo", "hi").sortWithinPartitions("tag", "key", "lo", "hi").select("tag", "key", "lo", "hi", "own", "fp")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Batches cut at bucket borders: columns same-bucket number, own, fp."""
        rest = None
        for batch in batches:
            tag, key, lo, hi, own, fp = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6))
            block = np.stack([tag, key, lo, hi, own, fp])
            block = block if rest is None else np.concatenate([rest, block], axis=1)
            last = (block[:4] == block[:4, -1:]).all(0)
            cut = len(last) - int(last[::-1].argmin() if not last.all() else len(last))
            rest = block[:, cut:]
            if cut:
                yield block[:, :cut]
        if rest is not None and rest.shape[1]:
            yield rest

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches):
            change = np.r_[True, (block[:4, 1:] != block[:4, :-1]).any(0)]
            begins = np.flatnonzero(change)
            sizes = np.diff(np.r_[begins, block.shape[1]])
            own, prints = block[4], block[5].view(np.uint64)
            a, b = [], []
            of_small = np.repeat(sizes <= SMALL_BUCKET, sizes)
            number = np.cumsum(change)
            for shift in range(1, int(min(sizes.max(), SMALL_BUCKET))):
                i = np.flatnonzero(of_small[:-shift] & (number[shift:] == number[:-shift]))
                if not len(i):
                    break
                j = i + shift
                near = (np.bitwise_count(prints[i] ^ prints[j]) <= limit) & ((block[2][i] == block[3][i]) | (own[i] != own[j]))
                a.append(i[near])
                b.append(j[near])
            for k in np.flatnonzero(sizes > SMALL_BUCKET):
                at, to = begins[k], begins[k] + sizes[k]
                x, y = bucket_links(prints[at:to], own[at:to], limit, block[2][at] != block[3][at])
                a.append(x + at)
                b.append(y + at)
            if a:
                i, j = np.concatenate(a), np.concatenate(b)
                if len(i):
                    pairs = np.unique(np.sort(np.stack([block[5][i], block[5][j]]), axis=0), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return sorted_rows.mapInArrow(work, "a bigint, b bigint")


def labelled_prints(prints: DataFrame, limit: int) -> DataFrame:
    """(fp, root, low, n_same) of the stored :func:`fingerprints`: ``root`` the
    same for all that links connect, ``low`` the fingerprint's smallest id."""
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n_same")), "nodes")
    count, both = bit_statistics(nodes)
    if count:
        edges = links(nodes, plan_partitions(count, both, limit), limit)
        roots = stored(components(edges, "simhash"), "roots")
    else:
        roots = nodes.select(F.col("fp").alias("node"), F.col("fp").alias("root")).limit(0)
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low", "n_same")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, limit: int = 4, seed: int = 42
) -> DataFrame:
    """Columns: ``id_col``, fingerprint (16 hex digits), component_id (smallest
    id reachable by links of at most ``limit`` differing bits), n_same (rows of
    the same fingerprint), kept (its id is the component's)."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle, seed).drop("same"), "fingerprints")
    rooted = labelled_prints(prints, limit)
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    labelled = rooted.join(least, "root").select("fp", "n_same", "component_id")
    return (
        prints.join(labelled, "fp")
        .select(
            F.col("id").alias(id_col),
            F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
            "component_id",
            "n_same",
            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, limit: int = 4, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, all their columns, without near copies: one row of
    each component. Rows that share an id stay apart if their texts are no copies.

    Rows are stored once, where they are, with a place of their own and in
    buckets of the stretch of places it is in. Which rows stay comes back as one
    bitmap a stretch, so at any number of rows kept or dropped no text is
    shuffled or sorted."""
    place = F.monotonically_increasing_id()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = stored_by(docs.select(whole, place.alias("place")).withColumn("cell", F.shiftright("place", CELL_BITS)), "documents", "cell")
    prints = rows.select(F.struct(F.col(f"row.`{id_col}`").alias("id"), "place").alias("id"), F.col(f"row.`{text_col}`").alias("text"))
    prints = stored(fingerprints(prints, "id", "text", shingle, seed).select("fp", "id.id", "id.place", "same"), "fingerprints")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "same", "place")
    best = prints.groupBy("fp").agg(F.min(order).alias("best"))
    rooted = labelled_prints(prints, limit).select("fp", "root").join(best, "fp")
    winners = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.place").alias("place"))
    in_cell = F.col("place").bitwiseAND(F.lit((1 << CELL_BITS) - 1))
    kept = winners.groupBy(F.shiftright("place", CELL_BITS).alias("cell")).agg(F.bitmap_construct_agg(in_cell).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(in_cell, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(kept.hint("shuffle_hash"), "cell").filter(F.getbit(byte, in_cell.bitwiseAND(F.lit(7)).cast("int")) == 1).select("row.*")
