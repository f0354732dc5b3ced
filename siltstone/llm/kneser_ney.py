"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, order four: symbols are UTF-16 units, so that a
code point beyond U+FFFF is two of them and none share one. A gram packs four
symbols in a long, so grams and contexts of all orders are shifts and masks of
it. Counts of the trusted rows are summed in
each Arrow batch, then by a sharded aggregate; continuation counts, discounts
from the counts of counts, context sums and interpolated probabilities are
joins of the count tables, sharded by gram. Grams that begin with the mark of a
text's begin have one left context only, so raw counts stand for their
continuation counts. All trusted rows are counted, so the tables grow with the
input.

Two folds, by a hash of the text so that exact copies share one: a fold's model
is of its own trusted rows and judges the rows of the other fold. No row is
judged by a model that has seen it, and thresholds are of unseen good text.

Scoring cuts whole texts into pieces and piles of about ``PILE`` symbols. A
pile asks for each of its distinct grams once, which pre-aggregates common
grams: one list for each shard, that of the gram's two middle symbols, where
the grams of orders four and three and their contexts meet (those of orders two
and one go to all shards). The shards' answers, in single precision, meet the
piles again and symbols are summed by document. A pile and a shard are bounded,
whatever the texts; nothing is broadcast.

Thresholds are the ``quantile`` of the trusted rows' perplexities, by language,
taken from a histogram in steps of 0.001 of log perplexity, so no group is
gathered. Rows above their language's threshold are rejected; ties with it
stay.

Defined results: a null text counts as empty; an empty text has only its end
symbol; very long texts are pieces of their own, summed; a null language is a
language of its own; languages without trusted rows use the threshold over all
of them; where one fold has no trusted rows, one model of all trusted rows
judges every row; without any trusted row everything is kept and perplexities
are null; a null id is never trusted; repeated rows get equal results; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shared import stored_by
from .common import stored

ORDER = 4
BEGIN, END = 1, 2
QUANTILE = 0.995
STEP = 0.001
#: Symbols of a pile, and of a piece of a text, at most (and one text more).
PILE = 4 << 20
#: Shards of a model, at least, and entries of a shard, about.
LEAST_SHARDS, SHARD_ENTRIES = 32, 1 << 20
#: Piles whose grams one task of a shard answers, about.
ANSWER_PILES = 256
#: Symbols that are counted at once.
SLICE = 1 << 20


def packed(symbols: np.ndarray) -> np.ndarray:
    """Grams, as uint64, of ``symbols``: one for each from the fourth on."""
    size = len(symbols) - ORDER + 1
    gram = np.zeros(max(size, 0), np.uint64)
    for k in range(ORDER):
        gram = gram << np.uint64(16) | symbols[k : k + size]
    return gram


def symbols_of(text: str) -> np.ndarray:
    return np.r_[np.full(ORDER - 1, BEGIN), units_of(text), END].astype(np.uint64)


def units_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)


def text_grams(text: str) -> Iterator[np.ndarray]:
    """One gram for each symbol and the end, by slices."""
    symbols = symbols_of(text)
    for start in range(0, len(symbols) - ORDER + 1, SLICE):
        yield packed(symbols[start : start + SLICE + ORDER - 1])


def count_grams(texts: DataFrame) -> DataFrame:
    """(fold, gram, n) of columns fold and text; counted in each batch first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        known = {0: none, 1: none}

        def out(fold: int) -> pa.RecordBatch:
            grams, counts = known[fold]
            known[fold] = none
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), fold, np.int32)), pa.array(grams.view(np.int64)), pa.array(counts)], names=["fold", "gram", "n"])

        for batch in batches:
            folds = batch.column(0).to_numpy(zero_copy_only=False)
            for fold in (0, 1):
                pile, size = [], 0
                for n in np.flatnonzero(folds == fold):
                    for grams in text_grams(batch.column(1)[int(n)].as_py() or ""):
                        pile.append(grams)
                        size += len(grams)
                        if size > SLICE:
                            known[fold] = merged(*known[fold], pile)
                            pile, size = [], 0
                known[fold] = merged(*known[fold], pile)
                if len(known[fold][0]) > 2_000_000:
                    yield out(fold)
        for fold in (0, 1):
            yield out(fold)

    return texts.select("fold", "text").mapInArrow(work, "fold int, gram bigint, n bigint").groupBy("fold", "gram").agg(F.sum("n").alias("n"))


def merged(known: np.ndarray, counts: np.ndarray, pile: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not pile:
        return known, counts
    fresh, n = np.unique(np.concatenate(pile), return_counts=True)
    every = np.concatenate([known, fresh])
    order = np.argsort(every, kind="stable")
    every, both = every[order], np.concatenate([counts, n])[order]
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    return every[first], np.add.reduceat(both, first)


def suffix(gram: Column, order: int) -> Column:
    return gram if order == ORDER else gram.bitwiseAND(F.lit((1 << 16 * order) - 1).cast("long"))


def context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 16)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; 0.5, 1, 1.5 where counts are too few."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def fit(texts: DataFrame) -> DataFrame:
    """Stored models of columns fold and text, one for each fold: (fold, ord,
    kind, code, value). Kind ``p`` has the log probability of a gram, kind ``g``
    the log of what a context hands to the shorter one, both of grams and
    contexts of that order; order 0 has one row, the log probability of a
    symbol that was never seen."""
    raw = stored(count_grams(texts), "grams")
    orders = {ORDER: raw.withColumn("raw", F.col("n"))}
    for k in range(ORDER - 1, 0, -1):
        shorter = orders[k + 1].groupBy("fold", suffix(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).alias("after"), F.sum("raw").alias("raw"))
        begins = F.shiftrightunsigned("gram", 16 * (k - 1)) == BEGIN
        orders[k] = stored(shorter.select("fold", "gram", F.when(begins, F.col("raw")).otherwise(F.col("after")).alias("n"), "raw"), "order")
    tables, lower = None, None
    for k in range(1, ORDER + 1):
        now = orders[k]
        counts = now.groupBy("fold").agg(*[F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)], F.count(F.lit(1))).collect()  # a row a fold
        cut = F.lit(None).cast("double")
        for fold, n1, n2, n3, n4, _ in counts:
            d1, d2, d3 = discounts(n1, n2, n3, n4)
            cut = F.when(F.col("fold") == fold, F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)).otherwise(cut)
        sums = stored(now.groupBy("fold", context(F.col("gram")).alias("ctx")).agg(F.sum("n").alias("sum"), (F.sum(cut) / F.sum("n")).alias("gamma")), "contexts")
        joined = now.withColumn("cut", cut).withColumn("ctx", context(F.col("gram"))).join(sums, ["fold", "ctx"])
        if k == 1:
            gamma = {r.fold: r.gamma for r in sums.collect()}  # a row a fold: the empty context
            floor = [(r[0], gamma[r[0]] / (r[5] + 1)) for r in counts]  # one symbol for all that was never seen
            flat = texts.sparkSession.createDataFrame(floor, "fold int, flat double")
            joined = joined.join(F.broadcast(flat), "fold").withColumn("backed", F.col("flat"))  # two rows at most
            tables = flat.select("fold", F.lit(0).alias("ord"), F.lit("p").alias("kind"), F.lit(0).cast("long").alias("code"), F.log("flat").alias("value"))
        else:
            short = lower.select("fold", F.col("gram").alias("short"), F.col("p").alias("q"))
            joined = joined.withColumn("short", suffix(F.col("gram"), k - 1)).join(short, ["fold", "short"]).withColumn("backed", F.col("gamma") * F.col("q"))
        lower = stored(joined.select("fold", "gram", (F.greatest(F.col("n") - F.col("cut"), F.lit(0.0)) / F.col("sum") + F.col("backed")).alias("p")), "probabilities")
        tables = tables.unionByName(lower.select("fold", F.lit(k).alias("ord"), F.lit("p").alias("kind"), F.col("gram").alias("code"), F.log("p").alias("value")))
        if k > 1:
            tables = tables.unionByName(sums.select("fold", F.lit(k).alias("ord"), F.lit("g").alias("kind"), F.col("ctx").alias("code"), F.log("gamma").alias("value")))
    return tables


class Tables:
    """Sorted arrays of one model, or of a shard of it."""

    def __init__(self, order: np.ndarray, is_p: np.ndarray, code: np.ndarray, value: np.ndarray):
        self.of = {}
        for k in range(ORDER + 1):
            for kind in (True, False):
                own = (order == k) & (is_p == kind)
                keys, values = code[own].view(np.uint64), value[own]
                at = np.argsort(keys)
                self.of[k, kind] = (keys[at], values[at])

    def look(self, k: int, is_p: bool, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, values = self.of[k, is_p]
        if not len(known):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return known[at] == keys, values[at]

    def log_probability(self, gram: np.ndarray) -> np.ndarray:
        """Of the grams' last symbols: the longest order that has a gram, and
        what the longer contexts hand down."""
        out = np.zeros(len(gram))
        open_, short = np.arange(len(gram)), gram
        for k in range(ORDER, 0, -1):
            hit, value = self.look(k, True, short)
            out[open_[hit]] += value[hit]
            open_, short = open_[~hit], short[~hit]
            if not len(open_):
                return out
            if k > 1:
                hit, value = self.look(k, False, short >> np.uint64(16))
                out[open_[hit]] += value[hit]
                short = short & np.uint64((1 << 16 * (k - 1)) - 1)
        out[open_] += self.of[0, True][1][0]
        return out


def shard_of(middle: np.ndarray, shards: int) -> np.ndarray:
    """Of the two middle symbols, 32 bits."""
    mixed = middle * np.uint64(0x9E3779B97F4A7C15)  # odd multiplier: 2^64 by the golden ratio
    return ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


def sharded(model: DataFrame, shards: int) -> DataFrame:
    """``model`` with its shard; orders below three go to all shards."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64(0xFFFFFFFF)
        for batch in batches:
            order, code = batch.column(1).to_numpy(), batch.column(3).to_numpy().view(np.uint64)
            is_p = batch.column(2).to_numpy(zero_copy_only=False) == "p"
            middle = np.where(is_p, code >> np.uint64(16), code) & low
            short = np.flatnonzero(order < 3)
            long = np.flatnonzero(order >= 3)
            yield _with(batch, long, shard_of(middle[long], shards))
            for s in range(shards if len(short) else 0):
                yield _with(batch, short, np.full(len(short), s, np.int32))

    def _with(batch: pa.RecordBatch, at: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
        part = batch.take(pa.array(at))
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(shard)], names=[*part.schema.names, "shard"])

    return model.select("fold", "ord", "kind", "code", "value").mapInArrow(work, "fold int, ord int, kind string, code bigint, value double, shard int")


def pieces(rows: DataFrame, shards: int, size: int = PILE) -> DataFrame:
    """``rows`` (id, lang, trusted, fold, text) with texts in pieces of at most
    ``size`` characters, ``head`` the three characters before a piece. The pieces of a
    pile are of one fold and, but for the last, hold less than ``size`` symbols.
    A row has the pieces of a pile that were read together: (pile, fold, and
    lists who, row, head, length, ends), their texts joined and packed in
    ``body``. For each pile and shard one more row has its distinct grams:
    (pile, fold, shard, grams)."""
    plain = rows.select(F.struct("id", "lang", "trusted").alias("who"), "fold", "text")
    who = plain.schema["who"].dataType.simpleString()
    kinds = {"pile": pa.int64(), "fold": pa.int32(), "row": pa.list_(pa.int64()), "head": pa.list_(pa.string()), "length": pa.list_(pa.int32()), "ends": pa.list_(pa.bool_()), "body": pa.binary(), "shard": pa.int32(), "grams": pa.list_(pa.int64())}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        made, read, nobody = 0, 0, None
        # by fold: pile, symbols, distinct grams, grams that wait to be made distinct, their number
        open_: dict[int, list] = {}

        def rows_of(who: list[pa.Array], **columns) -> pa.RecordBatch:
            size = len(columns["pile"])
            arrays = [pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in kinds.items()]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(w) for w in who])].astype(np.int32)), pa.concat_arrays(who)) if who else pa.nulls(size, pa.list_(nobody))
            return pa.RecordBatch.from_arrays([*arrays, lists], names=[*kinds, "who"])

        def texts(batch: pa.RecordBatch, cut: list[tuple]) -> pa.RecordBatch:
            piles = sorted({c[2] for c in cut})
            of = [[c for c in cut if c[2] == pile] for pile in piles]
            return rows_of(
                [batch.column(0).take(pa.array([c[0] for c in own], pa.int64())) for own in of],
                pile=piles, fold=[own[0][3] for own in of], row=[[c[1] for c in own] for own in of], head=[[c[4] for c in own] for own in of], length=[[len(c[5]) for c in own] for own in of],
                ends=[[c[6] for c in own] for own in of], body=[zlib.compress("".join(c[5] for c in own).encode("utf-8", "surrogatepass"), 1) for own in of],
            )

        def asked(fold: int) -> pa.RecordBatch:
            pile, _, mine, wait, _ = open_.pop(fold)
            lists = by_shard(np.unique(np.concatenate([mine, *wait])), shards)
            return rows_of([], pile=[pile] * shards, fold=[fold] * shards, shard=range(shards), grams=[g.view(np.int64) for g in lists])

        for batch in batches:
            nobody = batch.column(0).type
            cut, held = [], 0
            for n, (fold, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                body = text.as_py() or ""
                for start in range(0, len(body) or 1, size):
                    part, head = body[start : start + size], body[max(0, start - ORDER + 1) : start]
                    ends = start + size >= len(body)
                    if fold not in open_:
                        open_[fold], made = [task + made, 0, np.zeros(0, np.uint64), [], 0], made + 1
                    state = open_[fold]
                    cut.append((n, task + read, state[0], fold, head, part, ends))
                    grams = piece_grams(head, part, ends)
                    state[1] += len(grams)
                    state[3].append(grams)
                    state[4] += len(grams)
                    if state[4] > SLICE:
                        state[2:] = [np.unique(np.concatenate([state[2], *state[3]])), [], 0]
                    held += len(part) + 1
                    if state[1] >= size:
                        yield asked(fold)
                    if held >= size:
                        yield texts(batch, cut)
                        cut, held = [], 0
                read += 1
            if cut:
                yield texts(batch, cut)
        for fold in list(open_):
            yield asked(fold)

    return plain.mapInArrow(work, f"pile bigint, fold int, row array<bigint>, head array<string>, length array<int>, ends array<boolean>, body binary, shard int, grams array<bigint>, who array<{who}>")


def by_shard(grams: np.ndarray, shards: int) -> list[np.ndarray]:
    """Sorted distinct grams, cut into those of each shard."""
    shard = shard_of(grams >> np.uint64(16) & np.uint64(0xFFFFFFFF), shards)
    order = np.argsort(shard, kind="stable")
    return np.split(grams[order], np.searchsorted(shard[order], np.arange(1, shards)))


def piece_grams(head: str, body: str, ends: bool) -> np.ndarray:
    """The grams of a piece's symbols; a head of less than three characters is
    the text's begin."""
    symbols = symbols_of(head + body)
    begin = len(units_of(head)) if len(head) == ORDER - 1 else 0
    return packed(symbols[begin : None if ends else -1])


def answers(asked: DataFrame, model: DataFrame, salts: int = 1) -> DataFrame:
    """(pile, shard, lps) of ``asked`` (fold, shard, pile, grams): a task holds
    the tables of one shard at a time, and the lists stream past them. Each
    shard has ``salts`` tasks with its tables, which share out the piles."""
    keys = ["fold", "shard", "salt"]
    model = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("pile"), F.lit(salts)).cast("int"))
    entries = model.select(*keys[:2], F.lit(0).alias("later"), "ord", "kind", "code", "value", F.lit(None).cast("long").alias("pile"), F.lit(None).cast("array<bigint>").alias("grams"), "salt")
    lists = asked.select(*keys[:2], F.lit(1).alias("later"), F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("code"), F.lit(None).cast("double").alias("value"), "pile", "grams", "salt")
    both = entries.unionByName(lists).repartition(*keys).sortWithinPartitions(*keys, "later")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap, tables = None, [], None
        for batch in batches:
            fold, shard, later, salt = (batch.column(k).to_numpy() for k in (0, 1, 2, 9))
            number = np.cumsum(np.r_[0, (fold[1:] != fold[:-1]) | (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])])
            for n in range(int(number[-1]) + 1 if len(number) else 0):
                at, to = np.searchsorted(number, [n, n + 1])
                if (fold[at], shard[at], salt[at]) != now:
                    now, heap, tables = (fold[at], shard[at], salt[at]), [], None
                first = at + int(np.searchsorted(later[at:to], 1))
                if first > at:
                    part = batch.slice(at, first - at)
                    heap.append((part.column(3).to_numpy(), part.column(4).to_numpy(zero_copy_only=False) == "p", part.column(5).to_numpy(), part.column(6).to_numpy()))
                if first == to:
                    continue
                if tables is None:
                    tables, heap = Tables(*[np.concatenate(c) for c in zip(*heap)]), []
                part = batch.slice(first, to - first)
                for pile, lists in zip(part.column(7).to_pylist(), part.column(8)):
                    grams = lists.values.to_numpy().view(np.uint64)
                    lps = tables.log_probability(grams).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([pile], pa.int64()), pa.array([now[1]], pa.int32()), pa.array([lps], pa.list_(pa.float32()))], names=["pile", "shard", "lps"])

    return both.mapInArrow(work, "pile bigint, shard int, lps array<float>")


def perplexities(rows: DataFrame, model: DataFrame, size: int = PILE) -> DataFrame:
    """(id, lang, trusted, n_symbols, log_perplexity) of ``rows`` (id, lang,
    trusted, fold, text), fold the model that judges; symbols include the end."""
    shards = max(LEAST_SHARDS, -(-model.count() // SHARD_ENTRIES))
    made = stored_by(pieces(rows, shards, size), "pieces", "pile")  # so that texts need no shuffle to meet their answers
    cut = made.filter("shard IS NULL").drop("fold", "shard", "grams")
    salts = max(1, -(-made.filter("shard = 0").count() // ANSWER_PILES))
    found = answers(made.filter("shard IS NOT NULL").select("fold", "shard", "pile", "grams"), sharded(model, shards), salts)

    def judge(texts: pa.Table, known: pa.Table) -> pa.Table:
        own = []
        for body, *lists in zip(texts["body"], *[texts[c].to_pylist() for c in ("head", "length", "ends")]):
            text, at = zlib.decompress(body.as_py()).decode("utf-8", "surrogatepass"), 0
            for head, length, ends in zip(*lists):
                own.append(piece_grams(head, text[at : at + length], ends))
                at += length
        every = np.concatenate(own)
        distinct, place = np.unique(every, return_inverse=True)
        values = np.zeros(len(distinct))
        lists = {s: v.values.to_numpy() for s, v in zip(known["shard"].to_pylist(), known["lps"])}
        shard = shard_of(distinct >> np.uint64(16) & np.uint64(0xFFFFFFFF), shards)
        for s, lps in lists.items():
            values[shard == s] = lps
        sizes = np.array([len(x) for x in own])
        sums = np.add.reduceat(values[place], np.r_[0, np.cumsum(sizes)[:-1]])
        who = texts["who"].combine_chunks().flatten()
        return pa.table({**dict(zip(("id", "lang", "trusted"), who.flatten())), "row": texts["row"].combine_chunks().flatten(), "total": pa.array(sums, pa.float64()), "n": pa.array(sizes, pa.int64())})

    kind = rows.schema["id"].dataType.simpleString()
    judged = cut.groupBy("pile").cogroup(found.groupBy("pile")).applyInArrow(judge, f"id {kind}, lang string, trusted boolean, row bigint, total double, n bigint")
    sums = judged.groupBy("id", "lang", "trusted", "row").agg(F.sum("n").alias("n_symbols"), (-F.sum("total") / F.sum("n")).alias("log_perplexity"))
    return sums.drop("row")


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, most): by language, and over all for lang null, the quantile of
    the trusted rows' log perplexities, upper end of its histogram step."""
    steps = scored.filter("trusted").select(F.col("lang"), F.ceil(F.col("log_perplexity") / F.lit(STEP)).alias("step"))
    counted = stored(steps.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n")), "histogram")
    both = counted.unionByName(counted.groupBy("step").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string")).select("lang", "step", "n"))
    order = Window.partitionBy("lang").orderBy("step")
    running = both.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    return running.filter(F.col("upto") >= F.col("all") * F.lit(quantile)).groupBy("lang").agg((F.min("step") * F.lit(STEP)).alias("most"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", quantile: float = QUANTILE, size: int = PILE) -> DataFrame:
    """Columns: ``id_col``, lang, n_symbols, perplexity, threshold, kept.
    Trusted rows are those whose largest label is 1."""
    good = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL").groupBy("id").agg(F.max("y").alias("y")).filter("y = 1").select("id", F.lit(True).alias("good"))
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = stored(source.select("id").join(good, "id").select("id").distinct(), "trusted")
    if ids.count() <= 2_000_000:  # at most 16 MB of ids
        ids = F.broadcast(ids)
    rows = source.join(ids.withColumn("good", F.lit(True)), "id", "left")
    rows = rows.select("id", "lang", F.coalesce("good", F.lit(False)).alias("trusted"), F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"), "text")
    having = [r.fold for r in rows.filter("trusted").select("fold").distinct().collect()]  # two at most
    if not having:
        return source.select(F.col("id").alias(id_col), "lang", (F.char_length(F.regexp_replace("text", r"[\x{10000}-\x{10FFFF}]", "xx")) + 1).cast("long").alias("n_symbols"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    if len(having) == 1:
        rows = rows.withColumn("fold", F.lit(having[0]))
    judge = F.col("fold") if len(having) == 1 else 1 - F.col("fold")
    model = fit(rows.filter("trusted").select("fold", "text"))
    scored = stored(perplexities(rows.withColumn("fold", judge), model, size), "perplexities")
    most = stored(thresholds(scored, quantile), "thresholds")
    overall = most.filter("lang IS NULL").first().most
    by_lang = most.filter("lang IS NOT NULL").select(F.col("lang").alias("of"), "most")
    done = scored.join(by_lang, F.col("lang") == F.col("of"), "left").withColumn("limit", F.coalesce("most", F.lit(overall)))
    return done.select(F.col("id").alias(id_col), "lang", "n_symbols", F.round(F.exp("log_perplexity"), 4).alias("perplexity"), F.round(F.exp("limit"), 4).alias("threshold"), (F.col("log_perplexity") <= F.col("limit")).alias("kept"))
