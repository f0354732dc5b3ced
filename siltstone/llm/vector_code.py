"""Compression of vectors to codes of their parts.

Components become integers, and a vector is cut into equal parts. Equal integer
parts of a position are one weighted row: everything after works on these
distinct rows, however often each occurs. A codebook for each position starts as
the parts of the vectors of smallest ids. Each round of weighted Lloyd is one
pass over the distinct rows in Arrow batches: a batch gives count and sum of the
parts at each entry, partial aggregates add them up, and only sums of the size
of the codebooks reach the driver. The last assignment is stored with the
distinct rows and joined back to the vectors' parts: the few parts that make up
a thousandth of their position or more by a broadcast, the others by a shuffle.
A vector's codes then meet as bits of whole numbers, again by partial
aggregates. All arithmetic is of integers and exact.

Defined results: vectors that are null or empty, hold null or non-finite
components, or are of another length than that of smallest id, are left out; a
zero vector is one like others. A length that does not divide is filled with
zeros at its end. Repeated rows, and rows with a null id, are vectors of their
own; null ids come last where ids are ordered, equal ids by their vectors.
Fewer vectors than entries make a smaller codebook. Integers so large that
errors would not fit a long (beyond 2^27 at 64 components) count as that
bound. Ties go to the lower entry; null labels are one label; a label's error
that does not fit a long is null. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, stored

#: Distinct rows that are held against a codebook at once.
CHUNK = 4096


def integers(source: DataFrame, dim: int, parts: int, scale: int) -> DataFrame:
    """(id, label, parts): each part the bytes of its 32-bit integers; narrow."""
    width, bound = -(-dim // parts), math.isqrt((1 << 62) // max(dim, 1)) // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(start, CHUNK)
                x = np.zeros((piece.num_rows, parts * width))
                x[:, :dim] = np.asarray(piece.column(2).flatten(), dtype=np.float64).reshape(-1, dim)
                whole = np.clip(np.floor(x * scale), -bound, bound).astype("<i4")
                cells = pa.array([c.tobytes() for c in whole.reshape(-1, width)], pa.binary())
                offsets = pa.array(np.arange(0, len(cells) + 1, parts, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.ListArray.from_arrays(offsets, cells)], names=["id", "label", "parts"])

    kinds = {c: source.schema[c].dataType.simpleString() for c in ("id", "label")}
    return source.mapInArrow(work, f"id {kinds['id']}, label {kinds['label']}, parts array<binary>")


def nearest_entries(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row; ties to the lower entry."""
    codes, errors = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    for start in range(0, len(values), CHUNK):
        piece = values[start : start + CHUNK]
        away = ((piece[:, None, :] - book[None]) ** 2).sum(2)
        codes[start : start + CHUNK], errors[start : start + CHUNK] = away.argmin(1), away.min(1)
    return codes, errors


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)


def assigned(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """``distinct`` (part, value, n) with ``code`` and ``error``; narrow."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, values = batch.column(0).to_numpy(), matrix(batch.column(1), books.shape[2])
            codes, errors = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for p in np.unique(part):
                own = part == p
                codes[own], errors[own] = nearest_entries(values[own], books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes), pa.array(errors)], names=["part", "value", "n", "code", "error"])

    return distinct.mapInArrow(work, "part int, value binary, n long, code long, error long")


def moved(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: floors of the weighted means; an entry that
    no part is nearest to stays."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, values, n = batch.column(0).to_numpy(), matrix(batch.column(1), books.shape[2]), batch.column(2).to_numpy()
            sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
            for p in np.unique(part):
                own = part == p
                codes, _ = nearest_entries(values[own], books[p])
                np.add.at(sums[p], codes, values[own] * n[own][:, None])
                np.add.at(counts[p], codes, n[own])
            p, e = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["part", "code", "n", "sums"])

    partial = distinct.mapInArrow(work, "part long, code long, n long, sums array<long>")
    each = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(books.shape[2])]
    books = books.copy()
    for r in partial.groupBy("part", "code").agg(F.sum("n").alias("n"), *each).collect():  # a row an entry
        books[r.part, r.code] = [r[f"s{k}"] // r.n for k in range(books.shape[2])]
    return books


def joined_codes(kept: DataFrame, coded: DataFrame, parts: int, total: int) -> DataFrame:
    """(row, code, error) of ``kept`` (row, parts), from ``coded``."""
    cells = kept.select("row", F.posexplode("parts").alias("part", "value"))
    met = hot_join(cells, coded, ["part", "value"], "n", total)
    number = lambda k: F.bit_or(F.when((F.col("part") >= 8 * k) & (F.col("part") < 8 * k + 8), F.expr(f"shiftleft(code, 8 * (7 - (part - {8 * k})))")).otherwise(F.lit(0).cast("long")))
    whole = met.groupBy("row").agg(F.sum("error").alias("error"), *[number(k).alias(f"c{k}") for k in range(-(-parts // 8))])
    digits = F.concat(*[F.substring(F.lower(F.lpad(F.hex(f"c{k}"), 16, "0")), 1, 2 * min(8, parts - 8 * k)) for k in range(-(-parts // 8))])
    return whole.select("row", digits.alias("code"), "error")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, words: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """Columns: ``id_col``, code (two hex digits a part), error, label_error,
    codebooks_sha256. ``words`` is 256 at most."""
    vec = F.col("vec")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    source = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("vec")).filter((F.size(vec) > 0) & F.forall(vec, finite))
    least = source.agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.size(vec).alias("dim"))).alias("least")).first().least
    dim = least.dim if least else 1
    whole = integers(source.filter(F.size(vec) == dim), dim, parts, scale)
    kept = stored(whole.withColumn("row", F.monotonically_increasing_id()), "integers")
    total = kept.count()
    distinct = stored(kept.select(F.posexplode("parts").alias("part", "value")).groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")), "distinct")
    seeds = kept.select("id", "parts").orderBy(F.col("id").asc_nulls_last(), "parts").limit(words).collect()
    width = -(-dim // parts)
    books = np.array([[np.frombuffer(s.parts[p], "<i4") for s in seeds] for p in range(parts)], np.int64).reshape(parts, len(seeds), width)
    for _ in range(rounds if total else 0):
        books = moved(distinct, books)
    coded = stored(assigned(distinct, books), "coded")
    codes = joined_codes(kept.select("row", "parts"), coded, parts, total)
    named = stored(kept.select("row", "id", "label").join(codes, "row").select("id", "label", "code", "error"), "codes")
    labels = stored(named.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.try_sum("error").alias("label_error")), "labels")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return hot_join(named, labels, ["label"], "n", total).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
