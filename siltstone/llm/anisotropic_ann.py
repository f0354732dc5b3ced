"""Nearest neighbours by score-aware anisotropic quantisation.

Vectors are cut into two-component parts and each part is replaced by one of 16
codewords, so a vector is four bits a part. Codewords and assignments minimise
an anisotropic loss: the residual's share parallel to the vector weighs
``eta`` times its orthogonal share, since it is the parallel error that moves
the largest inner products. Codebooks are fitted on a bounded sample (the
``SAMPLE`` vectors of smallest hash); every row is indexed.

The index is made once and stored: for each row its packed codes, two parts a
byte, its length and its vector, dealt by number into groups of bounded size.
Queries, one for each id, are numbered into chunks of bounded size and stored
likewise. Rows go to groups by their place, so repeated ids spread. Each group
meets each chunk in a task of its own, by one shuffle, so nothing goes to the
driver and nothing is broadcast, and a task's memory does not grow with the
input: a table of 256 scores for each byte and query is summed over the codes,
the best ``rerank`` of a block and query, and all that tie with the last of
them, are scored exactly in double precision on the original vectors, and a
task keeps its ``k`` best for each query. A last window ranks them. The scan is
of all queries and rows and so quadratic by meaning.

What is shuffled, a row for each chunk, a query and its ``k`` finds for each
group, shrinks as chunks and groups grow; their bounds are what a task's memory
allows (some 40 MB of rows and 100 MB of queries at 64 components). Vectors
travel with the codes and candidates meet them in the task. With codes alone
every candidate would be sent to its vector, some 24 bytes each; a query's
share of a group's vectors is 512 bytes, and it has ``rerank`` candidates in
each block.

Defined results: vectors that are null, empty, zero, of another length than the
query of smallest id, or that hold null or non-finite components, and null ids,
take no part; ties go to the smaller id. Rows that share an id are one
candidate, with the best of their scores, and one query, with the least of
their vectors; fewer candidates than ``k`` give fewer rows; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import dense_number
from .common import stored
from .embedding_dedup import usable

#: Vectors that codebooks are fitted on, at most.
SAMPLE = 20_000
#: Rows of a group of the index, at most.
GROUP = 131_072
#: A table of so many groups (16 bytes each) is broadcast.
BROADCAST_GROUPS = 200_000
#: Queries of a chunk, at most.
QUERY_CHUNK = 65_536
#: Rows of a block that are scored together.
BLOCK = 4096
WORDS = 16


def eta_for(dim: int, threshold: float) -> float:
    """Weight of the parallel against the orthogonal error for scores above
    ``threshold`` times the query's length."""
    return (dim - 1) * threshold**2 / (1 - threshold**2)


def anisotropic_assign(x: np.ndarray, books: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """Codes (rows x parts) by coordinate descent on the whole vector's loss
    |r|^2 + (eta - 1) <r, x>^2, r the residual of the unit vector x."""
    n, parts = len(x), len(books)
    cut = x.reshape(n, parts, -1)
    distance = ((cut[:, :, None, :] - books[None]) ** 2).sum(3)  # n x parts x words
    inner = (cut[:, :, None, :] * books[None]).sum(3)
    codes = distance.argmin(2)
    rows = np.arange(n)
    own = (cut * cut).sum(2)
    along = own.sum(1) - np.take_along_axis(inner, codes[:, :, None], 2)[:, :, 0].sum(1)  # <r, x>
    for _ in range(rounds):
        for p in range(parts):
            rest = along + inner[rows, p, codes[:, p]]
            loss = distance[:, p] + (eta - 1) * (rest[:, None] - inner[:, p]) ** 2
            codes[:, p] = loss.argmin(1)
            along = rest - inner[rows, p, codes[:, p]]
    return codes.astype(np.uint8)


def fit_codebooks(x: np.ndarray, eta: float, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Alternate anisotropic assignment and the weighted least squares of each
    part's codewords. ``x``: unit vectors."""
    n, dim = x.shape
    parts = -(-dim // 2)
    if dim % 2:
        x = np.c_[x, np.zeros(n)]
    cut = x.reshape(n, parts, 2)
    draw = np.random.default_rng(seed)
    books = np.stack([cut[draw.choice(n, WORDS, replace=n < WORDS), p] for p in range(parts)])
    for _ in range(rounds):
        codes = anisotropic_assign(x, books, eta)
        chosen = np.stack([books[p][codes[:, p]] for p in range(parts)], 1)
        along = ((cut - chosen) * cut).sum((1, 2))
        for p in range(parts):
            part = cut[:, p]
            rest = along + (chosen[:, p] * part).sum(1)  # <r, x> with this part's word taken out
            for w in range(WORDS):
                own = codes[:, p] == w
                if own.any():
                    a = part[own]
                    left = own.sum() * np.eye(2) + (eta - 1) * a.T @ a
                    books[p, w] = np.linalg.solve(left, a.sum(0) + (eta - 1) * (a * rest[own][:, None]).sum(0))
            fresh = books[p][codes[:, p]]
            along = rest - (fresh * part).sum(1)
            chosen[:, p] = fresh
    return books


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _lengths(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    return scale[:, 0] * np.sqrt(((x / scale) ** 2).sum(1))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    rerank: int = 64,
    threshold: float = 0.2,
) -> DataFrame:
    """Columns: query_id, rank (from 1), ``id_col``'s value as vec_id, score.

    ``is_query`` picks the queries among the rows; candidates are all other
    rows. The score is the cosine of the original vectors."""
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q")).filter(F.col("id").isNotNull() & usable("vec"))
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    first = source.filter("q").select(F.size("vec").alias("dim"), "id").agg(F.min_by("dim", "id")).first()
    if first is None or first[0] is None:
        return spark.createDataFrame([], schema)
    dim = first[0]
    source = source.filter(F.size("vec") == dim)
    queries = source.filter("q").groupBy("id").agg(F.min("vec").alias("vec"))
    queries = stored(dense_number(queries, [F.col("id")], "at").select("id", "vec", F.floor(F.col("at") / QUERY_CHUNK).alias("chunk")), "queries")
    sample = np.array([r.vec for r in source.select("id", "vec").orderBy(F.xxhash64("id"), "id", "vec").limit(SAMPLE).collect()], dtype=np.float64)
    eta = eta_for(dim, threshold)
    books = fit_codebooks(sample / _lengths(sample)[:, None], eta)
    index = stored(encoded(source.select("id", "vec"), dim, books, eta), "index")
    names = stored(dense_number(index.select("dealt").distinct(), [F.col("dealt")], "group"), "groups")  # a row a group
    groups, chunks = names.count(), queries.agg(F.max("chunk")).first()[0] + 1
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = index.join(F.broadcast(names) if groups <= BROADCAST_GROUPS else names, "dealt").withColumn("chunk", upto(chunks))
    asked = queries.withColumn("group", upto(groups))
    keys = ["group", "chunk"]
    found = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_scan(dim, books, k, rerank), "query_id bigint, vec_id bigint, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes of four bits a byte."""
    if codes.shape[1] % 2:
        codes = np.c_[codes, np.zeros(len(codes), np.uint8)]
    return (codes[:, 0::2] << 4 | codes[:, 1::2]).astype(np.uint8)


def encoded(source: DataFrame, dim: int, books: np.ndarray, eta: float) -> DataFrame:
    """(dealt, id, codes, length, vec) of (id, vec), ``dealt`` the group of at
    most ``GROUP`` rows, whatever their ids; narrow."""
    group = GROUP

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, read = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                dealt = task + np.arange(read, read + part.num_rows) // group
                read += part.num_rows
                x = _matrix(part.column(1), dim)
                length = _lengths(x)
                unit = x / length[:, None]
                codes = packed(anisotropic_assign(np.c_[unit, np.zeros(len(unit))] if dim % 2 else unit, books, eta))
                yield pa.RecordBatch.from_arrays([pa.array(dealt), part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), part.column(1)], names=["dealt", "id", "codes", "length", "vec"])

    return source.mapInArrow(work, f"dealt bigint, id bigint, codes binary, length double, vec {source.schema['vec'].dataType.simpleString()}")


def _scan(dim: int, books: np.ndarray, k: int, rerank: int):
    def work(asked: pa.Table, rows: pa.Table) -> pa.Table:
        kinds = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
        if not asked.num_rows or not rows.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in kinds})
        number = asked["id"].to_numpy()
        q = _matrix(asked["vec"].combine_chunks(), dim)
        long = _lengths(q)
        turned = q / long[:, None]
        if dim % 2:
            turned = np.c_[turned, np.zeros(len(q))]
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
        for batch in rows.select(["id", "codes", "length", "vec"]).to_batches(BLOCK):
            ids, length = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            codes = np.stack([np.frombuffer(c.as_py(), np.uint8) for c in batch.column(1)])
            x = _matrix(batch.column(3), dim)
            for start in range(0, len(q), 256):
                table = _byte_table(turned[start : start + 256], books)
                rough = np.zeros((len(table), len(x)), np.float32)
                for p in range(codes.shape[1]):
                    rough += table[:, p][:, codes[:, p]]
                rough[number[start : start + 256][:, None] == ids[None, :]] = -np.inf
                take = min(rerank, len(x))
                floor = np.partition(rough, len(x) - take, axis=1)[:, len(x) - take]
                for n in range(len(table)):
                    near = np.flatnonzero((rough[n] >= floor[n]) & (rough[n] > -np.inf))
                    if len(near):
                        m = start + n
                        score = (x[near] @ q[m]) / (length[near] * long[m])
                        best[m] = _best(np.r_[best[m][0], score], np.r_[best[m][1], ids[near]], k)
        counts = [len(b[0]) for b in best]
        columns = [np.repeat(number, counts), np.concatenate([b[1] for b in best]), np.concatenate([b[0] for b in best])]
        return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds, columns)})

    return work


def _byte_table(turned: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Scores of each query, byte of codes and value of that byte."""
    table = np.einsum("npc,pwc->npw", turned.reshape(len(turned), len(books), 2), books).astype(np.float32)
    if table.shape[1] % 2:
        table = np.concatenate([table, np.zeros_like(table[:, :1])], axis=1)
    both = table[:, 0::2, :, None] + table[:, 1::2, None, :]
    return np.ascontiguousarray(both.reshape(len(turned), -1, WORDS * WORDS))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of distinct ids, ties to the smaller id."""
    order = np.lexsort((ids, -score))
    score, ids = score[order], ids[order]
    top = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return score[top], ids[top]
