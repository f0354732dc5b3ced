"""Ordered operators: islands, caps, buckets and batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import dense_number
from .shared import stored


def islands(df: DataFrame, keys: list[str], order: list[Column], value: Column) -> DataFrame:
    """Adds ``island``: the number, from 1, of each run of equal values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(value) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__change", change).withColumn("island", F.sum("__change").over(w)).drop("__change")


def cap_by_family(df: DataFrame, family: Column, caps: dict[str, int], cluster: str, order: list[Column]) -> DataFrame:
    """At most ``caps[family]`` rows of each cluster; other families are whole."""
    marked = df.withColumn("__family", family)
    rank = F.row_number().over(Window.partitionBy("__family", cluster).orderBy(*order))
    limit = F.coalesce(*[F.when(F.col("__family") == f, F.lit(n)) for f, n in caps.items()])
    return marked.withColumn("__rank", rank).filter(limit.isNull() | (F.col("__rank") <= limit)).drop("__family", "__rank")


def length_buckets(df: DataFrame, length: str, spread: int = 100) -> DataFrame:
    """Adds ``bucket``, from 0: lengths in order, a new bucket where the length
    exceeds the bucket's smallest by more than ``spread``.

    The state is sequential, so it runs once over the distinct lengths, whose
    number is bounded by the longest row, and joins back."""
    distinct = df.select(F.col(length).cast("long").alias(length)).distinct()

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(length, ignore_index=True)
        bucket, anchor, out = -1, None, []
        for x in pdf[length]:
            if anchor is None or x - anchor > spread:
                bucket, anchor = bucket + 1, x
            out.append(bucket)
        return pd.DataFrame({length: pdf[length], "bucket": out})

    table = distinct.withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(walk, f"`{length}` long, bucket long")
    return df.join(table, length)


def batch_assign(df: DataFrame, bucket: str, length: str, order: list[Column], most: int, budget: int, replicas: int) -> DataFrame:
    """Adds ``batch``, ``replica`` within each bucket; rows beyond the last full
    batch of all replicas are dropped. Places within a bucket come from one
    numbering of all rows, so a large bucket is not one task's."""
    numbered = dense_number(df, [F.col(bucket), *order], "__at")
    of = df.groupBy(F.col(bucket).alias("__bucket")).agg(F.count(F.lit(1)).alias("__n"), F.max(length).alias("__longest"))
    first = numbered.groupBy(F.col(bucket).alias("__bucket")).agg(F.min("__at").alias("__first"))
    size = F.least(F.lit(most), F.floor(F.lit(budget) / (F.col("__longest") * F.col("__longest"))) + 1).cast("long")
    # a row a bucket, whose number the longest row bounds
    known = of.join(first, "__bucket").withColumn("__size", size).drop("__longest")
    sized = numbered.join(known, F.col(bucket) == F.col("__bucket")).withColumn("__rn", F.col("__at") - F.col("__first"))
    full = F.floor(F.col("__n") / (F.col("__size") * replicas)) * F.col("__size") * replicas
    return (
        sized.filter(F.col("__rn") < full)
        .withColumn("batch", F.floor(F.col("__rn") / (F.col("__size") * replicas)).cast("long"))
        .withColumn("replica", (F.floor(F.col("__rn") / F.col("__size")) % replicas).cast("long"))
        .drop("__size", "__n", "__rn", "__at", "__first", "__bucket")
    )


def balanced_assign(df: DataFrame, key: str, value: str, workers: int) -> DataFrame:
    """(key, value, worker): largest first to the worker of least squared load
    among those below the count cap; what is left over goes round robin.

    One order over all rows is the operator's meaning; rows stream through one
    task in that order with a state of ``workers`` numbers."""
    total = df.count()
    cap = total // workers

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load, count, spare = [0.0] * workers, [0] * workers, 0
        for pdf in batches:
            out = []
            for v in pdf[value]:
                open_ = [k for k in range(workers) if count[k] < cap]
                if open_:
                    w = min(open_, key=lambda k: (load[k], k))
                    load[w] += float(v) ** 2
                    count[w] += 1
                else:
                    w, spare = spare % workers, spare + 1
                out.append(w)
            yield pd.DataFrame({key: pdf[key], value: pdf[value], "worker": out})

    ordered = df.select(F.col(key).cast("long").alias(key), F.col(value).cast("long").alias(value)).orderBy(F.desc(value), key).coalesce(1)
    return ordered.mapInPandas(walk, f"`{key}` long, `{value}` long, worker long")


def running_quota(df: DataFrame, keys: list[str], order: list[Column], amount: str, quota: float) -> DataFrame:
    """Rows while the running sum of ``amount`` stays within ``quota``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(amount).over(w)).filter(F.col("running") <= quota)


def placed_by(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` stored in a total order, with ``__part`` and ``__place``: the range
    partition a row is in, and a number that grows along all rows."""
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()), name)
    return placed.withColumn("__part", F.shiftright("__place", 33))


def prefix_sums(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before, in a total
    order and without one task for all rows: sums within range partitions, and
    those of the partitions before by a broadcast of a row a partition."""
    placed = placed_by(df, order, "prefix")
    sums = placed.groupBy(F.col("__part").alias("__of")).agg(F.sum(value).alias("__sum"))
    before = sums.select("__of", F.coalesce(F.sum("__sum").over(Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(before), F.col("__part") == F.col("__of"))
    return joined.withColumn(name, F.col("__before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__part", "__place", "__of", "__before")


def as_of(asked: DataFrame, marks: DataFrame, on: str, mark: Column) -> DataFrame:
    """``asked`` with ``mark`` of the last row of ``marks`` at or below it in
    ``on``, null where there is none. ``mark`` must grow with ``on``. One range
    sort of both; what reaches into a partition comes by one row a partition."""
    sought = asked.select(F.col(on).alias("on"), F.lit(1).alias("kind"), F.struct(*[F.col(f"`{c}`") for c in asked.columns]).alias("asked"))
    both = marks.select(F.col(on).alias("on"), F.lit(0).alias("kind"), mark.alias("mark")).unionByName(sought, allowMissingColumns=True)
    placed = placed_by(both, [F.col("on").asc_nulls_first(), F.col("kind")], "as-of")
    tops = placed.groupBy(F.col("__part").alias("of")).agg(F.max("mark").alias("top"))
    before = tops.select("of", F.max("top").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    so_far = F.max("mark").over(Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0))
    found = placed.withColumn("here", so_far).filter("kind = 1").join(F.broadcast(before), F.col("__part") == F.col("of"))
    return found.select("asked.*", F.coalesce("here", "before").alias("mark"))
