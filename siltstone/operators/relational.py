"""Filters, joins, set operators and ranking as ``DataFrame -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

Transform = Callable[[DataFrame], DataFrame]


def pipeline(*steps: Transform) -> Transform:
    """The steps one after another; an empty input stays empty, and adaptive
    execution drops what would run on it."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


def bound(step: Callable[..., DataFrame], *args, **kwargs) -> Transform:
    """A transform of ``step`` with all arguments but the table given."""
    return lambda df: step(df, *args, **kwargs)


def each_variant(df: DataFrame, step: Callable[[DataFrame, int], DataFrame], variants: int, name: str = "variant") -> DataFrame:
    """The rows of ``step(df, k)`` for each of a few variants k, marked ``name``:
    a union, so that the variants run side by side."""
    return union_all(*[step(df, k).withColumn(name, F.lit(k)) for k in range(variants)])


def null_tokens(df: DataFrame, columns: list[str], tokens: list[str]) -> DataFrame:
    """Strings among ``tokens`` become null."""
    return df.withColumns({c: F.when(~F.col(c).isin(tokens), F.col(c)) for c in columns})


def keep_unknown_or_below(df: DataFrame, column: str, cutoff: float) -> DataFrame:
    """Rows whose value is unknown or at most ``cutoff``."""
    return df.filter(F.col(column).isNull() | (F.col(column) <= cutoff))


def rejects(df: DataFrame, reason: Column) -> DataFrame:
    """Rows and reasons per reason; null is a row that passes."""
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def semi_list(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    return df.join(values.select(F.col(values.columns[0]).alias(column)).distinct(), column, "left_semi")


def anti_tuple(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows whose tuple is not listed; a null never matches."""
    return df.join(excluded, list(excluded.columns), "left_anti")


def lookup(df: DataFrame, dim: DataFrame, on: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join with a unique-keyed table, with defaults for what it lacks."""
    return df.join(dim, on, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def first_seen(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """At most ``n`` rows of each key; plans a group limit before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def dense_number(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in a total order without one task for all rows.

    Rows are range-partitioned by the order, sorted and stored once with their
    partition and their place in it; both the counts and the numbers are read
    from that table, so that they cannot be of two different partitionings. The
    one exchange is the range exchange; each partition's offset, the rows of the
    partitions before it, comes by a broadcast of a row a partition."""
    place = F.monotonically_increasing_id()
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", place), "numbered")
    placed = placed.withColumn("__part", F.shiftright("__place", 33)).withColumn("__local", F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row for each partition
    offsets = counts.select(F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    return placed.join(F.broadcast(offsets), F.col("__part") == F.col("__of")).withColumn(name, (F.col("__local") + F.col("__offset") + start).cast("long")).drop("__place", "__part", "__local", "__of", "__offset")


def dense_ids(df: DataFrame, keys: list[str], name: str, start: int = 0) -> DataFrame:
    """Dense number of each distinct key in sorted order: the distinct keys are
    numbered and joined back, so no task sees all rows."""
    distinct = dense_number(df.select(*keys).distinct(), [F.col(k) for k in keys], name, start)
    renamed = distinct.select(*[F.col(k).alias(f"__{k}") for k in keys], name)
    return df.join(renamed, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).drop(*[f"__{k}" for k in keys])


def groups_where(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Rows of the groups whose aggregate ``condition`` holds."""
    good = df.groupBy(*keys).agg(condition.alias("__ok")).filter("__ok").drop("__ok")
    return df.join(good, keys, "left_semi")


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def nearest_key(df: DataFrame, key: str, value: str, wanted: float) -> DataFrame:
    """The value at the key nearest to ``wanted``, the smaller on ties."""
    order = F.struct(F.abs(F.col(key) - wanted), F.col(key))
    return df.agg(F.min_by(key, order).alias(key), F.min_by(value, order).alias(value))


def mode_first(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """Most frequent value of each group; the first seen on ties."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))
