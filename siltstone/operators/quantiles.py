"""Exact order statistics of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A sketch's rank error is at most a group's rows over this.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(keys, one column for each of ``wanted``): quantiles interpolated between
    neighbours, nulls skipped.

    A mergeable sketch brackets each quantile; the rows below the bracket are
    counted, and only the values within, some 8 / ACCURACY of a group and each
    with its count, are ranked. Groups of up to 2 * ACCURACY rows are ranked
    whole. So no large group's values meet in one task."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    margin = 4 / ACCURACY  # the sketch's error, and some ranks more in a group of 2 * ACCURACY rows
    names, at = list(wanted), list(wanted.values())
    low = F.percentile_approx("__v", [max(q - margin, 0.0) for q in at], ACCURACY)
    high = F.percentile_approx("__v", [min(q + margin, 1.0) for q in at], ACCURACY)
    bracket = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), low.alias("__low"), high.alias("__high"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    each = F.transform(
        F.sequence(F.lit(0), F.lit(len(at) - 1)),
        lambda k: F.struct(
            k.alias("k"),
            F.when((F.col("__n") <= 2 * ACCURACY) | (F.get(F.lit(at), k) <= margin), F.col("__min")).otherwise(F.get("__low", k)).alias("low"),
            F.when((F.col("__n") <= 2 * ACCURACY) | (F.get(F.lit(at), k) >= 1 - margin), F.col("__max")).otherwise(F.get("__high", k)).alias("high"),
            (F.get(F.lit(at), k) * (F.col("__n") - 1)).alias("rank"),
        ),
    )
    spans = bracket.select(*[F.col(k).alias(f"__{k}") for k in keys], F.explode(each).alias("__s"))
    same = [rows[k].eqNullSafe(F.col(f"__{k}")) for k in keys] or [F.lit(True)]
    near = rows.join(spans, same).filter(F.col("__v") <= F.col("__s.high"))
    inside = F.when(F.col("__v") >= F.col("__s.low"), F.col("__v"))
    counted = near.groupBy(*keys, "__s", inside.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))  # null: all rows below the bracket
    order = Window.partitionBy(*keys, "__s").orderBy(F.col("__v").asc_nulls_first())
    ranked = counted.withColumn("__upto", F.sum("__c").over(order))
    first, second = F.floor("__s.rank"), F.ceil("__s.rank")
    pick = lambda r: F.min(F.when((F.col("__upto") > r) & F.col("__v").isNotNull(), F.col("__v")))
    found = ranked.groupBy(*keys, "__s").agg(pick(first).alias("__a"), pick(second).alias("__b"))
    found = found.withColumn("__q", F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__s.rank") - F.floor("__s.rank")))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__s.k") == k, F.col("__q"))).alias(n) for k, n in enumerate(names)])
