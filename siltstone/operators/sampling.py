"""Splits, weights and draws; every draw is a hash of its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import hash_int, hash_uniform
from .ordered import as_of, prefix_sums
from .relational import dense_number
from .shared import stored


def split_rows(df: DataFrame, key: str, parts: dict[str, float], seed: str) -> DataFrame:
    """Adds ``split``: rows in hash order, cut at floors of the shares; the last
    part takes the rest."""
    total = df.count()
    ordered = dense_number(df.withColumn("__h", hash_int(F.col(key), seed)), [F.col("__h"), F.col(key)], "__rn").drop("__h")
    names = list(parts)
    upto, label = 0, F.lit(names[-1])
    bounds = []
    for name in names[:-1]:
        upto += int(total * parts[name])
        bounds.append((upto, name))
    for bound, name in reversed(bounds):
        label = F.when(F.col("__rn") < bound, name).otherwise(label)
    return ordered.withColumn("split", label).drop("__rn")


def split_clusters(df: DataFrame, cluster: str, parts: dict[str, float], seed: str) -> DataFrame:
    """Adds ``split`` by cluster, so that no cluster is in two parts."""
    return df.join(split_rows(df.select(cluster).distinct(), cluster, parts, seed), cluster)


def sampling_weight(kind: Column, counts: dict[str, Column], alpha: dict[str, float], beta: dict[str, float], cluster_size: Column, copies: Column, eps: float = 1e-9) -> Column:
    """beta[kind] * sum(alpha * count) / (cluster size + eps) / copies."""
    scale = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in beta.items()], F.lit(0.0))
    total = sum((F.lit(alpha[k]) * c for k, c in counts.items()), F.lit(0.0))
    return scale * total / (cluster_size + F.lit(eps)) / copies


def mixture_weights(df: DataFrame, dataset: str, weight: str, shares: dict[str, float]) -> DataFrame:
    """Each dataset's weights rescaled to its share."""
    sums = df.groupBy(dataset).agg(F.sum(weight).alias("__sum"))
    share = F.coalesce(*[F.when(F.col(dataset) == k, F.lit(v)) for k, v in shares.items()], F.lit(0.0))
    return df.join(sums, dataset).withColumn("mixed", F.col(weight) * share / F.col("__sum")).drop("__sum")


def weighted_topn(df: DataFrame, key: str, weight: Column, n: int, seed: str) -> DataFrame:
    """``n`` rows without replacement, each step by weight: the smallest
    exponential keys -ln(u) / w."""
    u = (hash_int(F.col(key), seed) + 1) / F.lit(4294967297.0)
    return df.withColumn("draw", -F.log(u) / weight).filter(weight > 0).orderBy("draw", key).limit(n)


def draw_with_replacement(df: DataFrame, key: str, weight: Column, n: int, seed: int, epoch: int = 0, replicas: int = 1, scale: float = 1.0) -> DataFrame:
    """(draw, replica, step, ``key``): ``n`` draws of rows by weight, each from
    all rows; draw i is step i div ``replicas`` of replica i mod ``replicas``.

    Weights count in whole units of 1 / ``scale``; null and smaller ones are
    never drawn, and keys are unique. A draw is a hash of seed, epoch and its
    number, taken as a place among all units, so any partitioning gives the same.
    Rows' first units are exact distributed prefix sums, and each draw finds its
    row by one range sort of both, however large one row's weight is."""
    units = df.select(key, F.round(weight * F.lit(scale)).cast("long").alias("units")).filter("units > 0")
    starts = stored(prefix_sums(units, [F.col(key)], "units", "at"), "starts")
    whole = starts.agg(F.sum("units")).first()[0]
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("draw"), F.lit(seed), F.lit(epoch), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")
    draws = df.sparkSession.range(n if whole else 0).select(F.col("id").alias("draw"), (hashed % F.lit(whole or 1)).alias("at"))
    found = as_of(draws, starts, "at", F.struct("at", key))
    return found.select("draw", (F.col("draw") % replicas).alias("replica"), F.expr(f"draw div {replicas}").alias("step"), F.col(f"mark.{key}").alias(key))


def keep_probability(length: Column, cluster_size: Column) -> Column:
    return F.least(F.greatest(length, F.lit(256)), F.lit(512)) / F.lit(512.0) / cluster_size


def choose(key: Column, shares: dict[str, float], seed: str) -> Column:
    """One of ``shares`` by its weight, from the key's hash."""
    u, upto, names = hash_uniform(key, seed), 0.0, list(shares)
    out = F.lit(names[-1])
    bounds = []
    for name in names[:-1]:
        upto += shares[name]
        bounds.append((upto, name))
    for bound, name in reversed(bounds):
        out = F.when(u < bound, name).otherwise(out)
    return out


def offset_ids(df: DataFrame, key: str, base: DataFrame, base_id: str) -> DataFrame:
    """Adds ``new_id``: the rank of each distinct key above ``base``'s largest id."""
    from .relational import dense_ids

    top = base.agg(F.coalesce(F.max(base_id), F.lit(0))).first()[0]
    return dense_ids(df, [key], "new_id", int(top) + 1)


def similar_replacement(failed: DataFrame, good: DataFrame, key: str, size: str, band: int) -> DataFrame:
    """For each failed row the good row of nearest size within ``band`` (the
    smaller key on ties), else null. Sizes are cut into cells of the band's
    width, so candidates meet in an equi-join."""
    a = failed.select(F.col(key).alias("failed"), F.col(size).alias("failed_size"), F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.floor(F.col(size) / band) + d)).alias("cell"))
    b = good.select(F.col(key).alias("other"), F.col(size).alias("other_size"), F.floor(F.col(size) / band).alias("cell"))
    near = a.join(b, "cell").filter(F.abs(F.col("failed_size") - F.col("other_size")) <= band)
    best = near.groupBy("failed").agg(F.min_by("other", F.struct(F.abs(F.col("failed_size") - F.col("other_size")), F.col("other"))).alias("replacement"))
    return failed.select(F.col(key).alias("failed"), F.col(size).alias("failed_size")).join(best, "failed", "left")


def within_index(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
