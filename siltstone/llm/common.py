"""Shared plumbing: hot-bucket splitting, joins of hot keys and connected
components; stored tables come from :mod:`siltstone.operators.shared`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import drop_stored, shared_path, stored  # noqa: F401

#: A bucket with more members than this is compared block against block.
BUCKET_BLOCK = 4096
#: A table of large buckets up to so many rows (about 32 bytes each) is broadcast.
BROADCAST_BUCKETS = 200_000
#: A key of so large a share of all rows is joined by broadcast.
HEAVY_SHARE = 1 / 1000


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, a stored table of unique keys
    ``on`` (null equals null) that has each key's number of rows in ``count``.

    Keys of a ``HEAVY_SHARE`` of ``total`` rows or more meet by a broadcast: at
    most 1 / HEAVY_SHARE of them for each time a key has ``total`` rows to share
    (each part of a vector, say). The others meet by a shuffle."""
    names = [c for c in table.columns if c not in (*on, count)]
    known = table.select(*[F.col(c).alias(f"__{c}") for c in on], F.struct(*names).alias("__found"), F.col(count).alias("__n"))
    equal = lambda: [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]
    drop = [*[f"__{c}" for c in on], "__n"]
    met = rows.join(F.broadcast(known.filter(F.col("__n") >= total * HEAVY_SHARE)), equal(), "left").drop(*drop)
    light = known.filter(F.col("__n") < total * HEAVY_SHARE)
    rest = met.filter("__found IS NULL").drop("__found").join(light, equal()).drop(*drop)
    return met.filter("__found IS NOT NULL").unionByName(rest).select(*rows.columns, "__found.*")


def bucket_blocks(rows: DataFrame, keys: list[str], spread: str, block: int = BUCKET_BLOCK) -> DataFrame:
    """Deal the members of each bucket so that no task holds an unbounded one.

    ``rows`` has one row for each member and bucket. A bucket of at most
    ``block`` members stays whole (``lo = hi = own = 0``). A larger one is cut
    into ``k`` blocks by a hash of ``spread``; each member goes to the ``k``
    block pairs (lo, hi) that contain its own block, so each two members still
    meet in exactly one pair of blocks, or in (own, own) if they share one.
    """
    sizes = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > block), "large-buckets")
    if sizes.count() <= BROADCAST_BUCKETS:
        sizes = F.broadcast(sizes)
    k = F.ceil(F.col("__n") / F.lit(float(block))).cast("int")
    own = F.when(F.col("__n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.col(spread), F.lit(17)), k).cast("int"))
    other = F.when(F.col("__n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), k - 1))
    dealt = rows.join(sizes, keys, "left").withColumn("own", own).withColumn("__other", F.explode(other))
    return dealt.withColumn("lo", F.least("own", "__other")).withColumn("hi", F.greatest("own", "__other")).drop("__n", "__other")


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable, for each node of an undirected edge list.

    ``edges`` has long columns ``a`` and ``b``. Returns (node, root), one row
    for each node that has an edge; a node without edges is its own root and is
    not listed. Alternates large-star and small-star steps, whose minima are
    partial aggregates and never gather a neighbourhood, and stores each round
    in the shared folder. Nulls and self-loops are ignored.
    """
    now = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(),
        name,
    )
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        after = stored(small, name)
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stored(now)
        now = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    own = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(own)
