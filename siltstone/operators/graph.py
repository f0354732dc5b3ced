"""Connected components and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import TASK_ROWS, by_shuffle, dealt, drop_stored, stored


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable, itself included.

    ``nodes`` has one column; ``edges`` has two. Labels move to the smaller
    label across edges and then to their label's label, which halves chains;
    minima are partial aggregates, and the edges of a hub are dealt to as many
    tasks as they want, each with the hub's label."""
    a, b = edges.columns
    pairs = stored(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")), "pairs")
    one = stored(dealt(pairs, pairs.count(), "a", "b").distinct(), "edges")
    drop_stored(pairs)
    both, size = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))), 2 * one.count()
    # hubs are no more than the edges' share of a task's rows
    hubs = stored(both.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TASK_ROWS).select("b", F.ceil(F.col("n") / TASK_ROWS).alias("parts")), "hubs")
    parts = F.coalesce("parts", F.lit(1))
    both = both.join(F.broadcast(hubs), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), parts).alias("part"))
    listed = stored(nodes.select(F.col(nodes.columns[0]).alias("node")), "nodes")
    now = stored(dealt(listed, listed.count(), "node").distinct().select("node", F.col("node").alias("component")), "labels")
    drop_stored(listed)
    seen = None
    for _ in range(max_rounds):
        said = now.join(F.broadcast(hubs.withColumnRenamed("b", "node")), "node", "left").select(F.col("node").alias("b"), "component", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        near = dealt(both, size, "b", "part").join(by_shuffle(dealt(said, size, "b", "part")), ["b", "part"]).groupBy("a").agg(F.min("component").alias("low"))
        moved = stored(now.join(by_shuffle(near), now["node"] == near["a"], "left").select("node", F.least("component", F.coalesce("low", "component")).alias("component")), "labels")
        jump = moved.select(F.col("node").alias("of"), F.col("component").alias("next"))
        after = stored(moved.join(by_shuffle(jump), moved["component"] == jump["of"], "left").select("node", F.least("component", F.coalesce("next", "component")).alias("component")), "labels")
        state = after.agg(F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()
        drop_stored(now)
        drop_stored(moved)
        now = after
        if state == seen:
            drop_stored(one)
            drop_stored(hubs)
            return now
        seen = state
    raise RuntimeError("components did not settle")


def representatives(labelled: DataFrame, node: str, component: str, size: str) -> DataFrame:
    """Largest member of each component; the smallest id on ties."""
    return labelled.groupBy(component).agg(F.max_by(node, F.struct(size, -F.col(node))).alias(node), F.count(F.lit(1)).alias("members"))
