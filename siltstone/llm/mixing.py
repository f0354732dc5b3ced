"""Mixing sources to target weights by iterative proportional fitting.

Native: only DataFrame and SQL functions. One narrow pass counts tokens; a
partial aggregate gives the tokens of each (source, language, topic) cell, and
everything after works on cells. Each round rakes the cell weights to the
source, then the language, then the topic marginal: sum by value and scale to
the target, by windows over the cells of a value; a few rounds make one job,
stored in the shared folder. Few cells stay in one partition, so that they are
not shuffled; beyond, sums are partial aggregates joined back, as a value may
have a large share of all cells. Rounds end when no weight moves by more than
``TOLERANCE`` in a round, when every marginal is that near its target, or after
``MOST_ROUNDS``; the largest relative distance of a marginal from its target is
returned as ``residual``. Targets that no weights meet leave one above the
tolerance, and so do targets met only in the limit, by weights that tend to
zero: there n rounds leave a distance of about 1 / n. A document's probability is its cell's calibrated weight
over its tokens, times the factor that makes the expected sampled tokens the
wanted share; where that would exceed one, the cell is taken whole and the rest
is scaled again, until no more cells are full. A document is sampled if the
uniform hash of its id falls below its probability, so a sample is the same
under any partitioning.

Defined results: a null text has no tokens; null marginal values form a value
of their own, the empty string; a value without a target keeps its share of
the tokens, and targets are scaled to sum to one over the values that occur;
rows without tokens belong to their cell like others; repeated rows, and rows
without an id, are sampled alike; a probability equal to the hash leaves the
row out; very long texts are counted whole; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

DIMENSIONS = ("source", "lang", "topic")
#: Rounds end when no weight moves by a larger share in one.
TOLERANCE = 1e-11
#: Rounds of a job, and the most rounds.
JOB_ROUNDS, MOST_ROUNDS = 6, 360
#: A table of cells up to so many rows is broadcast to the documents.
BROADCAST_CELLS = 50_000


def tokens_of(text: Column) -> Column:
    """Blank-separated tokens, counted by their blanks; 0 for an empty text."""
    body = F.coalesce(text, F.lit(""))
    return F.when(body == "", F.lit(0)).otherwise(F.char_length(body) - F.char_length(F.replace(body, F.lit(" "), F.lit(""))) + 1).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from marks in the text: table, code, contact or prose."""
    body = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(body, F.lit(" | ")), "table")
        .when(F.contains(body, F.lit("=")) | F.contains(body, F.lit("{")), "code")
        .when(F.contains(body, F.lit("@")), "contact")
        .otherwise("prose")
    )


def uniform(key: Column, seed: str) -> Column:
    """In [0, 1), from the first 32 bits of md5(seed || key)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def tempered_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, share): the observed shares raised to ``power`` and rescaled."""
    by_value = cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("raw"))
    return by_value.select("value", F.col("raw").alias("share"))


def goals_of(cells: DataFrame, targets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """For each dimension (value, goal): the tokens that each value shall have."""
    whole = cells.agg(F.sum("tokens")).first()[0] or 0.0
    goals = {}
    for d in targets:
        own = cells.groupBy(F.col(d).alias("value")).agg((F.sum("tokens") / F.lit(float(whole) or 1.0)).alias("observed"))
        joined = own.join(targets[d].select("value", "share"), "value", "left")
        sums = joined.agg(F.sum("share"), F.sum(F.when(F.col("share").isNull(), F.col("observed")))).first()
        scale = (1.0 - (sums[1] or 0.0)) / sums[0] if sums[0] else 1.0
        goals[d] = joined.select("value", (F.coalesce(F.col("share") * F.lit(scale), F.col("observed")) * F.lit(float(whole))).alias("goal"))
    return goals


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (dimensions, tokens) with columns ``weight``, raked to
    ``targets``, and ``residual``; targets: by dimension a table (value, share)."""
    goals = goals_of(cells, targets)
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in targets:
        now = now.join(goals[d].select(F.col("value").alias(d), F.col("goal").alias(f"goal_{d}")), d)
    now = stored(now, "cells")
    small = now.count() <= BROADCAST_CELLS

    def summed(rows: DataFrame, d: str) -> DataFrame:
        if small:
            return rows.withColumn("sum", F.sum("weight").over(Window.partitionBy(d)))
        return rows.join(rows.groupBy(d).agg(F.sum("weight").alias("sum")), d)

    def scaled(rows: DataFrame, d: str) -> DataFrame:
        weight = F.when(F.col("sum") > 0, F.col("weight") * F.col(f"goal_{d}") / F.col("sum")).otherwise(F.lit(0.0))
        return summed(rows, d).withColumn("weight", weight).drop("sum")

    def distance(rows: DataFrame) -> float:
        """The largest relative distance of a marginal from its goal."""
        off, rows = F.lit(0.0), rows.coalesce(1) if small else rows
        for d in targets:
            away = F.when(F.col(f"goal_{d}") > 0, F.abs(F.col("sum") / F.col(f"goal_{d}") - 1)).otherwise(F.lit(0.0))
            rows = summed(rows, d).withColumn(f"off_{d}", away).drop("sum")
            off = F.greatest(off, F.col(f"off_{d}"))
        return rows.agg(F.max(off)).first()[0] or 0.0

    residual = 0.0
    for _ in range(0, MOST_ROUNDS, JOB_ROUNDS):
        rows = now.coalesce(1) if small else now
        for n in range(JOB_ROUNDS):
            if n == JOB_ROUNDS - 1:
                rows = rows.withColumn("before", F.col("weight"))
            for d in targets:
                rows = scaled(rows, d)
                if not small:  # a step reads the weights twice, so chained steps would double the plan
                    rows = stored(rows, "cells")
        moved = F.when(F.col("before") > 0, F.abs(F.col("weight") / F.col("before") - 1)).otherwise(F.lit(0.0))
        after = stored(rows.withColumn("moved", moved).drop("before"), "cells")
        drop_stored(now)
        now = after.drop("moved")
        now._stored_at = after._stored_at
        residual = distance(now)
        if min(after.agg(F.max("moved")).first()[0] or 0.0, residual) <= tolerance:
            break
    return now.select(*cells.columns, "weight", F.lit(float(residual)).alias("residual"))


def calibrate(raked: DataFrame, share: float) -> DataFrame:
    """Adds ``probability``: expected sampled tokens are ``share`` of all, as
    far as whole cells allow. Each round takes more cells whole, or ends."""
    whole = raked.agg(F.sum("tokens")).first()[0] or 0
    goal = share * whole
    mass = raked.agg(F.sum("weight")).first()[0] or 0.0
    scale, taken = goal / mass if mass else 0.0, 0
    while True:
        over = F.col("weight") * F.lit(scale) >= F.col("tokens")
        count, full, free = raked.agg(F.count_if(over), F.sum(F.when(over, F.col("tokens")).otherwise(0)), F.sum(F.when(~over, F.col("weight")))).first()
        if not free or count <= taken:
            break
        taken, scale = count, max(goal - (full or 0), 0.0) / free
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") * F.lit(scale) / F.col("tokens"))).otherwise(F.lit(share))
    return raked.withColumn("probability", F.round(chance, 6))


def mix(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    share: float = 0.8,
    powers: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    seed: str = "mix",
) -> DataFrame:
    """Columns: ``id_col``, source, lang, topic, tokens, weight (calibrated
    tokens of the cell over its tokens), probability, kept, residual.

    Without ``targets`` the observed shares raised to ``powers`` are the
    targets, which lifts small values and lowers large ones."""
    rows = prepared(docs, id_col, text_col, source_col, lang_col, topic)
    cells = fitted(rows, targets, share, powers)
    return decided(rows, cells, seed).select(F.col("id").alias(id_col), *DIMENSIONS, "tokens", "weight", "probability", "kept", "residual")


def prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None, extra: list[Column] | None = None) -> DataFrame:
    topic = topic_of(F.col(text_col)) if topic is None else topic
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), name(F.col(source_col)).alias("source"), name(F.col(lang_col)).alias("lang"), name(topic).alias("topic"), tokens_of(F.col(text_col)).alias("tokens"), *(extra or [])
    )


def fitted(rows: DataFrame, targets: dict[str, DataFrame] | None, share: float, powers: dict[str, float] | None) -> DataFrame:
    """(dimensions, weight, probability, residual) of each cell, stored."""
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    powers = {"source": 0.7, "lang": 0.7, "topic": 0.8} | (powers or {})
    targets = targets or {d: tempered_targets(cells, d, powers[d]) for d in DIMENSIONS}
    done = calibrate(rake(cells, targets), share)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(1.0))
    return stored(done.select(*DIMENSIONS, F.round(ratio, 6).alias("weight"), "probability", F.round("residual", 6).alias("residual")), "cells")


def decided(rows: DataFrame, cells: DataFrame, seed: str) -> DataFrame:
    if cells.count() <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    return rows.join(cells, list(DIMENSIONS)).withColumn("kept", uniform(F.col("id"), seed) < F.col("probability"))


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", share: float = 0.8, seed: str = "mix", **how) -> DataFrame:
    """The sampled rows of ``docs``, all their columns."""
    columns = docs.columns
    plain = prepared(docs, id_col, text_col, source_col, lang_col, None)
    cells = fitted(plain, how.get("targets"), share, how.get("powers"))
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    return decided(prepared(docs, id_col, text_col, source_col, lang_col, None, [row]), cells, seed).filter("kept").select("row.*")
