"""Sharding by sampled splitters.

Native: only DataFrame and SQL functions. One narrow pass gives each record a
key (digest of its text, then its id, then a number of its own), its size and
its checksum. A bounded sample of keys, drawn with chances in proportion to
size, gives quantile boundaries, and records are range-partitioned by a binary
search among them. Ranges are then counted; those that are overfull in bytes or
in rows (many small records) are subdivided by splitters sampled from their own
records, until none is. Keys are unique, so that a group of equal texts, or of
equal rows, of any size can be cut. Running sums within the ranges, and the
totals of the ranges before, place every record exactly, and shards are equal
cuts of the whole; the sample decides how the work is dealt out, never which
shard a record is in. Equal texts are neighbours and share a shard except where
a cut falls into their group.

Laws: under ``bytes`` a record goes to the shard its middle byte falls into, so
shards differ from their equal share by less than two records' sizes; under
``rows`` every record weighs one, so counts differ by one at most.

Defined results: a null text has no bytes and the digest of an empty one; every
record has one byte more than its text, so that empty ones spread; null ids come
first among equal texts; repeated rows are records of their own; a record beyond
a shard's share makes that shard the larger one; an empty table has no shards;
extra columns are ignored unless carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import stored

#: Records of a range, as a rule, and the most ranges before subdividing.
RANGE_ROWS, MOST_RANGES = 2000, 1024
#: Sampled keys for each range.
KEYS = 32
#: A range with so many times its share of rows or bytes is subdivided.
OVERFULL = 2
ROUNDS = 4


def uniform(key: Column, seed: int) -> Column:
    """In [0, 1), by a hash."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def range_of(key: Column, bounds: list[str]) -> Column:
    """How many of the sorted ``bounds`` are at or below ``key``: a binary
    search in steps of falling powers of two."""
    if not bounds:
        return F.lit(0)
    n, among = len(bounds), F.lit(bounds)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    passes = lambda at: (at <= n) & (F.element_at(among, F.least(at, F.lit(n))) <= key)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(passes(at + step), at + step).otherwise(at))


def splitters(ranged: DataFrame, plan: DataFrame, measure: Column, seed: int) -> list[str]:
    """Keys that cut each range of ``plan`` (range, pieces, measured: the sum of
    its records' measures) into pieces of about equal measure.

    About ``KEYS`` keys for each piece are drawn with chances in proportion to
    the measure; a record that is sure to be drawn counts its whole measure, the
    others what each drawn one stands for."""
    step = F.col("measured") / (F.col("pieces") * KEYS)
    met = ranged.join(F.broadcast(plan), "range").withColumn("m", measure)
    drawn = met.filter(uniform(F.col("key"), seed) * step < F.col("m")).select("range", "pieces", "key", F.greatest("m", step).alias("m"))
    own = Window.partitionBy("range")
    before = F.coalesce(F.sum("m").over(own.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    cell = F.floor(before * F.col("pieces") / F.sum("m").over(own))
    cuts = drawn.withColumn("cell", cell).filter("cell > 0").groupBy("range", "cell").agg(F.min("key").alias("key"))
    return [r.key for r in cuts.select("key").collect()]


def counted(ranged: DataFrame) -> DataFrame:
    """(range, n, w): rows and weight of each range, a row a range, stored."""
    return stored(ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")), "ranges")


def ranges_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (key, weight) with their ``range``, and :func:`counted`."""
    ranged = rows.withColumn("range", F.lit(0))
    totals = counted(ranged)
    whole = totals.first()
    if whole is None:
        return ranged, totals
    pieces = min(max(whole.n // RANGE_ROWS, 16), MOST_RANGES)
    each_n, each_w = whole.n / pieces, whole.w / pieces
    plan, measure, bounds = totals.select("range", F.lit(pieces).alias("pieces"), F.col("w").cast("double").alias("measured")), F.col("weight").cast("double"), []
    for seed in range(ROUNDS):
        fresh = splitters(ranged, plan, measure, seed)
        if not fresh:
            break
        bounds = sorted({*bounds, *fresh})
        ranged = rows.withColumn("range", range_of(F.col("key"), bounds))
        totals = counted(ranged)
        full = F.greatest(F.col("n") / each_n, F.col("w") / each_w)
        over = totals.filter((full > OVERFULL) & (F.col("n") > 1))
        plan = over.select("range", F.least(F.ceil(full), F.col("n")).cast("int").alias("pieces"), (F.col("w") / each_w + F.col("n") / each_n).alias("measured"))
        measure = F.col("weight") / F.lit(each_w) + F.lit(1 / each_n)
    return ranged, totals


def assign(docs: DataFrame, shards: int = 8, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns: ``id_col``, size, text_crc32, law, shard, slot, and with
    ``carry`` a struct ``row`` of those columns of ``docs``."""
    if law not in ("bytes", "rows"):
        raise ValueError("sampled splitters keep the laws 'bytes' and 'rows'")
    text, name = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{id_col}`")
    part = F.lpad(F.hex(name), 16, "0") if isinstance(docs.schema[id_col].dataType, IntegralType) else name.cast("string")
    size = (F.octet_length(text) + 1).cast("long")
    key = F.concat_ws(" ", F.md5(text), F.coalesce(part, F.lit("")), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
    kept = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    rows = stored(docs.select(name.alias("id"), size.alias("size"), F.crc32(text).alias("text_crc32"), (size if law == "bytes" else F.lit(1).cast("long")).alias("weight"), key.alias("key"), *kept), "records")
    ranged, totals = ranges_of(rows)
    whole = totals.agg(F.sum("w")).first()[0] or 1
    until = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = F.broadcast(totals.select("range", F.coalesce(F.sum("n").over(until), F.lit(0)).alias("n_before"), F.coalesce(F.sum("w").over(until), F.lit(0)).alias("w_before")))
    inside = Window.partitionBy("range").orderBy("key")
    placed = ranged.join(starts, "range").withColumn("at", F.col("n_before") + F.row_number().over(inside) - 1)
    placed = placed.withColumn("upto", F.col("w_before") + F.sum("weight").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    shard = F.least(F.expr(f"(2 * upto - weight) * {shards} div (2 * {whole})"), F.lit(shards - 1)).cast("int")
    placed = stored(placed.select("id", "size", "text_crc32", shard.alias("shard"), "at", *(["row"] if carry else [])), "placed")
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("at").alias("first")))  # a row a shard
    out = placed.join(firsts, "shard")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"), *(["row"] if carry else []))


def write_shards(docs: DataFrame, folder: str, shards: int = 8, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text") -> None:
    """All columns of ``docs`` as Parquet folders ``shard=0`` and so on, records
    by slot. A shard has as many files as the range exchange cuts it into; the
    folders' column takes underscores while ``docs`` has one of its name."""
    dealt = assign(docs, shards, law, id_col, text_col, docs.columns)
    by = "shard"
    while by in docs.columns:
        by += "_"
    ordered = dealt.select(F.col("shard").alias("__shard"), F.col("slot").alias("__slot"), "row").repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    ordered.select("row.*", F.col("__shard").alias(by)).write.partitionBy(by).parquet(folder)
