"""Alignments as rows: copies, empty columns, first rows, and merges by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import first_seen

#: Columns of one mask number; bits of a long that hold no sign.
BLOCK = 60


def letters(seq: Column) -> Column:
    return F.filter(F.split(seq, ""), lambda c: c != "")


def without_copies(rows: DataFrame) -> DataFrame:
    """``rows`` (alignment, row, name, seq) without those that repeat an earlier
    row at the columns where the alignment's first row, its query, has a
    letter."""
    query = rows.groupBy("alignment").agg(F.min_by("seq", "row").alias("__query"))
    joined = rows.join(query, "alignment")
    kept = F.filter(F.zip_with(letters(F.col("seq")), letters(F.col("__query")), lambda c, q: F.when(q != "-", c)), lambda c: c.isNotNull())
    return first_seen(joined.withColumn("__key", F.xxhash64(F.array_join(kept, ""))).withColumn("__text", F.array_join(kept, "")), ["alignment", "__key", "__text"], [F.col("row")]).select(*rows.columns)


def without_empty_columns(rows: DataFrame) -> DataFrame:
    """``rows`` without the columns in which all rows have a gap.

    A row's gaps are bits of a few whole numbers, and an alignment's empty
    columns are the bits that all its rows share: one partial aggregate of a
    number a block, however many rows there are. Rows shorter than the
    alignment have gaps at its end, and come out without them."""
    width = rows.groupBy("alignment").agg(F.max(F.length("seq")).alias("__width"))
    padded = rows.join(width, "alignment").withColumn("__full", F.expr("rpad(seq, __width, '-')"))
    blocks = F.sequence(F.lit(0), F.ceil(F.greatest("__width", F.lit(1)) / F.lit(float(BLOCK))).cast("int") - 1)
    piece = F.rpad(F.substring(F.col("__full"), F.col("__block") * BLOCK + 1, F.lit(BLOCK)), BLOCK, "-")
    bits = F.conv(F.translate(F.regexp_replace(piece, "[^-]", "0"), "-", "1"), 2, 10).cast("long")
    masks = padded.select("alignment", "__full", F.explode(blocks).alias("__block")).groupBy("alignment", "__block").agg(F.bit_and(bits).alias("__gaps"))
    listed = masks.groupBy("alignment").agg(F.array_sort(F.collect_list(F.struct("__block", "__gaps"))).alias("__masks"))  # a number for each 60 columns
    gap = lambda i: F.getbit(F.get("__masks", F.floor(i / F.lit(BLOCK)).cast("int"))["__gaps"], F.lit(BLOCK - 1) - i % BLOCK) == 1
    kept = F.filter(F.transform(letters(F.col("seq")), lambda c, i: F.when(~gap(i), c)), lambda c: c.isNotNull())
    return padded.join(listed, "alignment").withColumn("seq", F.array_join(kept, "")).select(*rows.columns)


def first_rows(rows: DataFrame, most: int) -> DataFrame:
    """The rows of an alignment's ``most`` first names, by their first row."""
    first = rows.groupBy("alignment", "name").agg(F.min("row").alias("__first"))
    rank = F.row_number().over(Window.partitionBy("alignment").orderBy("__first", "name"))
    return rows.join(first.withColumn("__rank", rank).filter(F.col("__rank") <= most), ["alignment", "name"], "left_semi")


def merged(rows: DataFrame, how: str, gaps: dict[str, str], features: dict[str, str] | None = None) -> DataFrame:
    """(complex, row, seq, and each of ``features``): the unpaired alignments of
    a complex's chains as one.

    ``rows``: complex, number (of the chain), kind, row (0, 1, ... in each chain),
    seq, and columns of arrays, one value a place, named in ``features`` with the
    value that fills them. ``gaps`` has the letter that fills a kind's place.
    ``dense_max`` pads chains to the most rows, ``dense_min`` cuts them to the
    fewest, ``sparse`` puts each chain's rows below those before. A chain's
    places are one string, its width that of its first row; only rows that meet
    in a merged row are gathered, one a chain."""
    if how not in ("dense_max", "dense_min", "sparse"):
        raise ValueError(f"unknown way to merge: {how}")
    features = features or {}
    chains = rows.groupBy("complex", "number").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind"), F.max_by(F.length("seq"), -F.col("row")).alias("width"))
    order = Window.partitionBy("complex").orderBy("number")  # a row a chain
    sized = chains.withColumn("most", F.max("n").over(Window.partitionBy("complex"))).withColumn("fewest", F.min("n").over(Window.partitionBy("complex")))
    sized = sized.withColumn("below", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy("complex")))
    height = {"dense_max": F.col("most"), "dense_min": F.col("fewest"), "sparse": F.col("all")}[how]
    # every chain has a piece in every merged row, its own or a fill
    grid = sized.filter(height > 0).select("complex", "number", "kind", "width", "below", F.explode(F.sequence(F.lit(0).cast("long"), height - 1)).alias("at"))
    own = grid.withColumn("row", (F.col("at") - F.col("below") if how == "sparse" else F.col("at")).cast(rows.schema["row"].dataType))
    have = rows.select("complex", "number", "row", "seq", *features)
    fill = F.lit("-")
    for kind, letter in gaps.items():
        fill = F.when(F.col("kind") == kind, F.lit(letter)).otherwise(fill)
    met = own.withColumn("__fill", fill).join(have, ["complex", "number", "row"], "left")
    piece = F.coalesce(F.col("seq"), F.expr("repeat(__fill, width)")).alias("seq")
    kinds = {c: rows.schema[c].dataType for c in features}
    values = [F.coalesce(F.col(c), F.array_repeat(F.expr(v), F.col("width").cast("int")).cast(kinds[c])).alias(c) for c, v in features.items()]
    gathered = met.groupBy("complex", F.col("at").alias("row")).agg(F.array_sort(F.collect_list(F.struct("number", piece, *values))).alias("pieces"))
    return gathered.select("complex", "row", F.array_join(F.col("pieces.seq"), "").alias("seq"), *[F.flatten(F.col(f"pieces.{c}")).alias(c) for c in features])
