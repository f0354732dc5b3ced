"""Copy-on-write keyed upsert by comparison of digests.

A table is a folder of sorted Parquet files of bounded size. Changes find their
home file by one range sort of keys and file starts, without a broadcast of the
starts; only files that are the home of some change are read. Their rows are
replayed with the changes through a shuffled hash join. Before and after, each
home has ordered SHA-256 digests of its rows, in which nulls are tagged, block
by block of ``BLOCK`` rows; only homes with an unequal block are rewritten. The
rows after the replay are numbered once in a total order; a row's rank within
its home gives its cut. Small cuts join their left neighbours: the cut that a
group must end before is found by one sort of positions, and which cuts begin a
group by doubling of those jumps, so that no task walks along all cuts. Each
final file is one partition of one write; then the replaced files go. One path
a file passes through the driver, one at a time, as in Spark's own listing of a
folder; all else stays in Spark.

Defined results: changes without a key are ignored; of a key's changes the
largest by the given order counts, null first, then the largest by the rest.
Rows with a null key sort first, and no change meets them. Rows that share a key
are changed or deleted alike within the key's home; copies in files before it
stay, as that is no home of theirs. A change to a key below all files belongs to
the first; an empty table is one empty home without a first key. A home left
without rows leaves no file. Values are compared as text, so that NaN equals
NaN and nulls are equal. An empty table of changes changes nothing. Other
columns, of any name, are kept; only the columns given are set.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.relational import dense_number
from ..operators.shared import file_system, remove, shared_dir
from .common import stored

#: Rows whose digests make one digest of a block.
BLOCK = 1024


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that nothing removes."""
    return f"{shared_dir(spark)}/siltstone/{name}-{uuid.uuid4().hex}"


def named(column: str) -> Column:
    return F.col(f"`{column}`")


def write_sorted(df: DataFrame, key: str, rows_per_file: int, folder: str) -> None:
    """``df`` by ``key`` (null first) as files of ``rows_per_file`` rows, the
    last of the rest; each file is one partition of the write."""
    rows = df.select(named(key).alias("key"), F.struct(*map(named, df.columns)).alias("row"))
    numbered = dense_number(rows, [F.col("key").asc_nulls_first()], "n")
    fs, at = file_system(df.sparkSession, folder)
    fs.mkdirs(at)  # an empty table is a folder without files
    if files := math.ceil(numbered.count() / rows_per_file):
        write_files(numbered.withColumn("file", F.floor(F.col("n") / rows_per_file)), files, folder)


def write_files(rows: DataFrame, files: int, folder: str) -> None:
    """Append ``row`` of (row, n, file), each file's by ``n``, to ``folder``."""
    dealt = rows.select("row", "n", F.col("file").cast("int").alias("file")).repartitionById(files, "file").sortWithinPartitions("n")
    dealt.select("row.*").write.mode("append").parquet(folder)


def rows_of(spark: SparkSession, schema: StructType, *paths: str) -> DataFrame:
    """(path, at, row) of Parquet files: the row and its place in its file."""
    read = spark.read.schema(schema).parquet(*paths)
    whole = F.struct(*map(named, schema.names)).alias("row")
    return read.select(read.metadataColumn("_metadata").alias("of"), whole).select(F.col("of.file_path").alias("path"), F.col("of.row_index").alias("at"), "row")


def files_of(spark: SparkSession, schema: StructType, folder: str, key: str) -> DataFrame:
    """(path, first, n_rows, file) of each file, numbered by its first key."""
    rows = rows_of(spark, schema, folder).select("path", "at", F.col(f"row.`{key}`").alias("key"))
    files = rows.groupBy("path").agg(F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"), F.count(F.lit(1)).alias("n_rows"))
    order = [F.col("first").asc_nulls_first(), F.col("last").asc_nulls_first(), F.col("path")]
    return stored(dense_number(files, order, "file").drop("last"), "files")


def latest(changes: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """(key, change): the largest change of each key by ``order``, null first,
    and then by ``payload``; a partial aggregate, so that no key gathers."""
    whole = F.struct(*map(named, order), *map(named, [c for c in payload if c not in order]))
    rows = changes.filter(named(key).isNotNull())
    return rows.groupBy(named(key).alias("key")).agg(F.max(whole).alias("change"))


def as_of(asked: DataFrame, marks: DataFrame, on: str, mark: Column) -> DataFrame:
    """``asked`` with ``mark`` of the last row of ``marks`` at or below it in
    ``on``, null where there is none. ``mark`` must grow with ``on``. One range
    sort of both; what reaches into a partition comes by one row a partition."""
    sought = asked.select(F.col(on).alias("on"), F.lit(1).alias("kind"), F.struct(*map(named, asked.columns)).alias("asked"))
    both = marks.select(F.col(on).alias("on"), F.lit(0).alias("kind"), mark.alias("mark")).unionByName(sought, allowMissingColumns=True)
    order = [F.col("on").asc_nulls_first(), F.col("kind")]
    placed = stored(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "as-of")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    tops = placed.groupBy(F.col("part").alias("of")).agg(F.max("mark").alias("top"))
    before = tops.select("of", F.max("top").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    so_far = F.max("mark").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    found = placed.withColumn("here", so_far).filter("kind = 1").join(F.broadcast(before), F.col("part") == F.col("of"))
    return found.select("asked.*", F.coalesce("here", "before").alias("mark"))


def row_digest(row: str, schema: StructType) -> Column:
    """SHA-256 of a row's values as text, each with its length, or a mark of
    its own for null."""

    def tagged(column: str) -> Column:
        value = F.col(f"{row}.`{column}`")
        nested = schema[column].dataType.typeName() in ("array", "map", "struct")
        text = F.to_json(F.struct(value.alias("v"))) if nested else value.cast("string")
        return F.when(value.isNull(), "~").otherwise(F.concat(F.char_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(tagged, schema.names)), 256)


def ordered_digest(rows: DataFrame, schema: StructType, name: str) -> DataFrame:
    """(home, block, ``name``) of (home, rank, row): a digest of the digests of
    each ``BLOCK`` rows in their order."""
    hashed = rows.select("home", F.floor(F.col("rank") / BLOCK).alias("block"), F.struct("rank", row_digest("row", schema).alias("sha")).alias("one"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["sha"]), "")
    return hashed.groupBy("home", "block").agg(F.sha2(joined, 256).alias(name))


def replayed(before: DataFrame, acts: DataFrame, schema: StructType, key: str, values: list[str]) -> DataFrame:
    """(home, key, at, row) of the homes' rows after the changes ``acts``
    (home, key, act, change), through a shuffled hash join; inserted rows have
    null in columns that are not set."""
    rows = before.select("home", F.col(f"row.`{key}`").alias("key"), "at", "row")
    met = rows.alias("b").join(acts.alias("a").hint("shuffle_hash"), (F.col("b.home") == F.col("a.home")) & (F.col("b.key") == F.col("a.key")), "full_outer")
    sets = F.col("a.act") == "set"
    columns = []
    for c in schema.names:
        own = F.col(f"b.row.`{c}`")
        if c == key:
            own = F.coalesce(own, F.col("a.key").cast(schema[c].dataType))
        elif c in values:
            own = F.when(sets, F.col(f"a.change.`{c}`").cast(schema[c].dataType)).otherwise(own)
        columns.append(own.alias(c))
    alive = F.when(F.col("a.act").isNull(), F.lit(True)).otherwise(sets)
    return met.filter(alive).select(F.coalesce("b.home", "a.home").alias("home"), F.coalesce("b.key", "a.key").alias("key"), F.coalesce("b.at", F.lit(-1)).alias("at"), F.struct(*columns).alias("row"))


def cuts_of(homes: DataFrame, most: int) -> DataFrame:
    """(home, piece, size, s, e) of (home, start, n): the fewest cuts of at most
    ``most`` rows, sizes at most one apart, larger first; ``s`` to ``e`` are
    their positions among the numbered rows."""
    k = F.ceil(F.col("n") / F.lit(float(most))).cast("long")
    pieces = homes.filter("n > 0").withColumn("k", k).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    base, extra = F.expr("n div k"), F.expr("n % k")
    at = F.col("start") + F.col("piece") * base + F.least("piece", extra)
    size = base + F.when(F.col("piece") < extra, 1).otherwise(0)
    return pieces.select("home", "chain", "piece", size.alias("size"), at.alias("s"), (at + size).alias("e"))


def group_starts(cuts: DataFrame, most: int) -> DataFrame:
    """(s): the cuts that begin a final file. Along each chain of neighbours a
    group takes cuts while they have at most ``most`` rows together.

    The first cut past a group's rows is the one that contains position
    ``s + most``: cuts and positions meet in stretches of ``most`` positions.
    Jumps are then doubled until no chain is longer."""
    stretch = lambda c: F.expr(f"{c} div {most}")
    has = cuts.select(F.explode(F.sequence(stretch("s"), stretch("(e - 1)"))).alias("stretch"), F.col("s").alias("pos"), F.lit(0).alias("kind"), F.struct("s", "e", "chain").alias("cut"))
    asks = cuts.select(stretch(f"(s + {most})").alias("stretch"), (F.col("s") + most).alias("pos"), F.lit(1).alias("kind"), F.col("s").alias("from"), F.col("chain").alias("own"))
    both = has.unionByName(asks, allowMissingColumns=True)
    last = F.last("cut", ignorenulls=True).over(Window.partitionBy("stretch").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("met", last).filter("kind = 1")
    jumps = stored(met.filter("met.e > pos AND met.chain = own").select(F.col("from").alias("s"), F.col("met.s").alias("t")), "jumps")
    begun = stored(cuts.groupBy("chain").agg(F.min("s").alias("s")).select("s"), "begun")
    while True:
        further = stored(begun.join(jumps, "s").select(F.col("t").alias("s")), "begun")
        if further.isEmpty():
            return begun
        begun = stored(begun.unionByName(further).distinct(), "begun")
        jumps = stored(jumps.alias("a").join(jumps.alias("b"), F.col("a.t") == F.col("b.s")).select("a.s", "b.t"), "jumps")


def upsert(spark: SparkSession, folder: str, schema: StructType, key: str, winners: DataFrame, values: list[str], rows_per_file: int, decide: Callable[[Column, Column], Column]) -> DataFrame:
    """Apply ``winners`` (key, change) to the files of ``folder``, which
    :func:`write_sorted` wrote with ``schema``, and return (path, rewritten) of
    the files that remain.

    ``decide(first, change)`` is ``'set'``, ``'delete'`` or ``'ignore'`` for a
    change whose home's first key is ``first``; ``'set'`` takes ``values`` from
    the change, nulls too."""
    winners = winners.withColumn("key", F.col("key").cast(schema[key].dataType))
    files = files_of(spark, schema, folder, key)
    first = files.filter("file = 0").select(F.struct("file", "first").alias("m")).first()
    lowest = F.struct(F.lit(0).cast("long").alias("file"), F.lit(first.m.first if first else None).cast(schema[key].dataType).alias("first"))
    homed = as_of(winners, files.withColumnRenamed("first", "key"), "key", F.struct("file", F.col("key").alias("first"))).withColumn("mark", F.coalesce("mark", lowest))
    acts = homed.select(F.col("mark.file").alias("home"), "key", decide(F.col("mark.first"), F.col("change")).alias("act"), "change").filter("act <> 'ignore'")
    acts = stored(acts, "acts")
    asked = acts.select(F.col("home").alias("file")).distinct()
    paths = [r.path for r in files.join(asked, "file", "left_semi").select("path").toLocalIterator()]
    if paths:
        before = rows_of(spark, schema, *paths).join(files.select("path", F.col("file").alias("home")), "path").drop("path")
    else:
        before = spark.createDataFrame([], StructType().add("at", "long").add("row", schema).add("home", "long"))
    numbered = dense_number(replayed(before, acts, schema, key, values), [F.col("home"), F.col("key").asc_nulls_first(), F.col("at")], "n")
    homes = stored(numbered.groupBy("home").agg(F.min("n").alias("start"), F.count(F.lit(1)).alias("n")), "homes")
    ranked = numbered.join(homes.withColumnRenamed("n", "of"), "home").withColumn("rank", F.col("n") - F.col("start"))
    was, now = ordered_digest(before.withColumnRenamed("at", "rank"), schema, "was"), ordered_digest(ranked, schema, "now")
    changed = was.join(now, ["home", "block"], "full_outer").filter(~F.col("was").eqNullSafe(F.col("now"))).select("home").distinct()
    # neighbours that are all rewritten have the same number of files kept before them
    changed = stored(dense_number(changed, [F.col("home")], "nth").select("home", (F.col("home") - F.col("nth")).alias("chain")), "changed")
    cuts = stored(cuts_of(homes.join(changed, "home"), rows_per_file), "cuts")
    begun = dense_number(group_starts(cuts, rows_per_file), [F.col("s")], "file")
    final = begun.count()
    if final:
        grouped = as_of(cuts.select("home", "piece", "s"), begun, "s", F.col("file")).select("home", "piece", F.col("mark").alias("file"))
        base, extra = F.expr("of div k"), F.expr("of % k")
        cut = F.when(F.col("rank") < extra * (base + 1), F.expr("rank div (of div k + 1)")).otherwise(extra + F.expr("(rank - (of % k) * (of div k + 1)) div (of div k)"))
        rows = ranked.join(changed, "home", "left_semi").withColumn("k", F.ceil(F.col("of") / F.lit(float(rows_per_file))).cast("long")).withColumn("piece", cut)
        write_files(rows.join(grouped, ["home", "piece"]).select("row", "n", "file"), final, folder)
    for gone in files.join(changed, files["file"] == changed["home"], "left_semi").select("path").toLocalIterator():
        remove(spark, gone.path)
    kept = rows_of(spark, schema, folder).select("path").distinct()
    return kept.join(files.select("path", F.lit(False).alias("old")), "path", "left").select("path", F.col("old").isNull().alias("rewritten"))


def summaries(rows: DataFrame) -> DataFrame:
    """(path, first_id, n_rows, cents, rows_crc, ids_sha256) of (path, at, id,
    cents, crc): each file is read in its order by one task, as a stream."""
    schema = "path string, first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "first_id", "n_rows", "cents", "rows_crc", "ids_sha256"]
        open_path, state = None, None

        def closed() -> pa.RecordBatch:
            values = [open_path, state[0], state[1], state[2], state[3], state[4].hexdigest()]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            paths, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for path, i, cents, crc in zip(paths, ids, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if path != open_path:
                    if state:
                        yield closed()
                    open_path, state = path, [i, 0, 0, 0, hashlib.sha256()]
                state[4].update(f",{i}".encode() if state[1] else f"{i}".encode())
                state[1], state[2], state[3] = state[1] + 1, state[2] + cents, state[3] + crc
        if state:
            yield closed()

    dealt = rows.repartition("path").sortWithinPartitions("path", "at").select("path", "id", "cents", "crc")
    return dealt.mapInArrow(work, schema)
