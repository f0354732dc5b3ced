"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of whole numbers that one task sorts or groups: some 100 MB in memory.
TASK_ROWS = 1 << 20
#: Paths written within each open :func:`scratch`, the innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where that is unset, and
    only on a local master, a temporary folder is made."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A new path; with ``outer`` the innermost :func:`scratch` leaves it."""
    path = f"{shared_dir(spark)}/siltstone/{name}-{uuid.uuid4().hex}"
    for paths in _open[-1 - outer :][:1] if len(_open) > outer else []:
        paths.append(path)
    return path


def file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def stored(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name, outer)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def stored_by(df: DataFrame, name: str, key: str, buckets: int = 0) -> DataFrame:
    """As :func:`stored`, in ``buckets`` of ``key``, by default as many as a
    shuffle has partitions: grouping or joining by ``key`` then needs no shuffle
    of what is stored. Each task writes a file for each bucket that it has rows
    of. The catalogue forgets the table as soon as it is read from."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    table = f"siltstone_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    back = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # external: the files stay
    back._stored_at = path
    return back


def drop_stored(df: DataFrame) -> None:
    """Remove what :func:`stored` wrote, once nothing reads it any more."""
    remove(df.sparkSession, df._stored_at)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of an equi-join that both sides enter by a shuffle.

    Spark takes a table for as large as its files, which for stored columns of
    whole numbers may be a hundredth of its rows, and the output of a task's
    function for as large as its input. By either a large table looks small enough
    to be collected on the driver and sent to all executors."""
    return df.hint("merge")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of some ``rows`` rows, by ``keys`` in as many tasks as its rows
    want. Adaptive execution joins partitions by their compressed bytes, of
    which a row of whole numbers has few, so that a task's memory would grow
    with the input. What one task can hold is left as it is."""
    if rows <= TASK_ROWS:
        return df
    return df.repartition(max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), *keys)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored within goes at the end, also after a failure."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)
