"""Sinks that a plain writer lacks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.shared import file_system


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a replacement of ``path`` that was cut off: without a
    table at ``path``, the one set aside comes back."""
    path = path.rstrip("/")
    fs, now = file_system(spark, path)
    _, aside = file_system(spark, f"{path}_aside")
    if fs.exists(aside):
        if fs.exists(now):
            fs.delete(aside, True)
        elif not fs.rename(aside, now):
            raise OSError(f"could not bring back {path} from {path}_aside")


def overwrite_with_backup(df: DataFrame, path: str, form: str = "parquet", **options) -> None:
    """Replace the table at ``path``, which ``df`` may read; the first table
    ever replaced stays at ``path`` + ``_backup``.

    The new table is written beside, and the backup is a copy, so ``path`` is
    missing only between two renames; a run cut off there is mended by the next
    one, or by :func:`recover`."""
    spark, path = df.sparkSession, path.rstrip("/")
    recover(spark, path)
    fresh = f"{path}_new-{uuid.uuid4().hex}"
    df.write.format(form).options(**options).save(fresh)
    fs, now = file_system(spark, path)
    _, backup = file_system(spark, f"{path}_backup")
    _, aside = file_system(spark, f"{path}_aside")
    _, new = file_system(spark, fresh)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if fs.exists(now) and not fs.exists(backup):
        _, half = file_system(spark, f"{path}_backup-{uuid.uuid4().hex}")
        if not jvm.org.apache.hadoop.fs.FileUtil.copy(fs, now, fs, half, False, conf) or not fs.rename(half, backup):
            raise OSError(f"could not back up {path}; the new table is at {fresh}")
    if fs.exists(now) and not fs.rename(now, aside):
        raise OSError(f"could not set {path} aside; the new table is at {fresh}")
    if not fs.rename(new, now):
        recover(spark, path)
        raise OSError(f"could not replace {path}; the new table is at {fresh}")
    fs.delete(aside, True)


def append_errors(errors: DataFrame, path: str, keys: list[str]) -> None:
    """Append one JSON row for each key; a key that is there already stays."""
    spark = errors.sparkSession
    fs, at = file_system(spark, path)
    fresh = errors.dropDuplicates(keys)
    if fs.exists(at):
        old = spark.read.schema(errors.schema).json(path).select(*keys)
        same = [fresh[k].eqNullSafe(old[k]) for k in keys]
        fresh = fresh.join(old, same, "left_anti")
    fresh.write.mode("append").json(path)
