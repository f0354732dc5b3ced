"""Nested columns and records: flattening and key-wise merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def flatten_columns(df: DataFrame, sep: str = ":") -> DataFrame:
    """Every leaf of nested structs as a column, its path joined by ``sep``;
    decided from the schema, so the plan is one projection."""

    def leaves(schema: StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for field in schema:
            here = (*path, field.name)
            if isinstance(field.dataType, StructType):
                out += leaves(field.dataType, here)
            else:
                column = F.col(f"`{here[0]}`")
                for name in here[1:]:
                    column = column.getField(name)
                out.append(column.alias(sep.join(here)))
        return out

    return df.select(*leaves(df.schema, ()))


def merge_maps(df: DataFrame, keys: list[str], entries: str, order: list[str], combine=None) -> DataFrame:
    """(keys, key, values): the maps ``entries`` of a group's rows merged key by
    key into the list of their values in ``order``, or ``combine`` of the list."""
    each = df.select(*keys, *order, F.explode(entries).alias("key", "value"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, "value"))), lambda x: x["value"])
    merged = each.groupBy(*keys, "key").agg(listed.alias("values"))
    return merged if combine is None else merged.withColumn("values", combine(F.col("values")))
