"""Ordered-map operations on tables of keys and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(df: DataFrame, key: Column, value: Column, order: Column) -> DataFrame:
    """``key, value, n_inserts``: the last write of each key by ``order``, and how
    often it was written (the first write inserts, the others replace)."""
    return df.groupBy(key.alias("key")).agg(F.max_by(value, order).alias("value"), F.count(F.lit(1)).alias("n_inserts"))


def case_folded(key: Column) -> Column:
    return F.lower(key)


def find(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Each of ``keys`` with its row of ``table`` and ``found``."""
    return keys.join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def delete(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return table.join(keys, key, "left_anti")


def in_order(table: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows by key; any expression serves as the comparator."""
    return table.orderBy(*keys)


def length(table: DataFrame, name: str = "n") -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias(name))


def string_dictionary(df: DataFrame, value: str, order: str) -> DataFrame:
    """``value, id``: distinct values numbered by first appearance."""
    from sieveloom.functions.numeric import with_position

    first = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.min(order).alias("first"))
    return with_position(first, [F.col("first"), F.col("value")], "id").select("value", "id")
