"""Numeric functions: entropy terms, tolerant comparison, ordering."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveloom.sources.scratch import stored

EPSILON = 1e-6
LN2 = math.log(2)
#: Digits that results are rounded to before they are ranked or compared.
DIGITS = 9


def xlogx(x: Column) -> Column:
    """x ln x, 0 for x <= 0."""
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def greater(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return (a - b) > eps


def smaller(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return (b - a) > eps


def greater_or_equal(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return ((b - a) < eps) | (a >= b)


def equal(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return (a == b) | (F.abs(a - b) < eps)


def argsort_array(values: Column) -> Column:
    """Positions (from 0) of an array's items in ascending order; ties by
    position, nulls and NaN last."""
    last = lambda x: x.isNull() | F.isnan(x)
    keyed = F.transform(values, lambda x, i: F.struct(last(x).alias("missing"), F.when(last(x), 0.0).otherwise(x).alias("x"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda s: s["i"])


def argsort(df: DataFrame, value: str, tie: str) -> DataFrame:
    """``df`` with ``position`` (from 0) in ascending order of ``value``, ties by
    ``tie``, missing last. Ranks come from a range-partitioned sort."""
    return with_position(df, [F.col(value).isNull() | F.isnan(value), F.col(value), F.col(tie)], "position")


def with_position(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows from 0 in ``order`` without sorting them in one task:
    rows are dealt by range, numbered there, and moved up by the earlier ranges'
    sizes. The ranges follow from a sample, so the dealt rows are stored: rows and
    sizes must come from the same ranges."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__k{i}" for i in range(len(order))]
    dealt = df.select("*", *[c.alias(k) for k, c in zip(keys, order, strict=True)]).repartitionByRange(n, *keys)
    dealt = stored(dealt.withColumn("__part", F.spark_partition_id()), "position")
    within = Window.partitionBy("__part").orderBy(*keys)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = dealt.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__ahead"))
    out = dealt.withColumn("__nth", F.row_number().over(within) - 1).join(F.broadcast(sizes), "__part")
    return out.withColumn(name, (F.col("__nth") + F.col("__ahead")).cast("long")).drop(*keys, "__part", "__nth", "__ahead")


def shuffle_key(row_id: Column, seed: int) -> Column:
    """A seeded order of rows that any SQL engine reproduces."""
    return F.md5(F.concat(F.lit(f"{seed}-"), row_id.cast("string")))


def shuffled_position(df: DataFrame, row_id: str, seed: int, name: str = "position") -> DataFrame:
    """Number the rows from 0 in seeded order. The order's leading digits are
    uniform, so they deal the rows evenly and in order."""
    keyed = df.withColumn("__key", shuffle_key(F.col(row_id), seed)).withColumn("__lead", F.substring("__key", 1, 3))
    before = Window.orderBy("__lead").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    sizes = keyed.groupBy("__lead").count().select("__lead", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__ahead"))
    nth = F.row_number().over(Window.partitionBy("__lead").orderBy("__key", row_id)) - 1
    return keyed.withColumn("__nth", nth).join(F.broadcast(sizes), "__lead").withColumn(name, (F.col("__nth") + F.col("__ahead")).cast("long")).drop("__key", "__lead", "__nth", "__ahead")
