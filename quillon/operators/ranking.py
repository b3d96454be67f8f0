"""Ranks and samples in hash order, without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading hex digits of a digest that make a bucket: 4096 even parts of any group.
DIGITS = 3


def bucket_rank(df: DataFrame, bucket: Column, order: list, by: list[str], name: str = "rank") -> DataFrame:
    """0-based rank by `order` within `by`, if `bucket` never falls along that order.

    Rows are ranked within buckets, and ranks are moved by the counts of the buckets before: the result of one row_number
    over the group, though no task holds a group.  Nulls sort first; rows that tie are ranked in any order."""
    bucketed = df.withColumn("_bucket", bucket)
    counts = bucketed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)) - 1
    ranked = bucketed.withColumn("_inside", inside)
    same = F.col("_bucket").eqNullSafe(F.col("_of"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return ranked.join(offsets, same).withColumn(name, F.col("_before") + F.col("_inside")).drop("_bucket", "_before", "_inside", "_of", *(f"_{c}" for c in by))


def hash_rank(df: DataFrame, key: str, tie: str, by: list[str], name: str = "rank") -> DataFrame:
    """0-based rank by a hex digest (then tie) within `by`: the digest's leading digits are the buckets."""
    return bucket_rank(df, F.substring(key, 1, DIGITS), [key, tie], by, name)


def order_rank(df: DataFrame, order: str, by: list[str], name: str = "rank", width: int = 100_000) -> DataFrame:
    """0-based rank by an integer column within `by`: ranges of `width` values are the buckets."""
    return bucket_rank(df, F.floor(F.col(order) / width), [order], by, name)


def exactly(df: DataFrame, count: int, what: str) -> DataFrame:
    """df, a result of few rows, which fails when it is used if it hasn't `count` rows."""
    n = df.agg(F.count("*").alias("_n"))
    error = F.raise_error(F.concat(F.lit(f"{what}: {count} rows wanted, found "), F.col("_n").cast("string"))).cast("boolean")
    # No row ever comes of the check, which fails or finds the number right.
    none = n.where(F.when(F.col("_n") == count, F.lit(False)).otherwise(error))
    return df.unionByName(none.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields)))


def hash_top(df: DataFrame, key: str, tie: str, count: int) -> DataFrame:
    """The first `count` rows in hash order: partial top-k in each task.  With fewer rows, all; `exactly` raises on them."""
    return df.orderBy(key, tie).limit(count)


def top_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; the row_number filter becomes a limit inside the window."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("position", rank).where(F.col("position") <= k)
