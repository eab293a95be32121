"""Exact ranks over whole tables without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(seed: int, *names: str) -> Column:
    """The order key of a seeded permutation."""
    return F.md5(F.concat(F.lit(f"{seed}:"), *[F.col(n).cast("string") for n in names]).cast("binary"))


def hash_ranked(df: DataFrame, key: str, tie: list[str], within: list[str] | None = None) -> DataFrame:
    """df with rank (from 1) and total, by a column of hex digests, in each group of `within`.

    Two levels: the first three digits make 4096 buckets, whose counts give offsets (at most 4096 rows a group), and
    rows are numbered inside their bucket. So even a group that holds nearly all rows is ranked by many tasks.
    """
    within = within or []
    bucketed = df.withColumn("_bucket", F.substring(key, 1, 3))
    counts = bucketed.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*within)
    offsets = counts.select(*within, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.sum("_n").over(whole).alias("total"))
    inside = Window.partitionBy(*within, "_bucket").orderBy(key, *tie)
    numbered = bucketed.withColumn("_k", F.row_number().over(inside))
    joined = numbered.join(offsets, [*within, "_bucket"])
    return joined.withColumn("rank", F.col("_offset") + F.col("_k")).drop("_bucket", "_offset", "_k")
