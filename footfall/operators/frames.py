"""Small building blocks used by many operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.session import stored


def top_per(df: DataFrame, part: list[str], order: list[Column], k: int | None, rank: str | None = None) -> DataFrame:
    """First k rows of each group. The rank filter becomes a per-task limit before the
    shuffle, so a group of any size sends at most k rows per task."""
    if k is None and rank is None:
        return df
    col = rank or "_rank"
    out = df.withColumn(col, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    if k is not None:
        out = out.where(F.col(col) <= k)
    return out if rank else out.drop(col)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def calendar(sites: DataFrame, first: str, last: str, step: str) -> DataFrame:
    """One row per site and bucket between two timestamps, both included."""
    return sites.select(
        F.col("id").alias("site_id"),
        F.explode(F.expr(
            f"sequence(TIMESTAMP_NTZ '{first}', TIMESTAMP_NTZ '{last}', INTERVAL {step})"
        )).alias("bucket_ts"),
    )


def zero_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[
        F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) if c in cols else F.col(c)
        for c in df.columns
    ])


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """`df` with, for each name of `sums`, the total of that expression over all rows before
    this one in `order`. Two levels: totals inside range partitions, then over the list of
    partitions (as many rows as there are partitions), so no task sees the whole table. The
    partition numbers are written down once: a second sampling of ranges could differ."""
    dealt = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.unboundedPreceding
    parts = dealt.groupBy("_part").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    w = Window.orderBy("_part").rowsBetween(before, -1)
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(w), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(before, -1)
    out = dealt.join(parts, "_part")
    for n, e in sums.items():
        out = out.withColumn(n, F.col(f"_b_{n}") + F.coalesce(F.sum(e).over(inside), F.lit(0)))
    return out.drop("_part", *[f"_b_{n}" for n in sums])
