"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.session import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: numbers; loops, repeats and nulls are
    ignored); root is the smallest node reachable. Empty edges give an empty table.

    Alternates two steps until nothing changes: every node hangs its larger neighbours below
    its smallest one, then its smaller ones. The edge list never grows beyond the input, chains
    halve, and the tables of minima are written first so that a hub's edges can be split."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e, "edges")
    seen = None
    while (now := _state(e)) != seen:
        seen = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stored(large.distinct(), "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("low")), "low")
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        e = stored(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
