"""A bounded sample that any run repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def bounded_sample(df: DataFrame, hashed: Column, n: int, total: int) -> DataFrame:
    """About `n` and at most 2 `n` of the `total` rows of `df`: those whose hash (64 bits) is in the lowest
    share n / total. Tasks choose on their own, so nothing but the sample travels."""
    if total <= n:
        return df.limit(n)
    cut = int(n / total * 2**64) - 2**63
    return df.where(hashed < cut).limit(2 * n)
