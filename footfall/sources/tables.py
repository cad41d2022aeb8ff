"""Stored tables: parquet by day, and the same tables behind JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.timewin import day_of, within
from footfall.schema import HITS


def scan_hits(spark: SparkSession, path: str, window=None, site_id: int | None = None) -> DataFrame:
    """Hits of a half-open window; reads only the day folders and columns the query needs."""
    by_day = T.StructType([*HITS.fields, T.StructField("day", T.DateType())])
    hits = within(spark.read.schema(by_day).parquet(path), window)
    return hits if site_id is None else hits.where(F.col("site_id") == site_id)


def append_events(hits: DataFrame, items: DataFrame, hits_path: str, items_path: str) -> None:
    """Adds hits and their product lines, in day folders, clustered by site inside a file."""
    for df, path in ((hits, hits_path), (items, items_path)):
        by_day = df.withColumn("day", day_of("ts"))
        # A day and site may hold most rows: the extra key keeps it from being one file.
        spread = by_day.repartition("day", "site_id", F.pmod(F.xxhash64("id"), F.lit(64)))
        spread.sortWithinPartitions("day", "site_id", "ts").write.mode("append").partitionBy("day").parquet(path)


def replace_days(df: DataFrame, path: str) -> None:
    """Writes a derived table by day; only the days in `df` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str | None = None, lower: int = 0,
    upper: int = 0, parts: int = 1, predicates: list[str] | None = None, **options: str,
) -> DataFrame:
    """A table of the operational database, read in parallel by key range or by predicates
    (one per day, say). Filters and columns are pushed into the database query."""
    if predicates:
        return spark.read.jdbc(url, table, predicates=predicates, properties=options)
    if key:
        return spark.read.jdbc(
            url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=options)
    return spark.read.jdbc(url, table, properties=options)


def ordered_scan(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in key order across files: a range shuffle and a sort inside each range."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)
