"""Spreadsheet-safe CSV: semicolons, a UTF-8 byte order mark, decimal commas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.numbers import cell

BOM = "﻿"


def cells(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every column as the text of its exported cell; `keep` columns stay as they are."""
    return df.select(*[
        F.col(n) if n in keep else cell(F.col(n), t).alias(n) for n, t in df.dtypes])


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None, sep: str = ";") -> None:
    """Writes one folder of CSV files. The mark goes into the header, which every file has:
    the writer itself cannot put it there."""
    parts = partition_by or []
    text = cells(df, tuple(parts))
    first = next(c for c in text.columns if c not in parts)
    text = text.withColumnRenamed(first, BOM + first)
    out = text.write.mode("overwrite").option("sep", sep).option("header", True).option(
        "quote", '"').option("escape", '"').option("emptyValue", "")
    (out.partitionBy(*parts) if parts else out).csv(path)
