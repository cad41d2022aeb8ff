"""Rates, deltas and cell formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int = 0) -> Column:
    """part/whole in percent, half-even, 0 for an empty base."""
    rate = F.bround(part.cast("double") / F.when(whole != 0, whole) * 100, digits)
    rate = F.coalesce(rate, F.lit(0.0))
    return rate.cast("long") if digits == 0 else rate


def ratio(part: Column, whole: Column, digits: int = 1) -> Column:
    r = F.bround(part.cast("double") / F.when(whole != 0, whole), digits)
    return F.coalesce(r, F.lit(0.0))


def delta(now: Column, before: Column, invert: bool = False) -> Column:
    """Change against the previous period: struct<pct, trend>. pct is null without a base
    and when the change is above 500 percent (too little data to compare); trend is
    'better', 'worse', 'same' or null. `invert` for measures where lower is better."""
    base = F.when(before.isNotNull() & (before != 0), before)
    pct = F.bround((now - before).cast("double") / base * 100).cast("long")
    shown = F.when(F.abs(pct) <= 500, pct)
    up, down = ("worse", "better") if invert else ("better", "worse")
    trend = F.when(shown > 0, up).when(shown < 0, down).when(shown == 0, "same")
    return F.struct(shown.alias("pct"), trend.alias("trend"))


def usage_share(used: Column, limit: Column) -> Column:
    """min(100, percent used); null for an unlimited plan."""
    pct = F.bround(used.cast("double") / F.when(limit != 0, limit) * 100).cast("long")
    return F.least(pct, F.when(pct.isNotNull(), F.lit(100).cast("long")))


def money_text(cents: Column) -> Column:
    """Minor units as an amount with a decimal comma: 12345 -> 123,45."""
    c = F.coalesce(cents.cast("long"), F.lit(0))
    a = F.abs(c)
    return F.concat(
        F.when(c < 0, "-").otherwise(""),
        F.floor(a / 100).cast("long").cast("string"),
        F.lit(","),
        F.lpad((a % 100).cast("string"), 2, "0"),
    )


def decimal_text(v: Column) -> Column:
    """Whole numbers without decimals, others with up to four and a decimal comma."""
    whole = v == v.cast("long")
    text = F.regexp_replace(F.format_string("%.4f", v.cast("double")), r"\.?0+$", "")
    return F.when(whole, v.cast("long").cast("string")).otherwise(F.translate(text, ".", ","))


def safe_cell(text: Column) -> Column:
    """Keep spreadsheets from running a text cell as a formula."""
    return F.when(text.rlike(r"\A[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def cell(col: Column, dtype: str) -> Column:
    """Text of one exported cell for a column of Spark type `dtype`."""
    if dtype == "boolean":
        text = F.when(col, "ja").otherwise("nei")
        text = F.when(col.isNotNull(), text)
    elif dtype in ("double", "float") or dtype.startswith("decimal"):
        text = decimal_text(col)
    elif dtype.startswith("timestamp"):
        text = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    elif dtype == "date":
        text = F.date_format(col, "yyyy-MM-dd")
    elif dtype == "string":
        text = safe_cell(col)
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))
