"""Half-open UTC windows. The clock is always a parameter (`as_of`), never read."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.schema import SEARCH_LAG_DAYS

Window = tuple[datetime, datetime]


def _midnight(t: datetime) -> datetime:
    return datetime(t.year, t.month, t.day)


def period_window(days: int, as_of: datetime, offset: int = 0) -> Window:
    """[start, end) of `days` calendar days up to and with today; offset=1 is the equal
    window before it."""
    end = _midnight(as_of) + timedelta(days=1) - timedelta(days=days * offset)
    return end - timedelta(days=days), end


def month_window(label: str, offset: int = 0) -> Window:
    """[start, end) of the calendar month "YYYY-MM", or the `offset`-th month before it."""
    months = int(label[:4]) * 12 + int(label[5:7]) - 1 - offset
    first = datetime(months // 12, months % 12 + 1, 1)
    months += 1
    return first, datetime(months // 12, months % 12 + 1, 1)


def search_days(days: int, as_of: datetime, offset: int = 0) -> tuple[date, date]:
    """Inclusive day range of search statistics, which arrive some days late."""
    last = as_of.date() - timedelta(days=SEARCH_LAG_DAYS + days * offset)
    return last - timedelta(days=days - 1), last


def bot_days(days: int, as_of: datetime) -> tuple[date, date]:
    """Inclusive day range of the last `days` days."""
    return as_of.date() - timedelta(days=days - 1), as_of.date()


def ntz(t: datetime) -> Column:
    """A zone-less literal: a zoned one would put a cast on the column and stop the
    filter from reaching the parquet scan."""
    return F.expr(f"TIMESTAMP_NTZ '{t:%Y-%m-%d %H:%M:%S.%f}'")


def day_lit(d: date | datetime) -> Column:
    return F.expr(f"DATE '{d:%Y-%m-%d}'")


def within(hits: DataFrame, window: Window | None) -> DataFrame:
    """Rows with start <= ts < end; also prunes `day` partitions when the table has them."""
    if window is None:
        return hits
    start, end = window
    out = hits.where((F.col("ts") >= ntz(start)) & (F.col("ts") < ntz(end)))
    if "day" in hits.columns:
        last = end - timedelta(microseconds=1)
        out = out.where((F.col("day") >= day_lit(start)) & (F.col("day") <= day_lit(last)))
    return out


def pageviews(hits: DataFrame, window: Window | None = None) -> DataFrame:
    return within(hits, window).where(F.col("name") == "pageview")


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a UTC zone-less timestamp (session zone is UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def day_of(ts: Column | str) -> Column:
    return F.to_date(F.col(ts) if isinstance(ts, str) else ts)


def day_text(d: Column | str) -> Column:
    return F.date_format(F.col(d) if isinstance(d, str) else d, "yyyy-MM-dd")


def split_window(window: Window, horizon: datetime) -> tuple[Window, Window | None]:
    """(part before the horizon, read from stored days; part after it, read from raw hits)."""
    start, end = window
    return (start, min(end, horizon)), ((horizon, end) if end > horizon else None)
