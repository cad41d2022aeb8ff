"""Windows that reach past the raw hits: stored days plus raw rows from the horizon on."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.numbers import percent, ratio
from footfall.functions.referrers import ai_name
from footfall.functions.timewin import day_lit, day_of, day_text, pageviews, period_window, split_window
from footfall.operators.frames import calendar, top_per, union_all, zero_fill
from footfall.operators.metrics import API_PROPS, PAGEVIEW_DIMS
from footfall.operators.rollup import ALL_DIMS, COLUMNS, KPIS, breakdown_cube
from footfall.schema import RAW_DAYS


STATS_DIMS = (*PAGEVIEW_DIMS, "campaign")


def horizon(as_of: datetime, raw_days: int = RAW_DAYS) -> datetime:
    """First instant still read from raw hits."""
    return period_window(raw_days, as_of)[0]


def _days(df: DataFrame, window) -> DataFrame:
    return df.where((F.col("day") >= day_lit(window[0])) & (F.col("day") < day_lit(window[1])))


def stored_kpis(breakdowns: DataFrame, rollups: DataFrame, window) -> DataFrame:
    """(site_id, day, pageviews, visitors, sessions, bounces) of stored days: kpi rows, else
    the sealed totals, with bounces rebuilt from the rounded rate."""
    kpi = _days(breakdowns, window).where("dim = 'kpi'").groupBy("site_id", "day").agg(*[
        F.coalesce(F.sum(F.when(F.col("key") == k, F.col("n"))), F.lit(0)).alias(k) for k in KPIS])
    rebuilt = F.bround(F.coalesce("bounce_rate", F.lit(0.0)) * F.col("sessions") / 100).cast("long")
    older = _days(rollups, window).join(kpi.select("site_id", "day"), ["site_id", "day"], "left_anti").select(
        "site_id", "day", "pageviews", "visitors", "sessions", rebuilt.alias("bounces"))
    return kpi.unionByName(older)


def merged(
    breakdowns: DataFrame, rollups: DataFrame, hits: DataFrame, items: DataFrame, bots: DataFrame,
    sites: DataFrame, window, limit_horizon: datetime, dims=None,
) -> DataFrame:
    """(site_id, dim, key, currency, n, visitors, revenue_cents) over the whole window, of all
    or the given dimensions. Both branches are aggregates already; one more sum joins them.
    Visitors add up because their keys change every day."""
    old, recent = split_window(window, limit_horizon)
    dims = tuple(dims or ALL_DIMS)
    parts = []
    listed = [d for d in dims if d != "kpi"]
    if old[0] < old[1] and listed:
        parts.append(_days(breakdowns, old).where(F.col("dim").isin(*listed)).select("site_id", *COLUMNS))
    if old[0] < old[1] and "kpi" in dims:
        k = stored_kpis(breakdowns, rollups, old)
        parts.append(k.select("site_id", F.inline(F.array(*[
            F.struct(
                F.lit("kpi").alias("dim"), F.lit(c).alias("key"), F.lit("").alias("currency"),
                F.col(c).alias("n"), F.lit(None).cast("long").alias("visitors"),
                F.lit(None).cast("long").alias("revenue_cents"))
            for c in KPIS]))))
    if recent:
        parts.append(breakdown_cube(hits, items, bots, sites, recent, by_day=False, cap=None, dims=dims))
    return union_all(parts).groupBy("site_id", "dim", "key", "currency").agg(
        F.sum("n").alias("n"), F.sum("visitors").alias("visitors"), F.sum("revenue_cents").alias("revenue_cents"))


def _of(m: DataFrame, *dims: str) -> DataFrame:
    return m.where(F.col("dim").isin(*dims))


def long_kpis(m: DataFrame) -> DataFrame:
    k = _of(m, "kpi").groupBy("site_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("key") == c, F.col("n"))), F.lit(0)).alias(c) for c in KPIS])
    return k.select(
        "site_id", "pageviews", "visitors", "sessions",
        percent(F.col("bounces"), F.col("sessions")).alias("bounce_rate"),
        ratio(F.col("pageviews"), F.col("sessions")).alias("views_per_session"))


def long_top(m: DataFrame, dims: list[str], limit: int | None = 10) -> DataFrame:
    """(site_id, dim, key, n, visitors) top lists; campaign keys are JSON arrays."""
    rows = _of(m, *dims).select("site_id", "dim", "key", "n", "visitors")
    return top_per(rows, ["site_id", "dim"], [F.desc("n"), F.asc("key")], limit)


def long_stats(m: DataFrame, limit: int = 10) -> DataFrame:
    return long_top(m, list(STATS_DIMS), limit)


def long_campaigns(m: DataFrame, limit: int = 10) -> DataFrame:
    part = F.from_json("key", "array<string>")
    return long_top(m, ["campaign"], limit).select(
        "site_id", part[0].alias("source"), part[1].alias("medium"), part[2].alias("campaign"), "n", "visitors")


def long_flow(m: DataFrame, limit: int | None = 10) -> DataFrame:
    return long_top(m, ["entry", "exit"], limit).select(
        "site_id", F.col("dim").alias("kind"), F.col("key").alias("path"), "n")


def long_events(m: DataFrame, limit: int | None = 10) -> DataFrame:
    return long_top(m, ["event"], limit).select("site_id", F.col("key").alias("event"), "n", "visitors")


def long_breakdown(m: DataFrame, prop: str, limit: int | None = 100) -> DataFrame:
    return long_top(m, [API_PROPS[prop]], limit).select(
        "site_id", F.col("key").alias("value"), F.col("n").alias("pageviews"), "visitors")


def long_orders(m: DataFrame) -> DataFrame:
    return _of(m, "ecom").select("site_id", "currency", F.col("n").alias("orders"), "revenue_cents")


def _long_money(m: DataFrame, dim: str, key: str, n: str, currency: str | None, limit: int | None) -> DataFrame:
    rows = _of(m, dim)
    if currency is not None:
        rows = rows.where(F.col("currency") == currency)
    rows = rows.select("site_id", "currency", F.col("key").alias(key), F.col("n").alias(n), "revenue_cents")
    return top_per(rows, ["site_id", "currency"], [F.desc("revenue_cents"), F.asc(key)], limit)


def long_products(m: DataFrame, currency: str | None = "NOK", limit: int | None = 10) -> DataFrame:
    return _long_money(m, "product", "product", "qty", currency, limit)


def long_revenue_by_source(m: DataFrame, currency: str | None = "NOK", limit: int | None = 10) -> DataFrame:
    return _long_money(m, "ecom_source", "source", "orders", currency, limit)


def long_revenue_by_payment(m: DataFrame, currency: str | None = "NOK", limit: int | None = 10) -> DataFrame:
    return _long_money(m, "ecom_payment", "method", "orders", currency, limit)


def long_ai_referrals(m: DataFrame) -> DataFrame:
    return _of(m, "ai_total").select("site_id", "visitors", F.col("n").alias("views"))


def long_ai_sources(m: DataFrame, limit: int | None = 8) -> DataFrame:
    rows = _of(m, "ai").select("site_id", F.col("key").alias("assistant"), "visitors", F.col("n").alias("views"))
    order = [F.desc("visitors"), F.desc("views"), F.asc("assistant")]
    return top_per(rows, ["site_id"], order, limit).withColumn("name", ai_name(F.col("assistant")))


def long_bot_summary(m: DataFrame, limit: int = 10) -> DataFrame:
    from footfall.operators.robots import bot_summary

    pair = F.from_json("key", "array<string>")
    agents = _of(m, "bot").select("site_id", pair[0].alias("bot_class"), pair[1].alias("agent"), F.lit("").alias("path"), "n")
    all_but_paths = bot_summary(agents, limit=limit)
    paths = top_per(_of(m, "bot_ai_path"), ["site_id"], [F.desc("n"), F.asc("key")], limit).select(
        "site_id", F.lit("ai_paths").alias("section"), F.lit("ai").alias("bot_class"), "key", "n")
    return all_but_paths.unionByName(paths)


def long_series(
    breakdowns: DataFrame, rollups: DataFrame, hits: DataFrame, sites: DataFrame, days: int,
    as_of: datetime, limit_horizon: datetime,
) -> DataFrame:
    """(site_id, bucket, pageviews, visitors) per day: stored totals before the horizon, raw
    page views after it."""
    window = period_window(days, as_of)
    old, recent = split_window(window, limit_horizon)
    parts = []
    if old[0] < old[1]:
        parts.append(stored_kpis(breakdowns, rollups, old).select("site_id", "day", "pageviews", "visitors"))
    if recent:
        parts.append(pageviews(hits, recent).groupBy("site_id", day_of("ts").alias("day")).agg(
            F.count(F.lit(1)).alias("pageviews"), F.count_distinct("visitor_hash").alias("visitors")))
    cal = calendar(sites, f"{window[0]}", f"{window[1]}", "1 DAY").where(
        F.col("bucket_ts") < F.expr(f"TIMESTAMP_NTZ '{window[1]}'")
    ).select("site_id", F.to_date("bucket_ts").alias("day"))
    s = zero_fill(cal.join(union_all(parts), ["site_id", "day"], "left"), ["pageviews", "visitors"])
    return s.select("site_id", day_text("day").alias("bucket"), "pageviews", "visitors")


def long_goals(m: DataFrame, goals: DataFrame) -> DataFrame:
    """Completions are the summed daily visitors of the goal's event or page."""
    got = _of(m, "event", "page").select("site_id", F.col("dim").alias("_dim"), F.col("key").alias("match_value"), "visitors")
    base = _of(m, "kpi").where("key = 'visitors'").select("site_id", F.col("n").alias("base"))
    g = goals.withColumn("_dim", F.when(F.col("match_type") == "event", "event").otherwise("page"))
    out = g.join(got, ["site_id", "_dim", "match_value"], "left").join(base, "site_id", "left")
    out = zero_fill(out.withColumnRenamed("visitors", "completions"), ["completions", "base"])
    return out.withColumn("rate", percent(F.col("completions"), F.col("base"), 1)).drop("_dim", "base")
